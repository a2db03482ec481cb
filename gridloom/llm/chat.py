"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is text, or an array of typed parts (text, image, audio, document). A visitor flattens the parts in order, with
one visiting rule for each type (VISITORS): text is escaped, any other part becomes a numbered placeholder, and its attachment
(ordinal, kind, reference, expanded token count) is recorded. The template marks turns by control strings that all begin with `<|`;
inside texts and roles every control string (and the common ones of other templates) is broken by a backslash, reversibly.
References never enter the formatted text: placeholders hold the kind and the ordinal, attachments hold the reference as it is.

One output row per message (`segment` is its formatted text), so that a conversation of any length is formatted without being
gathered; a conversation's document is the concatenation of its segments in the order of turn, role and text.

Escaping. A head is a backslash, a `<` that begins `<|`, `<s>` or `</s>`, or a `[` that begins `[INST]` or `[/INST]`. A backslash
is put after each head. Unescaping removes one backslash after any backslash, `<` or `[`, from the left: where an unmarked
`<` or `[` stands before k backslashes, these were written as 2 k, of which one goes with the `<` and the rest in pairs,
leaving k. So the text comes back whole, and no control string occurs in an escaped text.

Defined results: null text is empty; a null role is the empty role; an unknown part type is treated as text where it has text,
else as a document; rows with equal turn are ordered by role, then by text (by bytes, as read back from the output); repeated rows
are repeated turns; a null conv_id is one conversation; a null turn comes first; very long texts and messages of very many parts are
formatted within their row, in time proportional to their length; an empty table gives an empty result; of the input only conv_id,
turn, role and content are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, running

#: Fixed strings of the template.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Expanded tokens of one unit: an image tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}
#: Roles whose text is under the loss mask.
LEARNED = ("assistant",)

_HEADS = r"\\|<(?=\||/?s>)|\[(?=/?INST\])"
_MARKED = r"([\\<\[])\\"
_PLACEHOLDER = r"<\|part:[a-z]+:[0-9]+\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _HEADS, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _MARKED, "$1")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin(*TOKENS_PER_UNIT), part["type"]).when(part["text"].isNotNull(), F.lit("text")).otherwise(F.when(part["type"] == "text", F.lit("text")).otherwise(F.lit("document")))


def _placeholder(part: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("<|part:"), part["kind"], F.lit(":"), ordinal.cast("string"), F.lit("|>"))


#: What the visitor writes for a part of each type, given the number of attachments before it.
VISITORS = {"text": lambda part, ordinal: escape(part["text"]), **dict.fromkeys(TOKENS_PER_UNIT, _placeholder)}


def visit(parts: Column) -> Column:
    """The flattened body of a message: every part through the rule of its type, in order."""
    def each(part: Column, ordinal: Column) -> Column:
        out = F.lit("")
        for kind, rule in VISITORS.items():
            out = F.when(part["kind"] == kind, rule(part, ordinal)).otherwise(out)
        return out

    ordinals = running(F.transform(parts, lambda p: F.when(p["kind"] == "text", 0).otherwise(1)))
    return F.array_join(F.zip_with(parts, ordinals, each), "")


def format_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, segment, loss_from, loss_chars, attachments of each message.

    messages: conv_id, turn, role, content (array of struct<type, text, ref, units>). loss_from and loss_chars give the characters
    of the segment under the loss mask (0 and 0 where the role is not learned). attachments: ordinal within the message, kind,
    ref, n_tokens.
    """
    content = F.coalesce(F.col("content"), F.array().cast("array<struct<type:string,text:string,ref:string,units:bigint>>"))
    typed = F.transform(content, lambda p: F.struct(_kind(p).alias("kind"), F.coalesce(p["text"], F.lit("")).alias("text"), p["ref"].alias("ref"), F.coalesce(p["units"], F.lit(1)).alias("units")))
    per_unit = F.create_map(*[x for k, v in TOKENS_PER_UNIT.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    others = F.filter(F.col("parts"), lambda p: p["kind"] != "text")
    attachments = F.transform(others, lambda p, k: F.struct(k.alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), (p["units"] * per_unit[p["kind"]]).alias("n_tokens")))
    rows = messages.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), typed.alias("parts"))
    rows = rows.withColumn("body", let(F.col("parts"), visit)).withColumn("attachments", attachments)
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    learned = F.col("role").isin(*LEARNED)
    return rows.select(
        "conv_id", "turn", "role", F.concat(head, F.col("body"), F.lit(END)).alias("segment"),
        F.when(learned, F.length(head)).otherwise(F.lit(0)).cast("long").alias("loss_from"),
        F.when(learned, F.length("body")).otherwise(F.lit(0)).cast("long").alias("loss_chars"), "attachments",
    )


def role_of(segment: Column) -> Column:
    """The role, read back from a segment."""
    return unescape(F.substring_index(F.substring(segment, len(TURN) + 1, 1 << 30), SAYS, 1))


def text_of(segment: Column) -> Column:
    """The message's text, read back from a segment; placeholders of other parts are left out."""
    body = F.regexp_replace(F.regexp_extract(segment, r"(?s)^<\|turn\|>.*?<\|says\|>(.*)<\|end\|>$", 1), _PLACEHOLDER, "")
    return unescape(body)


def masked_of(segment: Column, loss_from: Column, loss_chars: Column) -> Column:
    """The text under a segment's loss mask, unescaped."""
    return unescape(F.regexp_replace(F.substring(segment, loss_from + 1, loss_chars), _PLACEHOLDER, ""))


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id and its segments in order, as an array of structs: the document of a conversation."""
    said = formatted.withColumn("said", text_of(F.col("segment")))
    return said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "said", "segment", "loss_from", "loss_chars"))).alias("segments"))


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's row per conversation, read back from the formatted segments."""
    masked = F.when(F.col("loss_chars") > 0, masked_of(F.col("segment"), F.col("loss_from"), F.col("loss_chars")))
    back = formatted.select("conv_id", "turn", role_of(F.col("segment")).alias("role"), text_of(F.col("segment")).alias("text"), masked.alias("masked"), F.length("segment").alias("n"))
    grouped = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "masked"))).alias("t"), F.sum("n").alias("formatted_chars"))
    said = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    grouped = grouped.withColumn("loss", F.array_join(F.transform("t", lambda x: x["masked"]), ""))
    return grouped.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("t", said), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
