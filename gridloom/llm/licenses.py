"""License scans by an exact set-similarity join, in DataFrame functions only.

Base. Three fixed phrases mark licenses where their words stand consecutively.

Method. A document's text blocks are its lines. The join finds every pair of a block and a template (the token set of a license
notice) whose containment |block and template| / |template| is THRESHOLD or more:

* token order: all template tokens by their number of blocks over the whole corpus, rarest first;
* prefix filter: a template of n tokens needs an overlap of o = ceil(THRESHOLD n), so a matching block has one of the template's
  n - o + 1 rarest tokens; only those are indexed, and a block without any of them is never split into tokens;
* length filter: a block has at least o distinct tokens;
* positional filter: at a match at position p of the template's order, being the block's first match, at most n - p tokens remain,
  so p <= n - o;
* verification: the exact overlap of the survivors.

Near twins. Several templates differ by a word or two, so a block of one reaches the threshold of another. `matches` keeps all of
them, as the SQL of `op7_licenses` does. `notices`, behind `op7_licenses_told`, takes the same join as its candidates and keeps a
template with twins only where the words that tell it apart (TELLING) stand in the block. Its blocks are the lines and, for notices
wrapped over lines, all runs of as many words as the template has and SLACK more, across line ends: overlapping windows of twice
the longest run are joined, and the runs within the windows that reach a threshold decide.

The corpus counts and the join are exact for any input; templates are a fixed list of bounded size, and only they are broadcast.

Defined results: null text is empty: no words, no labels, score 0; score is the largest containment among matching blocks, 1 where
a base phrase occurs; tokens of equal count are ordered by the token; rows with equal doc_id are scanned each by itself; equal rows
get equal labels; very long texts are scanned whole, in time proportional to their length and their matches; an empty table gives an
empty result; of the input only doc_id and text are read, so further columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import ALNUM_SEP_ANYCASE, cut, let, running

#: Phrase and label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Label and wording of common notices.
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license"),
    ("all-rights-reserved", "copyright all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "licensed under creative commons attribution 4 0 international"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "this document is confidential and proprietary"),
)
THRESHOLD = 0.8
#: Words that may stand between those of a wrapped notice.
SLACK = 4
_VERSION = r"(?:version|license|v) ?(?:[0-9](?: 0)? (?:or|and) (?:version |v ?)?)*"
#: The wording of a template with near twins, and patterns of words which all stand in its notices and not in a twin's.
TELLING = {
    "licensed under the gnu affero general public license": ("affero",),
    "released under the bsd license": (r"bsd (?:[^ ]+ ){0,2}license|under (?:[^ ]+ ){0,2}bsd",),
    "licensed under cc by nc 4 0": ("by nc",),
    "licensed under cc by sa 4 0": ("by sa",),
    "licensed under the gnu general public license version 2": ("gnu general", f"{_VERSION}2"),
    "this work is licensed under the gnu general public license version 3": ("gnu general", f"{_VERSION}3"),
    "licensed under the gnu lesser general public license": ("lesser",),
    "released under the mit license": (r"mit (?:[^ ]+ ){0,2}license|under (?:[^ ]+ ){0,2}mit",),
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """Words joined by single blanks; capitals are kept."""
    return F.trim(F.regexp_replace(text, ALNUM_SEP_ANYCASE, " "))


def _phrase(words: str) -> str:
    return rf"(?i)(?<![^ ]){words}(?![^ ])"


def places(words: Column, phrase: str) -> Column:
    """Word positions of a phrase in a normalised text, ascending."""
    pieces = F.split(words, _phrase(phrase), -1)
    size = len(phrase.split())
    counts = F.transform(pieces, lambda p: F.when(F.trim(p) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(p), " "))))
    before = F.slice(counts, 1, F.size(counts) - 1)
    walk = let(before, lambda ns: F.zip_with(ns, running(F.transform(ns, lambda n: n + size)), lambda n, at: at + n))
    return F.when(words.rlike(_phrase(phrase)), walk).otherwise(F.array().cast("array<int>"))


def base(rows: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base (labels) to rows with `norm`."""
    rows = rows.select("*", *[places(F.col("norm"), p).alias(f"at_{k}") for k, (p, _) in enumerate(BASE)])
    every = F.concat(*[F.col(f"at_{k}") for k in range(len(BASE))])
    labels = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(x)) for k, (_, x) in enumerate(BASE)])))
    blanks = F.length("norm") - F.length(F.translate("norm", " ", ""))
    return rows.select(
        "*", F.when(F.col("norm") == "", F.lit(0)).otherwise(blanks + 1).cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"),
    ).drop(*[f"at_{k}" for k in range(len(BASE))])


def _sql_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def block_tokens(block: Column, vocabulary: tuple[str, ...]) -> Column:
    """The distinct template tokens of a block."""
    return F.array_intersect(F.split(F.translate(normal(block), _UPPER, _LOWER), " "), _sql_array(vocabulary))


def token_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """The number of blocks that have each template token, over the whole corpus; at most as many rows as template tokens."""
    vocabulary = tuple(sorted({t for _, words in templates for t in words.split()}))
    blocks = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("block"))
    found = blocks.select(F.explode(block_tokens(F.col("block"), vocabulary)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r["token"]: r["n"] for r in found.collect()}


def index(spark: SparkSession, counts: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """The prefix index (token, place, id, label, tokens, need), and a pattern that any block with an indexed token matches."""
    order = sorted(counts, key=lambda t: (counts[t], t))
    rank = {t: k for k, t in enumerate(order)}
    rows = []
    for k, (label, words) in enumerate(templates):
        tokens = sorted(set(words.split()), key=rank.__getitem__)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        rows += [(tokens[p], p, k, label, tokens, need) for p in range(len(tokens) - need + 1)]
    prefix = sorted({r[0] for r in rows})
    frame = spark.createDataFrame(rows, "token string, place int, id int, label string, tokens array<string>, need int")
    return frame, rf"(?i)(?<![0-9A-Za-z\x{{80}}-\x{{10FFFF}}])(?:{'|'.join(prefix)})(?![0-9A-Za-z\x{{80}}-\x{{10FFFF}}])"


def matches(docs: DataFrame, counts: dict[str, int], key: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, block (its number), label and containment of every block and template at the threshold."""
    prefix, pattern = index(docs.sparkSession, counts, templates, threshold)
    vocabulary = tuple(sorted(counts))
    blocks = docs.where(F.col("text").rlike(pattern)).select(key, F.posexplode(F.split("text", "\n")).alias("block", "line")).where(F.col("line").rlike(pattern))
    sets = blocks.select(key, "block", block_tokens(F.col("line"), vocabulary).alias("has"))
    probes = sets.select(key, "block", "has", F.explode("has").alias("token"))
    met = probes.join(F.broadcast(prefix), "token")  # a fixed list: a few hundred short rows
    met = met.where((F.size("has") >= F.col("need")) & (F.col("place") <= F.size("tokens") - F.col("need")))
    first = ~F.exists(F.slice("tokens", 1, F.col("place")), lambda t: F.array_contains(F.col("has"), t))  # a pair meets once, at its first common token
    overlap = F.size(F.array_intersect("has", "tokens"))
    return met.where(first).select(key, "block", "label", "need", "tokens", overlap.alias("overlap")).where("overlap >= need").select(key, "block", "label", (F.col("overlap") / F.size("tokens")).alias("containment"))


def telling(words: str) -> str:
    """A pattern that a normalised lower-case block meets if it has all that tells a template from its twins."""
    return "^" + "".join(rf"(?=(?:.* )?(?:{p})(?![^ ]))" for p in TELLING.get(words, ()))


def _runs(words: Column, length: Column) -> Column:
    """All runs of so many consecutive words; the whole where it is shorter."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - length + 1)), lambda i: F.slice(words, i, length))


def notices(docs: DataFrame, counts: dict[str, int], key: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """key, label and containment of lines and of runs of words across lines, without those of templates whose near twin the block is."""
    prefix, pattern = index(docs.sparkSession, counts, templates, threshold)
    per = lambda values: F.element_at(_sql_array(values), F.col("id") + 1)
    lengths = [len(words.split()) + SLACK for _, words in templates]
    prefix = prefix.withColumn("tells", per([telling(words) for _, words in templates])).withColumn("length", per(lengths))
    vocabulary, step = tuple(sorted(counts)), max(lengths)
    lower = lambda text: F.translate(normal(text), _UPPER, _LOWER)
    held = docs.where(F.col("text").rlike(pattern))
    lines = held.select(key, F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(pattern)).select(key, lower(F.col("line")).alias("words"), F.lit(True).alias("whole"))
    wrapped = held.where(F.col("text").contains("\n")).select(key, F.split(lower(F.col("text")), " ").alias("all"))
    # any run of up to `step` words lies in one window of twice as many
    windows = wrapped.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("all"), F.lit(step)), lambda i: F.array_join(F.slice("all", i, 2 * step), " "))).alias("words"))
    blocks = lines.union(windows.select(key, "words", F.lit(False).alias("whole"))).where(F.col("words").rlike(pattern))
    sets = blocks.select(key, "words", "whole", block_tokens(F.col("words"), vocabulary).alias("has"))
    met = sets.select("*", F.explode("has").alias("token")).join(F.broadcast(prefix), "token")
    met = met.where((F.size("has") >= F.col("need")) & (F.col("place") <= F.size("tokens") - F.col("need")))
    met = met.where((F.size(F.array_intersect("has", "tokens")) >= F.col("need")) & F.expr("words RLIKE tells"))
    tried = F.when(F.col("whole"), F.array(F.split("words", " "))).otherwise(_runs(F.split("words", " "), F.col("length")))
    ran = met.select(key, "label", "tokens", "need", "tells", F.explode(tried).alias("run")).withColumn("overlap", F.size(F.array_intersect("run", "tokens")))
    return ran.where("overlap >= need").where(F.expr("array_join(run, ' ') RLIKE tells")).select(key, "label", (F.col("overlap") / F.size("tokens")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, find=matches) -> DataFrame:
    """The contract's row per document; find: `matches` (as the SQL) or `notices`."""
    counts = token_counts(docs, templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = base(rows.withColumn("norm", normal(F.col("text")))).drop("norm")
    pattern = index(docs.sparkSession, counts, templates, threshold)[1]
    # few documents have an indexed token: their texts, once, with a key of the row
    held = cut(found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.when(F.col("text").rlike(pattern), F.col("text")).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    hits = find(held.where("text is not null"), counts, "row", templates, threshold)
    hits = hits.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best")).withColumnRenamed("row", "of")
    joined = held.join(hits, held["row"] == hits["of"], "left")
    labels = F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
