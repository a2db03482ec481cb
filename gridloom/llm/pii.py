"""Personal data by weak supervision, in DataFrame functions only.

Base. Four fixed patterns (email, ip, card, phone) with their validity rules give base spans, which always stay.

Method. For each kind of ADDED a wide pattern proposes candidates: long tokens and whatever follows a telling word (secrets),
national numbers, bank accounts, dates of birth. Labelers vote on each candidate: pattern labelers on its shape and check
digits, a gazetteer labeler on the words shortly before it, a context labeler on the characters right before it. The votes are
counted by pattern over all documents. Expectation-maximisation on these counts, started from and held by each kind's expected
rates (as STRENGTH observations), estimates each labeler's reliability and each pattern's probability. A logistic span
classifier over votes and coarse features is then fitted to these probabilities. Every cell of votes and features weighs by the
logarithm of its count, so that a rare pattern is not drowned by frequent ones, and the fit is repeated with more weight on the
cells where it decides otherwise than the probabilities do, until there is none. The classifier's weights become a column
expression that decides on every candidate. Only the counts (at most 2 ** 4 * FEATURE_CELLS rows for each proposal) reach the
driver.

Offsets count code points; ends are exclusive. All candidate and base patterns are linear or possessive, so that long runs of
digits neither overflow the matcher's stack nor take quadratic time, and the positions of matches are found by `scan`, whose time
grows in proportion to their number.

Defined results: null text is empty and has no spans; matches that fail a rule are dropped without another try; candidates that
overlap a base span are dropped unless it is a smaller part of them (a run of digits in a longer code), and of overlapping added spans the later in the order of PROPOSALS; without candidates nothing is fitted or
added; very long texts are searched whole; equal rows get equal spans; an empty table gives an empty result; of the input only
text and the kept columns are read, so further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, let, running, scan

#: Kind, a cheap test that any text with a match meets, the pattern.
PATTERNS = (
    ("email", "contains(t, '@')", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"t RLIKE '[0-9]\\.[0-9]'", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"),
    ("card", r"t RLIKE '[0-9](?:[\\x20-]?[0-9]){15}'", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "contains(t, '+')", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
KINDS = tuple(k for k, _, _ in PATTERNS)

#: Gazetteers: words that tell of what follows them.
TELLING = (
    r"(?:token|secret|password|passwd|passphrase|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth[_ -]?key|secret[_ -]?key|bearer|credential|"
    r"passwort|kennwort|zugangscode|mot de passe|contrase\x{F1}a|senha)"
)
NATIONAL = r"(?:ssn|social security(?: number| no)?|national id|tax id|insurance number|sozialversicherungsnummer|seguridad social|s\x{E9}curit\x{E9} sociale)"
ACCOUNT = r"(?:iban|account|konto|kontonummer|compte|cuenta|bank)"
BORN = r"(?:born|born on|birth|birthday|birthdate|dob|geboren|geboren am|geburtsdatum|n\x{E9}e? le|naissance|nacid[oa](?: el)?|nacimiento)"
#: Countries whose account numbers have the international form.
COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA"
).split()
#: Further secrets: tokens of any length and make shortly after a telling word.
TOLD = rf"(?i)(?<![A-Za-z0-9])(?=[A-Za-z0-9])(?<={TELLING}[^A-Za-z0-9]{{1,8}})[A-Za-z0-9](?:[A-Za-z0-9_+/=@#$%^&*!?~.:-]*[A-Za-z0-9_+/=@#$%^&*!?~-])?"
CONTEXT = 24
VOTES = ("v0", "v1", "v2", "v3")
FEATURES = ("f_long", "f_digits")
FEATURE_CELLS = 4
#: The weight of the expected rates, in observations.
STRENGTH = 20.0


def _after(words: str, start: str = "(?<![A-Za-z0-9])") -> Callable[[Column], Column]:
    return lambda c: c["before"].rlike(rf"(?i){start}{words}[^A-Za-z0-9]{{0,8}}$")


def _mark(c: Column) -> Column:
    return c["before"].rlike("[=:\"'`][ \"'`]*$")


def _says(pattern: str) -> Callable[[Column], Column]:
    return lambda c: c["m"].rlike(pattern)


def _mixed(c: Column) -> Column:
    return c["m"].rlike("[0-9][A-Za-z]") & c["m"].rlike("[A-Za-z][0-9]")


def _account_checks(c: Column) -> Column:
    """The remainder by 97 of the account number, its first four characters last and letters as 10 to 35, is 1."""
    plain = F.upper(F.regexp_replace(c["m"], "[^0-9A-Za-z]", ""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    digits = F.filter(F.split(turned, ""), lambda x: x != "")
    return F.aggregate(digits, F.lit(0), lambda n, x: (n * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97) == 1


@dataclass(frozen=True)
class Proposal:
    """Candidates of a kind: a cheap test, the pattern, and up to four labelers, each with the rates at which it is expected to vote
    for true spans and for others; share is the expected part of true spans."""

    label: str
    test: str
    pattern: str
    share: float
    labelers: tuple[tuple[Callable[[Column], Column], float, float], ...]

    @property
    def prior(self) -> tuple[float, list[tuple[float, float]]]:
        return self.share, [(r, q) for _, r, q in self.labelers] + [(0.5, 0.5)] * (len(VOTES) - len(self.labelers))


#: In the order of their claims on overlapping spans.
PROPOSALS = (
    Proposal(
        "iban", "t RLIKE '[A-Z]{2}[0-9]{2}'", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])", 0.3,
        ((_account_checks, 0.98, 0.02), (_says(rf"^(?:{'|'.join(COUNTRIES)})"), 0.98, 0.1), (_after(ACCOUNT), 0.5, 0.02), (_mark, 0.5, 0.2)),
    ),
    Proposal(
        "national_id", "t RLIKE '[0-9]{3}-[0-9]{2}-[0-9]{4}'", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", 0.3,
        ((_says("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), 0.98, 0.7), (_after(NATIONAL), 0.6, 0.01), (_mark, 0.5, 0.2)),
    ),
    Proposal(
        "birth_date", f"t RLIKE '(?i){BORN}'".replace("\\", "\\\\"),
        r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][01]?[0-9][./](?:19|20)[0-9]{2})(?![0-9])", 0.1,
        ((_after(BORN), 0.9, 0.005), (_says("19[0-9]{2}|200[0-9]|201[0-5]"), 0.95, 0.5), (_mark, 0.4, 0.2)),
    ),
    Proposal(
        "secret", "t RLIKE '[A-Za-z0-9_+/=-]{16}' AND t RLIKE '[0-9]'", r"(?:\G|(?<![A-Za-z0-9_+/=-]))(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_+/=-]{15,}+", 0.2,
        ((_says("^[0-9a-f]{32,}$|^[0-9A-F]{32,}$"), 0.5, 0.1), (_mixed, 0.9, 0.3), (_after(TELLING, ""), 0.6, 0.02), (_mark, 0.6, 0.2)),
    ),
    Proposal(
        "secret", f"t RLIKE '(?i){TELLING}'".replace("\\", "\\\\"), TOLD, 0.3,
        ((lambda c: c["before"].rlike("[=:][ \"'`]*$"), 0.9, 0.15), (_says("[A-Za-z].*[^A-Za-z]|[^A-Za-z].*[A-Za-z]"), 0.7, 0.03), (lambda c: c["before"].rlike("[\"'`]$"), 0.4, 0.05), (_says("^.{8}"), 0.6, 0.2)),
    ),
)
ADDED = ("secret", "iban", "national_id", "birth_date")
SECRETS = next(p for p in PROPOSALS if p.label == "secret")


def spans(text: Column, test: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs: from, to, match, and the characters before."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(found, lambda f: F.zip_with(f, F.slice(gaps, 1, F.size(f)), lambda m, g: F.struct(m.alias("m"), F.right(g, F.lit(CONTEXT)).alias("before"), F.length(g).alias("gap"), F.length(m).alias("len"))))
    place = lambda p, at: F.struct((at + p["gap"]).alias("from"), (at + p["gap"] + p["len"]).alias("to"), p["m"].alias("m"), p["before"].alias("before"))
    walk = let(pairs, lambda ps: F.zip_with(ps, running(F.transform(ps, lambda p: p["gap"] + p["len"])), place))
    return F.when(F.expr(test), walk).otherwise(F.expr("cast(array() AS array<struct<from:int,to:int,m:string,before:string>>)"))


def _bare(column: str | Column) -> Column:
    return F.transform(column, lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to")))


def _merged(first: Column, second: Column) -> Column:
    """Both lists of spans in one order, first ones (k = 0) before second ones (k = 1) of the same start."""
    mark = lambda spans, k: F.transform(spans, lambda s: F.struct(s["from"].alias("from"), F.lit(k).alias("k"), s["to"].alias("to")))
    return F.array_sort(F.concat(mark(first, 0), mark(second, 1)))


def _where(items: Column, flags: Column) -> Column:
    return F.transform(F.filter(F.zip_with(items, flags, lambda i, f: F.struct(i.alias("i"), f.alias("f"))), lambda z: z["f"]), lambda z: z["i"])


def clear_of(items: Column, covers: Column) -> Column:
    """The items (in order, apart from each other) that overlap none of the covers: one sweep from each side over both."""
    def swept(every):
        reach = scan(every, F.lit(0), lambda s, x: F.when(x["k"] == 0, F.greatest(s, x["to"])).otherwise(s), lambda s, x: s, "int")
        ahead = F.reverse(scan(F.reverse(every), F.lit(1 << 30), lambda s, x: F.when(x["k"] == 0, F.least(s, x["from"])).otherwise(s), lambda s, x: s, "int"))
        near = F.zip_with(reach, ahead, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        clear = F.zip_with(every, near, lambda x, n: F.struct(x["k"].alias("k"), ((n["a"] <= x["from"]) & (n["b"] >= x["to"])).alias("ok")))
        return F.transform(F.filter(clear, lambda c: c["k"] == 1), lambda c: c["ok"])

    kept = _where(items, let(_merged(covers, items), swept))
    return F.when((F.size(items) > 0) & (F.size(covers) > 0), kept).otherwise(items)


def not_inside(covers: Column, items: Column) -> Column:
    """The covers, in order, that are not shorter parts of an item (items are apart from each other)."""
    def swept(every):
        last = "struct<from:int,to:int>"
        state = scan(every, F.expr(f"cast(named_struct('from', 0, 'to', 0) AS {last})"), lambda s, x: F.when(x["k"] == 0, F.struct(x["from"].alias("from"), x["to"].alias("to"))).otherwise(s), lambda s, x: s, last)
        part = F.zip_with(every, state, lambda x, s: F.when((x["k"] == 1) & ~((x["to"] <= s["to"]) & (x["to"] - x["from"] < s["to"] - s["from"])), F.struct(x["from"].alias("from"), x["to"].alias("to"))))
        return F.filter(part, lambda p: p.isNotNull())

    return F.when((F.size(items) > 0) & (F.size(covers) > 0), let(_merged(items, covers), swept)).otherwise(covers)


def valid(kind: str, m: Column) -> Column:
    """The rule of a kind for one match."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        back = F.reverse(digits)
        value = lambda i: F.substring(back, i, F.lit(1)).cast("int")
        luhn = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda n, i: n + F.when(i % 2 == 1, value(i)).otherwise(2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)))
        return F.when(F.length(digits).between(16, 19), luhn % 10 == 0).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _valid_span(kind: str):
    return lambda s: valid(kind, s["m"])


def base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, t (the text) and an array of base spans for each kind."""
    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("*", *[spans(F.col("t"), test, pattern).alias(f"all_{kind}") for kind, test, pattern in PATTERNS])
    return rows.select(*keep, "t", *[F.filter(f"all_{kind}", _valid_span(kind)).alias(kind) for kind in KINDS])


def _described(k: int, proposal: Proposal):
    digits = lambda c: F.length(F.regexp_replace(c["m"], "[^0-9]", ""))

    def describe(c: Column) -> Column:
        votes = [vote(c).cast("int").alias(v) for v, (vote, _, _) in zip(VOTES, proposal.labelers, strict=False)]
        votes += [F.lit(0).alias(v) for v in VOTES[len(votes) :]]
        features = [((c["to"] - c["from"]) >= 24).cast("int").alias("f_long"), (10 * digits(c) >= 2 * (c["to"] - c["from"])).cast("int").alias("f_digits")]
        return F.struct(F.lit(k).alias("k"), c["from"].alias("from"), c["to"].alias("to"), *votes, *features)

    return describe


def candidates(found: DataFrame) -> DataFrame:
    """Adds `cand`: each proposal's candidates, but for those that overlap a base span which is no smaller part of them, with their votes and features."""
    rows = found.withColumn("covers", F.concat(*[_bare(k) for k in KINDS]))
    for k, proposal in enumerate(PROPOSALS):
        rows = rows.withColumn(f"raw_{k}", spans(F.col("t"), proposal.test, proposal.pattern))
    names = [F.transform(clear_of(F.col(f"raw_{k}"), not_inside(F.col("covers"), F.col(f"raw_{k}"))), _described(k, proposal)) for k, proposal in enumerate(PROPOSALS)]
    return rows.withColumn("cand", F.concat(*names)).drop("covers", *[f"raw_{k}" for k in range(len(PROPOSALS))])


def _odds(votes: tuple[int, ...], share: float, rates: list[tuple[float, float]]) -> float:
    """Log odds of a vote pattern when labelers err independently."""
    return math.log(share / (1 - share)) + sum(math.log(r / q) if x else math.log((1 - r) / (1 - q)) for x, (r, q) in zip(votes, rates, strict=True))


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def reliabilities(counts: dict[tuple[int, ...], int], prior=SECRETS.prior, rounds: int = 500) -> tuple[float, list[tuple[float, float]], dict[tuple[int, ...], float]]:
    """EM over vote patterns: the share of true spans, each labeler's (rate among them, rate among others), and each pattern's probability."""
    total = sum(counts.values())
    share, rates = prior
    posterior = {v: _logistic(_odds(v, share, rates)) for v in counts}
    for _ in range(rounds):
        inside = sum(counts[v] * p for v, p in posterior.items())
        outside = total - inside
        share = (inside + STRENGTH * prior[0]) / (total + STRENGTH)
        rates = []
        for k, (r, q) in enumerate(prior[1]):
            yes = sum(counts[v] * p for v, p in posterior.items() if v[k])
            no = sum(counts[v] * (1 - p) for v, p in posterior.items() if v[k])
            rates.append(((yes + STRENGTH * r) / (inside + STRENGTH), (no + STRENGTH * q) / (outside + STRENGTH)))
        new = {v: _logistic(_odds(v, share, rates)) for v in counts}
        moved = max((abs(new[v] - posterior[v]) for v in counts), default=0.0)
        posterior = new
        if moved < 1e-10:
            break
    return share, rates, posterior


def _fit(cells: list[tuple[tuple[int, ...], float, float]], rounds: int = 400, decay: float = 1e-4) -> list[float]:
    """Weights (bias first) of a logistic model over (features, probability, weight) cells: Newton steps on one weight after another."""
    rows = [((1, *x), min(0.999, max(0.001, p)), a) for x, p, a in cells]
    d = len(VOTES) + len(FEATURES) + 1
    w = [0.0] * d
    z = [0.0] * len(rows)
    for _ in range(rounds):
        most = 0.0
        for k in range(d):
            g, h = decay * w[k], decay
            for (x, p, a), zi in zip(rows, z, strict=True):
                if x[k]:
                    s = _logistic(zi)
                    g += a * (s - p)
                    h += a * max(s * (1 - s), 1e-3)
            step = max(-2.0, min(2.0, -g / h))
            w[k] += step
            most = max(most, abs(step))
            z = [zi + step * x[k] for (x, _, _), zi in zip(rows, z, strict=True)]
        if most < 1e-7:
            break
    return w


def _at(w: list[float], x: tuple[int, ...]) -> float:
    return w[0] + sum(a * b for a, b in zip(w[1:], x, strict=True))


def classifier(cells: list[tuple[tuple[int, ...], float, int]], rounds: int = 40) -> list[float]:
    """Weights (bias first) that decide on every cell (features, probability, count) as its probability does."""
    weight = [1 + math.log(n) for _, _, n in cells]
    w = _fit([(x, p, a) for (x, p, _), a in zip(cells, weight, strict=True)])
    for _ in range(rounds):
        wrong = [i for i, (x, p, _) in enumerate(cells) if (_at(w, x) >= 0) != (p >= 0.5)]
        if not wrong:
            break
        for i in wrong:
            weight[i] *= 4
        w = _fit([(x, 0.98 * (p >= 0.5) + 0.01 if i in wrong else p, a) for i, ((x, p, _), a) in enumerate(zip(cells, weight, strict=True))])
    return w


def learn(found: DataFrame) -> dict[int, list[float]]:
    """Weights of each proposal's span classifier, from the vote counts of all candidates."""
    names = ("k", *VOTES, *FEATURES)
    each = found.select(F.explode("cand").alias("c")).groupBy(*[F.col(f"c.{n}").alias(n) for n in names]).agg(F.count("*").alias("n"))
    rows = sorted((tuple(r[n] for n in names), r["n"]) for r in each.collect())  # at most 2 ** 4 * FEATURE_CELLS for each proposal
    out = {}
    for k, proposal in enumerate(PROPOSALS):
        cells = [(x[1:], n) for x, n in rows if x[0] == k]
        counts: dict[tuple[int, ...], int] = {}
        for x, n in cells:
            counts[x[: len(VOTES)]] = counts.get(x[: len(VOTES)], 0) + n
        if counts:
            share, rates, posterior = reliabilities(counts, proposal.prior)
            w = classifier([(x, posterior[x[: len(VOTES)]], n) for x, n in cells])
            if any((_at(w, x) >= 0) != (posterior[x[: len(VOTES)]] >= 0.5) for x, _ in cells):  # the odds of independent labelers are linear, too
                none = (0,) * len(VOTES)
                bias = _odds(none, share, rates)
                w = [bias, *(_odds(tuple(int(j == i) for j in range(len(VOTES))), share, rates) - bias for i in range(len(VOTES))), *[0.0] * len(FEATURES)]
            out[k] = w
    return out


def decide(weights: dict[int, list[float]]):
    """The classifiers as a function of a candidate struct."""
    def true_span(c: Column) -> Column:
        out = F.lit(False)
        for k, w in weights.items():
            score = sum((F.lit(a) * c[n] for a, n in zip(w[1:], (*VOTES, *FEATURES), strict=True)), F.lit(w[0]))
            out = F.when(c["k"] == k, score >= 0).otherwise(out)
        return out

    return true_span


def _of(k: int):
    return lambda c: c["k"] == k


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, and an array of spans (from, to) for each base kind and each kind of ADDED."""
    found = candidates(base_spans(docs, keep)).drop("t")
    found = cut(found.select(*keep, *[_bare(k).alias(k) for k in KINDS], "cand"))
    found = found.withColumn("cand", F.filter("cand", decide(learn(found))))
    for k in range(len(PROPOSALS)):
        mine = _bare(F.filter("cand", _of(k)))
        found = found.withColumn(f"add_{k}", clear_of(mine, F.concat(*[F.col(f"add_{j}") for j in range(k)])) if k else mine)
    labels = [F.array_sort(F.concat(*[F.col(f"add_{k}") for k, p in enumerate(PROPOSALS) if p.label == label])).alias(label) for label in ADDED]
    return found.select(*keep, *KINDS, *labels)


def _named(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["from"].cast("string"), s["to"].cast("string")))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's row per document; then the number of secrets, of all spans, and whether there is any."""
    found = find(docs, ["doc_id"])
    every = sum((F.size(k) for k in (*KINDS, *ADDED)), F.lit(0))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*[_named(k) for k in KINDS]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[_named(k) for k in (*KINDS, *ADDED)]), ",").alias("spans"), F.size("secret").cast("long").alias("n_secret"),
        every.cast("long").alias("n_spans"), (every > 0).alias("personal"),
    )
