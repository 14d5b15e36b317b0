"""Personal data by weak supervision.

Base rules find emails, addresses, cards and phone numbers. A wider pattern gives candidates that base rules miss
(spelled-out emails, numbers without a plus sign, numbers of unusual length). Five labelers vote on each: two regular
expressions, a gazetteer and two on context. Expectation-maximisation over the counts of vote patterns estimates how
far each labeler can be trusted; base spans are sure examples of what the two context labelers say before personal
data. The posteriors then train a naive Bayes span classifier on the spans' own features, and candidates that it holds
for personal data with probability ``ACCEPT`` are added to the base spans.

Texts are read once. What the models are fitted on is counted by Spark over all candidates and base spans and comes
back as tables of fixed size: at most ``4 * 3 ** 5`` vote patterns, and the fixed feature classes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, functions as F

from .storage import materialise
from .text import apart, no_spans, spans, whole

KINDS = ["email", "ip", "card", "phone"]

# Possessive and anchored forms: the same leftmost matches, without quadratic retries inside a run of one class.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Wider patterns. Each has one kind of span in mind.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
}

#: Words that speak for a kind when they come shortly before a span.
CUES = {"email": "mail|contact|write to|reach", "ip": "ip|address|host|server|from", "card": "card|visa|credit|debit|pay", "phone": "phone|tel|call|fax|mobile|cell"}
#: Words that speak against any kind.
AGAINST = "version|section|page|isbn|issn|invoice|order|licen[cs]e|chapter|figure|table|id"
#: Beginnings or ends that are known for a kind.
GAZETTEER = {
    "email": r"(?i)(?:com|net|org|edu|gov|info|io|de|fr|es|uk)$",
    "ip": r"(?i)^(?:2[0-9a-f]{3}|3[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\(?[2-9][0-9]{2}",
}
SHAPE = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*\x20?[\[(]",
    "ip": r"^(?:[0-9A-Fa-f]{1,4}:){7}",
    "card": r"^(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}$|^[0-9]{13,19}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$",
    "phone": r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$",
}
LABELERS = 5
#: The labelers that look at the words before a span.
CONTEXT = (3, 4)
ACCEPT = 0.9

#: Feature classes: digits 0-19, lengths 20-35, first characters 36-39, separators 40-55, word before 56-119.
FEATURES = 120

_ABSTAIN, _FOR, _AGAINST = 0, 1, 2


def base_spans(text: Column) -> dict[str, Column]:
    """The four kinds' spans; failing matches are dropped, without a retry inside them."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    luhn = lambda x: (F.length(digits(x.m)).between(16, 19)) & F.call_function("luhn_check", digits(x.m))
    return {
        "email": F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(no_spans()),
        "ip": F.filter(spans(text, IP), lambda x: x.m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), F.filter(spans(text, CARD), luhn)).otherwise(no_spans()),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE), lambda x: F.length(digits(x.m)).between(8, 15))).otherwise(no_spans()),
    }


def _votes(kind: str, x: Column) -> list[Column]:
    digits = F.regexp_replace(x.m, "[^0-9]", "")
    before = F.lower(x.c)
    checked = {
        "card": F.when(F.call_function("luhn_check", digits), _FOR).otherwise(_AGAINST),
        "phone": F.when(F.length(digits).between(9, 12), _FOR).when(F.length(digits) < 8, _AGAINST).otherwise(_ABSTAIN),
        "email": F.when(x.m.rlike(r"(?:\.|[\])]\x20?)[A-Za-z]{2,6}$"), _FOR).otherwise(_AGAINST),
        "ip": F.when(F.length(F.regexp_replace(x.m, "[0:]", "")) > 4, _FOR).otherwise(_AGAINST),
    }[kind]
    return [
        F.when(x.m.rlike(SHAPE[kind]), _FOR).otherwise(_ABSTAIN),
        checked,
        F.when(x.m.rlike(GAZETTEER[kind]), _FOR).otherwise(_AGAINST),
        F.when(before.rlike(rf"\b(?:{CUES[kind]})[a-z]*[\s:.]*(?:[a-z]+[\s:.]+)?$"), _FOR).otherwise(_ABSTAIN),
        F.when(before.rlike(rf"\b(?:{AGAINST})s?[\s:#.]*$"), _AGAINST).otherwise(_ABSTAIN),
    ]


def _word_before(x: Column) -> Column:
    return 56 + F.pmod(F.xxhash64(F.regexp_extract(F.lower(x.c), r"([^\s]+)\s*$", 1)), F.lit(64)).cast("int")


def _features(x: Column) -> Column:
    digits = F.least(F.lit(19), F.length(F.regexp_replace(x.m, "[^0-9]", "")))
    size = F.least(F.lit(15), F.floor(F.length(x.m) / 2).cast("int"))
    first = F.left(x.m, F.lit(1))
    kind = F.when(first.rlike("[0-9]"), 0).when(first == "(", 1).when(first.rlike("[A-Za-z]"), 2).otherwise(3)
    marks = sum((F.when(F.contains(x.m, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(" .-(")), F.lit(0))
    return F.array(digits, 20 + size, 36 + kind, 40 + marks, _word_before(x))


def _code(votes: dict[int, Column]) -> Column:
    return sum((v * 3**i for i, v in votes.items()), F.lit(0)).cast("int")


def candidates(text: Column, base: dict[str, Column]) -> Column:
    """Spans of the wide patterns that touch no base span: array of ``(k, s, e, votes, features)``. Cards must pass Luhn."""
    taken = F.concat(*base.values())

    def described(k: int, kind: str):
        return lambda x: F.struct(F.lit(k).alias("k"), x.s.alias("s"), x.e.alias("e"), _code(dict(enumerate(_votes(kind, x)))).alias("votes"), _features(x).alias("f"))

    def wide(kind: str) -> Column:
        found = spans(text, WIDE[kind])
        return found if kind != "card" else F.filter(found, lambda x: F.call_function("luhn_check", F.regexp_replace(x.m, "[^0-9]", "")))

    return F.concat(*[F.transform(apart(wide(kind), taken), described(k, kind)) for k, kind in enumerate(KINDS)])


def sure_examples(base: dict[str, Column]) -> Column:
    """What comes before each base span: array of ``(k, votes, f)``, votes of the context labelers alone."""

    def described(k: int, kind: str):
        return lambda x: F.struct(F.lit(k).alias("k"), _code({i: _votes(kind, x)[i] for i in CONTEXT}).alias("votes"), _word_before(x).alias("f"))

    return F.concat(*[F.transform(base[kind], described(k, kind)) for k, kind in enumerate(KINDS)])


def estimate(patterns: list[Row], sure: list[Row] = [], rounds: int = 50) -> dict[tuple[int, int], float]:  # noqa: B006
    """Posterior of each (kind, vote pattern), by expectation-maximisation over the patterns' counts.

    One latent bit for each candidate; each labeler has its own chance of each vote under either value of the bit,
    begun in its favour, with a prior of a few pseudo-votes so that none becomes certain on little data. ``sure`` counts
    what context labelers vote on base spans, whose bit is known; they weigh as much as the candidates of their kind at
    most, since other notations of personal data come in other contexts too.
    """
    out: dict[tuple[int, int], float] = {}
    for k in range(len(KINDS)):
        rows = [(r.votes, [(r.votes // 3**i) % 3 for i in range(LABELERS)], r.n) for r in patterns if r.k == k]
        if not rows:
            continue
        total = sum(n for *_, n in rows)
        known: dict[int, list[int]] = {i: [0, 0, 0] for i in CONTEXT}
        for r in sure:
            for i in CONTEXT:
                if r.k == k:
                    known[i][r.votes // 3**i % 3] += r.n
        weight = min(1.0, total / max(1, *[sum(x) for x in known.values()]))
        prior = 0.3
        chance = {1: [[0.4, 0.55, 0.05]] * LABELERS, 0: [[0.5, 0.1, 0.4]] * LABELERS}
        start = {z: [list(x) for x in chance[z]] for z in (0, 1)}
        post = {}
        for _ in range(rounds):
            for code, votes, _n in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(chance[1][i][v] / chance[0][i][v]) for i, v in enumerate(votes))
                post[code] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
            prior = (sum(post[c] * n for c, _, n in rows) + 3) / (total + 10)
            for z in (0, 1):
                for i in range(LABELERS):
                    got = [10 * x for x in start[z][i]]
                    if z and i in known:
                        got = [x + weight * n for x, n in zip(got, known[i], strict=True)]
                    for code, votes, n in rows:
                        got[votes[i]] += n * (post[code] if z else 1 - post[code])
                    chance[z][i] = [x / sum(got) for x in got]
        out |= {(k, code): p for code, p in post.items()}
    return out


def train(counts: list[Row], posterior: dict[tuple[int, int], float]) -> list[float]:
    """Naive Bayes log-odds by ``kind * (FEATURES + 1) + feature``; the last of each kind is its prior."""
    weights = [0.0] * (len(KINDS) * (FEATURES + 1))
    mass = {z: [[1.0] * FEATURES for _ in KINDS] for z in (0, 1)}
    seen = {z: [1.0] * len(KINDS) for z in (0, 1)}
    for r in counts:
        p = posterior[r.k, r.votes]
        for z, share in ((1, p), (0, 1 - p)):
            mass[z][r.k][r.f] += share * r.n
            seen[z][r.k] += share * r.n / 5
    groups = [(0, 20), (20, 36), (36, 40), (40, 56), (56, 120)]
    for k in range(len(KINDS)):
        for a, b in groups:
            s1, s0 = sum(mass[1][k][a:b]), sum(mass[0][k][a:b])
            for f in range(a, b):
                weights[k * (FEATURES + 1) + f] = math.log(mass[1][k][f] / s1) - math.log(mass[0][k][f] / s0)
        weights[k * (FEATURES + 1) + FEATURES] = math.log(seen[1][k] / seen[0][k])
    return weights


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found_<kind>``, ``added`` (arrays of spans) for every row of ``docs(doc_id, text)``.

    Null texts count as empty. Rows without doc_id and repeated rows are handled like all others; other columns are
    not looked at. Without candidates nothing is added; an empty table gives an empty result. A very long text, or one with
    very many matches, takes time in proportion to its length and to n log n of its matches.
    """
    text = whole("text")
    found = docs.select("doc_id", text.alias("text")).withColumns({f"found_{k}": v for k, v in base_spans(F.col("text")).items()})
    base = {k: F.col(f"found_{k}") for k in KINDS}
    found = materialise(found.withColumns({"cand": candidates(F.col("text"), base), "sure": sure_examples(base)}).drop("text"), "pii")
    each = found.select(F.explode("cand").alias("x")).select("x.k", "x.votes", "x.f")
    patterns = each.groupBy("k", "votes").agg(F.count("*").alias("n")).collect()
    sure = found.select(F.explode("sure").alias("x")).groupBy("x.k", "x.votes").agg(F.count("*").alias("n")).collect()
    posterior = estimate(patterns, sure)
    counts = each.select("k", "votes", F.explode("f").alias("f")).groupBy("k", "votes", "f").agg(F.count("*").alias("n")).collect()
    weights = train(counts, posterior)
    table = F.from_json(F.lit("[" + ",".join(f"{w:.6f}" for w in weights) + "]"), "array<double>")
    at = lambda x: x.k * (FEATURES + 1)
    odds = lambda x: F.aggregate(x.f, F.get(table, at(x) + FEATURES), lambda acc, f: acc + F.get(table, at(x) + f))
    sure = math.log(ACCEPT / (1 - ACCEPT))
    added = F.transform(F.filter("cand", lambda x: odds(x) >= sure), lambda x: F.struct(x.k.alias("k"), x.s.alias("s"), x.e.alias("e")))
    return found.withColumn("added", added).drop("cand", "sure")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans, as the registered query returns them."""

    def of(k: int):
        return lambda x: F.struct(F.lit(k).alias("k"), x.s.alias("s"), x.e.alias("e"))

    base = F.concat(*[F.transform(f"found_{kind}", of(k)) for k, kind in enumerate(KINDS)])
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda xs: F.concat_ws(",", F.transform(F.array_sort(xs), lambda x: F.concat_ws(":", F.get(names, x.k), x.s.cast("string"), x.e.cast("string"))))
    return found.select(
        "doc_id", *[F.size(f"found_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.concat(base, "added")).alias("spans"),
    )
