"""URL filter: rules first, then naive Bayes over the words of hosts and paths.

Names in hosts are words run together. A unigram model, counted over the pages' own text, splits them: the best
segmentation of each distinct run of letters (of any script) is found by Viterbi. Segmented host words and path tokens are the
features of a multinomial naive Bayes classifier, trained on the URLs that the rules decide and applied to the rest. What
rules test themselves (labels that they name, the last label of a host, the first part of a path) is no feature: the
classifier would learn the rules by heart and know nothing about URLs that they don't fit.

Unigram counts stay a distributed table: the substrings of distinct runs are joined with it, so nothing that grows
with the vocabulary is broadcast. Words longer than ``SHORT`` letters are met by their beginnings, so no length of word or run
is left out. The classifier's table has ``BUCKETS`` entries whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .storage import discard, materialise, ship

#: Fixed values: (verdict, rule); a rule is a host and the beginning of a path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: Words of up to so many letters are looked up as they are, longer ones by so many first letters; results don't depend on it.
SHORT = 24
STRETCH = 256
BUCKETS = 16384
#: Amounts of smoothing that are tried; that with the best balanced accuracy on one host in ``FOLDS`` is taken.
SMOOTHING = (1.0, 0.1, 0.01)
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """``host`` and ``path`` of ``url``; both empty where it is null or has no ``://``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    out = pages.withColumn("_rest", rest)
    host = F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), _UPPER, _LOWER)
    return out.withColumns({"host": host, "path": F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)}).drop("_rest")


def rule_of(rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def unigrams(pages: DataFrame) -> DataFrame:
    """``word, n``: runs of letters in the pages' own text, tags included, in lower case."""
    letters = F.split(F.lower(F.coalesce("html", F.lit(""))), r"[^\p{L}]+", -1)
    return pages.select(F.explode(letters).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def best_split(run: str, known: list[tuple[int, int, int]], total: int) -> list[str]:
    """Most probable words of a run; ``known`` has (start, length, count). Unknown pieces pay tenfold a letter.

    Of equally probable splits the one whose last word is longest wins. An unknown piece's price is the same at any place,
    so the best start of one that ends here is carried along: a step takes as long as there are known words that end here.
    """
    ending: dict[int, list[tuple[int, int]]] = {}
    for start, length, n in known:
        ending.setdefault(start + length, []).append((start, n))
    unknown, letter = math.log(0.1 / total), math.log(10)
    best, back, opened = [0.0], [0], (0.0, 0)
    for end in range(1, len(run) + 1):
        # all starts at hand, dearest part of an unknown piece taken off; the longest piece first
        found = (opened[0] + unknown - end * letter, opened[1])
        for start, n in sorted(ending.get(end, ())):
            p = best[start] + math.log(n / total)
            if p > found[0] + 1e-9 or (p > found[0] - 1e-9 and start < found[1]):
                found = (p, start)
        best.append(found[0])
        back.append(found[1])
        if found[0] + end * letter > opened[0] + 1e-9:
            opened = (found[0] + end * letter, end)
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``run, total, known`` (array of start, length, count) to ``run, words``."""
    for batch in batches:
        rows = batch.to_pylist()
        words = [best_split(r["run"], [(x["s"], x["l"], x["n"]) for x in r["known"] or []], max(1, r["total"])) for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])


def segmented(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``run, words`` for distinct ``runs(run)``, by the unigram ``counts(word, n)``."""
    ship(runs.sparkSession)
    # numbered once, in a stored table, so that pieces needn't carry their run
    numbered = materialise(runs.withColumn("id", F.monotonically_increasing_id()), "runs")
    # a run goes in stretches that overlap by SHORT letters, as finding a place in a string takes as long as it is far on
    stretches = F.transform(F.sequence(F.lit(0), F.expr(f"(length(run) - 1) div {STRETCH}")), lambda w: F.struct((w * STRETCH).alias("at"), F.substring(F.col("run"), w * STRETCH + 1, F.lit(STRETCH + SHORT)).alias("x")))
    laid = numbered.select("id", F.explode(stretches).alias("w")).select("id", "w.*")
    starts = F.sequence(F.lit(0), F.least(F.lit(STRETCH), F.length("x")) - 1)
    pieces = F.flatten(F.transform(starts, lambda s: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(SHORT), F.length("x") - s)), lambda k: F.struct((F.col("at") + s).cast("int").alias("s"), k.alias("l"), F.substring(F.col("x"), s + 1, k).alias("word")),
    )))
    parts = laid.select("id", F.explode(pieces).alias("p")).select("id", "p.*")
    short = parts.join(counts, "word").select("id", "s", "l", "n")
    head = lambda c: F.substring(c, 1, SHORT)
    longer = counts.where(F.length("word") > SHORT).select(head("word").alias("head"), "word", "n")
    heads = parts.where(F.col("l") == SHORT).select("id", "s", F.col("word").alias("head")).join(longer, "head")
    # a long word must stand in the run as a whole; only runs in which one begins are looked at
    whole = heads.join(numbered, "id").where(F.expr("substring(run, s + 1, length(word)) = word")).select("id", "s", F.length("word").alias("l"), "n")
    known = short.unionByName(whole).groupBy("id").agg(F.collect_list(F.struct("s", "l", "n")).alias("known"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first().t
    return numbered.join(known, "id", "left").select("run", F.lit(int(total)).cast("long").alias("total"), "known").mapInArrow(_split, "run string, words array<string>")


def _bucket(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")


def _weights(counts: list, smoothing: float) -> list[int]:
    """Log-odds of block against allow by class of token, in millionths; classes that were never seen say nothing."""
    classes = len(counts)
    block, allow = (sum(r[k] for r in counts) + smoothing * classes for k in ("block", "allow"))
    weights = [0] * BUCKETS
    for r in counts:
        weights[r.f] = round(1e6 * (math.log((r.block + smoothing) / block) - math.log((r.allow + smoothing) / allow)))
    return weights


def _counts(decided: DataFrame) -> list:
    each = decided.select((F.col("decided") == "block").alias("b"), F.explode("features").alias("f"))
    return each.groupBy("f").agg(F.count_if("b").alias("block"), F.count_if(~F.col("b")).alias("allow")).collect()  # BUCKETS rows at most


def _held_out_host() -> Column:
    return F.pmod(F.xxhash64("host"), F.lit(FOLDS)) == 0


def fit(rows: DataFrame) -> list[int]:
    """Weights from all rows with ``decided``, both verdicts equally likely beforehand, with the best of ``SMOOTHING``."""
    decided = rows.where("decided IS NOT NULL")
    return _weights(_counts(decided), chosen_smoothing(decided))


def chosen_smoothing(decided: DataFrame) -> float:
    """The amount under which a classifier trained on other hosts has the best mean of its two verdicts' accuracies; the first of equal ones."""
    counts = _counts(decided.where(~_held_out_host()))
    tested = decided.where(_held_out_host())
    for i, a in enumerate(SMOOTHING):
        tested = with_score(tested, _weights(counts, a)).withColumn(f"right{i}", ((F.col("score") > 0) == (F.col("decided") == "block")).cast("int"))
    mean = lambda i, v: F.coalesce(F.avg(F.when(F.col("decided") == v, F.col(f"right{i}"))), F.lit(0.0))
    got = tested.agg(*[(mean(i, "block") + mean(i, "allow")).alias(f"x{i}") for i in range(len(SMOOTHING))]).first()
    return max(zip(SMOOTHING, got, strict=True), key=lambda x: x[1])[0]


def with_score(rows: DataFrame, weights: list[int]) -> DataFrame:
    """``rows`` with ``score``, the log-odds of block in millionths."""
    table = F.from_json(F.lit("[" + ",".join(map(str, weights)) + "]"), "array<int>")
    return rows.withColumn("score", F.aggregate("features", F.lit(0).cast("long"), lambda acc, f: acc + F.get(table, f)))


def described(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, decided, host_words, features``: all that the classifier goes by."""
    rule, verdict = rule_of(rules)
    parts = with_parts(pages.select("page_id", "url")).drop("url").withColumns({"rule": rule, "decided": verdict})
    named = sorted({label for _, text in rules for label in text.partition("/")[0].split(".")})
    labels = F.split(F.lower("host"), r"\.", -1)
    runs = F.flatten(F.transform(labels, lambda label, i: F.transform(
        F.regexp_extract_all(label, F.lit(r"\p{L}+"), F.lit(0)), lambda run: F.struct(run.alias("run"), ((i < F.size(labels) - 1) & ~label.isin(named)).alias("own")),
    )))
    hosts = parts.select("host").distinct().withColumn("runs", runs)
    each = hosts.select("host", F.posexplode("runs").alias("at", "r")).select("host", "at", "r.*")
    counts = materialise(unigrams(pages), "unigrams")
    split = materialise(segmented(each.select("run").distinct(), counts), "segments")
    discard(counts)
    placed = each.join(split, "run").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "own", "words"))).alias("x"))
    words = placed.select("host", F.flatten(F.transform("x", lambda x: x.words)).alias("host_words"), F.flatten(F.transform(F.filter("x", lambda x: x.own), lambda x: x.words)).alias("own"))
    # stored, so that the join with all pages is one of two plain tables, and Spark may split a host that very many share
    words = materialise(words, "hosts")
    discard(split)
    none = F.expr("cast(array() AS array<string>)")
    rows = parts.join(words, "host", "left").withColumns({"host_words": F.coalesce("host_words", none), "own": F.coalesce("own", none)})
    later = F.regexp_replace(F.lower("path"), "^/[^/]*", "")
    tokens = F.array_remove(F.split(F.regexp_replace(later, "[0-9]+", "0"), r"[^\p{L}0-9]+", -1), "")
    numbers = F.regexp_extract_all("host", F.lit("[0-9]+"), F.lit(0))
    features = F.concat(
        F.transform("own", lambda w: _bucket(F.concat(F.lit("h:"), w))), F.transform(numbers, lambda w: _bucket(F.lit("n:"))), F.transform(tokens, lambda t: _bucket(F.concat(F.lit("p:"), t)))
    )
    return rows.withColumn("features", features).drop("own")


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, host_words, score`` for every row of ``pages(page_id, url, html)``.

    The verdict is the rule's; else block where the classifier's log-odds ``score`` (millionths) is above 0. Null
    URLs have an empty host and path and are allowed, as is whatever has no word that the classifier knows.
    Repeated rows and rows without page_id are judged like all others; other columns aren't looked at; an empty table
    gives an empty result.
    """
    rows = described(pages, rules)
    final = F.coalesce("decided", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return with_score(rows, fit(rows)).select("page_id", "host", "path", "rule", final.alias("verdict"), "host_words", "score")


def held_out(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> dict[str, float]:
    """How the classifier does on rule-decided hosts that it wasn't trained on: one host in ``FOLDS``, by hash.

    Shares of right verdicts among all, among blocked and among allowed URLs, and what always saying the more usual verdict
    would get (``null``). The smoothing is chosen on hosts of the training part.
    """
    rows = described(pages, rules).where("decided IS NOT NULL").withColumn("test", F.pmod(F.xxhash64(F.lit("test"), F.col("host")), F.lit(FOLDS)) == 0)
    right = (F.col("score") > 0) == (F.col("decided") == "block")
    tested = with_score(rows.where("test"), fit(rows.where("NOT test")))
    blocked = F.avg((F.col("decided") == "block").cast("int"))
    return tested.agg(F.avg(right.cast("int")).alias("all"), *[F.avg(F.when(F.col("decided") == v, right.cast("int"))).alias(v) for v in ("block", "allow")], F.greatest(blocked, 1 - blocked).alias("null")).first().asDict()
