"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word 1-grams and 2-grams are hashed into ``BUCKETS`` classes. Two multinomials over the classes are counted in one
pass over all documents: the raw corpus, and the trusted documents among it. A document's score is the mean, over
its n-grams, of ``log((target + K) / (expected + K))``, where ``expected`` is the count that the raw share would give
the target: classes with little evidence say little. Documents under ``THRESHOLD`` are rejected, as are those that
fail the base rules. The table of class weights has a fixed size whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .storage import free_prefix
from .text import whole, words

BUCKETS = 65536
K = 5.0
#: Weights are integers, in thousandths; so is the threshold. Sums are exact in any order.
SCALE = 1000
THRESHOLD = -150
#: Trusted documents used at most: those with the least MD5 of their id. All other counts cover every document.
TRUSTED_ROWS = 20_000

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def grams(w: Column) -> Column:
    """Classes of the 1-grams and 2-grams of an array of words."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    two = F.zip_with(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
        lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"),
    )
    return F.concat(one, two)


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """``id`` of documents labelled good and not toxic; at most ``most`` of them, chosen by hash."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct()
    return good.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id").limit(most)


def fit(docs: DataFrame, labels: DataFrame) -> list[int]:
    """Weights of the classes. The counts come back as at most ``BUCKETS`` rows."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc"), whole("text").alias("t"))
    marked = slim.join(F.broadcast(trusted_ids(labels)), F.col("doc") == F.col("id"), "left")  # TRUSTED_ROWS at most
    each = marked.select(F.col("id").isNotNull().alias("good"), F.explode(grams(words(F.col("t")))).alias("b"))
    counts = each.groupBy("b").agg(F.count("*").alias("raw"), F.count_if("good").alias("target")).collect()
    raw, target = sum(r.raw for r in counts), sum(r.target for r in counts)
    weights = [0] * BUCKETS
    if target:
        for r in counts:
            weights[r.b] = round(SCALE * math.log((r.target + K) / (r.raw * target / raw + K)))
    return weights


def _base(docs: DataFrame, p: str) -> DataFrame:
    """``docs`` with the base counts and, under names that begin with ``p``, its words."""
    text = whole("text")
    w, lines, windows, sorted_, again = (p + x for x in ("w", "lines", "windows", "sorted", "again"))
    out = docs.withColumns({w: words(text), lines: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size(w)
    window = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(5)])
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.concat_ws("", w)).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        windows: F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(F.expr("cast(array() AS array<bigint>)")),
    })
    # only where a window occurs twice are the places looked for: sorted by hash, equal neighbours
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(sorted_, F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed))
    twice = F.filter(sorted_, lambda x, k: (F.get(sorted_, k - 1).h == x.h) | (F.get(sorted_, k + 1).h == x.h))
    out = out.withColumn(again, F.when(F.col(sorted_).isNotNull(), F.array_sort(F.transform(twice, lambda x: x.i))))
    covered = F.aggregate(
        F.col(again), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
        lambda acc, i: F.struct((acc.n + F.least(F.lit(5), i - acc.last)).cast("long").alias("n"), i.alias("last")), lambda acc: acc.n,
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop(lines, windows, sorted_, again)


def scored(docs: DataFrame, weights: list[int], threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, ``llr_sum, n_grams, base_failed, kept``. The weights travel as one literal."""
    p = free_prefix(docs)
    out = _base(docs, p)
    table = F.from_json(F.lit("[" + ",".join(map(str, weights)) + "]"), "array<int>")
    total = F.aggregate(grams(F.col(f"{p}w")), F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b))
    out = out.withColumns({"llr_sum": total, "n_grams": F.greatest(2 * F.col("n_words") - 1, F.lit(0))}).drop(f"{p}w")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr_sum") >= threshold * F.col("n_grams")))
    # as one generated row: a filter on the verdict then stays above it, instead of being pushed down with all of
    # the expressions it stands on written out inside each other
    return out.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in out.columns]))))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with counts, score and verdict ``kept``.

    Null and empty texts have no words and fail the base rules. Rows without doc_id are scored like all others but
    are never trusted ones; a repeated row counts as often as it occurs. Without any trusted document all weights
    are 0, so the base rules alone decide. All columns of ``docs`` stay, whatever their names; only those named like
    the added ones are replaced. Empty tables give an empty result.
    """
    return scored(docs, fit(docs, labels))
