"""Mixing sources to target weights by iterative proportional fitting, then sampling by calibrated probabilities.

Token counts are summed by cell (source, language, topic), a table as small as the number of their combinations.
Each sweep rescales the cells' weights to the targets of one marginal after the other (raking). No cell may weigh more
than the tokens it has: what a full cell can't take is given to the others of its classes by the sweeps that follow. A
document is kept when a uniform number derived from its id lies under its cell's probability, so a run can be repeated
exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .storage import free_prefix
from .text import whole, words

SWEEPS = 16
DIMS = ["source", "lang", "topic"]
#: Without explicit targets: the observed shares to these powers, normalised; under 1 flattens large groups.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 1.0}
#: Expected share of all tokens in the sample.
BUDGET = 0.8
SEED = "mix-1"


def form_topic(text: Column, tokens: Column) -> Column:
    """A stand-in where documents carry no topic: their form, by tables, lines and length."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when(tokens == 0, "empty").when(bars * 8 > tokens, "table").when(lines * 15 > tokens, "list")
        .when(tokens < 100, "brief").when(tokens < 1000, "article").otherwise("long")
    )


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + SEED))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def rake(cells: DataFrame, dims: list[str], temper: dict[str, float], sweeps: int = SWEEPS, budget: float = BUDGET, targets: DataFrame | None = None) -> DataFrame:
    """``cells(dims..., tokens)`` with ``w``: weights whose marginals approach the targets, and ``goal_<dim>``.

    ``targets(dimension, class, share)`` gives shares for classes by name, null for the class of nulls; a class that it
    doesn't name, and every class of a dimension that it doesn't name, aims at its observed share to the power in
    ``temper``. Shares of a dimension are normalised over the classes that have tokens. Only cells with tokens have a
    weight, ``tokens / budget`` at most, so ``budget * w / tokens`` is a probability; where the bound leaves the targets
    out of reach, the weights fall short of them.
    """
    rows = cells.where("tokens > 0").withColumns({"total": F.sum("tokens").over(W.partitionBy()).cast("double"), "w": F.col("tokens").cast("double")})
    for d in dims:
        aim = F.pow(F.sum("tokens").over(W.partitionBy(d)) / F.col("total"), F.lit(float(temper[d])))
        if targets is not None:
            given = targets.where(F.col("dimension") == d).select(F.col("class").alias("given_class"), F.col("share").cast("double").alias("given_share"))
            rows = rows.join(given, rows[d].eqNullSafe(given["given_class"]), "left").drop("given_class")
            aim = F.coalesce("given_share", aim)
        rows = rows.withColumn(f"goal_{d}", aim).drop("given_share")
        # one target for each class: its share over the sum of those of all classes
        once = F.col(f"goal_{d}") / F.count("*").over(W.partitionBy(d))
        rows = rows.withColumn("once", once).withColumn(f"goal_{d}", F.col("total") * F.col(f"goal_{d}") / F.sum("once").over(W.partitionBy()))
    full = F.col("tokens") / F.lit(float(budget))
    for _ in range(sweeps):
        for d in dims:
            rows = rows.withColumn("w", F.least(full, F.col("w") * F.col(f"goal_{d}") / F.sum("w").over(W.partitionBy(d))))
    return rows.select(*dims, "tokens", "w", *[f"goal_{d}" for d in dims])


def achieved(raked: DataFrame, dims: list[str] = DIMS) -> DataFrame:
    """``dimension, class, target, share``: what the raked weights of each class come to, beside the target."""
    total = F.sum("w").over(W.partitionBy())
    rows = raked.withColumn("all", total)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("class"), F.col(f"goal_{d}").alias("goal")) for d in dims]))
    folded = rows.select(each.alias("x"), "w", "all").groupBy("x.dimension", "x.class").agg(F.max("x.goal").alias("goal"), F.sum("w").alias("w"), F.max("all").alias("all"))
    goals = F.sum("goal").over(W.partitionBy("dimension"))
    return folded.select("dimension", "class", (F.col("goal") / goals).alias("target"), (F.col("w") / F.col("all")).alias("share"))


def _counted(docs: DataFrame, topic: Column | None, p: str) -> DataFrame:
    """``docs`` with its token count and its cell, under names of their own."""
    text = whole("text")
    out = docs.withColumn(f"{p}n", F.size(words(text)).cast("long"))
    made = form_topic(text, F.col(f"{p}n")) if topic is None else topic.cast("string")
    return out.withColumns({f"{p}source": F.col("source").cast("string"), f"{p}lang": F.col("lang").cast("string"), f"{p}topic": made})


def cells_of(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``source, lang, topic, tokens`` of a table of documents."""
    p = free_prefix(docs)
    return _counted(docs, topic, p).groupBy(*[F.col(p + d).alias(d) for d in DIMS]).agg(F.sum(f"{p}n").alias("tokens"))


def mixed(docs: DataFrame, topic: Column | None = None, temper: dict[str, float] | None = None, budget: float = BUDGET, targets: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``topic, n_tokens, probability, sampled``.

    ``topic`` may be any column expression; without it documents count by form. Null sources, languages and topics are
    classes of their own, apart from empty ones. Targets are those of :func:`rake`. A document without tokens weighs
    nothing in the targets and is kept with probability 1. Rows that share a doc_id share their fate where they fall in
    the same cell; so do all rows without one. All columns of ``docs`` stay, whatever their names; only those named like
    the four added ones are replaced. An empty input gives an empty result.
    """
    p = free_prefix(docs)
    counted = _counted(docs, topic, p)
    rates = rake(cells_of(docs, topic), DIMS, temper or TEMPER, budget=budget, targets=targets)
    rates = rates.select(*[F.col(d).alias(f"{p}r_{d}") for d in DIMS], (F.lit(float(budget)) * F.col("w") / F.col("tokens")).alias(f"{p}p"))
    same = [F.col(p + d).eqNullSafe(F.col(f"{p}r_{d}")) for d in DIMS]
    out = counted.join(rates, same[0] & same[1] & same[2], "left")
    probability = F.when(F.col(f"{p}n") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col(f"{p}p")))
    kept = [c for c in docs.columns if c.lower() not in ("topic", "n_tokens", "probability", "sampled")]
    return out.select(*[counted[f"`{c}`"] for c in kept], F.col(f"{p}topic").alias("topic"), F.col(f"{p}n").alias("n_tokens"), probability.alias("probability"), (uniform(counted["doc_id"]) < probability).alias("sampled"))
