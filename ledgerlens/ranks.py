"""Order statistics over the whole table without a window over all rows.

Rows are dealt out by ranges of their order, so that each task holds a stretch of it; sums by stretch are a small table,
and what lies before a stretch is a running sum over them. Only stretches that hold a wanted rank are looked into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import materialise


def in_stretches(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` stored with ``stretch``: its rows in order of ``order`` are those of stretch 0, then of stretch 1, and so on.

    Rows that are equal in all of ``order`` lie in one stretch, so ``order`` should tell apart what may be very frequent.
    """
    return materialise(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("stretch", F.spark_partition_id()), name)


def before_stretches(stored: DataFrame, amount: Column, within: list[str] = []) -> DataFrame:  # noqa: B006
    """``stretch, within..., before, amount``: sums by stretch and what lies before it, among rows equal in ``within``.

    As many rows as there are stretches, and for ``within`` one more each time that it changes.
    """
    sums = stored.groupBy("stretch", *within).agg(F.sum(amount).alias("amount"))
    before = F.sum("amount").over(W.partitionBy(*within).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    return sums.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))


def values_at(counted: DataFrame, by: list[str], value: str, n: str, wanted: DataFrame) -> DataFrame:
    """``by..., rank, value``: the value at each rank (from 0) of ``wanted(by..., rank)``, by weights.

    ``counted`` has each value of a group once, with its number ``n``. Nothing is ever held for a group as a whole.
    """
    stored = in_stretches(counted, [*by, value], "stretches")
    sums = before_stretches(stored, F.col(n), by)
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    inside = (F.col("w.rank") >= F.col("s.before")) & (F.col("w.rank") < F.col("s.before") + F.col("s.amount"))
    # a row for each wanted rank, with the stretch that holds it
    found = materialise(wanted.alias("w").join(sums.alias("s"), [*same("w", "s"), inside]).select("w.*", "s.stretch", "s.before"), "ranks")
    hit = found.select("stretch", *by, "before").distinct()
    on = lambda a, b: [F.col(f"{a}.stretch") == F.col(f"{b}.stretch"), *same(a, b)]
    rows = stored.alias("t").join(hit.alias("h"), on("t", "h")).select("t.*", "h.before")
    upto = F.col("before") + F.sum(n).over(W.partitionBy("stretch", *by).orderBy(F.col(value).asc_nulls_first()))
    placed = rows.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col(n)).drop("before")
    held = (F.col("w.rank") >= F.col("p.from")) & (F.col("w.rank") < F.col("p.upto"))
    return found.alias("w").join(placed.alias("p"), [*on("w", "p"), held]).select(*[F.col(f"w.{c}") for c in by], "w.rank", F.col(f"p.{value}").alias("value"))
