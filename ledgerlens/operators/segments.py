"""Windows over a wallet's time, cut into segments so that no task holds a busy wallet's whole life.

Rows go by (wallet, segment of time). What a window needs from other segments comes in two ways. Forward windows of a bounded
length get an overlap: rows that such a window can reach are dealt to the segment before, too, where they count but don't begin
windows. Everything that reaches back (the row before, gaps) comes from a summary of each segment: a window over the summaries
carries the end of one segment to the beginning of the next. A wallet has as many summaries as its life has segments,
however many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DAY = 86400
#: Seconds of a segment.
WIDTH = 30 * DAY
#: Parts that a wallet's rows are dealt to where they meet what is known of the wallet.
PARTS = 16
#: Rows from which a wallet counts as busy. One with fewer may lie in one task as a whole.
BUSY = 100_000


def place(width: int = WIDTH) -> Column:
    return F.floor(F.col("ts") / width).cast("long")


def busy_wallets(rows: DataFrame, least: int = BUSY) -> DataFrame:
    """``wallet, life(first, last)`` of wallets with ``least`` rows or more. There are no more of them than ``least`` goes into all rows."""
    lives = rows.groupBy("wallet").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return lives.where(F.col("n") >= least).select("wallet", F.struct("first", "last").alias("life"))


def with_overlap_if_busy(rows: DataFrame, busy: DataFrame, reach: int, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``segment``, ``own`` and, for the wallets of ``busy``, ``life``; any other wallet is one segment, 0.

    A busy wallet's rows that forward windows of ``reach`` seconds may meet come in the segment before, too.
    """
    if reach > width:
        raise ValueError("a window must not be longer than a segment")
    marked = rows.join(F.broadcast(busy), "wallet", "left")
    cut = F.col("life").isNotNull()
    home = F.when(cut, place(width)).otherwise(F.lit(0).cast("long"))
    near = cut & (F.col("ts") - home * width < reach)
    spread = marked.withColumn("segment", F.explode(F.when(near, F.array(home, home - 1)).otherwise(F.array(home))))
    return spread.withColumn("own", F.col("segment") == home)


def forward(count: Column, seconds: int) -> Column:
    """A count over the rows from a row's own time to so many ``seconds`` later, as a difference of two counts from the beginning.

    Both grow from row to row, whereas a frame that begins at the row is counted again for each, at the square of a dense wallet's rows.
    """
    upto = lambda end: count.over(in_segment("ts").rangeBetween(W.unboundedPreceding, end))
    return upto(seconds) - upto(-1)


def in_segment(*order: str):
    """Window over a wallet's rows in one segment."""
    return W.partitionBy("wallet", "segment").orderBy(*order)


def across():
    """Window over a wallet's summaries."""
    return W.partitionBy("wallet").orderBy("segment")


def gaps(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``wallet, gap``: seconds between consecutive rows of a wallet, within segments and over their borders."""
    placed = rows.select("wallet", "ts", place(width).alias("segment"))
    inside = placed.select("wallet", (F.col("ts") - F.lag("ts").over(in_segment("ts"))).alias("gap")).where("gap IS NOT NULL")
    ends = placed.groupBy("wallet", "segment").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return inside.unionByName(ends.select("wallet", (F.col("first") - F.lag("last").over(across())).alias("gap")).where("gap IS NOT NULL"))


def previous(rows: DataFrame, columns: list[str], *order: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with ``before``: the ``columns`` of the wallet's row before in ``order``, which begins with ``ts``; null for its first.

    The last row of each segment is carried to the first of the wallet's next one. ``rows`` are read twice.
    """
    placed, here = rows.withColumn("segment", place(width)), F.struct(*columns)
    last = placed.groupBy("wallet", "segment").agg(F.max_by(here, F.struct(*order)).alias("_last"))
    carried = last.select("wallet", "segment", F.lag("_last").over(across()).alias("_carried"))
    inside = placed.withColumn("_before", F.lag(here).over(in_segment(*order)))
    return inside.join(carried, ["wallet", "segment"]).withColumn("before", F.coalesce("_before", "_carried")).drop("segment", "_before", "_carried")


def with_wallet(rows: DataFrame, known: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``known``, which has one row a wallet.

    A wallet's rows are dealt to some parts and its row in ``known`` is copied to each, so a busy wallet's rows don't meet in
    one task. An aggregate by wallet that follows is done in parts first, as the rows don't lie by wallet alone.
    """
    each = known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("ts", "ord"), F.lit(PARTS)).cast("int"))
    return dealt.join(each, ["wallet", "_part"], how).drop("_part")
