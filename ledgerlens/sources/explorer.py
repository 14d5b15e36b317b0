"""Scans of landed explorer responses: block ranges and wallets choose the files, pages are read on, failures are rows.

A fetcher lands each response as a line with its wallet, page number, page size and body, below folders named by action and
by the first block of a range of ``BLOCKS``. A scan's block range is a filter on those folders, so other ranges aren't
opened; nothing is listed or parsed on the driver. What can't be read goes into a second table, by fetch, and takes no
rows of other fetches with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .ingest import RAW_TOKEN, RAW_TX, start_block

#: Blocks of a folder.
BLOCKS = 100_000
LAST_BLOCK = 99_999_999
#: Fixed value: rows that one scan gives a wallet at most.
MOST = 1000
#: Messages of responses that hold nothing.
NOTHING = ["No transactions found", "No records found"]

_LANDED = "wallet string, page int, size int, body string, action string, lo long"
_ELEMENT = {"txlist": RAW_TX, "txlistinternal": RAW_TX, "tokentx": RAW_TOKEN}


def land(pages: DataFrame, path: str) -> None:
    """Append responses ``(wallet, action, lo, page, size, body)``; ``lo`` is the first block of their range, a multiple of ``BLOCKS``."""
    pages.select("wallet", "page", "size", "body", "action", "lo").write.mode("append").partitionBy("action", "lo").json(path)


def responses(spark: SparkSession, path: str, action: str, low: int = 0, high: int = LAST_BLOCK, wallets: DataFrame | None = None) -> DataFrame:
    """Landed responses of the folders that may hold blocks from ``low`` to ``high``, parsed: ``wallet, lo, page, size, status, message, result, rows``.

    ``rows`` is null where the body isn't JSON or its result is no list; a response landed again counts once.
    """
    landed = spark.read.schema(_LANDED).option("basePath", path).json(path).where((F.col("action") == action) & (F.col("lo") <= high) & (F.col("lo") > low - BLOCKS))
    if wallets is not None:
        landed = landed.join(wallets.select("wallet").distinct(), "wallet", "left_semi")
    outer = "status string, message string, result string"
    parsed = landed.dropDuplicates(["wallet", "lo", "page", "body"]).withColumn("r", F.from_json("body", outer))
    rows = F.from_json("r.result", T.ArrayType(_ELEMENT[action]))
    return parsed.select("wallet", "lo", "page", "size", "r.status", "r.message", "r.result", F.when(F.ltrim("r.result").startswith("["), rows).alias("rows"))


def scan(
    spark: SparkSession, path: str, action: str = "txlist", low: int = 0, high: int = LAST_BLOCK, page: int = 1, offset: int = MOST, sort: str = "asc", wallets: DataFrame | None = None
) -> DataFrame:
    """``wallet, place, block, ord, raw``: rows of each wallet in a range of blocks, page ``page`` of ``offset`` rows, by block.

    All landed pages of a range are read on to the last. Rows of equal blocks come in the order in which they were listed,
    which ``sort='desc'`` turns around with the blocks. ``place`` counts from 1 within the wallet's rows of the range.
    """
    listed = responses(spark, path, action, low, high, wallets).select("wallet", "lo", "page", F.posexplode("rows").alias("i", "raw"))
    rows = listed.withColumn("block", F.col("raw.blockNumber").try_cast("long")).where(F.col("block").between(low, high))
    keys = [F.col(c).desc() if sort == "desc" else F.col(c).asc() for c in ("block", "lo", "page", "i")]
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("wallet").orderBy(*keys)))
    wanted = placed.where((F.col("place") <= page * offset) & (F.col("place") > (page - 1) * offset))
    return wanted.select("wallet", "place", "block", F.col("place").alias("ord"), "raw")


def errors(spark: SparkSession, path: str, action: str = "txlist", low: int = 0, high: int = LAST_BLOCK, wallets: DataFrame | None = None) -> DataFrame:
    """``wallet, action, lo, page, problem``: what a scan of the same range can't have seen, a row a fetch.

    ``refused`` and what the explorer said; ``unreadable`` bodies; and ``unfinished`` ranges, whose last landed page is full
    without one that follows. A message that there is nothing is no error.
    """
    seen = responses(spark, path, action, low, high, wallets).withColumn("n", F.size("rows"))
    empty = F.col("message").isin(NOTHING)
    problem = F.when(F.col("rows").isNotNull() | empty, None).when(F.col("status").isNull() & F.col("message").isNull(), "unreadable").otherwise(F.concat(F.lit("refused: "), F.coalesce("result", "message", F.lit(""))))
    said = seen.select("wallet", "lo", "page", problem.alias("problem")).where("problem IS NOT NULL")
    last = seen.groupBy("wallet", "lo").agg(F.max(F.struct("page", "n", "size")).alias("l")).where("l.n >= l.size")
    open_ = last.select("wallet", "lo", (F.col("l.page") + 1).alias("page"), F.lit("unfinished").alias("problem"))
    return said.unionByName(open_).select("wallet", F.lit(action).alias("action"), "lo", "page", "problem")


def profile(spark: SparkSession, path: str, wallets: DataFrame, days: int, now: int, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transactions, token transfers and errors of wallets over a look-back window; what failed leaves the rest as it is."""
    low, most = start_block(days, now), min(most, MOST)
    found = [scan(spark, path, a, low, offset=most, wallets=wallets) for a in ("txlist", "tokentx")]
    return found[0], found[1], errors(spark, path, "txlist", low, wallets=wallets).unionByName(errors(spark, path, "tokentx", low, wallets=wallets))
