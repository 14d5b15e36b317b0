"""Sharding along a Hilbert curve: rows near in several metadata dimensions land in the same shard.

Every row gets a cell, its quantised metadata; cells are put in the order in which a Hilbert curve passes them, and
the ordered rows are cut into runs of equal counts. Strings are quantised as wholes in their own order, at quantiles of the
table, so a shard's least and greatest raw values are close and files cut like this prune on each of the dimensions.

The place of a row in the global order is found without a global sort. Cells are split by a salt of the row's key,
rows are counted by (cell, salt), and the counts before each such group come from sums over at most
``2 ** (bits * dimensions)`` cells and, within a cell, over ``SALTS`` salts: both bounded, whatever the input. Rows
are then numbered within their own small group, so a source with a third of all rows is dealt over all its salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..ranks import values_at
from .storage import discard, free_prefix, materialise

SALTS = 256
BITS = 4


def order_key(value: Column) -> Column:
    """A string as one that is never null, in the same order; null comes before all."""
    return F.coalesce(F.concat(F.lit("x"), value.cast("string")), F.lit(""))


def cut_points(df: DataFrame, columns: list[str], bits: int = BITS) -> dict[str, list[str]]:
    """Quantiles of the columns' :func:`order_key`: at most ``2 ** bits - 1`` whole strings each.

    Distinct strings are counted, and the quantiles found by rank among the counted strings in order; all columns in one
    pass. What comes to the driver is the cut points.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), order_key(F.col(c)).alias("key")) for i, c in enumerate(columns)]))
    counted = materialise(df.select(keys.alias("k")).groupBy("k.c", "k.key").agg(F.count("*").alias("n")), "strings")
    total = counted.where("c = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    steps = 2**bits
    ranks = sorted({-(-i * total // steps) - 1 for i in range(1, steps)}) if total else []
    wanted = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("c"), F.explode(F.array(*[F.lit(r).cast("long") for r in ranks])).alias("rank")) if ranks else None
    found = values_at(counted, ["c"], "key", "n", wanted).select("c", "value").distinct().collect() if wanted is not None else []
    discard(counted)
    return {c: sorted((r.value for r in found if r.c == i), key=lambda v: v.encode()) for i, c in enumerate(columns)}


def order_dimension(value: Column, cuts: list[str], bits: int = BITS) -> Column:
    """A string in at most ``2 ** bits`` classes that follow its order: how many cut points are no greater than it."""
    key = order_key(value)
    return sum(((key >= F.lit(c)).cast("int") for c in cuts[: 2**bits - 1]), F.lit(0)).cast("int")


def log_dimension(value: Column, bits: int = BITS) -> Column:
    """A size in ``2 ** bits`` classes, two binary orders of magnitude each."""
    return sum((F.coalesce(value >= 4**j, F.lit(False)).cast("int") for j in range(1, 2**bits)), F.lit(0)).cast("int")


def curve_steps(dims: list[str], bits: int) -> list[dict[str, str]]:
    """Skilling's transform from coordinates to the transposed index, as successive column assignments.

    ``{xor}`` marks stand for the dialect's exclusive or; the steps run in Spark and in the SQL twin alike. The last
    step has one column, the index.
    """
    steps = []
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for d in dims:
            bit = f"({d} & {q}) <> 0"
            t = f"(xor({dims[0]}, {d}) & {p})"
            if d == dims[0]:
                steps.append({d: f"CASE WHEN {bit} THEN xor({d}, {p}) ELSE {d} END"})
            else:
                steps.append({dims[0]: f"CASE WHEN {bit} THEN xor({dims[0]}, {p}) ELSE xor({dims[0]}, {t}) END", d: f"CASE WHEN {bit} THEN {d} ELSE xor({d}, {t}) END"})
    for a, d in zip(dims, dims[1:], strict=False):
        steps.append({d: f"xor({d}, {a})"})
    t = "0"
    for b in range(bits - 1, 0, -1):
        t = f"xor({t}, CASE WHEN ({dims[-1]} & {1 << b}) <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    steps.append({d: f"xor({d}, {t})" for d in dims})
    index = " + ".join(f"CASE WHEN ({d} & {1 << b}) <> 0 THEN {1 << (b * len(dims) + len(dims) - 1 - i)} ELSE 0 END" for b in range(bits) for i, d in enumerate(dims))
    return [*steps, {"h": f"CAST({index} AS BIGINT)"}]


def spark_dialect(expression: str) -> str:
    """``xor(a, b)`` as Spark's operator."""
    while (k := expression.rfind("xor(")) >= 0:
        depth, comma = 0, 0
        for end in range(k + 4, len(expression)):
            c = expression[end]
            if c == "(":
                depth += 1
            elif c == ")" and depth == 0:
                break
            elif c == ")":
                depth -= 1
            elif c == "," and depth == 0:
                comma = end
        expression = f"{expression[:k]}(({expression[k + 4 : comma]}) ^ ({expression[comma + 1 : end]})){expression[end + 1 :]}"
    return expression


def with_hilbert_index(df: DataFrame, dims: list[str], bits: int = BITS, name: str = "h") -> DataFrame:
    """``df`` with ``name``, the Hilbert index of integer columns ``dims`` (each under ``2 ** bits``)."""
    p = free_prefix(df)
    names = [f"{p}x{i}" for i in range(len(dims))]
    out = df.withColumns({n: F.col(d).cast("int") for n, d in zip(names, dims, strict=True)})
    *steps, index = curve_steps(names, bits)
    for step in steps:
        out = out.withColumns({k: F.expr(spark_dialect(v)) for k, v in step.items()})
    return out.withColumn(name, F.expr(spark_dialect(index["h"]))).drop(*names)


def hilbert_shards(docs: DataFrame, n_shards: int, dimensions: list[Column], key: Column, order: list[str]) -> DataFrame:
    """``docs`` with ``hilbert_index, shard, slot``; shard counts are at most one apart, slots gapless from 0.

    ``dimensions`` are quantised integer columns under ``2 ** BITS``; ``key`` is a long that spreads rows within a cell
    (where it is null, a hash of ``order`` takes its place); ``order`` names the columns that settle the order within a
    (cell, salt) group, nulls first, and should be total. Rows equal in all of ``order`` are interchangeable: they get successive places. All columns of
    ``docs`` stay, whatever their names; only those named like the three added ones are replaced. An empty input gives
    an empty result.
    """
    docs = docs.drop("hilbert_index", "shard", "slot")
    p = free_prefix(docs)
    cell, salt = [f"{p}q{i}" for i in range(len(dimensions))], f"{p}salt"
    spread = F.coalesce(F.pmod(F.pmod(key, F.lit(1_000_003)) * 7919, F.lit(SALTS)), F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    keyed = docs.withColumns(dict(zip(cell, dimensions, strict=True)) | {salt: spread.cast("int")})
    groups = keyed.groupBy(*cell, salt).agg(F.count("*").alias(f"{p}n"))
    cells = with_hilbert_index(groups.groupBy(*cell).agg(F.sum(f"{p}n").alias(f"{p}cell_n")), cell, name=f"{p}h")
    n, cell_n = F.col(f"{p}n"), F.col(f"{p}cell_n")
    before = cells.select(*cell, f"{p}h", (F.sum(cell_n).over(W.orderBy(f"{p}h")) - cell_n).alias(f"{p}before"), F.sum(cell_n).over(W.partitionBy()).alias(f"{p}all"))
    in_cell = groups.withColumn(f"{p}within", F.sum(n).over(W.partitionBy(*cell).orderBy(salt)) - n)
    base = in_cell.join(before, cell).select(*cell, salt, f"{p}h", f"{p}all", (F.col(f"{p}before") + F.col(f"{p}within")).alias(f"{p}base"))
    numbered = keyed.withColumn(f"{p}row", F.row_number().over(W.partitionBy(*cell, salt).orderBy(*[F.col(c).asc_nulls_first() for c in order])) - 1)
    placed = numbered.join(base, [*cell, salt]).withColumn(f"{p}rank", F.col(f"{p}base") + F.col(f"{p}row"))
    shard = F.expr(f"({p}rank * {n_shards}) div {p}all").cast("int")
    return placed.withColumns({"hilbert_index": F.col(f"{p}h"), "shard": shard}).select(
        *[placed[f"`{c}`"] for c in docs.columns], "hilbert_index", "shard", (F.col(f"{p}rank") - F.expr(f"(shard * {p}all + {n_shards - 1}) div {n_shards}")).alias("slot")
    )


def document_shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Documents sharded on source, language and size; ``size`` (UTF-8 bytes + 1) and ``text_crc32`` come along.

    A null text has size 1 and the checksum of no bytes, 0. Null sources and languages are below all others. Rows
    without doc_id come first within their group. Equal texts have equal sizes and checksums, but rows go by their
    metadata, and copies from different sources may lie in different shards.
    """
    cuts = cut_points(docs, ["source", "lang"])
    octets = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    sized = docs.withColumns({"size": F.octet_length(octets).cast("long") + 1, "text_crc32": F.crc32(octets)})
    return hilbert_shards(
        sized, n_shards,
        [order_dimension(F.col("source"), cuts["source"]), order_dimension(F.col("lang"), cuts["lang"]), log_dimension(F.col("size"))],
        F.col("doc_id").cast("long"),
        ["doc_id", "text_crc32", "size", "source", "lang"],
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder ``shard=n`` for each shard, its rows in slot order, so that files and row groups cover short ranges."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
