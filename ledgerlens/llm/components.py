"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import discard, materialise

#: A node with more than this share of all edge ends is hot; there are fewer than ``HOT`` such nodes, whatever the input.
HOT = 1000


def _with_least(edges: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """``edges(u, v)`` with ``m`` of ``least(u, m, n)``, where ``n`` counts the rows of ``u`` among at most ``ends``.

    A hot ``u``, the centre of a star that may hold a third of all edges, never meets its edges in one task: the fewer
    than ``HOT`` rows of such nodes are broadcast, and only the other nodes' edges are shuffled to their row.
    """
    hot = F.broadcast(least.where(F.col("n") * HOT > ends).select("u", F.col("m").alias("hot_m")))
    tagged = edges.join(hot, "u", "left")
    rest = tagged.where("hot_m IS NULL").select("u", "v").join(least.where(F.col("n") * HOT <= ends).select("u", "m"), "u")
    return tagged.where("hot_m IS NOT NULL").select("u", "v", F.col("hot_m").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is hung under the least node around it. ``total`` is the number of edges."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are hung under the least of them. Edges come as (larger, smaller), at most ``total``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with an edge; the component is its least node.

    ``edges`` has long columns ``u, v``; self loops and repeats are harmless, nulls are left out. The edges after each
    star are a table in the shared folder, so plans and lineage stay short and a lost executor costs a re-read. An
    empty edge table gives an empty result.
    """
    now = materialise(
        edges.where("u <> v")
        .select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        large = materialise(_large_star(now, mark[0]), "large")
        small = materialise(_small_star(large, mark[0]), "edges")
        discard(now, large)
        now, seen, mark = small, mark, _mark(small)
        if mark == seen:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                roots.select("node", F.col("node").alias("component"))
            )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a digest of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
