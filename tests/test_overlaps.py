"""Funders that very many wallets share, links of wide nodes, halves in texts."""

import random

from pyspark.sql import functions as F

from ledgerlens.operators import graph, report
from ledgerlens.operators.overlaps import in_cells


def _common(n, seed):
    """Each wallet has some of 14 funders, and every third one of its own."""
    rng = random.Random(seed)
    return {f"w{i}": {f"f{rng.randrange(14)}" for _ in range(rng.randrange(2, 9))} | ({f"own{i}"} if i % 3 == 0 else set()) for i in range(n)} | {"alone": {"x"}, "same1": {"f1", "y"}, "same2": {"f1", "y"}}


def _links(spark, funders):
    return spark.createDataFrame([(w, f) for w, fs in funders.items() for f in fs], "wallet string, funder string").repartition(4)


def test_sets_of_common_funders_make_no_candidates(spark):
    funders, seen = _common(500, 1), []
    got = {r.wallet: r.fp_max_funder_jaccard for r in graph.funder_jaccard(_links(spark, funders), seen, looked_up=4).collect()}
    want = {w: max(len(a & b) / len(a | b) for v, b in funders.items() if v != w) for w, a in funders.items()}
    assert set(got) == set(want) and all(abs(got[w] - want[w]) < 1e-12 for w in want)
    assert sum(seen) <= 4 * len(funders)  # lookups alone would make some 20 candidates a wallet and more


def test_shared_funders_of_common_funders(spark):
    funders = _common(300, 2)
    rows = graph.shared_funders(_links(spark, funders))
    assert "bitmap" not in rows._jdf.queryExecution().optimizedPlan().toString()  # a bitmap of all wallets for each link
    assert {r.wallet: r.n_shared for r in rows.collect()} == {w: sum(v != w and bool(funders[v] & a) for v in funders) for w, a in funders.items()}


def test_cells_over_several_ranges(spark):
    """Ranges of 16 numbers, frequent and rare funders, against all pairs."""
    rng = random.Random(3)
    sets = sorted(({rng.randrange(6) for _ in range(rng.randrange(1, 5))} | {6 + int(rng.random() ** 2 * 40)} for _ in range(90)), key=len)
    held = spark.createDataFrame([(i, f, len(s)) for i, s in enumerate(sets) for f in s], "number long, funder long, n long")
    best = in_cells(held.withColumn("low", F.lit(0.0)), held, len(sets), "best", width=16)
    got = {r.number: r.j for r in best.groupBy("number").agg(F.max(F.col("i") / F.col("u")).alias("j")).collect()}
    want = {i: max(len(s & t) / len(s | t) for j, t in enumerate(sets) if j != i) for i, s in enumerate(sets)}
    assert {i: j for i, j in want.items() if j} == got
    below = in_cells(held.withColumn("low", F.col("number")), held, len(sets), "count", width=16, upto=True)
    got = {r.number: r.n for r in below.groupBy("number").agg(F.sum("shared").alias("n")).where("n > 0").collect()}
    want = {i: sum(bool(s & t) for t in sets[:i]) for i, s in enumerate(sets)}
    assert {i: n for i, n in want.items() if n} == got


def test_links_of_a_sampled_node_are_cut_before_they_meet_its_roots(spark):
    placed = spark.range(400).select(F.lit("hub").alias("wallet"), F.concat(F.lit("o"), "id").alias("other"), (1000.0 - F.col("id")).alias("value"), (F.col("id") + 1).cast("int").alias("place"))
    placed = placed.unionByName(spark.createDataFrame([("a", "hub", 1.0, 1), ("a", "b", 0.5, 2)], placed.schema))
    going = spark.range(50).select(F.concat(F.lit("r"), "id").alias("root"), F.lit("hub").alias("wallet"), F.lit("SAMPLE").alias("decision")).unionByName(spark.createDataFrame([("r0", "a", "EXPAND"), ("r1", "a", "SKIP")], "root string, wallet string, decision string"))
    rows = graph.onward(going, placed, 10)
    assert {(r.root, r.other) for r in rows.collect()} == {(f"r{i}", f"o{j}") for i in range(50) for j in range(10)} | {("r0", "hub"), ("r0", "b")}
    joins = [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 2 and not any("place" in x for x in joins)


def test_halves_in_texts_do_not_depend_on_the_order_of_sums(spark):
    rows = [("a", 0.10624999999999994), ("b", 0.10625), ("c", 0.10625000000000007)]
    features = spark.createDataFrame(rows, "wallet string, f7_within_wallet_sim double").withColumns({"f4_burstiness": F.lit(None).cast("double"), "f5_nonce_entropy": F.lit(None).cast("double"), "funding_source_count": F.lit(0)})
    assert {r.similarity for r in report.narrative(features).collect()} == {"0.1063 mean likeness of setups"}
