"""The reference's operators: SQL twins, hand-made wallets, golden values, ingest and streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import keccak, scalars as S
from ledgerlens.operators import aml, casestore, cohort, graph, lifecycle, report, rules, segments, versioned
from ledgerlens.schema import Config
from ledgerlens.sources import explorer, ingest
from ledgerlens.streaming import rules as stream

TX = "wallet string, stream int, ord long, ts long, src string, dst string, value decimal(38,0), gas_price long, gas_used long, nonce long, is_error boolean, input string, contract string, tx_hash string"
ETH = 10**18
DAY = 86400


def tx(spark, *rows):
    """Rows (wallet, ts, src, dst, eth or wei, extras)."""
    from decimal import Decimal

    out = []
    for n, (w, ts, src, dst, v, *more) in enumerate(rows):
        extra = {"stream": 0, "gas_price": 0, "gas_used": 0, "nonce": n, "is_error": False, "input": "0x", "contract": ""} | (more[0] if more else {})
        wei = Decimal(v) if isinstance(v, int) and v > 10**6 else Decimal(str(v)) * ETH
        out.append((w, extra["stream"], n, ts, src, dst, wei.to_integral_value(), extra["gas_price"], extra["gas_used"], extra["nonce"], extra["is_error"], extra["input"], extra["contract"], f"h{n}"))
    return spark.createDataFrame(out, TX)


def deploy(w, ts, k="k1"):
    return (w, ts, w, "", 0, {"contract": k, "input": "0x60806040"})


def entities(spark, *rows):
    return spark.createDataFrame(rows or [("nobody", "CEX")], "address string, type string")


def ages(spark, *rows):
    return spark.createDataFrame(rows or [("nobody", 0)], "address string, first_ts long")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_twins(spark, tiny):
    """A few queries against their SQL; the driver runs all."""
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tiny}/{f}'")
    for name in ("aml_risk_orders", "rule_rapid_burst", "cashout_features", "value_features", "fp2_min_hops", "prune_decision"):
        got = e.queries()[name](spark, tiny)
        cols = sorted(got.columns)
        norm = lambda rows: sorted(tuple("" if v is None else f"{float(v):.6g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v) for v in r) for r in rows)
        want = con.sql(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall()
        assert norm(map(tuple, got.select(*cols).collect())) == norm(want), name


def test_every_query_but_the_iterative_ones_has_a_twin():
    import __spark_entry__ as e

    assert not {q for q in e.queries() if not q.startswith("op") and q != "pipeline"} - set(e.oracle_sql())


def test_golden_value_rules(spark):
    """Published feature rows, where the environment says that there are any: how many wallets each rule hits."""
    path = os.environ.get("GOLDEN_VALUES")
    if not path:
        pytest.skip("no golden values")
    rows = spark.read.option("header", True).csv(f"file://{path}")
    doubles = [c for c in rows.columns if c.startswith("vs")]
    rows = rows.select("address", *[F.col(c).cast("double").alias(c) for c in doubles])
    fired = {r.rule_id: r.n for r in rules.evaluate(rows, key="address", partial=True).where("severity IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    assert [fired.get(f"RUG-VS-{i}", 0) for i in range(1, 7)] == [7, 0, 1, 6, 21, 49]


def response(*rows):
    return {"transactions": {"status": "1" if rows else "0", "message": "OK", "result": [{"timeStamp": str(t), "from": a, "to": b, "value": str(int(v * 10) * 10**17), "input": i} for t, a, b, v, i in rows] or "none found"}}


@pytest.mark.parametrize(("rows", "want", "fired"), [
    ([(1_000_000, "0xME", "0xcex", 0.5, "0x"), (1_100_000, "0xpal", "0xme", 0.2, "0x")], (2, 1, 1, 0.2, 0.5, 0.35, 2, 0), {}),
    ([(1_000_000, "0xmix", "0xme", 100, "0x"), *[(1_000_020 + 10 * n, "0xme", f"0xd{n}", v, "0xabcd1234" if n == 3 else "0x") for n, v in enumerate((100, 50, 10, 10))]], (5, 1, 4, 100.0, 170.0, 54.0, 5, 1), {"RULE-001": "CRITICAL", "RULE-006": "MEDIUM"}),
    ([], None, None),
])
def test_explorer_responses(spark, tmp_path, rows, want, fired):
    (tmp_path / "r.json").write_text(json.dumps(response(*rows)))
    raw = ingest.read_response(spark, f"file://{tmp_path}/r.json", "transactions", ingest.RAW_TX)
    if want is None:
        assert raw.count() == 0
        return
    clean = ingest.to_tx(raw.withColumn("stream", F.lit(0)), F.lit("0xme"))
    s = one(aml.wallet_stats(clean))
    assert (s.n_tx, s.n_in, s.n_out, s.received, s.sent, s.average, s.n_counterparties, s.n_calls) == want
    assert {r.rule_id: r.severity for r in aml.aml_rules(clean, entities(spark)).collect() if r.severity} == fired


def test_explorer_scan(spark, tmp_path):
    """Pages read on, ranges that choose folders, failures by fetch that cost no other rows."""
    path, step = f"file://{tmp_path}/landed", explorer.BLOCKS
    tx_row = lambda b, h: {"blockNumber": str(b), "hash": h, "from": "a", "to": "b", "value": "1"}
    body = lambda *rows: json.dumps({"status": "1", "message": "OK", "result": [tx_row(*r) for r in rows]})
    none = json.dumps({"status": "0", "message": "No transactions found", "result": []})
    refused = json.dumps({"status": "0", "message": "NOTOK", "result": "Max rate limit reached"})
    pages = [
        ("w", "txlist", 0, 1, 2, body((10, "h1"), (20, "h2"))), ("w", "txlist", 0, 2, 2, body((20, "h3"))), ("w", "txlist", step, 1, 2, body((step, "h4"), (step + 5, "h5"))),
        ("w", "txlist", 2 * step, 1, 2, none), ("w", "txlist", 5 * step, 1, 2, body((5 * step + 1, "far"))), ("v", "txlist", 0, 1, 2, refused), ("v", "txlist", step, 1, 2, body((step + 7, "h6"))),
        ("u", "txlist", 0, 1, 2, "<html>"), ("u", "tokentx", 0, 1, 2, body((3, "t1"))), ("w", "txlist", 0, 2, 2, body((20, "h3"))),
    ]
    explorer.land(spark.createDataFrame(pages, "wallet string, action string, lo long, page int, size int, body string"), path)
    got = lambda *a, **k: [(r.wallet, r.place, r.block, r.raw.hash) for r in explorer.scan(spark, path, *a, **k).orderBy("wallet", "place").collect()]
    assert got() == [("v", 1, step + 7, "h6"), ("w", 1, 10, "h1"), ("w", 2, 20, "h2"), ("w", 3, 20, "h3"), ("w", 4, step, "h4"), ("w", 5, step + 5, "h5"), ("w", 6, 5 * step + 1, "far")]
    assert got(low=20, high=step, page=2, offset=2, sort="desc") == [("w", 3, 20, "h2")]
    assert got("tokentx") == [("u", 1, 3, "t1")] and got(wallets=spark.createDataFrame([("v",)], "wallet string")) == [("v", 1, step + 7, "h6")]
    # only folders of the range are opened
    plan = explorer.responses(spark, path, "txlist", 20, step)._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(action" in plan.toString()
    files = lambda low, high: explorer.scan(spark, path, "txlist", low, high)
    read = {}
    for low, high in ((0, explorer.LAST_BLOCK), (20, step)):
        df = files(low, high)
        df.collect()
        scans = [p for p in _leaves(df._jdf.queryExecution().executedPlan()) if p.nodeName().startswith("Scan json")]
        read[low, high] = sum(p.metrics().apply("numFiles").value() for p in scans)
    assert read[20, step] < read[0, explorer.LAST_BLOCK] and read[20, step] > 0
    errors = {(r.wallet, r.action, r.lo, r.page, r.problem) for r in explorer.errors(spark, path).collect()}
    assert errors == {("v", "txlist", 0, 1, "refused: Max rate limit reached"), ("u", "txlist", 0, 1, "unreadable"), ("w", "txlist", step, 2, "unfinished")}
    normal, tokens, problems = explorer.profile(spark, path, spark.createDataFrame([("u",), ("w",)], "wallet string"), 99_999, ingest.GENESIS, most=2)
    assert {r.wallet for r in normal.collect()} == {"w"} and normal.count() == 2 and tokens.count() == 1 and problems.count() == 2


def _leaves(plan):
    plan = plan.finalPhysicalPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if plan.nodeName().endswith("QueryStage") else plan
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    inner = [plan.plan()] if plan.nodeName().endswith("QueryStage") else []
    return [x for p in below + inner for x in _leaves(p)] if below or inner else [plan]


def test_tied_funder_and_single_lag(spark):
    t = tx(spark, ("a", 100, "f1", "a", 1.0), ("a", 200, "f2", "a", 1.0), ("a", 300, "f2", "a", 1.0), ("a", 400, "f1", "a", 1.0), deploy("a", 4000))
    assert one(lifecycle.funding_lags(t)).asDict() == {"wallet": "a", "d_ord": 4, "funder": "f1", "lag_hours": 1.0}
    assert one(lifecycle.pre_features(t)).f2_funding_cv is None


def test_gap_of_exactly_30_days(spark):
    for extra, n in ((0, 0), (1, 1)):
        t = tx(spark, ("a", 0, "a", "b", 1.0), ("a", 30 * DAY + extra, "a", "", 0, {"contract": "k"}), ("a", 30 * DAY + extra + 5, "a", "m", 1.0))
        r = one(lifecycle.exit_dormancy(t, entities(spark, ("m", "MIXER"))))
        assert (r.exit2_dormancy_event_count, r.exit2_reactivation_context_score) == (n, 4 if n else None)


def test_closed_burst_window(spark):
    t = tx(spark, *[("a", s, "a", f"d{s}", 1.0) for s in (0, 75, 150, 225, 300)])
    assert one(aml.rapid_burst(t)).severity == "HIGH"


def test_dust_edge(spark):
    t = tx(spark, ("a", 1, "a", "b", 10**14), ("a", 2, "a", "b", 10**14 - 1))
    assert one(lifecycle.value_features(t)).vs4_outbound_dust_count == 1


def test_single_drain_has_no_span(spark):
    t = tx(spark, deploy("a", 10), ("a", 20, "v", "k1", 10.0), ("a", 9000, "k1", "a", 9.5, {"stream": 1}))
    f = lifecycle.cashout_features(t, entities(spark), ages(spark))
    r = one(f)
    assert (r.cp2_withdrawal_count, r.cp2_drain_ratio, r.cp2_withdrawal_span_hours, r.cp1_withdrawal_latency_sec) == (1, 0.95, None, 8980.0)
    got = {x.rule_id: x.severity for x in rules.evaluate(f, partial=True).collect()}
    assert got["RUG-POST-2"] == "CRITICAL" and got["RUG-POST-1"] == "HIGH"


@pytest.mark.parametrize(("selector", "mode", "found"), [("0xbaa2abde", "lstrip", True), ("0x02751cec", "lstrip", False), ("0x02751cec", "strict", True)])
def test_removal_sent_to_a_router(spark, selector, mode, found):
    t = tx(spark, deploy("a", 10), ("a", 50, "a", "dex", 0, {"input": selector + "0" * 64}))
    r = one(lifecycle.cashout_features(t, entities(spark, ("dex", "DEX")), ages(spark), Config(selector_mode=mode)))
    assert r.cp6_swap_detected == found and r.cp6_swap_latency_sec == (0.0 if found else None)


def test_destination_first_seen_after_deployment_counts_as_fresh(spark):
    t = tx(spark, deploy("a", 10), ("a", 50, "a", "d", 1.0))
    r = one(lifecycle.cashout_features(t, entities(spark), ages(spark, ("d", 40 * DAY))))
    assert (r.cp4_suspicious_destination_count, r.cp4_fresh_wallet_ratio) == (1, 1.0)


def test_large_migration(spark):
    # the inflow is far beyond what fits a long
    t = tx(spark, deploy("a", 10), ("a", 20, "v", "k1", 1000.0), ("a", 30 * DAY, "a", "d", 299.0), ("a", 30 * DAY, "a", "d", 301.0))
    cash = lifecycle.cashout_features(t, entities(spark), ages(spark))
    r = one(lifecycle.exit_migration(t, cash.select("wallet", "cp_victim_inflow_wei"), ages(spark, ("d", 29 * DAY))))
    assert (r.exit4_bulk_transfer_count, r.exit4_youngest_dest_age_days, r.exit4_total_eth_to_fresh_wallets) == (1, 1.0, 301.0)


def results(spark, *fired):
    all_rules = [r for r, _ in rules.RULES]
    return spark.createDataFrame([("a", r, dict(fired).get(r)) for r in all_rules], "wallet string, rule_id string, severity string")


@pytest.mark.parametrize(("fired", "score", "verdict"), [
    ([("RUG-FP4", "CRITICAL")], 80, "HIGH_CONFIDENCE_RUGPULL"), ([("RUG-NEW-A", "MEDIUM")], 10, "INSUFFICIENT_DEPLOYMENT_HISTORY"), ([("RUG-NEW-B", "HIGH")], 36, "MODERATE_PATTERN"),
    ([], 0, "CLEAN"), ([("RUG-NEW-A", "MEDIUM"), ("RUG-003", "HIGH")], 35, "WEAK_PATTERN"), ([(f"RUG-POST-{i}", "CRITICAL") for i in (1, 2, 5)], 100, "HIGH_CONFIDENCE_RUGPULL"),
])
def test_verdicts(spark, fired, score, verdict):
    r = one(rules.verdicts(results(spark, *fired)))
    assert (r.score, r.verdict) == (score, verdict)
    none = one(rules.verdicts(results(spark, *fired), spark.createDataFrame([("a", False)], "wallet string, has_data boolean")))
    assert (none.score, none.verdict) == (0, "INSUFFICIENT_DATA")


def test_thresholds_can_be_changed(spark):
    f = spark.createDataFrame([("a", 0.5, 7)], "wallet string, f2_funding_cv double, vs4_outbound_dust_count int").withColumn("vs4_pre_cashout_dust_count", F.lit(0))
    got = lambda **changed: {r.rule_id: r.severity for r in rules.evaluate(f, rules.rules_of(changed or None), partial=True).collect()}
    assert got() == {"RUG-002": "HIGH", "RUG-VS-4": "MEDIUM"}
    assert got(**{"RUG-002": {"high_funding_cv": 0.4}, "RUG-VS-4": {"medium_outbound_dust_count": 8}}) == {"RUG-002": "MEDIUM", "RUG-VS-4": None}
    with pytest.raises(ValueError, match="RUG-002.nothing"):
        rules.rules_of({"RUG-002": {"nothing": 1}})
    assert rules.rules_of() == rules.RULES and len(rules.RULES) == 28


def test_trace_strategies(spark):
    t = tx(spark, ("a", 1, "a", "b", 1.0), ("a", 2, "c", "a", 2.0), ("a", 3, "d", "a", 3.0, {"stream": 1}), ("a", 4, "a", "a", 9.0), ("a", 5, "a", "", 0))
    none = spark.createDataFrame([], "other string")
    got = {s: {r.other for r in graph.trace_scores(t, none, none, 10, strategy=s).collect()} for s in ("FORWARD_ONLY", "backward_only", "FULL", "anything")}
    assert got == {"FORWARD_ONLY": {"b"}, "backward_only": {"c"}, "FULL": {"b", "c"}, "anything": {"b", "c"}}


def test_cycle_noise_and_hops(spark):
    t = tx(spark, ("c", 1, "a", "b", 1.0), ("c", 2, "b", "c", 1.0), ("c", 3, "c", "a", 1.0), ("c", 4, "noise", "c", 1.0), ("c", 5, "x", "a", 1.0), ("c", 6, "dust", "c", 10**14))
    up = {r.funder: r.depth for r in graph.upstream_funders(t, entities(spark), ["noise"]).collect()}
    assert up == {"b": 1, "a": 2, "x": 3}
    assert one(graph.min_hops(t, entities(spark, ("x", "CEX")))).fp_min_hops == 3
    assert one(graph.min_hops(t, entities(spark, ("c", "CEX")))).fp_min_hops == 0
    assert one(graph.min_hops(t, entities(spark))).fp_min_hops is None


def test_shared_funder_modes(spark):
    links = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g")], "wallet string, funder string")
    order = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "wallet string, seq int")
    assert {r.wallet: r.n_shared for r in graph.shared_funders(links).collect()} == {"a": 1, "b": 1, "c": 0}
    assert {r.wallet: r.n_shared for r in graph.shared_funders(links, "sequential", order).collect()} == {"a": 0, "b": 1, "c": 0}
    assert {r.wallet: r.fp_max_funder_jaccard for r in graph.funder_jaccard(links).collect()} == {"a": 1.0, "b": 1.0, "c": 0.0}


def test_shared_funders_without_pairs(spark):
    """Earlier wallets that share a funder, against all pairs, with equal places, two funders of all wallets and numbers over a bucket."""
    import random

    rng = random.Random(6)
    funders = {f"w{i}": {"all"} | {f"f{rng.randrange(30)}" for _ in range(rng.randrange(3))} if i % 5 else {f"g{i}"} for i in range(150)}
    seq = {w: rng.randrange(60) for w in funders}
    links = spark.createDataFrame([(w, f) for w, fs in funders.items() for f in fs], "wallet string, funder string").repartition(4)
    order = spark.createDataFrame(list(seq.items()), "wallet string, seq long")
    got = {r.wallet: r.n_shared for r in graph.shared_funders(links, "sequential", order).collect()}
    assert got == {w: sum(seq[v] < seq[w] and bool(funders[v] & funders[w]) for v in funders) for w in funders}
    n = 70_000  # more than one bitmap holds
    many = spark.range(n).select(F.concat(F.lit("w"), "id").alias("wallet"), F.lit("all").alias("funder"), F.col("id").alias("seq"))
    odd = {r.wallet: r.n_shared for r in graph.shared_funders(many, "sequential", many.select("wallet", "seq")).where("wallet IN ('w0', 'w7', 'w8', 'w32767', 'w32768', 'w32777', 'w69999')").collect()}
    assert odd == {f"w{i}": i for i in (0, 7, 8, 32767, 32768, 32777, 69999)}
    plan = graph.shared_funders(links, "sequential", order)._jdf.queryExecution().optimizedPlan().toString()
    assert "other" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_funder_jaccard_against_all_pairs(spark, seed):
    import random

    rng = random.Random(seed)
    usual = [f"h{i}" for i in range(3)]
    funders = {f"w{i}": {x for x in usual if rng.random() < 0.8} | {f"f{int(rng.random() ** 2 * 60)}" for _ in range(rng.randrange(0, 9))} for i in range(120)}
    funders = {w: fs for w, fs in funders.items() if fs} | {"alone": {"x1", "x2"}, "same1": {"y", "h0"}, "same2": {"y", "h0"}}
    links = spark.createDataFrame([(w, f) for w, fs in funders.items() for f in fs], "wallet string, funder string").repartition(4)
    got = {r.wallet: r.fp_max_funder_jaccard for r in graph.funder_jaccard(links).collect()}
    want = {w: max(len(a & b) / len(a | b) for v, b in funders.items() if v != w) for w, a in funders.items()}
    assert set(got) == set(want) and all(abs(got[w] - want[w]) < 1e-12 for w in want)


def test_a_funder_of_all_wallets_makes_few_candidates(spark):
    """2,000 wallets with two funders in common and some of their own: candidates stay in proportion to the wallets."""
    n, seen = 2000, []
    links = spark.range(n).select(F.concat(F.lit("w"), "id").alias("wallet"), F.explode(F.array(F.lit("all"), F.lit("also"), F.concat(F.lit("own"), "id"), F.concat(F.lit("pair"), F.expr("id div 2")), F.concat(F.lit("ten"), F.expr("id div 10")))).alias("funder"))
    got = graph.funder_jaccard(links, seen).groupBy("fp_max_funder_jaccard").count().collect()
    assert [(round(r[0], 6), r[1]) for r in got] == [(round(4 / 6, 6), n)]
    assert sum(seen) <= 12 * n  # all pairs by funder would be four million


def test_trace_goes_on_through_subjects(spark):
    t = tx(spark, ("a", 1, "a", "b", 1.0), ("b", 2, "b", "c", 1.0), ("c", 3, "c", "a", 1.0), ("a", 4, "a", "cex", 5.0), ("a", 5, "a", "tiny", 0.01), ("c", 6, "c", "e", 1.0))
    got = {r.node: (r.depth, r.decision) for r in graph.trace(t, spark.createDataFrame([("a",)], "wallet string"), entities(spark, ("cex", "CEX"))).collect()}
    every = graph.trace(t, spark.createDataFrame([("a",)], "wallet string"), entities(spark, ("cex", "CEX")), max_nodes=2).collect()
    assert {r.node: (r.decision, r.reason) for r in every} == {"a": ("EXPAND", "ok"), "b": ("EXPAND", "ok"), "cex": ("HALT", "entity"), "tiny": ("SKIP", "dust"), "c": ("SKIP", "budget")}
    assert got == {"a": (0, "EXPAND"), "b": (1, "EXPAND"), "cex": (1, "HALT"), "tiny": (1, "SKIP"), "c": (2, "EXPAND"), "e": (3, "EXPAND")}


def test_evidence_is_the_transaction(spark):
    t = tx(spark, ("a", 1, "a", "b", 20.0), ("a", 2, "a", "c", 20.0)).withColumn("tx_hash", F.concat(F.lit("0xreal"), "ord"))
    r = one(aml.large_transfer(t))
    assert (r.evidence, r.severity) == ("0xreal0", "HIGH")
    said = {x.rule_id: x.reasoning for x in report.findings(t, entities(spark)).collect()}
    assert said["RULE-001"] == "one transfer moved 20.000000 ETH (0xreal0)"


def test_sequences_of_very_many_selectors(spark):
    """More selectors than a block of characters holds; surrogates are stepped over."""
    n = 60_000
    seqs = spark.range(n).select(F.lit("a").alias("wallet"), F.hex("id").alias("x")).groupBy("wallet").agg(F.array_sort(F.collect_list("x")).alias("seq"))
    few = seqs.select("wallet", F.expr("slice(seq, 55000, 40)").alias("seq"))
    other = seqs.select("wallet", F.expr("concat(slice(seq, 55000, 30), slice(seq, 100, 10))").alias("seq"))
    assert abs(one(lifecycle.sequence_similarity(None, seqs=few.unionByName(other).unionByName(few).unionByName(seqs.select("wallet", F.expr("slice(seq, 1, 1)").alias("seq")).limit(0)))).f7 - (1 + 0.75 + 0.75) / 3) < 1e-9


def test_rules_without_features_are_an_error(spark):
    with pytest.raises(ValueError, match="RUG-001"):
        rules.evaluate(spark.createDataFrame([("a", 1.0)], "wallet string, f2_funding_cv double"))


def test_escalation_and_investigation(spark):
    risks = spark.createDataFrame([("a", 20, "LOW"), ("b", 60, "HIGH"), ("c", 10, "LOW")], "wallet string, risk_score long, risk_level string")
    risks = risks.withColumns({f"n_{s}": F.lit(1) for s in ("critical", "high", "medium", "low")} | {f: F.col("wallet") == "c" for f in ("mixer", "cex", "bridge")})
    verdicts = spark.createDataFrame([("a", "STRONG_PATTERN", 60), ("c", "HIGH_CONFIDENCE_RUGPULL", 80), ("b", "MODERATE_PATTERN", 40)], "wallet string, verdict string, score long")
    got = aml.escalated(risks, verdicts)
    assert {r.wallet: (r.risk_score, r.risk_level) for r in got.collect()} == {"a": (60, "HIGH"), "b": (60, "HIGH"), "c": (80, "CRITICAL")}
    r = one(aml.investigation(got, spark.createDataFrame([("x", w) for w in "abc"], "case_id string, wallet string")))
    assert (r.risk_score, r.risk_level, r.n_wallets, r.n_high, r.mixer) == (80, "CRITICAL", 3, 3, True)


def test_token_mints(spark):
    from decimal import Decimal

    zero = "0x" + "0" * 40
    t = tx(spark, deploy("a", 10), ("a", 500, "a", "pool", 2.0, {"input": "0xf305d719" + "0" * 64}))
    mints = spark.createDataFrame([("a", 0, 100, zero, "a", Decimal(9)), ("a", 1, 50, zero, "b", Decimal(1)), ("a", 2, 40, "a", "b", Decimal(5))], "wallet string, ord long, ts long, src string, dst string, amount decimal(38,0)")
    r = one(lifecycle.value_features(t, mints))
    assert (r.vs6_creator_token_fraction, r.vs6_mint_to_lp_latency_sec) == (0.9, 400)
    assert one(lifecycle.value_features(t)).vs6_creator_token_fraction is None


def test_upstream_over_all_wallets(spark):
    t = tx(spark, ("a", 1, "x", "a", 1.0), ("x", 2, "y", "x", 1.0), ("y", 3, "z", "y", 1.0))
    ego, all_ = ({r.funder: r.depth for r in graph.upstream_funders(t.where("wallet = 'a'") if s == "ego" else t, entities(spark), [], scope=s).where("wallet = 'a'").collect()} for s in ("ego", "global"))
    assert ego == {"x": 1} and all_ == {"x": 1, "y": 2, "z": 3}


def test_requests_and_counts(spark):
    good = "0x" + "a" * 40
    rows = spark.createDataFrame([(good, 1, 90, 500), ("0x1", 0, 0, 9), (None, None, 3651, 1001)], "wallet_address string, depth int, lookback_days int, max_transactions int")
    assert [r.faults for r in casestore.request_faults(rows).collect()] == [[], ["wallet_address", "depth", "lookback_days", "max_transactions"], ["wallet_address", "depth", "lookback_days", "max_transactions"]]
    blobs = spark.createDataFrame([('{"a": 1}',), ("{oops",), (None,)], "j string")
    assert [r.x and r.x.a for r in blobs.select(casestore.parsed_json(F.col("j"), "a int").alias("x")).collect()] == [1, None, None]
    assert [r.renderer for r in spark.createDataFrame([(499,), (500,), (5000,)], "n int").select(graph.renderer(F.col("n")).alias("renderer")).collect()] == ["svg", "canvas", "webgl"]


def test_sketches_of_recipients(spark):
    """Within 3 % for wallets of 1,000 recipients or more, over spans of days, merged from the days' sketches."""
    from decimal import Decimal

    rows = [(w, 0, i, d * DAY + i, w, f"r{(i * 7 + d * 500) % 4000}", Decimal(1), 0, 0, i, False, "0x", "", f"h{w}{d}{i}") for w, n in (("a", 1500), ("b", 900), ("c", 3)) for d in range(4) for i in range(n)]
    sketches = aml.recipient_sketches(spark.createDataFrame(rows, TX))
    assert sketches.count() == 12
    for low, high in ((0, 3), (1, 2), (3, 3)):
        got = {r.wallet: r.fanout for r in aml.fanout_of_sketches(sketches, low, high).collect()}
        for w in "abc":
            exact = len({r[5] for r in rows if r[0] == w and low <= r[3] // DAY <= high})
            assert abs(got[w] - exact) <= max(1, 0.03 * exact), (w, low, high)


def test_truncate_and_mask(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",), (None,)], "x string")
    got = [tuple(r) for r in df.select(S.truncated(F.col("x"), 6), S.truncated(F.col("x"), 2), S.masked(F.col("x"))).collect()]
    assert got == [("abc...", "..", "abcd****ghij"), ("abc", "..", "****"), (None, None, None)]


def test_scalars(spark):
    df = spark.createDataFrame([("0xABCDEF0123", "12", 0.4999999999, 2.00001)], "data string, n string, v double, r double")
    r = one(df.select(
        S.selector(F.col("data")).alias("sel"), S.safe_int(F.lit("x"), 7).alias("d"), S.safe_int(F.col("n")).alias("n"), S.is_round_half(F.col("v")).alias("h"), S.round_amount(F.col("r")).alias("a"),
        S.stripped_selector(F.lit("0x02751cec00")).alias("st"), S.is_address(F.lit("0x" + "a" * 40)).alias("ok"), S.clamp(F.lit(5.0), 0.0, 1.0).alias("c"), S.safe_divide(F.lit(1.0), F.lit(0.0)).alias("z"),
    ))
    assert (r.sel, r.d, r.n, r.h, r.a, r.st, r.ok, r.c, r.z) == ("abcdef01", 7, 12, False, 2.0, "2751cec0", True, 1.0, 0.0)


def test_ingest(spark, tmp_path):
    (tmp_path / "ent.json").write_text(json.dumps({"_note": {"0xZ": {}}, "cex": {"0xAA": {"label": "A", "type": "CEX"}, "_x": {"label": "c", "type": "t"}}, "mix": {"0xaa": {"label": "B", "type": "mixer_suspected"}, "0xbb": {"label": "C", "type": "bridge"}}}))
    got = {r.address: (r.label, r.type) for r in ingest.read_entities(spark, f"file://{tmp_path}/ent.json").collect()}
    assert got == {"0xaa": ("B", "MIXER"), "0xbb": ("C", "BRIDGE")}
    (tmp_path / "cache.json").write_text(json.dumps({"0xA": {"normal_txs": [{"from": "0xA", "to": "", "value": "9" * 50, "timeStamp": "12", "contractAddress": "0xK"}], "internal_txs": [{"from": "0xB", "to": "0xA", "value": "7", "timeStamp": "oops"}]}, "0xE": {"normal_txs": [], "internal_txs": None}}))
    rows = sorted(ingest.to_tx(ingest.read_cache(spark, f"file://{tmp_path}/cache.json")).collect(), key=lambda r: r.stream)
    assert [(r.wallet, r.stream, r.src, r.dst, int(r.value), r.ts, r.contract) for r in rows] == [("0xa", 0, "0xa", "", 0, 12, "0xk"), ("0xa", 1, "0xb", "0xa", 7, 0, "")]
    a = "0x" + "1" * 40
    (tmp_path / "list.txt").write_text(f"# bad ones\n{a}\n\n0x12\n{a.upper().replace('0X', '0x')}\n")
    assert [r.wallet for r in ingest.read_addresses(spark, f"file://{tmp_path}/list.txt", "bad").collect()] == [a]
    assert ingest.start_block(10, ingest.GENESIS + 20 * DAY) == 65_000 and ingest.start_block(99, ingest.GENESIS) == 0
    ingest.write_matrix(spark.createDataFrame([("a", 1 / 3, None)], "wallet string, x double, y double"), f"file://{tmp_path}/m")
    assert one(spark.read.option("header", True).csv(f"file://{tmp_path}/m")).x == "0.333333"


def test_contracts_of_several_chains(spark):
    code = spark.createDataFrame([("a", "one", "0x6001", "[{}]"), ("a", "two", "0x", None), ("b", "one", "0x", None), ("c", "two", "0x6002", "Contract source code not verified"), ("d", "two", None, None)], "address string, chain string, bytecode string, abi string")
    who = spark.createDataFrame([(x,) for x in "abcde"], "address string")
    got = {r.address: (r.is_contract, r.chains, r.source_verified) for r in ingest.contract_info(who, code).collect()}
    assert got == {"a": (True, ["one"], True), "b": (False, [], False), "c": (True, ["two"], False), "d": (False, [], False), "e": (False, [], False)}
    plain, contracts = ingest.split_contracts(who, code)
    assert {r.address for r in plain.collect()} == {"b", "d", "e"} and {r.address for r in contracts.collect()} == {"a", "c"}


def test_large_cache_in_many_tasks(spark, tmp_path):
    """One JSON object over many splits, rows as the whole-file reader gives them, and who is missing or empty."""
    import random

    rng = random.Random(3)
    addr = lambda i: "0x" + f"{i:040x}"
    tx_row = lambda i, w: {"from": w, "to": addr(rng.randrange(99)) if i % 5 else "", "value": str(i), "timeStamp": str(i), "hash": "0x" + f"{i:064x}", "input": "0x" + "ab" * rng.randrange(60), "contractAddress": addr(i) if i % 7 == 0 else ""}
    cache = {addr(1000 + w): {"normal_txs": [tx_row(i, addr(1000 + w)) for i in range(rng.randrange(0, 60) if w % 9 else 0)], "internal_txs": [tx_row(i, addr(5)) for i in range(w % 3)] if w % 9 else None} for w in range(120)}
    cache[addr(7).upper().replace("0X", "0x")] = {"normal_txs": [], "internal_txs": []}
    cache[addr(2000)] = {"internal_txs": [tx_row(1, addr(3))], "normal_txs": [tx_row(2, addr(4))], "contract_address": addr(8)}
    for indent in (None, 2):
        path = tmp_path / f"cache{indent}.json"
        path.write_text(json.dumps(cache, indent=indent) + "\n")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        try:
            large = ingest.read_large_cache(spark, f"file://{path}")
            assert spark.read.option("lineSep", '"0x').text(f"file://{path}").rdd.getNumPartitions() > 10
            key = lambda r: (r.wallet, r.stream, r.ord, r.raw.hash, r.raw.input, r.raw.to)
            got = sorted(map(key, large.collect()))
            wallets = {r.wallet for r in ingest.cached_wallets(spark, f"file://{path}").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == sorted(map(key, ingest.read_cache(spark, f"file://{path}").collect())) and len(got) > 2000
        assert wallets == {w.lower() for w in cache}
    listed = spark.createDataFrame([(addr(1001), "bad"), (addr(1009), "bad"), (addr(7), "good"), (addr(1), "good")], "wallet string, label string")
    rows, skipped = ingest.cohort(ingest.read_cache(spark, f"file://{path}"), ingest.cached_wallets(spark, f"file://{path}"), listed)
    assert {r.wallet for r in rows.collect()} == {addr(1001)}
    assert {(r.wallet, r.reason) for r in skipped.collect()} == {(addr(1009), "empty"), (addr(7), "empty"), (addr(1), "missing")}


def test_case_store(spark, tmp_path):
    path = f"file://{tmp_path}/links"
    rows = spark.createDataFrame([("f", "a", 1), ("f", "b", 2), ("f", "a", 3)], "funder string, wallet string, depth int")
    assert casestore.insert_new(spark, rows, path, ["funder", "wallet"]).count() == 2
    assert casestore.insert_new(spark, rows, path, ["funder", "wallet"]).count() == 0
    assert versioned.VersionedTable(spark, "funder string, wallet string, depth int", ["funder", "wallet"], path).read().count() == 2
    ev = spark.createDataFrame([(i, s, i) for i, s in enumerate(["LOW", "CRITICAL", "HIGH", "INFO", "CRITICAL"])], "evidence_id int, severity string, detected_at int")
    assert [r.evidence_id for r in casestore.evidence_page(ev, 1, 3).collect()] == [4, 1, 2] and casestore.n_pages(5, 3) == 2
    assert casestore.without(ev, ev.where("evidence_id = 1").select("evidence_id"), "evidence_id").count() == 4


def content(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


def test_versioned_table(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "k int, v string, n int")
    t = versioned.VersionedTable(spark, "k int, v string, n int", ["k"], f"file://{tmp_path}/t", buckets=4)
    assert content(t) == [] and t.insert_new(make((1, "b", 1), (1, "a", 2), (2, "x", 1), (None, "nil", 0)))
    assert content(t) == [(1, "a", 2), (2, "x", 1), (None, "nil", 0)]
    t.insert_new(make((1, "other", 9), (3, "new", 3)))
    assert t.upsert(make((2, None, 5), (4, "four", 4), (None, "zero", None)), {"n": "old.n + new.n"}, batch="b1")
    assert content(t) == [(1, "a", 2), (2, "x", 6), (3, "new", 3), (4, "four", 4), (None, "zero", None)]
    assert not t.upsert(make((2, "again", 5)), batch="b1") and content(t, 2) == [(1, "a", 2), (2, "x", 1), (3, "new", 3), (None, "nil", 0)]
    t.delete(make((1, "", 0), (7, "", 0)))
    assert content(t) == [(2, "x", 6), (3, "new", 3), (4, "four", 4), (None, "zero", None)] and t.version() == 4
    t.insert_new(make((1, "", 0)).limit(0))
    assert content(t) == content(t, 4)
    before = content(t)
    assert t.vacuum() > 0 and content(t) == before
    with pytest.raises(ValueError, match="unpack"):
        versioned.cascade(versioned.VersionedTable(spark, "a int, b int", ["a", "b"], f"file://{tmp_path}/two"), make(), [])


def test_two_writers_insert_one_row(spark, tmp_path):
    """Both read the same version; the slower one finds its number taken, reads again, and leaves the other's row."""
    import threading

    make = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    path, both, tries = f"file://{tmp_path}/t", threading.Barrier(2, timeout=60), []

    class Slow(versioned.VersionedTable):
        def _publish(self, version, manifest):
            if version == 1:
                both.wait()  # each has read the empty table and written its rows
            done = super()._publish(version, manifest)
            tries.append((version, done))
            return done

    writers = [Slow(spark, "k int, v string", ["k"], path, buckets=2) for _ in range(2)]
    threads = [threading.Thread(target=w.insert_new, args=(make((1, name), (2 + i, name)),)) for i, (w, name) in enumerate(zip(writers, "ab", strict=True))]
    for th in threads:
        th.start()
    for th in threads:
        th.join(120)
    rows = content(writers[0])
    assert sorted(tries) == [(1, False), (1, True), (2, True)]
    assert [k for k, _ in rows] == [1, 2, 3] and rows[0][1] in "ab"


def test_broken_off_write_leaves_nothing(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    t = versioned.VersionedTable(spark, "k int, v string", ["k"], f"file://{tmp_path}/t")
    t.insert_new(make((1, "a")), batch="one")

    def stop(version, manifest):
        raise KeyboardInterrupt

    t._publish, publish = stop, t._publish
    with pytest.raises(KeyboardInterrupt):
        t.upsert(make((1, "z"), (2, "b")), batch="two")
    t._publish = publish
    assert content(t) == [(1, "a")] and t.manifest()["batches"] == ["one"]
    assert t.upsert(make((1, "z"), (2, "b")), batch="two") and content(t) == [(1, "z"), (2, "b")]
    assert t.vacuum() >= 1 and content(t) == [(1, "z"), (2, "b")]


def test_cascading_delete(spark):
    cases = versioned.VersionedTable(spark, "case_id int, name string", ["case_id"])
    evidence = versioned.VersionedTable(spark, "evidence_id int, case_id int", ["evidence_id"])
    cases.insert_new(spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, name string"))
    evidence.insert_new(spark.createDataFrame([(10, 1), (11, 2), (12, 1), (13, None)], "evidence_id int, case_id int"))
    versioned.cascade(cases, spark.createDataFrame([(1,)], "case_id int"), [(evidence, "case_id")])
    assert content(cases) == [(2, "b")] and content(evidence) == [(11, 2), (13, None)]


def test_ages_by_batches(spark):
    """Batches out of order, one repeated, against all rows at once."""
    rows = tx(spark, ("a", 50, "x", "a", 1.0), ("a", 20, "a", "y", 1.0), ("b", 70, "y", "b", 1.0), ("b", 10, "b", "", 1.0), ("a", 5, "y", "a", 1.0))
    ages_table = versioned.VersionedTable(spark, "address string, first_ts long", ["address"])
    done = [versioned.update_ages(ages_table, rows.where(F.col("ord").isin(*p)), name) for name, p in (("p2", (2, 3)), ("p1", (0, 1)), ("p2", (2, 3)), ("p3", (4,)))]
    assert done == [True, True, False, True]
    assert content(ages_table) == sorted(((r.address, r.first_ts) for r in ingest.first_seen(rows).collect()), key=str)


def test_cohort(spark):
    v = spark.createDataFrame([("a", 30), ("b", 10), ("c", 90)], "wallet string, score int").withColumn("verdict", F.lit("X"))
    lab = spark.createDataFrame([("a", "bad"), ("b", "bad"), ("c", "good")], "wallet string, label string")
    assert {r.label: (r.n, r.n_right) for r in cohort.confusion(v, lab).collect()} == {"bad": (2, 1), "good": (1, 0)}


def test_thresholds_from_classes(spark):
    """Against the classes' own values, in both directions; no negatives, no positives, ties on the threshold, nulls."""
    rows = [("bad", 1.0, 9.0, 1.0, None), ("bad", 2.0, 7.0, 2.0, None), ("bad", 4.0, 8.0, None, None), ("good", 2.0, 8.0, None, 1.0), ("good", 9.0, 1.0, None, 2.0), ("good", 8.0, 2.0, None, None), (None, 0.0, 9.0, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "label string, a double, b double, c double, d double")
    got = {r.feature: r for r in cohort.thresholds(frame, ["a", "b", "c", "d"], above=("b",)).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].high, got["a"].medium, got["a"].clean, got["a"].n_wrong, got["a"].quality) == (2.0, 3.0, 5.0, 1, "FAIR")
    assert (got["b"].direction, got["b"].high, got["b"].medium, got["b"].clean, got["b"].n_wrong) == ("above", 8.0, 7.5, 5.0, 1)
    assert (got["c"].quality, got["c"].n_negative, got["c"].clean) == ("UNKNOWN", 0, None)
    lines = [r.line for r in cohort.settings_lines(cohort.thresholds(frame, ["b", "c"], above=("b",))).orderBy("feature", "place").collect()]
    assert lines[:2] == ["# b: FAIR, 1 of 3 others on the suspicious side", "B_HIGH_MIN = 8.0000"] and lines[-1] == "C_CLEAN_MAX = None"
    assert cohort.thresholds(frame.where("false"), ["a", "b"]).count() == 0


def test_text_report_of_rules(spark, tmp_path):
    res = spark.createDataFrame([(w, r, s) for r, hits in (("R-2", {"a": "HIGH"}), ("R-1", {"b": "LOW", "a": "HIGH", "z": "HIGH"}), ("R-3", {})) for w in "abcz" for s in [hits.get(w)]], "wallet string, rule_id string, severity string")
    lab = spark.createDataFrame([(w, "good" if w == "z" else "bad") for w in "abcz"], "wallet string, label string")
    cohort.write_report(cohort.rule_report(res, lab), f"file://{tmp_path}/report")
    text = [line for f in sorted((tmp_path / "report").glob("part-*")) for line in f.read_text().splitlines()]
    assert text == ["R-1  fired on 2 of 3 (66.7%)", "  a  [HIGH]", "  b  [LOW]", "R-2  fired on 1 of 3 (33.3%)", "  a  [HIGH]", "R-3  fired on 0 of 3 (0.0%)", "R-1            66.7%", "R-2            33.3%", "R-3             0.0%"]
    assert cohort.rule_report(res.where("false"), lab).count() == 0


def test_report_store(spark, tmp_path):
    """One report an investigation, batches once, graphs for reports that are there, pages, counts, deletion and a new report after it."""
    store = casestore.ReportStore(spark, f"file://{tmp_path}/reports", buckets=2)
    rows = lambda *r: spark.createDataFrame(r, casestore.ReportStore.SCHEMA)
    assert store.recent().count() == 0 and store.counts().count() == 0
    first = rows(("i1", "r1", "HIGH", 60, 10, "s", None), ("i1", "r0", "LOW", 1, 11, "s", None), ("i2", "r2", "LOW", 5, 20, None, None), ("i3", "r3", "HIGH", 70, 20, "s", None))
    assert store.add(first, "one") and not store.add(first, "one")
    assert store.add(rows(("i1", "again", "LOW", 0, 1, "s", None), ("i4", "r4", "LOW", 0, 5, "s", None)), "two")
    assert [r.report_id for r in store.recent().collect()] == ["r2", "r3", "r1", "r4"]
    assert [r.report_id for r in store.recent(risk_level="HIGH", size=1, number=2).collect()] == ["r1"]
    graphs = spark.createDataFrame([("i1", "{}"), ("nobody", "{}")], "investigation_id string, graph string")
    assert store.attach_graphs(graphs, "g") and not store.attach_graphs(graphs, "g")
    asked = spark.createDataFrame([("i1",), ("nobody",)], "investigation_id string")
    assert {r.investigation_id: (r.has_report, r.report_id, r.risk_score, r.graph) for r in store.of(asked).collect()} == {"i1": (True, "r1", 60, "{}"), "nobody": (False, None, None, None)}
    store.delete(spark.createDataFrame([("r1",), ("unknown",)], "report_id string"))
    assert {r.risk_level: r.n for r in store.counts().collect()} == {"HIGH": 1, "LOW": 2} and not store.of(asked).where("has_report").count()
    store.add(rows(("i1", "r9", "LOW", 0, 30, "s", None)))
    assert [r.report_id for r in store.recent(size=1).collect()] == ["r9"]


def busy_wallets(n=1500):
    """Rows of wallets with lives of years; one has a third of all, much of it within minutes."""
    import random

    rng = random.Random(11)
    rows = []
    for i in range(n):
        w = "hot" if i % 3 == 0 else f"w{i % 40}"
        at = rng.choice([rng.randrange(0, 1500 * DAY), 30 * DAY * rng.randrange(1, 40) + rng.randrange(-200, 200), 700 * DAY + rng.randrange(0, 900)])
        rows.append((w, at, *rng.choice([(w, f"d{rng.randrange(30)}"), (w, "mix"), (f"s{i % 7}", w), (w, w), (w, "")]), rng.choice([0.5, 1.0, 3.3, 12.0]), {"stream": int(rng.random() < 0.1)}))
    return rows


def facts_by_hand(rows, c):
    """The timed facts and the dormancies of each wallet, from its rows in order."""
    out = {}
    for w in {r[0] for r in rows}:
        mine = sorted((ts, x["stream"], n, src, dst, v) for n, (o, ts, src, dst, v, x) in enumerate(rows) if o == w)
        sent = [r for r in mine if r[3] == w and r[4] != w and r[1] == 0]
        times = [r[0] for r in mine]
        burst = max(((sum(t <= u[0] <= t + c.burst_seconds for u in sent), -t) for t, *_ in sent), default=None)
        gap = max(((b - a, -b) for a, b in zip(times, times[1:], strict=False)), default=None)
        bucket = [(t - times[0]) // int(c.bucket_days * DAY) for t in times]
        k, last = len(set(bucket)), bucket.count(bucket[-1])
        ratio = last / ((len(times) - last) / (k - 1)) if k >= 2 and len(times) >= 4 else None
        own = [r for r in mine if r[3] == w and r[1] == 0]
        points = [2 * (r[4] == "") + 2 * (r[4] == "mix") for r in own]
        events = [(own[i][0], round((own[i][0] - own[i - 1][0]) / DAY, 1), sum(points[i : i + 3])) for i in range(1, len(own)) if own[i][0] - own[i - 1][0] > 30 * DAY]
        out[w] = {
            "burst": burst and float(burst[0]), "burst_evidence": burst and str(-burst[1]), "dormant": gap and gap[0] / DAY, "dormant_evidence": gap and str(sum(-gap[1] <= t <= -gap[1] + 48 * 3600 for t in times)),
            "activity": ratio, "fanout": float(len({r[4] for r in sent if r[4]})) or None, "large": max((r[5] for r in sent), default=None), "events": events, "own": bool(own),
        }
    return out


def test_busy_wallets_in_segments(spark):
    """Same facts as from each wallet's own rows in order, over many segments, with ties and windows across borders."""
    rows, c = busy_wallets(), Config(as_of=1500 * DAY)
    t = tx(spark, *rows).repartition(5)
    want = facts_by_hand(rows, c)
    got = {r.wallet: r.asDict() for r in aml.aml_facts(t, entities(spark), c).collect()}
    assert set(got) == set(want)
    for w, facts in want.items():
        for f in ("burst", "burst_evidence", "dormant", "dormant_evidence", "activity", "fanout", "large"):
            same = pytest.approx(facts[f]) if isinstance(facts[f], float) else facts[f]
            assert got[w][f] == same, (w, f)
    exits = {r.wallet: r for r in lifecycle.exit_dormancy(t, entities(spark, ("mix", "MIXER"))).collect()}
    assert set(exits) == {w for w, x in want.items() if x["own"]}
    for w, r in exits.items():
        assert [(x.ts, x.gap_days, x.rcs) for x in r.exit2_events] == want[w]["events"] and r.exit2_dormancy_event_count == len(want[w]["events"])
    gaps = sorted((r.wallet, r.gap) for r in segments.gaps(t).collect())
    times = {w: sorted(r[1] for r in rows if r[0] == w) for w in want}
    assert gaps == sorted((w, b - a) for w, ts in times.items() for a, b in zip(ts, ts[1:], strict=False))


def test_no_task_holds_a_busy_wallet(spark):
    """Windows over rows go by wallet and segment; those by wallet alone stand above an aggregate by both."""
    import re

    rows = busy_wallets(300)
    t = tx(spark, *rows)
    for df in (aml.aml_facts(t, entities(spark), Config()), lifecycle.exit_dormancy(t, entities(spark)), lifecycle.gap_entropy(t)):
        lines = df._jdf.queryExecution().sparkPlan().toString().splitlines()
        windows = [(i, re.search(r"windowspecdefinition\((wallet#\d+)(, segment#\d+L?)?, ", line)) for i, line in enumerate(lines) if re.search(r"\bWindow \[", line)]
        assert windows and all(m for _, m in windows)
        for i, m in windows:
            if not m[2]:
                assert any(re.search(r"Aggregate\(keys?=\[wallet#\d+, segment#", x) for x in lines[i + 1 :])
        # and each aggregate by wallet alone is preceded by its own part in the tasks that read the rows
        assert all("partial" in " ".join(lines[i + 1 :]) for i, x in enumerate(lines) if re.search(r"Aggregate\(keys?=\[wallet#\d+\], functions=\[(?!partial)", x))
    by = t.groupBy("wallet", segments.place()).count().agg(F.max("count").alias("m")).first().m
    assert by < len(rows) / 4  # the busiest segment, of a wallet with a third of all rows


def test_busy_wallets_in_parts(spark):
    """Features that were taken from a wallet's rows in order, against its rows in order; no window holds a wallet's rows."""
    import random
    import re

    rng = random.Random(12)
    rows = [r for w in ("hot", "w1", "w2") for r in (deploy(w, 300 * DAY, f"k{w}"), deploy(w, 300 * DAY, f"x{w}"), deploy(w, 420 * DAY), deploy(w, 424 * DAY))]
    for i in range(1500):
        w = "hot" if i % 3 else f"w{i % 5}"
        at, k = rng.choice([rng.randrange(0, 500 * DAY), 300 * DAY, 310 * DAY + rng.randrange(3 * DAY), 420 * DAY - rng.randrange(3 * DAY)]), f"k{w}"
        extra = {"stream": int(rng.random() < 0.2), "input": rng.choice(["0x", "0xbaa2abde" + "0" * 64, "0x02751cec" + "0" * 64])}
        rows.append((w, at, *rng.choice([(w, f"d{rng.randrange(60)}"), (w, "dex"), (w, k), (f"s{i % 9}", w), (k, w)]), rng.choice([0.00001, 0.5, 1.0, 3.3, 12.0]), extra))
    t, ents, firsts = tx(spark, *rows).repartition(5), entities(spark, ("dex", "DEX"), *[(f"d{i}", "CEX") for i in range(0, 60, 4)]), ages(spark, *[(f"d{i}", (280 + i) * DAY) for i in range(0, 60, 3)])
    cash, value = lifecycle.cashout_features(t, ents, firsts), lifecycle.value_features(t)
    got, vals = {r.wallet: r for r in cash.collect()}, {r.wallet: r for r in value.collect()}
    kinds, seen = {"dex"} | {f"d{i}" for i in range(0, 60, 4)}, {f"d{i}": (280 + i) * DAY for i in range(0, 60, 3)}
    assert set(got) == {"hot", "w1", "w2"} and set(vals) == {r[0] for r in rows}
    jaccard = {r.wallet: r.vs5 for r in lifecycle.seed_jaccard(t).collect()}
    for w in vals:
        full = [(r[1], (r[5] if len(r) > 5 else {}).get("stream", 0), n, r[2], r[3], r[4], (r[5] if len(r) > 5 else {}).get("input", "0x")) for n, r in enumerate(rows) if r[0] == w]
        mine, k = sorted(full), f"k{w}"
        amounts = sorted(([r[5] for r in mine if r[4] == w and r[3] != w].count(v) for v in (0.00001, 0.5, 1.0, 3.3, 12.0)), reverse=True)
        assert vals[w].vs1_mode_freq_ratio == pytest.approx(amounts[0] / sum(amounts)) and vals[w].vs1_top2_coverage == pytest.approx(sum(amounts[:2]) / sum(amounts))
        if w not in got:
            assert vals[w].vs4_pre_cashout_dust_count == 0
            continue
        drawn = min(r[0] for r in mine if r[3] == k and r[4] == w)
        assert vals[w].vs4_pre_cashout_dust_count == sum(r[3] == w and r[5] == 0.00001 and drawn - DAY <= r[0] <= drawn for r in mine)
        took = next(r for r in mine if r[3] == w and r[0] >= 300 * DAY and r[6][2:10] in ("baa2abde", "02751cec"))
        swaps = [r[0] - took[0] for r in mine if r[3] == w and r[4] == "dex" and r[:3] >= took[:3] and r[0] - took[0] < DAY]
        assert (got[w].cp6_swap_detected, got[w].cp6_swap_latency_sec) == (bool(swaps), swaps[0] if swaps else None)
        dests = {r[4] for r in mine if r[3] == w and r[4] not in ("", k) and r[0] >= 300 * DAY and r[5] > 0}
        unknown = dests - kinds
        assert got[w].cp4_suspicious_destination_count == len(unknown)
        assert got[w].cp4_fresh_wallet_ratio == pytest.approx(sum((300 * DAY - seen[d]) < 7 * DAY for d in unknown if d in seen) / len(dests))
        sets = [{round(r[5], 2) for r in mine if r[4] == w and r[3] != w and d - 72 * 3600 <= r[0] < d} for d in (300 * DAY, 300 * DAY, 420 * DAY, 424 * DAY)]
        pairs = [len(a & b) / len(a | b) for a, b in zip(sets, sets[1:], strict=False) if a | b]
        assert jaccard[w] == pytest.approx(sum(pairs) / len(pairs))
    for df in (cash, value):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert not re.search(r"windowspecdefinition\(wallet#\d+, (?!segment#)", plan)
        assert re.search(r"Join.*\[wallet#\d+, _part#\d+\]", plan)
    dealt = segments.with_wallet(t, t.where("wallet = 'hot'").select("wallet").distinct())
    parts = [len(p) for p in dealt.select("wallet", F.pmod(F.xxhash64("ts", "ord"), F.lit(segments.PARTS)).alias("p")).groupBy("p").agg(F.collect_list("wallet").alias("x")).rdd.map(lambda r: r.x).collect()]
    assert sum(parts) == sum(r[0] == "hot" for r in rows) and max(parts) < sum(parts) / 8


def test_percentiles_of_any_shape(spark):
    """Against numpy, with one value that a third of all rows share, few and many rows, and classes that are null or alone."""
    import random

    import numpy as np

    rng = random.Random(2)
    rows = [(f"w{i}", rng.choice(["bad", "good", None]), 7.0 if i % 3 == 0 else rng.gauss(0, 5), None if i % 2 else float(i)) for i in range(3000)] + [("one", "alone", 1.5, None), ("two", "pair", 1.0, 2.0), ("three", "pair", 2.0, -1.0)]
    frame = spark.createDataFrame(rows, "wallet string, label string, a double, b double").repartition(6)
    got = {(r.feature, r.label): r for r in cohort.feature_stats(frame, ["a", "b"]).collect()}
    for f, at in (("a", 2), ("b", 3)):
        for label in {r[1] for r in rows}:
            xs = [r[at] for r in rows if r[1] == label and r[at] is not None]
            if not xs:
                assert (f, label) not in got
                continue
            r = got[f, label]
            assert r.n == len(xs) and r.min == min(xs) and r.max == max(xs) and abs(r["mean"] - np.mean(xs)) < 1e-9
            assert np.allclose([r.p25, r.p50, r.p75], np.percentile(xs, [25, 50, 75]), atol=1e-9)
    assert cohort.feature_stats(frame.limit(0), ["a"]).count() == 0


def test_values_at_ranks_come_from_few_stretches(spark):
    from ledgerlens import ranks

    rows = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") * 7 % 5000).alias("x"), (1 + F.col("id") % 3).alias("n"))
    flat = sorted(x for r in rows.collect() for x in [r.x] * r.n)
    wanted = [0, 1, 17, len(flat) // 2, len(flat) - 1]
    got = ranks.values_at(rows, ["g"], "x", "n", spark.createDataFrame([("g", k) for k in wanted], "g string, rank long"))
    assert {r.rank: r.value for r in got.collect()} == {k: flat[k] for k in wanted}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one stretch
    try:
        stored = ranks.in_stretches(rows.repartition(4), ["x"], "t")
        again = ranks.values_at(rows, ["g"], "x", "n", spark.createDataFrame([("g", k) for k in wanted], "g string, rank long"))
        assert {r.rank: r.value for r in again.collect()} == {k: flat[k] for k in wanted}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums = {r.stretch: (r.before, r.amount) for r in ranks.before_stretches(stored, F.col("n")).collect()}
    assert len(sums) > 1 and all(sums[s][0] == sum(sums[q][1] for q in sums if q < s) for s in sums)


def test_streaming(spark, tmp_path):
    t0 = 1_700_000_000  # not the epoch: a stream's first watermark is there, and a row at it counts as late
    rows = [("a", t0 + t, "a", f"d{t}", 1.0) for t in (0, 60, 120, 180, 240, 40 * DAY)] + [("b", t0 + 5, "b", "x", 1.0)]
    src = f"file://{tmp_path}/in"
    tx(spark, *rows).coalesce(1).write.parquet(src)
    read = lambda: stream.timed(spark.readStream.schema(TX).parquet(src), "1 day")

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert [(r.wallet, r.gap_days) for r in run(stream.dormancies(read()), "dormant", "append")] == [("a", (40 * DAY - 240) / DAY)]
    assert max(r.n for r in run(stream.bursts(read()), "burst", "update")) == 5
    assert len(run(stream.deduplicated(read().union(read())), "dedup", "append")) == 7
    assert sum(r.n for r in run(stream.activity(read()), "act", "update")) == 7
    assert len({(r.wallet, r.first_ts) for r in run(stream.sessions(read()), "sess", "append")}) == 2  # the last session stays open


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_streaming_shared_funders(spark, tmp_path, rocks):
    """Batches with repeats; then one funder of 100,000 wallets, whose own state is one number."""
    import time

    src, got = f"file://{tmp_path}/in", []

    def arrive(rows):
        rows.coalesce(2).write.mode("append").parquet(src)
        links = spark.readStream.schema("funder string, wallet string").parquet(src)
        q = stream.shared_funders(links).writeStream.foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).outputMode("append")
        q = q.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {o["operatorName"]: o["numRowsTotal"] for p in q.recentProgress[-1:] for o in p["stateOperators"]}

    make = lambda *rows: spark.createDataFrame(rows, "funder string, wallet string")
    arrive(make(("f", "a"), ("g", "a"), ("f", "a")))
    assert got == []
    arrive(make(("f", "b"), ("f", "a"), ("h", "b")))
    arrive(make(("f", "c"), ("f", "b"), ("g", "c"), ("g", "b")))
    assert got[0] == ("b", "f", 1) and ("c", "f", 2) in got and {r[2] for r in got if r[1] == "g"} == {1, 2} and len(got) == 4
    began = time.perf_counter()
    state = arrive(spark.range(100_000).select(F.lit("hot").alias("funder"), F.concat(F.lit("w"), "id").alias("wallet")))
    assert time.perf_counter() - began < 90 and sorted(r[2] for r in got if r[1] == "hot") == list(range(1, 100_000))
    assert state["dedupe"] == 100_000 + 7 and state["transformWithStateInPandasExec"] == 4


def test_streaming_bursts_begin_anywhere(spark, tmp_path):
    t0 = 1_700_000_000 - 1_700_000_000 % 60
    edge = [("a", t0 + t, "a", f"d{t}", 1.0) for t in (59, 130, 200, 280, 358)]
    closed = [("b", t0 + t, "b", f"d{t}", 1.0) for t in (0, 75, 150, 225, 300)]
    wide = [("c", t0 + t, "c", f"d{t}", 1.0) for t in (0, 75, 150, 225, 301)]
    tied = [("d", t0 + 7, "d", "x", 1.0)] * 6 + [("d", t0 + 8, "d", "d", 1.0), ("d", t0 + 8, "x", "d", 1.0), ("d", t0 + 8, "d", "x", 1.0, {"stream": 1})]
    # parts out of order, then one long after: the watermark passes, and the wallet begins anew
    parts = [[*edge[1::2], *closed[:3], *wide], [*edge[::2], *closed[3:], *tied], [("b", t0 + 5 * DAY, "b", "y", 1.0)], [("a", t0 + 5 * DAY + t, "a", "z", 1.0) for t in (0, 299, 300, 300, 300)], [("a", t0 + 5 * DAY + 301, "a", "z", 1.0)]]
    src, got = f"file://{tmp_path}/in", []
    for rows in parts:
        tx(spark, *rows).coalesce(1).write.mode("append").parquet(src)
        q = stream.bursts(stream.timed(spark.readStream.schema(TX).parquet(src), "1 day")).writeStream.foreachBatch(lambda b, _: got.extend(map(tuple, b.collect())))
        q.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    u = t0 + 5 * DAY
    assert sorted(got) == [("a", t0 + 59, 5), ("a", u, 5), ("a", u + 299, 5), ("b", t0, 5), ("d", t0 + 7, 6)]
    latest = {(w, s): n for w, s, n in got}
    every = tx(spark, *[r for rows in parts for r in rows])
    batch = {r.wallet: r.metric for r in aml.rapid_burst(every).collect() if r.severity}
    assert batch == {w: max(n for (x, _), n in latest.items() if x == w) for w, _ in latest}


def plain_keccak(message):
    """Keccak-256 with integers, written from the sponge's definition."""
    rate, mask = 136, (1 << 64) - 1
    data = message + b"\x01" + b"\0" * (-(len(message) + 1) % rate)
    data = data[:-1] + bytes([data[-1] | 128])
    lanes = {(x, y): 0 for x in range(5) for y in range(5)}
    turn = lambda v, n: ((v << n % 64) | (v >> (64 - n % 64))) & mask
    for at in range(0, len(data), rate):
        for i in range(rate // 8):
            lanes[i % 5, i // 5] ^= int.from_bytes(data[at + 8 * i : at + 8 * i + 8], "little")
        bit = 1
        for _ in range(24):
            c = [lanes[x, 0] ^ lanes[x, 1] ^ lanes[x, 2] ^ lanes[x, 3] ^ lanes[x, 4] for x in range(5)]
            lanes = {(x, y): v ^ c[(x - 1) % 5] ^ turn(c[(x + 1) % 5], 1) for (x, y), v in lanes.items()}
            x, y, held = 1, 0, lanes[1, 0]
            for t in range(24):
                x, y = y, (2 * x + 3 * y) % 5
                held, lanes[x, y] = lanes[x, y], turn(held, (t + 1) * (t + 2) // 2)
            lanes = {(x, y): lanes[x, y] ^ (~lanes[(x + 1) % 5, y] & mask & lanes[(x + 2) % 5, y]) for x, y in lanes}
            for j in range(7):
                lanes[0, 0] ^= (bit & 1) << (2**j - 1)
                bit = (bit << 1) ^ (0x171 if bit & 128 else 0)
    return b"".join(lanes[i, 0].to_bytes(8, "little") for i in range(4))


def test_keccak_of_any_length():
    import random

    rng = random.Random(7)
    messages = [rng.randbytes(n) for n in [*range(0, 140), 271, 272, 273, 1000]]
    assert [bytes(d) for d in keccak.keccak256(messages)] == [plain_keccak(m) for m in messages]
    assert keccak.keccak256([b""])[0].tobytes().hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak.keccak256([]).shape == (0, 32) and keccak.checksummed([]) == []


#: Addresses that the standard publishes with their checksums.
PUBLISHED = ["0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "0xfB6916095ca1df60bB79Ce92cE3Ea74c37c5d359", "0xdbF03B407c01E7cD3CBea99509d93f8DDDC8C6FB", "0xD1220A0cf47c7B9Be7A2E6BA89F429762e7b9aDb"]


def test_checksummed_addresses(spark):
    """Published forms, each in lower, upper and a wrong case, beside what isn't an address; a column of the same name is replaced."""
    swapped = lambda a: a[:2] + a[2:].swapcase()
    rows = [(f(a), a, form) for a in PUBLISHED for f, form in ((str, "checksummed"), (str.lower, "lower"), (lambda a: a[:2] + a[2:].upper(), "upper"), (swapped, "wrong"))]
    rows += [("0x" + "1" * 40, "0x" + "1" * 40, "checksummed"), *[(x, None, "invalid") for x in (None, "", "0x", "0x" + "a" * 39, "0x" + "a" * 41, "0x" + "g" * 40, "0X" + "a" * 40, " 0x" + "a" * 40)]]
    frame = spark.createDataFrame([(i, a, "x") for i, (a, *_) in enumerate(rows)], "i int, address string, form string").repartition(3)
    got = {r.i: (r.checksum, r.form) for r in keccak.checksum_addresses(frame).collect()}
    assert [got[i] for i in range(len(rows))] == [(c, f) for _, c, f in rows]
    assert keccak.checksum_addresses(frame.limit(0)).count() == 0
    plan = keccak.checksum_addresses(frame)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "BatchEvalPython" not in plan


def test_checksums_by_hand(spark, tiny):
    """The registered query against the plain digest."""
    import __spark_entry__ as e

    rows = e.queries()["checksum_addresses"](spark, tiny).collect()
    for r in rows:
        digits = r.address[2:].lower()
        if len(digits) != 40 or set(digits) - set("0123456789abcdef"):
            assert (r.checksum, r.form) == (None, "invalid")
            continue
        digest = plain_keccak(digits.encode()).hex()
        want = "0x" + "".join(c.upper() if int(h, 16) > 7 else c for c, h in zip(digits, digest, strict=False))
        assert r.checksum == want
    assert {r.form for r in rows} == {"lower", "upper", "wrong", "invalid"}
