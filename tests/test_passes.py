"""How often queries go through their tables, and that cheaper forms say the same."""

import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import aml, cohort, lifecycle, rules, segments
from ledgerlens.schema import ROUND_AMOUNTS, Config
from ledgerlens.scratch import materialise, together
from ledgerlens.sources import demo_chain as demo
from test_reference import busy_wallets, entities, facts_by_hand, tx


@pytest.mark.parametrize("name", ["aml_findings", "aml_risk_orders", "investigation_risk", "template_reports"])
def test_orders_are_joined_once(spark, tiny, name):
    import __spark_entry__ as e

    plan = e.queries()[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") == 0  # the joined table is stored


@pytest.mark.parametrize("least", [1, 60, 10**9])
def test_facts_whichever_wallets_are_busy(spark, least):
    """All wallets in segments, some, none: the facts are those of each wallet's rows in order."""
    rows, c = busy_wallets(), Config(as_of=1500 * 86400, bucket_days=20.0)
    want = facts_by_hand(rows, c)
    got = {r.wallet: r.asDict() for r in aml.aml_facts(tx(spark, *rows).repartition(5), entities(spark), c, least=least).collect()}
    assert set(got) == set(want)
    for w, facts in want.items():
        for f in ("burst", "burst_evidence", "dormant", "dormant_evidence", "activity", "fanout", "large"):
            assert got[w][f] == (pytest.approx(facts[f]) if isinstance(facts[f], float) else facts[f]), (w, f)


def test_quiet_wallets_are_one_segment(spark):
    t = tx(spark, *busy_wallets())
    counts = {r["wallet"]: r["count"] for r in t.groupBy("wallet").count().collect()}
    most = max(counts.values())
    placed = segments.with_overlap_if_busy(t, segments.busy_wallets(t, most), 300).where("own").groupBy("wallet").agg(F.countDistinct("segment").alias("n"), F.count("*").alias("rows")).collect()
    assert {r.wallet: r.rows for r in placed} == counts
    assert all((r.n > 10) == (counts[r.wallet] == most) for r in placed) and all(r.n == 1 for r in placed if counts[r.wallet] < most)


def test_round_amounts_without_lambda(spark):
    """The same amounts as when the list is gone through, in code that Spark can compile."""
    rng = random.Random(5)
    values = [x * (1 + d) for x in ROUND_AMOUNTS for d in (0, 9e-5, -9e-5, 1.1e-4, -1.1e-4, 1e-4, -1e-4)] + [0.0, 0.005, None] + [rng.uniform(0, 120) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.round_amount(F.col("v")).alias("a"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    for v, a in df.collect():
        assert a == (None if v is None or v < 0.01 else next((x for x in ROUND_AMOUNTS if abs(v - x) / x <= 1e-4), None)), v


def test_families_of_features_side_by_side(spark):
    """Each waits for the other: one after the other they would never meet."""
    meet = threading.Barrier(2, timeout=60)

    def made(n):
        meet.wait()
        return materialise(spark.range(n), "range")

    a, b = together(lambda: made(2), lambda: made(3))
    assert (a.count(), b.count()) == (2, 3)


def test_rows_by_role(spark, tiny):
    """Deployments and calls are the same from a table in folders of their roles, whose other folders stay unread."""
    plain = demo.events_tx(spark, tiny)
    stored = materialise(lifecycle.with_role(plain), "tx", "role")
    key = lambda df: sorted(map(tuple, df.select("wallet", F.col("ord") if "ord" in df.columns else "d_ord").collect()))
    for f, folders in ((lifecycle.outgoing, {"made", "call"}), (lifecycle.calls_of, {"call"}), (lifecycle.deployments, {"made"})):
        got = f(stored)
        assert key(got) == key(f(plain)) != []
        assert {p.split("role=")[1].split("/")[0] for (p,) in got.select(F.input_file_name()).distinct().collect()} == folders
        assert "PartitionFilters: [role" in got._jdf.queryExecution().executedPlan().toString().replace("isnotnull(", "")


@pytest.mark.parametrize("made", [lambda t, e, a: lifecycle.cashout_features(t, e, a), lambda t, e, a: lifecycle.value_features(t)])
def test_wallet_aggregates_are_numbers(spark, tiny, made):
    """The aggregate over all rows holds nothing that makes Spark sort for it."""
    plan = made(demo.events_tx(spark, tiny), demo.entities(spark), demo.wallet_age(spark))._jdf.queryExecution().sparkPlan().toString()
    main = [x for x in plan.splitlines() if "Aggregate(" in x and "stddev_samp" in x]
    assert main and all("HashAggregate" in x for x in main)


def test_selectors_without_pattern(spark):
    texts = ["0xA9059CBB00", "0Xa9059cbb", "a9059cbb", "a9059cb", "0xa9059cb", "0x", "", None, "0x0xa9059cbb"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", S.selector(F.col("t")).alias("s"))
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
    for t, s in df.collect():
        bare = None if t is None else t.lower().removeprefix("0x")
        assert s == (bare[:8] if bare and len(bare) >= 8 else None), t


def below(plan, mark):
    """The first line of a plan with ``mark``, and those below it."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if mark in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    end = next((i for i in range(at + 1, len(lines)) if depth(lines[i]) <= depth(lines[at])), len(lines))
    return lines[at:end]


@pytest.mark.parametrize("made", [lambda t, e, a: lifecycle.cashout_features(t, e, a), lambda t, e, a: lifecycle.value_features(t)])
def test_rows_that_know_their_first_deployment(spark, tiny, made):
    """They say the same, and are summed where they are read: no shuffle for what is known of the wallet."""
    plain, known = demo.events_tx(spark, tiny), materialise(demo.events_tx(spark, tiny, first=True), "tx")
    firsts = {r.wallet: (r.k0, r.d0) for r in lifecycle.first_deployment(plain).collect()}
    assert {r.wallet: (r.k0, r.d0) for r in known.where("d0 IS NOT NULL").select("wallet", "k0", "d0").distinct().collect()} == firsts
    more = known.select(*plain.columns).withColumn("wallet", F.concat(F.lit("x"), "wallet")).where("contract = ''")  # no deployment
    plain, known = plain.unionByName(more), known.unionByName(more.withColumns({"k0": F.lit(None).cast("string"), "d0": F.lit(None).cast("long")}))
    ent, ages = demo.entities(spark), demo.wallet_age(spark)
    rows = lambda t: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in made(t, ent, ages).collect())
    want, got = rows(plain), rows(known)
    assert [[str(v) for v in r] for r in got] == [[str(v) for v in r] for r in want] != []
    explode = lambda t: sum("Generate explode" in x for x in below(made(t, ent, ages)._jdf.queryExecution().optimizedPlan().toString(), "stddev_samp"))
    assert (explode(known), explode(plain)) == (0, 1)


def test_wallets_without_a_name(spark, tmp_path):
    """Rows without a user have a first deployment, too, as in a window."""
    spark.createDataFrame([(1, "2024-01-02 00:00:00", None, "signup", 1.0), (4, "2024-01-03 00:00:00", None, "view", 2.0), (8, "2024-01-03 00:00:00", 5, "view", 2.0)], "event_id long, ts string, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.ord: (r.wallet, r.dst, r.k0) for r in demo.events_tx(spark, str(tmp_path), first=True).collect()}
    assert got == {1: (None, "", "k1"), 4: (None, "k1", "k1"), 8: ("u5", "k-none", None)}
    assert "Window" not in demo.events_tx(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_calls_meet_deployments_once(spark, tiny):
    t = materialise(lifecycle.with_role(demo.events_tx(spark, tiny)), "tx", "role")
    both = {(r.wallet, r.d_ord): (r.n_dry, r.seq) for r in lifecycle.before_deployments(t).collect()}
    dry = {(r.wallet, r.d_ord): r.n_dry for r in lifecycle.dry_runs(t).collect()}
    seqs = {(r.wallet, r.d_ord): r.seq for r in lifecycle.setup_sequences(t).collect()}
    assert both == {k: (dry.get(k, 0), seqs.get(k)) for k in dry.keys() | seqs.keys()} and sum(dry.values()) > 0
    # joins with calls, with funding, with new owners
    assert lifecycle.deploy_features(t)._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 3


@pytest.mark.parametrize("each", [1, 2, 64])
def test_sequences_in_as_many_parts_as_needed(spark, each, monkeypatch):
    """The same mean in any number of parts; a wallet with few sequences isn't copied to all."""
    rng = random.Random(3)
    rows = [(w, i, [rng.choice("abcde") for _ in range(rng.randint(1, 6))]) for w, n in (("p", 2), ("q", 9), ("r", 40)) for i in range(n)]
    seqs = spark.createDataFrame(rows, "wallet string, d_ord long, seq array<string>")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    monkeypatch.setattr(lifecycle, "SEQUENCES", each)
    got = {r.wallet: r.f7 for r in lifecycle.sequence_similarity(None, seqs=seqs).collect()}
    for w in "pqr":
        s = [x for v, _, x in rows if v == w]
        likes = [1 - distance(s[i], s[j]) / max(len(s[i]), len(s[j])) for i in range(len(s)) for j in range(i)]
        assert got[w] == pytest.approx(sum(likes) / len(likes)), w


def test_rules_are_compiled(spark):
    """Java doesn't compile a method of over 8,000 bytes; with all rules and the verdict's sums in it, the code for a row stays below."""
    bools, texts = {"new_a_single_deploy", "fp_shared_funder", "cp5_mixer_contact", "cp6_swap_detected"}, {"fp_first_inbound_source_type"}
    names = sorted({w for _, cases in rules.RULES for cond, _ in cases for w in re.findall(r"\b(?:f[1-7]|fp|cp\d?|vs\d|exit\d|new_a|ownership)_\w+", cond)})
    kind = lambda n: "boolean" if n in bools else "string" if n in texts else "double"
    rows = materialise(spark.range(3).select(F.col("id").cast("string").alias("wallet"), *[F.lit(None).cast(kind(n)).alias(n) for n in names]), "features")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = spark._jvm.PythonSQLUtils.explainString(rules.verdicts(rules.evaluate(rows))._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000, sizes


def test_report_evaluates_rules_once(spark, tmp_path):
    """Sums and lines both read the positives' results, which are stored."""
    res = materialise(spark.createDataFrame([("a", "R1", "HIGH"), ("a", "R2", None), ("b", "R1", None), ("b", "R2", "LOW"), ("c", "R1", "HIGH")], "wallet string, rule_id string, severity string"), "results")
    lab = spark.createDataFrame([("a", "bad"), ("b", "bad"), ("c", "good")], "wallet string, label string")
    report = cohort.rule_report(res, lab)
    assert sorted((r.rule_id, r.part, r.wallet, r.line) for r in report.collect() if r.part < 2) == [
        ("R1", 0, "", "R1  fired on 1 of 2 (50.0%)"), ("R1", 1, "a", "  a  [HIGH]"), ("R2", 0, "", "R2  fired on 1 of 2 (50.0%)"), ("R2", 1, "b", "  b  [LOW]"),
    ]
    assert not any(res._ledgerlens_path.rsplit("/", 1)[1] in f for f in report.inputFiles())
