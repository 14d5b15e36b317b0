"""Registered queries: every operator family over the driver's tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import keccak
from ..operators import aml, casestore, cohort, graph, lifecycle, report, rules, versioned
from ..schema import ORDER, STRICTER, Config, eth
from ..scratch import fresh_path, materialise, together
from ..sources import demo_chain as demo, explorer

#: The dense demo chain has short bursts and weeks rather than months.
DENSE = Config(burst_count=2, bucket_days=7.0, as_of=1_706_572_800)
AS_OF = 1_735_689_600

E, O = demo.events_tx, demo.orders_tx


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def context(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return demo.entities(spark), demo.wallet_age(spark)


def features(spark: SparkSession, sf: str) -> DataFrame:
    """The whole feature row of every wallet of the dense chain.

    Some fifteen relations read the transactions; they are stored once, and so is each family of features. Families don't
    wait for each other.
    """
    tx, (ent, ages) = materialise(lifecycle.with_role(E(spark, sf, first=True).drop("tx_hash")), "tx", "role"), context(spark)

    def cashed() -> DataFrame:
        cash = materialise(lifecycle.cashout_features(tx, ent, ages), "cash")
        return materialise(cash.join(lifecycle.exit_migration(tx, cash.select("wallet", "cp_victim_inflow_wei"), ages), "wallet", "left"), "cash")

    pre, funding, cash, value, silent = together(
        lambda: materialise(lifecycle.pre_features(tx), "pre"), lambda: materialise(graph.funding_features(tx, ent, ages, demo.NOISE), "funding"), cashed,
        lambda: materialise(lifecycle.value_features(tx), "value"), lambda: materialise(lifecycle.exit_silence(tx, DENSE.as_of).join(lifecycle.exit_dormancy(tx, ent), "wallet", "full"), "silent"),
    )
    out = pre
    for family in (funding, cash, value, silent):
        out = out.join(family, "wallet", "left")
    return out.na.fill(0, ["cp2_withdrawal_count", "cp3_outflow_count", "cp4_suspicious_destination_count", "exit4_bulk_transfer_count"]).na.fill(False, ["cp5_mixer_contact", "cp6_swap_detected"])


def results(spark: SparkSession, sf: str) -> DataFrame:
    return rules.evaluate(features(spark, sf))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """A class for each wallet, by its number."""
    bad = F.substring("wallet", 2, 20).cast("long") % 3 == 0
    return E(spark, sf).select("wallet").distinct().withColumn("label", F.when(bad, "bad").otherwise("good"))


def stored_orders(spark: SparkSession, sf: str) -> DataFrame:
    """What the rules read of the sparse chain, joined once: they and the flags go through it several times."""
    return materialise(O(spark, sf).select("wallet", *ORDER, "src", "dst", "value", eth("value").alias("amount"), "tx_hash"), "tx")


def flagship(spark: SparkSession, sf: str, tx: DataFrame | None = None) -> DataFrame:
    tx, ent, c = stored_orders(spark, sf) if tx is None else tx, demo.entities(spark), Config(as_of=AS_OF)
    return aml.aml_risk(aml.aml_rules(tx, ent, c), aml.entity_flags(tx, ent))


def _tx_classified(spark: SparkSession, sf: str) -> DataFrame:
    rows = aml.normalised(E(spark, sf), demo.entities(spark))
    return rounded(rows.select("wallet", "ord", "direction", "tx_type", "amount", (F.col("gas_used") * F.col("gas_price")).alias("gas_wei"), "src_type", "dst_type"), 9)


def _rule(name: str, spark: SparkSession, sf: str) -> DataFrame:
    ent = demo.entities(spark)
    made = {
        "large": lambda: aml.large_transfer(E(spark, sf)), "burst": lambda: aml.rapid_burst(E(spark, sf), DENSE), "fanout": lambda: aml.high_fanout(O(spark, sf)), "dormant": lambda: aml.dormant_activation(O(spark, sf)),
        "activity": lambda: aml.activity_burst(E(spark, sf), DENSE), "round": lambda: aml.round_numbers(E(spark, sf)), "new": lambda: aml.new_wallet(E(spark, sf), ent, DENSE),
    }
    return rounded(made[name]())


def _fanout_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct recipients over a span of days: exact, and whether the stored sketches come within 3 % (or one)."""
    tx = O(spark, sf)
    sketches = materialise(aml.recipient_sketches(tx), "sketches")
    low, high = 10_000, 10_400
    exact = aml.high_fanout(tx.where(F.expr("ts div 86400").between(low, high))).select("wallet", F.col("metric").cast("long").alias("fanout"))
    estimate = aml.fanout_of_sketches(sketches, low, high).select("wallet", F.col("fanout").alias("estimate"))
    off = F.abs(F.col("estimate") - F.col("fanout"))
    return exact.join(estimate, "wallet", "left").select("wallet", "fanout", F.coalesce(off <= F.greatest(F.lit(1.0), 0.03 * F.col("fanout")), F.lit(False)).alias("close"))


def _funding(name: str, spark: SparkSession, sf: str) -> DataFrame:
    tx, (ent, ages) = E(spark, sf), context(spark)
    links = lambda: graph.upstream_funders(tx, ent, demo.NOISE)
    made = {
        "first": lambda: graph.first_source(tx, ent, ages), "seed": lambda: graph.seed_features(tx, ent, ages), "hops": lambda: graph.min_hops(tx, ent), "upstream": links,
        "shared": lambda: graph.shared_funders(links()), "jaccard": lambda: graph.funder_jaccard(links()),
        "sequential": lambda: graph.shared_funders(links(), "sequential", tx.select("wallet").distinct().withColumn("seq", F.substring("wallet", 2, 20).cast("long"))),
    }
    return rounded(made[name]())


def _exit(name: str, spark: SparkSession, sf: str) -> DataFrame:
    ent, ages = context(spark)
    if name == "silence":
        return lifecycle.exit_silence(O(spark, sf), AS_OF)
    if name == "dormancy":
        rows = lifecycle.exit_dormancy(O(spark, sf), ent)
        return rows.withColumn("exit2_events", F.array_join(F.transform("exit2_events", lambda x: F.concat_ws(":", x.ts.cast("string"), x.gap_days.cast("string"), x.rcs.cast("string"))), ";"))
    cash = lifecycle.cashout_features(E(spark, sf), ent, ages)
    return lifecycle.exit_migration(E(spark, sf), cash.select("wallet", "cp_victim_inflow_wei"), ages)


def _retirement(spark: SparkSession, sf: str) -> DataFrame:
    tx = O(spark, sf)
    rows = lifecycle.exit_silence(tx, AS_OF).join(lifecycle.exit_dormancy(tx, demo.entities(spark)), "wallet")
    score = F.substring("wallet", 2, 20).cast("long") % 100
    likely, label = lifecycle.retirement(score, F.col("exit1_silence_days"), F.col("exit2_dormancy_event_count"))
    return rows.select("wallet", likely.alias("likelihood"), label.alias("label"))


def _verdict(spark: SparkSession, sf: str) -> DataFrame:
    return rules.verdicts(results(spark, sf)).withColumns({
        "fired": F.concat_ws(",", "fired"), "suspicious": rules.is_suspicious(F.col("verdict")),
        "breakdown": F.array_join(F.transform(F.map_entries("breakdown"), lambda x: F.concat_ws(":", x.key, x.value.cast("string"))), ","), "summary": rules.summary_line(),
    })


def _candidates(spark: SparkSession, sf: str, strategy: str = "FORWARD_ONLY") -> DataFrame:
    tx, ent = E(spark, sf), demo.entities(spark)
    flagged = ent.where("type = 'MIXER'").select(F.col("address").alias("other"))
    traced = ent.where("type = 'CEX'").select(F.col("address").alias("other"))
    return graph.trace_scores(tx, traced, flagged, DENSE.as_of, strategy=strategy)


def _ranked(spark: SparkSession, sf: str, strategy: str = "FORWARD_ONLY", k: int = 3) -> DataFrame:
    order: list[Column] = [F.round("score", 9).desc(), F.col("ts"), F.col("ord")]
    return rounded(aml.top_by(_candidates(spark, sf, strategy), "wallet", order, k).drop("ts", "ord"))


def _pruned(spark: SparkSession, sf: str) -> DataFrame:
    rows = _candidates(spark, sf).join(demo.entities(spark).select(F.col("address").alias("other"), "type"), "other", "left")
    number = F.substring("other", 2, 9).cast("int")
    rows = rows.withColumns({"traced": F.col("novelty_score") == 0, "n_nodes": 480 + number, "halt": F.coalesce(F.col("type").isin("MIXER", "BRIDGE"), F.lit(False)), "dex": F.coalesce(F.col("type") == "DEX", F.lit(False)), "n_counterparties": number * 3})
    kept = graph.accept(graph.prune(rows), "wallet", [F.desc("value"), F.col("other")], 500).select("wallet", "other", "rank")
    return graph.prune(rows).select("wallet", "other", "decision", "reason", "sample_size").join(kept, ["wallet", "other"], "left")


def _trace(spark: SparkSession, sf: str) -> DataFrame:
    tx = E(spark, sf)
    return graph.trace(demo.mirrored(tx), tx.select("wallet").distinct(), demo.entities(spark), depth=3, max_nodes=60)


def _ranked_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    order: list[Column] = [F.round("score", 9).desc(), F.col("ts"), F.col("ord")]
    rows = _candidates(spark, sf).withColumn("depth", 1 + F.substring("wallet", 2, 20).cast("int") % 4)
    return graph.top_of_depth(rows, "wallet", order, F.col("depth")).select("wallet", "depth", "other", "rank")


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = lifecycle.value_features(E(spark, sf), demo.tokens(spark, sf))
    return rounded(rows.select("wallet", "vs6_creator_token_fraction", "vs6_mint_to_lp_latency_sec"))


def _no_gas(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lifecycle.cashout_features(E(spark, sf), *context(spark), include_gas=False).select("wallet", "cp7_retained_ratio"))


def _case_of() -> Column:
    return F.concat(F.lit("case"), F.substring("wallet", 2, 20).cast("long") % 40)


def _investigations(spark: SparkSession, sf: str) -> DataFrame:
    """Cases of some wallets each; every third wallet has a verdict of its own, by its number."""
    risks = materialise(flagship(spark, sf), "risks")
    number = F.substring("wallet", 2, 20).cast("long")
    verdict = F.get(F.array(*[F.lit(v) for v in rules.VERDICTS]), (number % 5).cast("int"))
    own = risks.where(number % 3 == 0).select("wallet", verdict.alias("verdict"), (number % 101).alias("score"))
    return aml.investigation(aml.escalated(risks, own), risks.select(_case_of().alias("case_id"), "wallet"))


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    tx = stored_orders(spark, sf)
    counts = tx.groupBy("wallet").agg(F.count("*").alias("n_tx"))
    risks = flagship(spark, sf, tx)
    n = sum((F.col(f"n_{s}") for s in ("critical", "high", "medium", "low")), F.lit(0))
    return report.template_report(risks.join(counts, "wallet").withColumn("n_findings", n))


def _report_context(spark: SparkSession, sf: str) -> DataFrame:
    tx, ent = materialise(E(spark, sf), "tx"), demo.entities(spark)
    risks = aml.aml_risk(aml.aml_rules(tx, ent, DENSE), aml.entity_flags(tx, ent)).select("wallet", "risk_score", "risk_level")
    log = tx.select("wallet", F.col("ord").alias("step"), F.when(F.col("is_error"), "failed").otherwise("read").alias("note"))
    traced = graph.trace(tx, tx.select("wallet").distinct(), ent, depth=1)
    return report.context(risks, aml.wallet_stats(tx, 6).select("wallet", "n_tx", "n_counterparties"), report.findings(tx, ent, DENSE), traced, ent, log)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf}/events.parquet"), F.col("event_id")
    address = F.concat(F.lit("0x"), F.md5(i.cast("string").cast("binary")), F.when(i % 5 == 0, "zz").otherwise("00112233"))
    rows = e.select(i.alias("request_id"), address.alias("wallet_address"), (i % 5).alias("depth"), (i % 4000).alias("lookback_days"), (i % 1200).alias("max_transactions"))
    return casestore.request_faults(rows).select("request_id", F.array_join("faults", ",").alias("faults"))


def _checksums(spark: SparkSession, sf: str) -> DataFrame:
    """An address for each event: in lower case, in upper case, in the case of its own digits' hash, cut short, with a letter that isn't a digit."""
    i = F.col("event_id")
    digits = F.concat(F.md5(i.cast("string").cast("binary")), F.substring(F.md5(F.concat(F.lit("b"), i).cast("binary")), 1, 8))
    form = F.when(i % 7 == 1, F.upper(digits)).when(i % 7 == 2, F.concat(F.upper(F.substring(digits, 1, 20)), F.substring(digits, 21, 20)))
    form = form.when(i % 7 == 3, F.substring(digits, 1, 39)).when(i % 7 == 4, F.concat(F.substring(digits, 1, 39), F.lit("g"))).otherwise(digits)
    rows = spark.read.parquet(f"{sf}/events.parquet").select(i.alias("event_id"), F.concat(F.lit("0x"), form).alias("address"))
    return keccak.checksum_addresses(rows)


def _landed(spark: SparkSession, sf: str) -> str:
    """The dense chain as an explorer would answer for it: pages of five by wallet and range of blocks, some refused, some not JSON."""
    tx = E(spark, sf).withColumn("block", F.col("ts") - 1_704_000_000).withColumn("lo", F.expr(f"block div {explorer.BLOCKS} * {explorer.BLOCKS}"))
    place = F.row_number().over(W.partitionBy("wallet", "lo").orderBy("block", "ord")) - 1
    text = lambda c, n: F.col(c).cast("string").alias(n)
    row = F.struct(text("block", "blockNumber"), text("ts", "timeStamp"), text("tx_hash", "hash"), text("src", "from"), text("dst", "to"), text("value", "value"))
    pages = tx.withColumn("at", place).groupBy("wallet", "lo", F.expr("cast(at div 5 AS int) + 1").alias("page")).agg(F.array_sort(F.collect_list(F.struct("at", row.alias("r")))).alias("x"))
    fault = F.pmod(F.crc32(F.concat_ws(":", "wallet", "lo", "page").cast("binary")), F.lit(10))
    good = F.to_json(F.struct(F.lit("1").alias("status"), F.lit("OK").alias("message"), F.transform("x", lambda x: x.r).alias("result")))
    body = F.when(fault == 0, '{"status": "0", "message": "NOTOK", "result": "Max rate limit reached"}').when(fault == 1, "<html>").otherwise(good)
    path = fresh_path(spark, "explorer")
    explorer.land(pages.select("wallet", F.lit("txlist").alias("action"), "lo", "page", F.lit(5).alias("size"), body.alias("body")), path)
    return path


#: A range of blocks, seconds of the chain, of which the middle folders hold all.
RANGE = (350_000, 1_250_000)


def _explorer_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of twenty rows of each wallet within the range, newest first."""
    rows = explorer.scan(spark, _landed(spark, sf), "txlist", *RANGE, page=2, offset=20, sort="desc")
    return rows.select("wallet", "place", "block", F.col("raw.hash").alias("tx_hash"), F.col("raw.value").try_cast("decimal(38,0)").cast("double").alias("value"))


def _explorer_errors(spark: SparkSession, sf: str) -> DataFrame:
    return explorer.errors(spark, _landed(spark, sf), "txlist", *RANGE)


def _graph(part: int, spark: SparkSession, sf: str) -> DataFrame:
    tx = E(spark, sf)
    flagged = aml.large_transfer(tx).where("severity IS NOT NULL").select("wallet")
    return rounded(graph.graph(tx, flagged)[part])


STAT_FEATURES = ["vs1_mode_freq_ratio", "vs2_round_funding_ratio", "vs3_cv_gas", "vs6_extraction_multiplier"]


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cohort.feature_stats(lifecycle.value_features(E(spark, sf)).join(labels(spark, sf), "wallet"), STAT_FEATURES))


def _separation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cohort.separation(lifecycle.value_features(E(spark, sf)).join(labels(spark, sf), "wallet"), STAT_FEATURES))


def _thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.thresholds(lifecycle.value_features(E(spark, sf)).join(labels(spark, sf), "wallet"), STAT_FEATURES, above=("vs6_extraction_multiplier",))


def _report_store(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of the dense chain's wallets in batches: half of them, all of them with news for those that have one, the first batch again; graphs; high risks out."""
    tx, ent = materialise(E(spark, sf), "tx"), demo.entities(spark)
    number = F.substring("wallet", 2, 20).cast("long")
    risks = materialise(aml.aml_risk(aml.aml_rules(tx, ent, DENSE), aml.entity_flags(tx, ent)).select("wallet", "risk_level", F.col("risk_score").cast("int").alias("risk_score"), number.alias("k")), "risks")
    text = F.concat_ws(" ", "wallet", "risk_level")
    reports = lambda name, score: risks.select(F.col("wallet").alias("investigation_id"), F.concat(F.lit(name), "wallet").alias("report_id"), "risk_level", score.alias("risk_score"), (F.col("k") * 60).alias("generated_at"), text.alias("summary"), F.lit(None).cast("string").alias("graph"))
    store = casestore.ReportStore(spark, buckets=8)
    half = reports("a-", F.col("risk_score")).where("generated_at % 120 = 0")
    store.add(half, "half")
    store.add(reports("b-", F.lit(-1)).unionByName(reports("c-", F.lit(-2))), "all")
    store.add(half, "half")
    graphs = graph.graph_summary(tx).select(F.col("wallet").alias("investigation_id"), F.to_json(F.struct("n_nodes", "n_edges")).alias("graph"))
    store.attach_graphs(graphs)
    store.delete(store.table.read().where("risk_level = 'HIGH'"))
    return store.table.read()


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    grade = F.get(F.array(*[F.lit(s) for s in casestore.SEVERITY]), (F.col("event_id") % 5).cast("int"))
    rows = e.select(F.col("event_id").alias("evidence_id"), F.concat(F.lit("u"), "user_id").alias("case_id"), grade.alias("severity"), F.expr("unix_micros(cast(ts AS timestamp)) div 1000000").alias("detected_at"))
    return casestore.evidence_page(rows, 3, 50)


def _evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    grade = F.get(F.array(*[F.lit(s) for s in [*casestore.SEVERITY, "ODD"]]), (F.col("event_id") % 6).cast("int"))
    return e.select((F.col("event_id") - F.col("event_id") % 97 % 2).alias("evidence_id"), F.col("user_id").alias("case_id"), grade.alias("severity"))


def _evidence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return casestore.counts(_evidence_rows(spark, sf), ["case_id", "severity"], "severity <> 'INFO'")


def _assertions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _evidence_rows(spark, sf)
    return casestore.assertions(rows, rows.select("case_id").distinct().where("case_id % 10 <> 0"))


def _status(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    status = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "DONE").otherwise("RUNNING")
    return casestore.latest_status(e.select(F.col("user_id").alias("case_id"), F.expr("unix_micros(cast(ts AS timestamp)) div 1000000").alias("at"), F.col("event_id").alias("seq"), status.alias("status")))


#: How a case's columns change when a batch brings news of it.
CASE_CHANGES = {
    "status": "CASE WHEN old.status IN ('DONE', 'FAILED') THEN old.status ELSE coalesce(new.status, old.status) END",
    "started_at": "coalesce(old.started_at, new.started_at)", "n_events": "old.n_events + new.n_events",
}


def _case_store(spark: SparkSession, sf: str) -> DataFrame:
    """Cases kept up to date by three batches of events, the second of which comes twice, and those without an end taken out again."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    at = F.expr("unix_micros(cast(ts AS timestamp)) div 1000000")
    status = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "DONE").when(F.col("event_type") == "view", "RUNNING")
    rows = e.select(F.col("user_id").alias("case_id"), F.ntile(3).over(W.partitionBy("user_id").orderBy("event_id")).alias("part"), at.alias("at"), F.col("event_id").alias("seq"), status.alias("status"))
    table = versioned.VersionedTable(spark, "case_id long, status string, started_at long, n_events long", ["case_id"], buckets=8)
    for part in (1, 2, 2, 3):
        news = rows.where(F.col("part") == part).groupBy("case_id").agg(
            F.max(F.when(F.col("status").isNotNull(), F.struct("at", "seq", "status"))).getField("status").alias("status"), F.min(F.when(F.col("status") == "RUNNING", F.col("at"))).alias("started_at"), F.count("*").alias("n_events")
        )
        table.upsert(news, CASE_CHANGES, f"part-{part}")
    table.delete(table.read().where("status NOT IN ('DONE', 'FAILED')"))
    return table.read()


def _ages(spark: SparkSession, sf: str) -> DataFrame:
    """First-seen times kept up to date by three batches out of order, one of which comes twice."""
    tx = E(spark, sf)
    ages = versioned.VersionedTable(spark, "address string, first_ts long", ["address"], buckets=8)
    for part in (1, 2, 1, 0):
        versioned.update_ages(ages, tx.where(F.col("ord") % 3 == part), f"part-{part}")
    return ages.read()


def _internal(spark: SparkSession, sf: str) -> DataFrame:
    tx = E(spark, sf)
    once = tx.select("wallet", "tx_hash", "ord", "src", "dst", F.lit(0).alias("fetch"), F.when(F.col("ord") % 2 == 0, F.col("ord").cast("string")).alias("trace_id"), F.lit(None).cast("string").alias("log_index"), F.lit("call").alias("type"))
    again = once.where("ord % 3 = 0").withColumn("fetch", F.lit(1))
    return casestore.dedup_internal(once.unionByName(again)).groupBy("wallet").agg(F.count("*").alias("n"), F.sum("fetch").alias("n_second"))


QUERIES = {
    "aml_risk_orders": flagship,
    "tx_classified": _tx_classified,
    "wallet_stats": lambda s, d: rounded(aml.wallet_stats(E(s, d), 6)),
    "wallet_stats_orders": lambda s, d: aml.wallet_stats(O(s, d), 6).drop("average"),
    "rule_large_transfer": partial(_rule, "large"), "rule_rapid_burst": partial(_rule, "burst"), "rule_high_fanout": partial(_rule, "fanout"), "rule_dormant_activation": partial(_rule, "dormant"),
    "rule_activity_burst": partial(_rule, "activity"), "rule_round_numbers": partial(_rule, "round"), "rule_new_wallet": partial(_rule, "new"),
    "entity_flags": lambda s, d: aml.entity_flags(E(s, d), demo.entities(s)),
    "deploy_features": lambda s, d: rounded(lifecycle.deploy_features(E(s, d)).withColumn("seq", F.array_join(F.coalesce("seq", F.array().cast("array<string>")), " "))),
    "funding_sources": lambda s, d: lifecycle.funding_sources(E(s, d)),
    "narrative": lambda s, d: report.narrative(lifecycle.pre_features(E(s, d))),
    "value_features_tokens": _tokens, "cashout_without_gas": _no_gas, "trace_rank_by_depth": _ranked_by_depth, "graph_summary": lambda s, d: graph.graph_summary(E(s, d)),
    "investigation_risk": _investigations, "aml_findings": lambda s, d: report.findings(stored_orders(s, d), demo.entities(s), Config(as_of=AS_OF)), "template_reports": _reports, "report_context": _report_context,
    "request_faults": _requests, "evidence_counts": _evidence_counts, "evidence_assertions": _assertions, "rules_primary": lambda s, d: rules.rules_primary(results(s, d)),
    "pre_features": lambda s, d: rounded(lifecycle.pre_features(E(s, d))),
    "ownership_transfers": lambda s, d: lifecycle.ownership_transfers(E(s, d)),
    "fp1_first_source": partial(_funding, "first"), "fp_seed_features": partial(_funding, "seed"), "fp2_min_hops": partial(_funding, "hops"), "upstream_funders": partial(_funding, "upstream"),
    "fp4_shared_funders": partial(_funding, "shared"), "fp4_shared_sequential": partial(_funding, "sequential"), "funder_jaccard": partial(_funding, "jaccard"),
    "cashout_features": lambda s, d: rounded(lifecycle.cashout_features(E(s, d), *context(s)).withColumn("cp_victim_inflow_wei", F.col("cp_victim_inflow_wei").cast("double"))),
    "value_features": lambda s, d: rounded(lifecycle.value_features(E(s, d))),
    "exit1_silence": partial(_exit, "silence"), "exit2_dormancy": partial(_exit, "dormancy"), "exit4_migration": partial(_exit, "migration"), "retirement": _retirement,
    "rule_matrix": results, "verdict": _verdict,
    "trace_rank": _ranked, "trace_rank_backward": partial(_ranked, strategy="BACKWARD_ONLY"), "trace_rank_both": partial(_ranked, strategy="FULL"),
    "rules_with_other_thresholds": lambda s, d: rules.evaluate(features(s, d), rules.rules_of(STRICTER)),
    "prune_decision": _pruned, "bfs_trace": _trace, "graph_nodes": partial(_graph, 0), "graph_edges": partial(_graph, 1),
    "feature_percentiles": _stats, "separation_quality": _separation,
    "rule_metrics": lambda s, d: rounded(cohort.rule_metrics(results(s, d), labels(s, d))),
    "verdict_distribution": lambda s, d: rounded(cohort.verdict_distribution(rules.verdicts(results(s, d)), labels(s, d))),
    "severity_cube": lambda s, d: cohort.severity_cube(results(s, d), labels(s, d)),
    "threshold_derivation": lambda s, d: rounded(_thresholds(s, d)), "threshold_settings": lambda s, d: cohort.settings_lines(_thresholds(s, d)),
    "rule_report": lambda s, d: cohort.rule_report(results(s, d), labels(s, d)), "report_store": _report_store,
    "fanout_by_sketch": _fanout_sketch, "case_store_upserts": _case_store, "wallet_age_incremental": _ages, "explorer_scan": _explorer_scan, "explorer_errors": _explorer_errors, "checksum_addresses": _checksums, "evidence_page": _evidence, "latest_status": _status, "internal_dedup": _internal,
}
