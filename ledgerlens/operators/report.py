"""Texts and summaries at the end of an investigation: findings in words, context of a case, template report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .aml import FACTS, aml_facts, reasoning, severity_of
from ..schema import DEFAULT, Config

ADVICE = {
    "CRITICAL": "Freeze what can be frozen and report the case.", "HIGH": "Review all large and recent transfers by hand.",
    "MEDIUM": "Watch the wallet and its counterparties.", "LOW": "No action is needed.",
}


def findings(tx: DataFrame, entities: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """``wallet, rule_id, severity, evidence, reasoning`` of every rule that fired."""
    each = F.array(*[F.struct(F.lit(r).alias("rule_id"), severity_of(f, c).alias("severity"), F.col(f"{f}_evidence").alias("evidence"), reasoning(f).alias("reasoning")) for r, f in FACTS.items()])
    return aml_facts(tx, entities, c).select("wallet", F.explode(each).alias("x")).select("wallet", "x.*").where("severity IS NOT NULL")


def context(risks: DataFrame, stats: DataFrame, found: DataFrame, traced: DataFrame, entities: DataFrame, log: DataFrame, most_labels: int = 10, last_steps: int = 5) -> DataFrame:
    """One row a wallet with what a report may draw on: risk, statistics, findings, evidence, trace, recent steps.

    ``traced(root, node, depth, decision, reason)`` is a trace's outcome and ``log(wallet, step, note)`` the steps of the
    investigation. Labels and steps are cut to the first and last few by ranks, so no list grows with the case.
    """
    kinds = traced.join(entities.select(F.col("address").alias("node"), "type"), "node", "left")
    has = lambda t: F.count_if(F.col("type") == t)
    seen = kinds.groupBy(F.col("root").alias("wallet")).agg(
        F.count("*").alias("n_traced"), F.max("depth").alias("max_depth"), has("MIXER").alias("mixer_contacts"), has("CEX").alias("cex_contacts"), has("BRIDGE").alias("bridge_contacts"),
        F.count_if(F.col("reason") == "fanout").alias("high_fanout_nodes"),
    )
    labels = _first(kinds.where("type IS NOT NULL").select(F.col("root").alias("wallet"), F.concat_ws(" ", "type", "node").alias("x"), "depth"), most_labels, [F.col("depth"), F.col("x")], "notable")
    steps = _first(log.select("wallet", F.concat_ws(" ", "step", "note").alias("x"), "step"), last_steps, [F.desc("step"), F.col("x")], "recent_steps")
    folded = found.groupBy("wallet").agg(F.count("*").alias("n_findings"), F.concat_ws(",", F.array_sort(F.collect_list("rule_id"))).alias("rules"))
    out = risks.join(stats, "wallet", "left")
    for part in (folded, seen, labels, steps):
        out = out.join(part, "wallet", "left")
    return out.na.fill(0, ["n_findings", "n_traced", "max_depth", "mixer_contacts", "cex_contacts", "bridge_contacts", "high_fanout_nodes"]).na.fill("", ["rules", "notable", "recent_steps"])


def _first(rows: DataFrame, most: int, order: list[Column], name: str) -> DataFrame:
    """``wallet, name``: the first few ``x`` of each wallet in order, joined by semicolons."""
    from .aml import top_by

    top = top_by(rows, "wallet", order, most)
    return top.groupBy("wallet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda r: r.x), "; ").alias(name))


def template_report(context: DataFrame) -> DataFrame:
    """``wallet, title, summary, advice``: a report in fixed words, for every row of a context with risk and finding counts."""
    advice = F.col("risk_level")
    for level, text in ADVICE.items():
        advice = F.when(F.col("risk_level") == level, text).otherwise(advice)
    summary = F.format_string("%s scores %d of 100 (%s): %d findings in %d transactions.", "wallet", "risk_score", "risk_level", "n_findings", "n_tx")
    return context.select("wallet", F.concat(F.lit("Wallet "), F.substring("wallet", 1, 10)).alias("title"), summary.alias("summary"), advice.alias("advice"))


def narrative(features: DataFrame) -> DataFrame:
    """``wallet, burstiness, entropy, similarity, sources``: features that raise no alarm, in words; null where undefined.

    A mean that lies half-way between two numbers of four digits comes out a little above or below, as its sum's order has it;
    ten digits are taken first, so that the half is one again and is rounded up.
    """
    f = F.col
    number = lambda c: F.format_string("%.4f", F.round(F.round(c, 10), 4))
    said = lambda c, text: F.when(f(c).isNotNull(), text)
    return features.select(
        "wallet",
        said("f4_burstiness", F.concat(number("f4_burstiness"), F.when(f("f4_burstiness") > 0.1, " high: deployments come in clusters").otherwise(" low: deployments are spread out"))).alias("burstiness"),
        said("f5_nonce_entropy", F.concat(number("f5_nonce_entropy"), F.when(f("f5_nonce_entropy") < 3, " bits: gaps look scripted").otherwise(" bits: gaps vary"))).alias("entropy"),
        said("f7_within_wallet_sim", F.concat(number("f7_within_wallet_sim"), F.lit(" mean likeness of setups"))).alias("similarity"),
        F.format_string("%d sources of funds", f("funding_source_count").cast("long")).alias("sources"),
    )
