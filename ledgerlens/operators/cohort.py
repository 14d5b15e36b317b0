"""Cohort analytics over features, rule results and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..ranks import values_at
from ..scratch import materialise


def unpivot(features: DataFrame, names: list[str], ids: list[str]) -> DataFrame:
    """``ids..., feature, x`` of numeric columns."""
    return features.select(*ids, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(ids, names, "feature", "x")


#: The quartiles of a feature.
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def feature_stats(features: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    """Count, quartiles and range of each feature by class; percentiles are interpolated linearly.

    Equal values are counted first, and order statistics come from stretches of the values in order: no task holds all
    values of a class. Ranks that are wanted are six for each row of the result.
    """
    return _stats(_counted(features, names, label), label)


def _counted(features: DataFrame, names: list[str], label: str) -> DataFrame:
    """``feature, <label>, x, k``: how often each value occurs."""
    return materialise(unpivot(features, names, [label]).where("x IS NOT NULL").groupBy("feature", label, "x").agg(F.count("*").alias("k")), "values")


def _stats(counted: DataFrame, label: str) -> DataFrame:
    by = ["feature", label]
    stats = counted.groupBy(*by).agg(F.sum("k").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("k")) / F.sum("k")).alias("mean"))
    stats = materialise(stats, "stats")
    at = lambda q: (F.col("n") - 1) * F.lit(q)
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(at(q)), F.ceil(at(q))) for q in QUARTILES.values()]))
    found = values_at(counted, by, "x", "k", stats.select(*by, F.explode(ranks).alias("rank")))
    held = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    value = lambda r: F.element_at("at", r.cast("long"))
    out = stats.alias("s").join(held.alias("h"), [F.col(f"s.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by]).select("s.*", "h.at")
    low = {p: value(F.floor(at(q))) for p, q in QUARTILES.items()}
    point = {p: F.when(F.floor(at(q)) == at(q), low[p]).otherwise(low[p] + (at(q) - F.floor(at(q))) * (value(F.ceil(at(q))) - low[p])) for p, q in QUARTILES.items()}
    return out.select(*by, "n", *[x.alias(p) for p, x in point.items()], "min", "max", "mean")


def separation(features: DataFrame, names: list[str], label: str = "label", positive: str = "bad") -> DataFrame:
    """How far the classes' quartile ranges overlap: GOOD under 20 %, FAIR under 40 %, else WEAK."""
    s = feature_stats(features, names, label)
    a = s.where(F.col(label) == positive).select("feature", F.col("p25").alias("a1"), F.col("p75").alias("a3"))
    b = s.where(F.col(label) != positive).select("feature", F.col("p25").alias("b1"), F.col("p75").alias("b3"))
    both = F.greatest(F.lit(0.0), F.least("a3", "b3") - F.greatest("a1", "b1"))
    span = F.greatest("a3", "b3") - F.least("a1", "b1")
    share = F.when(span > 0, both / span).otherwise(1.0)
    return a.join(b, "feature").select("feature", share.alias("overlap"), F.when(share < 0.2, "GOOD").when(share < 0.4, "FAIR").otherwise("WEAK").alias("quality"))


def thresholds(features: DataFrame, names: list[str], label: str = "label", positive: str = "bad", above: tuple[str, ...] = ()) -> DataFrame:
    """``feature, direction, n_positive, n_negative, high, medium, clean, n_wrong, quality``: thresholds as the classes suggest them.

    Small values are suspicious, large ones for the features in ``above``. ``high`` is the positives' median, ``medium`` their
    quartile towards the other class and ``clean`` the other class's quartile towards them. ``n_wrong`` of the others lie on
    the suspicious side of ``high`` (or on it): under 20 % is GOOD, under 40 % FAIR, else WEAK, and UNKNOWN without any. A
    feature without positives has no row; the table has a row a feature, whatever the wallets.
    """
    counted = _counted(features, names, label)
    s = _stats(counted, label)
    up = F.col("feature").isin(list(above))
    mine = s.where(F.col(label) == positive).select("feature", F.col("n").alias("n_positive"), F.col("p50").alias("high"), F.when(up, F.col("p25")).otherwise(F.col("p75")).alias("medium"))
    mine = materialise(mine, "thresholds")
    rest = s.where(F.col(label) != positive).select("feature", F.when(up, F.col("p75")).otherwise(F.col("p25")).alias("clean"))
    values = counted.where(F.col(label) != positive).join(F.broadcast(mine), "feature")  # a row for each of ``names``
    beyond = F.when(up, F.col("x") >= F.col("high")).otherwise(F.col("x") <= F.col("high"))
    wrong = values.groupBy("feature").agg(F.sum("k").alias("n_negative"), F.sum(F.when(beyond, F.col("k")).otherwise(0)).alias("n_wrong"))
    out = mine.join(rest, "feature", "left").join(wrong, "feature", "left").na.fill(0, ["n_negative", "n_wrong"])
    quality = F.when(F.col("n_negative") == 0, "UNKNOWN").when(F.col("n_wrong") * 5 < F.col("n_negative"), "GOOD").when(F.col("n_wrong") * 5 < F.col("n_negative") * 2, "FAIR").otherwise("WEAK")
    return out.select("feature", F.when(up, "above").otherwise("below").alias("direction"), "n_positive", "n_negative", "high", "medium", "clean", "n_wrong", quality.alias("quality"))


def settings_lines(found: DataFrame) -> DataFrame:
    """``feature, place, line``: thresholds as lines of a settings file, four decimals each, under a comment on how far they can be trusted."""
    name = lambda what: F.concat(F.upper("feature"), F.lit(f"_{what}_"), F.when(F.col("direction") == "above", "MIN").otherwise("MAX"))
    value = lambda c: F.coalesce(F.col(c).cast("decimal(38,4)").cast("string"), F.lit("None"))
    note = F.concat(F.lit("# "), "feature", F.lit(": "), "quality", F.lit(", "), F.col("n_wrong").cast("string"), F.lit(" of "), F.col("n_negative").cast("string"), F.lit(" others on the suspicious side"))
    lines = [note, *[F.concat(name(w), F.lit(" = "), value(c)) for w, c in (("HIGH", "high"), ("MEDIUM", "medium"), ("CLEAN", "clean"))]]
    return found.select("feature", F.posexplode(F.array(*lines)).alias("place", "line"))


def rule_report(results: DataFrame, labels: DataFrame, positive: str = "bad") -> DataFrame:
    """``rule_id, part, wallet, line``: a text report on what each rule finds among the positives.

    Part 0 is a rule's heading with its rate, part 1 has a line for each wallet on which it fired, part 2 is its line in the
    table at the end. Sorted by (part = 2, rule_id, part, wallet) the lines are the report; no rule's wallets are gathered.
    The positives' results are stored, as both the sums and the lines read them.
    """
    rows = materialise(results.join(labels.where(F.col("label") == positive), "wallet").select("wallet", "rule_id", "severity"), "positives")
    fired, n = F.count_if(F.col("severity").isNotNull()), F.count("*")
    sums = rows.groupBy("rule_id").agg(fired.alias("fired"), n.alias("n")).withColumn("tenths", F.expr("(2000 * fired + n) div (2 * n)"))
    sums = sums.withColumn("rate", F.expr("concat(tenths div 10, '.', tenths % 10, '%')"))
    head = F.concat("rule_id", F.lit("  fired on "), F.col("fired").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" ("), "rate", F.lit(")"))
    table = F.concat(F.rpad("rule_id", 12, " "), F.lpad("rate", 8, " "))
    two = F.array(F.struct(F.lit(0).alias("part"), head.alias("line")), F.struct(F.lit(2).alias("part"), table.alias("line")))
    ends = sums.select("rule_id", F.explode(two).alias("x")).select("rule_id", "x.part", F.lit("").alias("wallet"), "x.line")
    each = rows.where("severity IS NOT NULL").select("rule_id", F.lit(1).alias("part"), "wallet", F.concat(F.lit("  "), "wallet", F.lit("  ["), "severity", F.lit("]")).alias("line"))
    return ends.unionByName(each)


def write_report(report: DataFrame, path: str) -> None:
    """The lines of :func:`rule_report` as text files whose names' order is the report's."""
    report.orderBy(F.col("part") == 2, "rule_id", "part", "wallet").select("line").write.text(path)


def rule_metrics(results: DataFrame, labels: DataFrame, positive: str = "bad") -> DataFrame:
    """Triggers, true and false positive rates, and precision of each rule."""
    rows = results.join(labels, "wallet").withColumns({"f": F.col("severity").isNotNull(), "p": F.col("label") == positive})
    tp, fp = F.count_if(F.col("f") & F.col("p")), F.count_if(F.col("f") & ~F.col("p"))
    return rows.groupBy("rule_id").agg(
        F.count_if("f").alias("n_fired"), F.try_divide(tp, F.count_if("p")).alias("tp_rate"), F.try_divide(fp, F.count_if(~F.col("p"))).alias("fp_rate"), F.try_divide(tp, tp + fp).alias("precision"),
    )


def verdict_distribution(verdicts: DataFrame, labels: DataFrame, detected: int = 25) -> DataFrame:
    """Wallets by class and verdict, with score extremes and how many count as detected."""
    rows = verdicts.join(labels, "wallet")
    return rows.groupBy("label", "verdict").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= detected).alias("n_detected"), F.avg("score").alias("mean_score"))


def severity_cube(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Fired rules by class, rule and severity, with all subtotals; the grouping id tells subtotals from nulls."""
    rows = results.where("severity IS NOT NULL").join(labels, "wallet")
    return rows.cube("label", "rule_id", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def confusion(verdicts: DataFrame, labels: DataFrame, positive: str = "bad", detected: int = 25) -> DataFrame:
    rows = verdicts.join(labels, "wallet")
    hit = F.when(F.col("label") == positive, F.col("score") >= detected).otherwise(F.col("score") < detected)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_right"))


def matrix(features: DataFrame, digits: int = 6) -> DataFrame:
    """A feature table ready for CSV: doubles rounded, undefined values empty."""
    cols = [F.coalesce((F.round(c, digits) if t in ("double", "float") else F.col(c)).cast("string"), F.lit("")).alias(c) for c, t in features.dtypes if not t.startswith(("array", "struct", "map"))]
    return features.select(*cols)
