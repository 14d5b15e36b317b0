"""Case store: tables that are appended to or change by versions, latest state by event, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

SEVERITY = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def severity_rank(c: Column) -> Column:
    out = F.lit(len(SEVERITY))
    for i, s in reversed(list(enumerate(SEVERITY, 1))):
        out = F.when(c == s, i).otherwise(out)
    return out


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of ordered rows; ``order`` should be total. Size is held between 1 and 100."""
    size, number = max(1, min(100, size)), max(1, number)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def n_pages(total: int, size: int) -> int:
    return -(-total // size) if total else 0


def evidence_page(evidence: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """Gravest first, then newest."""
    return page(evidence, [severity_rank(F.col("severity")), F.desc("detected_at"), F.col("evidence_id")], number, size)


def latest_status(events: DataFrame) -> DataFrame:
    """State of each case after its status events ``(case_id, at, seq, status)``: last status, first start, last end."""
    last = F.max(F.struct("at", "seq", "status"))
    return events.groupBy("case_id").agg(
        last.alias("l"), F.min(F.when(F.col("status") == "RUNNING", F.col("at"))).alias("started_at"), F.max(F.when(F.col("status").isin("DONE", "FAILED"), F.col("at"))).alias("ended_at"), F.count("*").alias("n_events"),
    ).select("case_id", F.col("l.status").alias("status"), "started_at", "ended_at", "n_events")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def insert_new(spark: SparkSession, rows: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Insert what isn't there yet into the versioned table at ``path`` (idempotent, safe beside other writers); the rows that were added."""
    from .versioned import VersionedTable

    table = VersionedTable(spark, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), key, path)
    before = table.version()
    table.insert_new(rows)
    return table.read().join(table.read(before), key, "left_anti")


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Cascading delete: rows whose parent isn't among ``deleted``."""
    return rows.join(deleted.select(key), key, "left_anti")


def dedup_internal(rows: DataFrame) -> DataFrame:
    """Internal transfers fetched twice, once from each side: the first of each (wallet, hash, trace) stays."""
    trace = F.coalesce("trace_id", "log_index", "type", F.lit(""))
    first = F.row_number().over(W.partitionBy("wallet", "tx_hash", trace).orderBy("fetch", "ord"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def newest_first(rows: DataFrame, at: str, key: str, number: int = 1, size: int = 20) -> DataFrame:
    """A page of cases or reports, the newest first."""
    return page(rows, [F.desc(at), F.col(key)], number, size)


def counts(rows: DataFrame, by: list[str], where: Column | str | None = None) -> DataFrame:
    """Rows that meet a predicate, counted by some columns."""
    return (rows if where is None else rows.where(where)).groupBy(*by).agg(F.count("*").alias("n"))


class ReportStore:
    """Reports in a versioned table, one for each investigation: the first that comes stays until it is deleted.

    A graph is attached when it has been laid out, which may be long after its report was written, by another job.
    """

    SCHEMA = "investigation_id string, report_id string, risk_level string, risk_score int, generated_at long, summary string, graph string"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16):
        from .versioned import VersionedTable

        self.table = VersionedTable(spark, self.SCHEMA, ["investigation_id"], path, buckets)

    def add(self, reports: DataFrame, batch: str | None = None) -> bool:
        """Add reports of investigations that have none; of several new ones of an investigation the earliest, then the least id."""
        return self.table.insert_new(reports, batch, ["generated_at", "report_id"])

    def attach_graphs(self, graphs: DataFrame, batch: str | None = None) -> bool:
        """``graphs(investigation_id, graph)`` put in place of the graphs of these reports; those without a report are left out."""
        return self.table.update(graphs.select("investigation_id", "graph"), batch=batch)

    def delete(self, report_ids: DataFrame) -> bool:
        """Delete reports by ``report_id``."""
        return self.table.delete(self.table.read().join(report_ids.select("report_id"), "report_id", "left_semi"))

    def of(self, investigations: DataFrame) -> DataFrame:
        """``investigations`` with their reports, nulls where there is none yet, and ``has_report``."""
        there = self.table.read()
        return investigations.join(there, "investigation_id", "left").withColumn("has_report", F.col("report_id").isNotNull())

    def recent(self, number: int = 1, size: int = 20, risk_level: str | None = None) -> DataFrame:
        """A page of reports, the newest first, of one risk level or of all."""
        rows = self.table.read()
        return newest_first(rows if risk_level is None else rows.where(F.col("risk_level") == risk_level), "generated_at", "report_id", number, size)

    def counts(self) -> DataFrame:
        """Reports by risk level."""
        return counts(self.table.read(), ["risk_level"])


def parsed_json(c: Column, schema: str) -> Column:
    """A JSON blob as a struct; null where it can't be read."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


#: Bounds of a request: field, least, most.
BOUNDS = [("depth", 1, 3), ("lookback_days", 1, 3650), ("max_transactions", 10, 1000)]


def request_faults(requests: DataFrame) -> DataFrame:
    """``requests`` with ``faults``: the fields out of bounds, an address of another form among them; an empty array if all is well."""
    from ..functions.scalars import is_address

    out = lambda c, low, high: F.when(~F.coalesce(F.col(c).between(low, high), F.lit(False)), c)
    found = F.array(F.when(~is_address(F.col("wallet_address")), "wallet_address"), *[out(*b) for b in BOUNDS])
    return requests.withColumn("faults", F.filter(found, lambda x: x.isNotNull()))


def assertions(evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """``problem, n``: evidence without a case, of no known severity, or under an id that occurs again; no row if all is well."""
    lost = evidence.join(cases.select("case_id"), "case_id", "left_anti").select(F.lit("no case").alias("problem"))
    odd = evidence.where(~F.coalesce(F.col("severity").isin(SEVERITY), F.lit(False))).select(F.lit("severity").alias("problem"))
    twice = evidence.groupBy("evidence_id").count().where("count > 1").select(F.lit("repeated id").alias("problem"))
    return lost.unionByName(odd).unionByName(twice).groupBy("problem").agg(F.count("*").alias("n"))
