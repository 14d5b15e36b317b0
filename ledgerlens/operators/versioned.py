"""Tables that change by whole versions: keyed buckets, copied on write, and a manifest that is renamed into place.

A version is a small file that names a folder for each bucket. A change reads the buckets that its keys touch, writes them anew
beside the old ones, and renames a new manifest to the next number, which the file system refuses where that number exists. So
of two writers one wins and the other does its change again on what it finds then; readers see a whole version; and a write that
breaks off leaves nothing but a folder that no manifest names. A change may carry a batch's name, which is kept in the manifest:
a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import fresh_path, remove

#: Times that a change is done again when other writers were faster.
ATTEMPTS = 20


class VersionedTable:
    """Rows of ``schema`` with one row a ``key``, in ``path``, a folder that all executors reach.

    Rows with equal keys (nulls are equal, too) are one row; which of several new ones counts is the first in ``order`` of the
    change. The driver handles one path for each of the ``buckets``, whatever the rows.
    """

    def __init__(self, spark: SparkSession, schema: str, key: list[str], path: str | None = None, buckets: int = 16):
        self.spark, self.key, self.path, self.buckets = spark, key, path or fresh_path(spark, "versioned"), buckets
        self.schema = spark.createDataFrame([], schema).schema

    # --- files ---

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """Number of the newest version; 0 before the first change."""
        fs, at = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """``buckets`` (number: folder) and ``batches`` of a version, the newest by default."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": {}, "batches": []}
        fs, at = self._fs(f"{self.path}/v{version:09d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> bool:
        """Put a manifest in place of the next version; False if another writer did."""
        attempt = f"{self.path}/attempt-{uuid.uuid4().hex}"
        fs, at = self._fs(attempt)
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        source, target = at, self._fs(f"{self.path}/v{version:09d}.json")[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception:
            remove(self.spark, attempt)
            if fs.exists(target):
                return False
            raise
        return True

    # --- reading ---

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        return self._rows(self.manifest(version)["buckets"].values())

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # --- changes ---

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _change(self, keys: DataFrame, merge: Callable[[DataFrame], DataFrame], batch: str | None) -> bool:
        """Replace the buckets that ``keys`` touch by ``merge`` of their rows; False if the batch was committed before."""
        touched = [str(r[0]) for r in keys.select(self._bucket()).distinct().collect()]  # at most as many as there are buckets
        for _ in range(ATTEMPTS):
            now = self.manifest()
            if batch is not None and batch in now["batches"]:
                return False
            folder = f"data-{uuid.uuid4().hex}"
            old = self._rows(now["buckets"][b] for b in touched if b in now["buckets"])
            after = merge(old).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
            after.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            fs = self._fs(self.path)[0]
            written = {b: f"{folder}/_bucket={b}" for b in touched if fs.exists(self._fs(f"{self.path}/{folder}/_bucket={b}")[1])}
            buckets = {b: f for b, f in now["buckets"].items() if b not in touched} | written
            if self._publish(now["version"] + 1, {"version": now["version"] + 1, "buckets": buckets, "batches": now["batches"] + ([batch] if batch is not None else [])}):
                return True
            remove(self.spark, f"{self.path}/{folder}")
        raise RuntimeError(f"other writers were faster {ATTEMPTS} times")

    def _first(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """One row a key."""
        rest = [f.name for f in self.schema if f.name not in self.key]
        if not rest:
            return rows.select(*self.key).distinct()
        least = rows.groupBy(*self.key).agg(F.min(F.struct(*order, *[F.col(c) for c in rest if c not in order])).alias("r"))
        return least.select(*self.key, *[F.col(f"r.{c}").alias(c) for c in rest])

    def _same(self, a: str, b: str) -> list[Column]:
        return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.key]

    def insert_new(self, rows: DataFrame, batch: str | None = None, order: list[str] = []) -> bool:  # noqa: B006
        """Insert rows whose key isn't there yet; the others stay as they are."""
        new = self._first(rows, order)
        return self._change(new, lambda old: old.unionByName(new.alias("n").join(old.alias("o"), self._same("n", "o"), "left_anti")), batch)

    def update(self, rows: DataFrame, transitions: dict[str, str] | None = None, batch: str | None = None, order: list[str] = []) -> bool:  # noqa: B006
        """Like :meth:`upsert`, but only rows whose key is there; ``rows`` may lack other columns, which stay."""
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in rows.columns]
        return self.upsert(rows.select("*", *rest), transitions, batch, order, insert=False)

    def upsert(self, rows: DataFrame, transitions: dict[str, str] | None = None, batch: str | None = None, order: list[str] = [], insert: bool = True) -> bool:  # noqa: B006
        """Insert rows (not without ``insert``) or change those of their key.

        ``transitions`` gives SQL over ``old`` and ``new`` for a column of a row that is there; other columns take the new
        value where it isn't null.
        """
        new, transitions = self._first(rows, order), transitions or {}
        there = F.col("o._there").isNotNull()

        def merge(old: DataFrame) -> DataFrame:
            both = new.withColumn("_new", F.lit(1)).alias("n").join(old.withColumn("_there", F.lit(1)).alias("o"), self._same("n", "o"), "full")
            held = both.select(F.struct("n.*").alias("new"), F.struct("o.*").alias("old"), there.alias("there"), F.col("n._new").isNotNull().alias("comes")).where(F.lit(insert) | F.col("there"))
            value = lambda c: F.when(~F.col("there"), F.col(f"new.{c}")).when(~F.col("comes"), F.col(f"old.{c}")).otherwise(F.expr(transitions[c]) if c in transitions else F.coalesce(f"new.{c}", f"old.{c}"))
            return held.select(*[(value(f.name) if f.name not in self.key else F.when(F.col("comes"), F.col(f"new.{f.name}")).otherwise(F.col(f"old.{f.name}"))).alias(f.name) for f in self.schema])

        return self._change(new, merge, batch)

    def delete(self, keys: DataFrame, batch: str | None = None) -> bool:
        """Take out the rows of these keys."""
        gone = keys.select(*self.key).distinct()
        return self._change(gone, lambda old: old.alias("o").join(gone.alias("g"), self._same("o", "g"), "left_anti"), batch)

    def vacuum(self) -> int:
        """Remove folders and attempts that the newest version doesn't name; how many. For when no other writer or reader is at work."""
        fs, at = self._fs(self.path)
        used = {f.split("/")[0] for f in self.manifest()["buckets"].values()}
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        loose = [n for n in names if n.startswith("attempt-") or (n.startswith("data-") and n not in used)]
        for n in loose:
            remove(self.spark, f"{self.path}/{n}")
        return len(loose)


def cascade(parents: VersionedTable, gone: DataFrame, children: list[tuple[VersionedTable, str]]) -> None:
    """Delete parents and the rows of ``children`` (table, column with the parent's key); children first, so none is left alone."""
    (key,) = parents.key
    for table, column in children:
        rows = table.read()
        table.delete(rows.join(gone.select(F.col(key).alias("_gone")).distinct(), rows[column] == F.col("_gone"), "left_semi"))
    parents.delete(gone)


def update_ages(ages: VersionedTable, tx: DataFrame, batch: str) -> bool:
    """Merge a batch of transactions into ``ages(address, first_ts)``: the least time that an address shows up at either end.

    A minimum is all that is kept, so a batch costs the buckets of its addresses, whatever came before; batches may come in
    any order, and one that comes again changes nothing.
    """
    seen = tx.select(F.explode(F.array("src", "dst")).alias("address"), "ts").where("address <> ''").groupBy("address").agg(F.min("ts").alias("first_ts"))
    return ages.upsert(seen, {"first_ts": "least(old.first_ts, new.first_ts)"}, batch)
