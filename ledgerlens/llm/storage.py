"""What operators share: scratch tables (of the library), shipped code, names of their own."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import discard, fresh_path, materialise, remove, shared_dir  # noqa: F401


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column of ``df`` begins with: names of one's own columns beside it can't clash."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once for each context; they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_ledgerlens_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    into = Path(tempfile.mkdtemp(prefix="spark-")) / "ledgerlens_code.zip"
    with zipfile.ZipFile(into, "w") as z:
        for f in [package / "__init__.py", package / "scratch.py", package / "ranks.py", *sorted((package / "llm").glob("*.py"))]:
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(into))
    context._ledgerlens_shipped = True


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema, as a plan that the optimizer knows to be empty."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields])
