"""Delta-maintained token totals by source, language and tokenizer version.

Events are signed: an insert adds a document and its tokens, a delete takes them away, a revision takes the old count
away and adds the new one. A batch of events becomes one small table of sums by key, written under the batch's own
name; totals are sums over the batches. Every batch is committed at most once: its sums are written to a folder of
their own and then renamed to the batch's name, which the file system refuses where that name exists, so of two writers
one wins and an attempt that breaks off leaves nothing. Sums are additive, so nothing that was counted is counted again.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .storage import empty, fresh_path, remove, ship

#: Two public tokenizers' ranks, on every machine under the same paths.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
TOKENIZER_MULTI = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the tokenizer's split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest piece given to the tokenizer at a time, in characters; cuts are made before a space only.
PIECE = 20_000

KEY = ["source", "lang", "tokenizer"]
_SUMS = "source string, lang string, tokenizer string, docs long, tokens long"


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    """Tokens of a whole text. Long texts go in pieces cut where a letter precedes a single space and letter, which is
    a boundary of the split pattern in any context."""
    encoding, total, at = _encoding(path), 0, 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        while cut > at and not (text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            break
        total += len(encoding.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(encoding.encode_ordinary(text[at:]))


def _count(batches: Iterator[pa.RecordBatch], paths: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        n = [pa.array([count_tokens(t or "", path) for t in texts], pa.int64()) for path in paths]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *n], names=[*batch.schema.names[:-1], *[f"n{i}" for i in range(len(paths))]])


def with_token_counts(docs: DataFrame, tokenizers: dict[str, str] | str = TOKENIZER) -> DataFrame:
    """``docs`` with a token count in place of ``text``: ``n_tokens``, or one column for each of ``{column: path}``.

    Null and empty texts have no tokens. All other columns stay, but those named like the added ones are replaced;
    repeated rows are counted each; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    named = {"n_tokens": tokenizers} if isinstance(tokenizers, str) else tokenizers
    added = {"text", *(n.lower() for n in named)}
    rest = F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]).alias("row")
    kept = docs.select(rest, docs["text"].cast("string").alias("text"))
    made = [f"n{i}" for i in range(len(named))]
    counted = kept.mapInArrow(partial(_count, paths=tuple(named.values())), kept.drop("text").withColumns({n: F.lit(0).cast("long") for n in made}).schema)
    return counted.select("row.*", *made).toDF("zero", *[c for c in docs.columns if c.lower() not in added], *named).drop("zero")


def inserts(counts: DataFrame, tokenizer: str, tokens: str = "n_tokens") -> DataFrame:
    """Events that add the documents of ``counts(source, lang, <tokens>)``."""
    return _signed(counts, tokenizer, F.lit(1), F.col(tokens))


def deletes(counts: DataFrame, tokenizer: str, tokens: str = "n_tokens") -> DataFrame:
    """Events that take documents away again."""
    return _signed(counts, tokenizer, F.lit(-1), -F.col(tokens))


def revisions(changed: DataFrame, tokenizer: str, old: str = "old_tokens", new: str = "n_tokens") -> DataFrame:
    """Events for ``changed(source, lang, <old>, <new>)``: documents counted anew."""
    return _signed(changed, tokenizer, F.lit(0), F.col(new) - F.col(old))


def _signed(rows: DataFrame, tokenizer: str, docs: Column, tokens: Column) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), docs.cast("long").alias("docs"), tokens.cast("long").alias("tokens"))


def _mark(sums: DataFrame) -> tuple:
    """Equal for equal sums."""
    return tuple(sums.agg(F.count("*"), F.sum(F.xxhash64(*KEY, "docs", "tokens").cast("decimal(38,0)"))).first())


class TokenRollup:
    """Committed batches in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "rollup")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def committed(self) -> list[str]:
        """Names of committed batches, those that were compacted among them."""
        fs, at = self._fs(self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def _read(self, batch: str) -> DataFrame:
        return self.spark.read.schema(_SUMS).parquet(f"{self.path}/batch={batch}")

    def _rename(self, source: str, target: str) -> bool:
        """Move a folder to a name that doesn't exist yet, in one step of the file system; False if it does."""
        jvm = self.spark._jvm
        where = self._fs(target)[1]
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            context.rename(self._fs(source)[1], where, self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception:
            if self._fs(target)[0].exists(where):
                return False
            raise
        return True

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Sum the events of a batch and commit them; False if that batch had been committed before.

        A batch that comes again must hold the same sums; one with others under a committed name is an error. Null
        sources and languages are keys of their own; a batch without events is committed too.
        """
        if not batch or "/" in batch:
            raise ValueError(f"not a batch name: {batch!r}")
        attempt = f"{self.path}/attempt-{uuid.uuid4().hex}"
        sums = events.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.parquet(attempt)
        if self._rename(attempt, f"{self.path}/batch={batch}"):
            return True
        same = _mark(self.spark.read.schema(_SUMS).parquet(attempt)) == _mark(self._read(batch))
        remove(self.spark, attempt)
        if not same:
            raise ValueError(f"batch {batch!r} was committed with other events")
        return False

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over all committed batches; keys that came to nothing are left out."""
        names = self.committed()
        rows = self.spark.read.schema(_SUMS).parquet(*[f"{self.path}/batch={b}" for b in names]) if names else empty(self.spark, _SUMS)
        sums = rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")
