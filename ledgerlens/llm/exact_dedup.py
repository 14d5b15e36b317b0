"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are the coefficients of a polynomial, read at two fixed points modulo ``2 ** 61 - 1``. Fingerprints of
neighbouring pieces combine: the left one is multiplied by the point to the power of the right one's length. So a piece's
share in its document is its own hash shifted by the bytes that follow it, and a document's fingerprint is a plain sum
over its pieces, in any order and over any tasks. Documents of up to ``HUGE`` bytes are hashed where they are read, the
pieces of larger ones are dealt out over the cluster first.

A fingerprint proves nothing, so the members of each group of equal length and fingerprints are compared chunk by chunk:
their chunks stream through an aggregate by (group, place of the chunk, bytes), which compares the bytes themselves. Copies
meet in each task first, so what many rows share moves once a task. Where a chunk has several contents, the group is
divided by what its members hold at each place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import discard, free_prefix, materialise, ship
from .text import whole

#: The modulus of both fingerprints, a Mersenne prime.
PRIME = 2**61 - 1
#: Bytes of a chunk: what is hashed in one product, moved as one piece, and compared as one value.
CHUNK = 1 << 16
#: Bytes over which a document's pieces are dealt out before they are hashed.
HUGE = 1 << 22
#: A group with more than this part of all rows is joined by broadcast; there are fewer such groups than ``HOT``.
HOT = 1000

_LIMB = 21
_FP = ["total", "f1", "f2"]


def _point(name: str, prime: int) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") % (prime - 1024) + 512


@cache
def points(prime: int = PRIME) -> tuple[int, int]:
    """The two points at which texts are read."""
    return _point("exact dedup, first point", prime), _point("exact dedup, second point", prime)


@cache
def _powers(prime: int) -> np.ndarray:
    """Powers of both points from ``CHUNK - 1`` down to 0, in limbs of 21 bits: sums of bytes times limbs are exact in doubles."""
    out = np.empty((CHUNK, 6))
    for k, x in enumerate(points(prime)):
        power = 1
        for i in range(CHUNK - 1, -1, -1):
            for j in range(3):
                out[i, 3 * k + j] = power >> _LIMB * j & (1 << _LIMB) - 1
            power = power * x % prime
    return out


def chunk_hash(data: np.ndarray, prime: int = PRIME) -> tuple[int, int]:
    """Both hashes of at most ``CHUNK`` bytes."""
    limbs = data.astype(np.float64) @ _powers(prime)[CHUNK - len(data) :]
    n = [int(x) for x in limbs]
    return tuple((n[i] + (n[i + 1] << _LIMB) + (n[i + 2] << 2 * _LIMB)) % prime for i in (0, 3))


def combined(left: tuple[int, int], right: tuple[int, int], right_bytes: int, prime: int = PRIME) -> tuple[int, int]:
    """Hashes of two neighbouring pieces put together."""
    return tuple((a * pow(x, right_bytes, prime) + b) % prime for a, b, x in zip(left, right, points(prime), strict=True))


def fingerprint(data: bytes | np.ndarray, prime: int = PRIME) -> tuple[int, int]:
    """Both hashes of a whole text, chunk after chunk."""
    data, out = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data, (0, 0)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        out = combined(out, chunk_hash(part, prime), len(part), prime)
    return out


def _views(column: pa.Array) -> list[np.ndarray]:
    """Each value's bytes, without a copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _hashed(batches: Iterator[pa.RecordBatch], prime: int) -> Iterator[pa.RecordBatch]:
    """``..., after, data`` to ``..., f1, f2``: hashes of the pieces, shifted by the ``after`` bytes that follow."""
    for batch in batches:
        after, data = batch.column(batch.num_columns - 2).to_pylist(), _views(batch.column(batch.num_columns - 1))
        found = [combined(fingerprint(x, prime), (0, 0), n, prime) for x, n in zip(data, after, strict=True)]
        fs = [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *fs], names=[*batch.schema.names[:-2], "f1", "f2"])


def _slices(batches: Iterator[pa.RecordBatch], prime: int, hashes: bool) -> Iterator[pa.RecordBatch]:
    """``doc_id, key, sha, total, data`` to a row a chunk: ``..., at, after, data``, or ``..., f1, f2, at, data`` with the whole text's hashes."""
    for batch in batches:
        held = batch.columns[:-1]
        data = batch.column(batch.num_columns - 1)
        for i, view in enumerate(_views(data)):
            starts = list(range(0, max(1, len(view)), CHUNK))
            more = [pa.array([x] * len(starts), pa.int64()) for x in fingerprint(view, prime)] if hashes else []
            for a in range(0, len(starts), 64):  # at most 64 chunks in a batch
                part = starts[a : a + 64]
                own = [pa.array([c[i].as_py()] * len(part), c.type) for c in held]
                at = pa.array(part, pa.int64())
                after = [] if hashes else [pa.array([len(view) - min(len(view), s + CHUNK) for s in part], pa.int64())]
                bodies = pa.array([view[s : s + CHUNK].tobytes() for s in part], pa.binary())
                names = [*batch.schema.names[:-1], *(["f1", "f2"] if hashes else []), "at", *([] if hashes else ["after"]), "data"]
                yield pa.RecordBatch.from_arrays([*own, *(x[: len(part)] for x in more), at, *after, bodies], names=names)


_ROW = "doc_id {0}, key long, sha string, total long"


class _Texts:
    """The texts of ``docs(doc_id, text)`` in the forms that the steps need."""

    def __init__(self, docs: DataFrame, key: str | None, prime: int, huge: int):
        ship(docs.sparkSession)
        rows = docs.select("doc_id", (F.col(key) if key else F.monotonically_increasing_id()).alias("key"), whole("text").cast("binary").alias("data"))
        rows = rows.select("doc_id", "key", F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("total"), "data")
        self.prime, self.row = prime, _ROW.format(docs.schema["doc_id"].dataType.simpleString())
        self.small, large = rows.where(F.col("total") <= huge), rows.where(F.col("total") > huge)
        if not key:  # numbers of rows of the two parts must differ
            self.small, large = self.small.withColumn("key", 2 * F.col("key")), large.withColumn("key", 2 * F.col("key") + 1)
        cut = large.mapInArrow(partial(_slices, prime=prime, hashes=False), f"{self.row}, at long, after long, data binary")
        #: Pieces of huge documents, stored once, dealt out by piece.
        self.pieces = materialise(cut.repartition("key", "at"), "pieces")

    def fingerprints(self) -> DataFrame:
        """``doc_id, key, sha, total, f1, f2`` for every row."""
        hashed = partial(_hashed, prime=self.prime)
        small = self.small.select("doc_id", "key", "sha", "total", F.lit(0).cast("long").alias("after"), "data")
        small = small.mapInArrow(hashed, f"{self.row}, f1 long, f2 long")
        return small.unionByName(self._large(hashed))

    def _large(self, hashed) -> DataFrame:
        shares = self.pieces.select("doc_id", "key", "sha", "total", "after", "data").mapInArrow(hashed, f"{self.row}, f1 long, f2 long")
        total = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")) % F.lit(self.prime)).cast("long").alias(c)
        return shares.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("sha").alias("sha"), F.first("total").alias("total"), total("f1"), total("f2"))

    def chunks(self, rows: DataFrame) -> DataFrame:
        """``doc_id, key, sha, total, f1, f2, at, data`` for every chunk; ``rows`` are the stored fingerprints."""
        small = self.small.mapInArrow(partial(_slices, prime=self.prime, hashes=True), f"{self.row}, f1 long, f2 long, at long, data binary")
        large = self.pieces.drop("after").join(rows.select("key", "f1", "f2"), "key")
        return small.unionByName(large)


def _best() -> Column:
    """The row that stays: largest doc_id, rows without one last, among repeats any one."""
    return F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "key")).alias("best")


def exact_groups(docs: DataFrame, key: str | None = None, prime: int = PRIME, huge: int = HUGE) -> DataFrame:
    """``doc_id, key, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text)``.

    Null texts count as empty, so empty and null texts form one group. Of equal texts the row with the largest doc_id
    stays; rows without doc_id come last, and of rows repeated in full one stays. ``key`` may name a column that tells rows
    apart; otherwise rows are numbered. Other columns aren't looked at; an empty table gives an empty result. ``prime``
    and ``huge`` are for tests: a small modulus makes fingerprints of different texts meet.
    """
    texts = _Texts(docs, key, prime, huge)
    rows = materialise(texts.fingerprints(), "fingerprints")
    groups = materialise(rows.groupBy(*_FP).agg(F.count("*").alias("n")).where("n > 1"), "groups")
    chunks = texts.chunks(rows).join(groups, _FP, "left_semi")
    contents = chunks.groupBy(*_FP, "at", "data").agg(F.count("*").alias("n")).drop("n")
    unlike = materialise(contents.groupBy(*_FP, "at").agg(F.count("*").alias("n")).where("n > 1").select(*_FP).distinct(), "unlike")
    rows = rows.withColumn("part", F.lit(""))
    if not unlike.isEmpty():
        held = materialise(texts.chunks(rows).join(unlike, _FP, "left_semi"), "unlike-chunks")
        rows = materialise(rows.join(unlike, _FP, "left_anti").unionByName(_divided(held)), "fingerprints")
        discard(held)
    classes = [*_FP, "part"]
    known = materialise(rows.groupBy(*classes).agg(F.count("*").alias("n"), _best()).where("n > 1").select(*classes, "n", "best.*").drop("has"), "classes")
    discard(texts.pieces, groups, unlike)
    known = known.withColumnsRenamed({"doc_id": "keep_id", "key": "keep_key"})
    found = _joined(rows, known, classes)
    single = F.col("n").isNull()
    return found.select(
        "doc_id", "key", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("key") == F.col("keep_key"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def _divided(held: DataFrame) -> DataFrame:
    """Rows of groups that aren't alike, with ``part``: the number of what they hold at each place."""
    contents = held.select(*_FP, "at", "data").distinct()
    order = F.row_number().over(Window.partitionBy(*_FP, "at").orderBy("data"))
    numbered = held.join(contents.withColumn("x", order), [*_FP, "at", "data"])
    mine = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p.x.cast("string")))
    return numbered.groupBy("doc_id", "key", "sha", *_FP).agg(mine.alias("part"))


def _joined(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with their class, if they share one. The few classes with over a thousandth of all rows go by broadcast, so
    none of them meets its rows in one task."""
    least = rows.count() // HOT + 1
    same = lambda a: [F.col(f"r.{c}") == F.col(f"{a}.{c}") for c in on]
    hot, cold = known.where(F.col("n") >= least), known.where(F.col("n") < least)
    what = lambda a: [F.col(f"{a}.{c}").alias(c) for c in ("n", "keep_id", "keep_key")]
    first = rows.alias("r").join(F.broadcast(hot).alias("h"), same("h"), "left").select("r.*", *what("h"))
    rest = first.where("n IS NULL").drop("n", "keep_id", "keep_key").alias("r").join(cold.alias("c"), same("c"), "left").select("r.*", *what("c"))
    return first.where("n IS NOT NULL").unionByName(rest)


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. The table is stored once, with a number for each row."""
    key = free_prefix(docs) + "row"
    stored = materialise(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    kept = materialise(exact_groups(stored, key, **options).where("kept").select(F.col("key").alias(key)), "kept")
    out = materialise(stored.join(kept, key, "left_semi").drop(key), "deduplicated")
    discard(stored, kept)
    return out
