"""Near-duplicate classes: MinHash, banding, signature check, exact confirmation, star components.

Plan for large inputs:

* one pass over the texts gives each row the size and a 128-bit hash of its shingle set, its signature and its band
  keys; all that is heavy happens in numpy inside the task that reads the rows;
* rows with equal sets are one class from then on, so thousands of copies cost one row each;
* a bucket (equal band key) is searched in two steps. First all its members are compared with one hub, the member
  that shares most buckets: a number of pairs linear in the rows. Only where a bucket still spans several
  components, its members meet block by block, by signature; those that may be linked across components form
  neighbourhoods, whose members meet once more with their texts. What leaves a group is a forest, never all its
  pairs. No bucket is capped and none is held whole by one task;
* every link is confirmed on the full shingle sets, built again from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordhash
from .components import components
from .storage import discard, free_prefix, materialise, ship

BANDS, ROWS = 40, 5
#: Signature agreement below ``threshold - SLACK`` ends a candidate. Over five standard deviations at 200 minima.
SLACK = 0.15
#: Members of a bucket that meet in one group are at most twice this many.
BLOCK = 2048
#: The same where texts come along.
TEXT_BLOCK = 512

_rng = np.random.default_rng(20240131)
_A = (_rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)

_SKETCH = "doc_id long, n_shingles long, c1 long, c2 long, sig binary, bands array<long>"


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """32-bit minima of ``BANDS * ROWS`` multiply-add-shift hashes, a row for each set with members."""
    out = np.empty((len(first), len(_A)), np.uint32)
    for k in range(len(_A)):
        out[:, k] = np.minimum.reduceat((sets * _A[k] + _B[k]) >> np.uint64(32), first)
    return out


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, b, raw, at in wordhash.blocks(batch.column(1)):
            sets, first = wordhash.shingle_sets(*wordhash.word_hashes(raw, at), k)
            size = np.diff(first)
            some = np.flatnonzero(size)
            c = np.zeros((2, b - a), np.uint64)
            sig = np.zeros((b - a, BANDS * ROWS), np.uint32)
            keys = np.zeros((b - a, BANDS), np.uint64)
            if len(some):
                c[0, some] = np.add.reduceat(wordhash.mix(sets + np.uint64(11)), first[some])
                c[1, some] = np.add.reduceat(wordhash.mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[some])
                sig[some] = signatures(sets, first[some])
                h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), BANDS)).copy()
                rows = sig[some].reshape(len(some), BANDS, ROWS).astype(np.uint64)
                for j in range(ROWS):
                    h = wordhash.mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, j])
                keys[some] = h
            width = BANDS * ROWS * 4
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))), pa.int32()),
                pa.array(keys[some].reshape(-1).view(np.int64)),
            )
            binary = pa.Array.from_buffers(
                pa.binary(), b - a,
                [None, pa.py_buffer((np.arange(b - a + 1) * width).astype(np.int32)), pa.py_buffer(sig)],
            )
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(size, pa.int64()), pa.array(c[0].view(np.int64)),
                 pa.array(c[1].view(np.int64)), binary, bands],
                names=["doc_id", "n_shingles", "c1", "c2", "sig", "bands"],
            )


def _agree(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) whose signatures (columns 2 and 3) agree on that share of places."""
    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
        good = pa.array((left == right).mean(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(good) for i in (0, 1)], names=["u", "v"])


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, in whole numbers."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) whose full shingle sets reach the similarity; texts in columns 2 and 3."""
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            sets = []
            for c in (2, 3):
                _, _, raw, at = next(wordhash.blocks(batch.column(c).slice(i, 1)))
                sets.append(wordhash.shingle_sets(*wordhash.word_hashes(raw, at), k)[0])
            good[i] = _similar(*sets, percent)
        good = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(good) for i in (0, 1)], names=["u", "v"])


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in rows that come sorted by them; a run may straddle batches."""
    held: list[pa.RecordBatch] = []
    tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in key]
        cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], axis=0)) + 1), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(int(x[a]) for x in cols)
            if held and now != tail:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            tail = now
    if held:
        yield pa.Table.from_batches(held)


def _agreeing(t: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(x, ys, shares)``: rows of different components, from the two blocks, whose signatures agree enough."""
    block, i, j = (t.column(c).to_numpy() for c in ("block", "i", "j"))
    comp = t.column("comp").to_numpy()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(comp), -1)
    left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
    for x in left:
        y = right[right > x] if i[0] == j[0] else right
        y = y[comp[y] != comp[x]]
        if len(y):
            share = (sig[y] == sig[x]).mean(axis=1)
            good = share >= least
            if good.any():
                yield int(x), y[good], share[good]


def _meet(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Which members of a group (bucket, block pair) may be linked: each with the least one it leads to.

    Every pair of rows of different components is compared by signature; what leaves is one row a member at most.
    """
    for t in _groups(batches, ["bkey", "i", "j"]):
        node = t.column("node").to_numpy()
        us, vs = [], []
        for x, ys, _ in _agreeing(t, least):
            us.append(np.full(len(ys), x))
            vs.append(ys)
        if us:
            u, v, root = np.concatenate(us), np.concatenate(vs), np.arange(len(node))
            while True:
                low = np.minimum(root[u], root[v])
                after = root.copy()
                np.minimum.at(after, u, low)
                np.minimum.at(after, v, low)
                after = after[after]
                if (after == root).all():
                    break
                root = after
            met = np.unique(np.concatenate([u, v]))
            yield pa.RecordBatch.from_arrays([pa.array(node[root[met]]), pa.array(node[met])], names=["u", "v"])


def _settle(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links that join components among the members of a group (neighbourhood, block pair), confirmed on full sets.

    Pairs are taken by falling agreement, and left out once their components are joined, so what leaves is a forest.
    """
    for t in _groups(batches, ["sup", "i", "j"]):
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        found = [(x, ys, s) for x, ys, s in _agreeing(t, percent / 100 - SLACK)]
        if not found:
            continue
        u = np.concatenate([np.full(len(ys), x) for x, ys, _ in found])
        v = np.concatenate([ys for _, ys, _ in found])
        order = np.argsort(-np.concatenate([s for *_, s in found]), kind="stable")
        texts = t.column("text").combine_chunks()
        sets: dict[int, np.ndarray] = {}
        parent = {int(c): int(c) for c in comp}

        def root(c: int, parent: dict[int, int] = parent) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        def members(x: int, texts: pa.Array = texts, sets: dict = sets) -> np.ndarray:
            if x not in sets:
                _, _, raw, at = next(wordhash.blocks(texts.slice(x, 1)))
                sets[x] = wordhash.shingle_sets(*wordhash.word_hashes(raw, at), k)[0]
            return sets[x]

        us, vs = [], []
        for x, y in zip(u[order].tolist(), v[order].tolist(), strict=True):
            a, b = root(int(comp[x])), root(int(comp[y]))
            if a != b and _similar(members(x), members(y), percent):
                parent[max(a, b)] = min(a, b)
                us.append(node[x])
                vs.append(node[y])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(us, np.int64)), pa.array(np.array(vs, np.int64))], names=["u", "v"])


def _star_links(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links among pairs (u, v) of a hub and a member.

    The text of ``v`` is fetched first and travels on to ``u``; a hub, in ``u`` of very many pairs, so never has its
    text copied through a shuffle, and Spark may split its side of the last join.
    """
    left, right = sigs.select(F.col("node").alias("v"), F.col("sig").alias("sv")), sigs.select(F.col("node").alias("u"), F.col("sig").alias("su"))
    pairs = pairs.join(left, "v").join(right, "u").select("u", "v", "su", "sv")
    pairs = materialise(pairs.mapInArrow(partial(_agree, least=percent / 100 - SLACK), "u long, v long"), "pairs")
    u, v = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
    full = pairs.join(v, "v").join(u, "u").select("u", "v", "tu", "tv")
    return full.mapInArrow(partial(_confirm, k=k, percent=percent), "u long, v long")


def _neighbourhoods(buckets: DataFrame, found: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """``(node, sup, comp)``: members of buckets that span several components and agree with one of another.

    Any two such members that agree with each other are in the same ``sup``.
    """
    placed = buckets.join(found, "node", "left").select("bkey", "node", "n", F.coalesce("component", "node").alias("comp"))
    several = placed.groupBy("bkey").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bkey")
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = placed.join(several, "bkey").withColumn("block", F.pmod(F.xxhash64("node"), n_blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    dealt = dealt.select("bkey", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp").join(sigs, "node")
    dealt = dealt.repartition(F.col("bkey"), F.col("i"), F.col("j")).sortWithinPartitions("bkey", "i", "j").select("bkey", "i", "j", "block", "node", "comp", "sig")
    near = materialise(dealt.mapInArrow(partial(_meet, least=percent / 100 - SLACK), "u long, v long"), "near")
    sups = components(near).withColumnRenamed("component", "sup")
    return sups.join(found, "node", "left").select("node", "sup", F.coalesce("component", "node").alias("comp"))


def _open_links(open_: DataFrame, sigs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components within a neighbourhood, found block pair by block pair.

    A component of a block's size or more has blocks of its own, which needn't meet each other; smaller ones share
    blocks and are never cut.
    """
    sizes = open_.groupBy("sup", "comp").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < TEXT_BLOCK).groupBy("sup").agg(F.sum("n").alias("shared"))
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / TEXT_BLOCK))
    mixed = F.pmod(F.xxhash64("comp"), F.ceil(F.col("shared") / (TEXT_BLOCK // 2)))
    block = F.when(F.col("n") >= TEXT_BLOCK, F.xxhash64("comp", own)).otherwise(mixed)
    dealt = open_.join(sizes, ["sup", "comp"]).join(small, "sup", "left").withColumn("block", block)
    dealt = materialise(dealt.withColumn("pure", F.when(F.col("n") >= TEXT_BLOCK, F.col("comp"))).select("sup", "comp", "node", "block", "pure"), "dealt")
    blocks = dealt.select("sup", "block", "pure").distinct()
    others = blocks.select("sup", F.col("block").alias("other"), F.col("pure").alias("other_pure"))
    meets = dealt.join(others, "sup").where("pure IS NULL OR other_pure IS NULL OR pure <> other_pure")
    rows = (
        meets.select("sup", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")
        .join(sigs, "node").join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    )
    rows = rows.repartition(F.col("sup"), F.col("i"), F.col("j")).sortWithinPartitions("sup", "i", "j")
    rows = rows.select("sup", "i", "j", "block", "node", "comp", "sig", "text")
    return rows.mapInArrow(partial(_settle, k=k, percent=percent), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text, ...)``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` over the sets of their k-word shingles (a text
    with fewer words has its whole sequence as its one shingle; A-Z is read as a-z); ``component_id`` is the least
    doc_id that links lead to and ``kept`` marks that document. Texts that are null, empty or blank have no shingles
    and stay alone. Rows that share a doc_id are one document. A row without doc_id takes the class of the rows
    with an equal text set, or stays alone with a null ``component_id`` and is kept. Other columns are not looked
    at. The banding misses a pair at the threshold with a probability under 1.3e-7 (80 %) or 1e-10 (85 %).
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = materialise(rows.mapInArrow(partial(_sketch, k=k), _SKETCH), "sketch")
    some = sketch.where("n_shingles > 0")
    classes = some.groupBy("c1", "c2").agg(F.min("doc_id").alias("node"))
    member = sketch.select("doc_id", "n_shingles", "c1", "c2")

    nodes = some.join(classes.where("node IS NOT NULL"), ["c1", "c2"]).where("doc_id = node")
    nodes = materialise(nodes.select("node", "sig", "bands").dropDuplicates(["node"]), "nodes")
    sigs = nodes.select("node", "sig")
    banded = nodes.select("node", F.explode("bands").alias("bkey"))
    shared = banded.groupBy("bkey").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialise(banded.join(shared, "bkey"), "buckets")

    score = buckets.groupBy("node").agg(F.sum("n").alias("score"))
    hubs = buckets.join(score, "node").groupBy("bkey").agg(F.max(F.struct("score", -F.col("node"))).alias("top"))
    stars = (
        buckets.join(hubs.select("bkey", (-F.col("top.col2")).alias("u")), "bkey")
        .where("u <> node").select("u", F.col("node").alias("v")).distinct()
    )
    texts = rows.where("doc_id IS NOT NULL")
    links = materialise(_star_links(stars, sigs, texts, k, percent), "links")
    found = materialise(components(links), "components")
    discard(links)
    open_ = materialise(_neighbourhoods(buckets, found, sigs, percent), "open")
    discard(buckets)
    more = _open_links(open_, sigs, texts, k, percent)
    edges = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
    final = components(edges).withColumnRenamed("node", "root")

    named = (
        classes.join(final, F.col("node") == F.col("root"), "left")
        .select("c1", "c2", F.coalesce("component", "node").alias("component_id"))
    )
    out = member.where("n_shingles > 0").join(named, ["c1", "c2"]).unionByName(member.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row, with all its columns, of each group of ``docs`` rows that links join: that with the least doc_id.

    Every row counts by itself, under a key of its own in a written table, whatever its doc_id. A row without doc_id is
    linked like any other and stays only if no row of its group has one; of rows with equal ids, or of several without,
    one stays. Rows whose text has no shingles are alone, so all of them stay.
    """
    row = free_prefix(docs) + "row"
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("row"), "component_id")
    ids = keyed.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    least = groups.join(ids, "row").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return keyed.join(least.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)
