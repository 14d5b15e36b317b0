"""Benchmark decontamination by spaced seeds.

A fixed mask picks some of a few consecutive tokens and ignores the others, so a window still hashes alike after
substitutions at ignored places. Seeds of benchmark items are joined with seeds of the training texts; a common seed
makes a document and an item a pair. There the item is laid on the document at every offset where a seed agrees and
compared token by token, substitutions allowed: the document is contaminated when an aligned run of enough tokens
agrees well enough. An item with fewer tokens than the shortest mask has one seed, all of its tokens.

The training texts are read twice and never shuffled as a whole. The first reading keeps only distinct window hashes
of a document that may be a benchmark's, by a bit table of fixed size (``2 ** BITS`` bits, whatever the sizes of the
tables), and the join is an ordinary shuffle join of slim rows without places, so a text that repeats itself sends
each window once. The second fetches the texts of documents with pairs, by a bit table of ids of the same size. Both
tables only spare work: the joins decide. A document's items come to it in blocks of ``BLOCK``, read as a stream: its
text moves once a block, and a task holds one text and one item at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordhash
from .storage import discard, free_prefix, materialise, ship

#: Positions of a window that count (1) or don't (0). Found by a greedy search over masks of five counted
#: positions: of random substitutions that leave 10 tokens and 70 % equal, in items of 12 to 30 tokens, under 0.1 % miss.
MASKS = ["111011", "1100001011", "11010011", "1001111", "11010100001"]
#: An aligned run must have this many equal tokens, or all of a shorter item's, and they must be this percentage of its places.
LEAST_EQUAL, LEAST_SHARE = 10, 70
#: Items with fewer tokens than this overlap with nothing: by default only those without any. Who takes items of one or two
#: tokens for phrases that any text may hold passes 3.
SHORTEST = 1
BITS = 26
#: Items that meet a document in one stream.
BLOCK = 1024
#: Places compared at a time.
CELLS = 4_000_000
#: Characters that don't count in a token: punctuation changes more easily than words.
DROP = b".,;:!?\"'()[]{}|*#_-"

_SPAN = min(map(len, MASKS))


def _hashes(words: np.ndarray, mask: str, tag: int) -> np.ndarray:
    """A hash for each place at which the mask fits into ``words``."""
    n = max(0, len(words) - len(mask) + 1)
    h = np.full(n, np.uint64(tag))
    for j, c in enumerate(mask):
        if c == "1":
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[j : n + j]
    return wordhash.mix(h)


def _masks(lengths: tuple[int, ...]) -> list[tuple[str, int]]:
    """Masks with their tags; those of short items, one for each of ``lengths``, have tags of their own."""
    return [(m, i + 1) for i, m in enumerate(MASKS)] + [("1" * n, 100 + n) for n in lengths]


def _item_seeds(words: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Seeds of one item, with the tag of their mask."""
    n = len(words)
    if 0 < n < _SPAN:
        yield _hashes(words, "1" * n, 100 + n), 100 + n
    elif n >= _SPAN:
        for mask, tag in _masks(()):
            yield _hashes(words, mask, tag), tag


def _scan_items(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """``(id, h, n)``: distinct seeds of items; ``n`` is the token count of a short item, else 0."""
    for batch in batches:
        out = [(np.zeros(0, np.int64),) * 3]
        for row, item in enumerate(batch.column(0).to_pylist()):
            words = _tokens(batch.column(1).slice(row, 1))
            found = [h for h, _ in _item_seeds(words)] if len(words) >= shortest else []
            h = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            out.append((np.full(len(h), item), h.view(np.int64), np.full(len(h), len(words) if len(words) < _SPAN else 0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(3)], names=["id", "h", "n"])


def _scan(batches: Iterator[pa.RecordBatch], bits, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """``(id, h)``: distinct seeds of each document that the bit table may hold."""
    for batch in batches:
        ids = batch.column(0)
        for a, _, raw, at in wordhash.blocks(batch.column(1)):
            words, first = wordhash.word_hashes(raw, at, DROP)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            found = []
            for mask, tag in _masks(lengths):
                h = _hashes(words, mask, tag)
                inside = np.flatnonzero((row[: len(h)] == row[len(mask) - 1 :]) & _holds(bits.value, h)) if len(h) else np.zeros(0, np.int64)
                found.append((row[inside], h[inside]))
            rows, h = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            if len(h):
                order = np.lexsort((h, rows))
                rows, h = rows[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[new] + a)), pa.array(h[new].view(np.int64))], names=["id", "h"])


def _holds(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    key = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
    return (table[key >> 3] >> (key & 7).astype(np.uint8)) & 1 == 1


def _bit_table(keys: DataFrame) -> np.ndarray:
    """Longs in column ``h`` as a table of ``2 ** BITS`` bits; what comes to the driver is at most that."""
    low = F.col("h").bitwiseAND((1 << BITS) - 1)
    words = keys.select(low.alias("k")).groupBy(F.shiftright("k", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 31 AS int))")).alias("bits"))
    got = words.toPandas()
    table = np.zeros(1 << (BITS - 5), np.uint32)
    table[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return table.view(np.uint8)


def _marked(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """Rows whose id (column 0) may be in the table of mixed ids."""
    for batch in batches:
        ids = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        hit = _holds(bits.value, wordhash.mix(ids))
        if hit.any():
            yield batch.filter(pa.array(hit))


def _mixed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(wordhash.mix(ids).view(np.int64))], names=["h"])


def _tokens(text: pa.Array) -> np.ndarray:
    _, _, raw, at = next(wordhash.blocks(text))
    return wordhash.word_hashes(raw, at, DROP)[0]


def best_run(equal: np.ndarray) -> tuple[int, int]:
    """Equal places and length of the stretch with most equal places among those that reach ``LEAST_SHARE`` percent.

    For each end the longest such stretch begins at the first place where the running sum was no higher.
    """
    total = np.concatenate(([0], np.cumsum(np.where(equal, 100 - LEAST_SHARE, -LEAST_SHARE))))
    count = np.concatenate(([0], np.cumsum(equal)))
    begin = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
    end = int((count - count[begin]).argmax())
    hits = np.flatnonzero(equal[begin[end] : end])
    return len(hits), int(hits[-1] - hits[0] + 1) if len(hits) else 0


def _pairs_of(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Differences ``place in a - place in b`` of equal hashes, item place by item place, so that memory stays linear."""
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    low, high = np.searchsorted(ranked, b, "left"), np.searchsorted(ranked, b, "right")
    for k in np.flatnonzero(high > low):
        yield order[low[k] : high[k]] - k


def best_overlap(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """``(equal tokens, places)`` of the best run over all offsets at which some seed agrees; (0, 0) if none is good enough.

    Of runs with equally many equal tokens the shortest counts.
    """
    n, least = len(item), min(LEAST_EQUAL, len(item))
    hit = np.zeros(len(doc) + n, bool)  # offsets, moved by the item's length
    for h, tag in _item_seeds(item):
        mask = dict((t, m) for m, t in _masks((n,)))[tag]
        for offsets in _pairs_of(_hashes(doc, mask, tag), h):
            hit[offsets + n] = True
    offsets = np.flatnonzero(hit) - n
    padded = np.concatenate([np.zeros(n, np.uint64), doc, np.zeros(n, np.uint64)])
    inside = np.concatenate([np.zeros(n, bool), np.ones(len(doc), bool), np.zeros(n, bool)])
    best, place = (0, 0), np.arange(n)
    step = max(1, CELLS // max(n, 1))
    for at in range(0, len(offsets), step):
        spots = offsets[at : at + step, None] + n + place
        equal = (padded[spots] == item) & inside[spots]
        total = equal.sum(axis=1)
        # in falling order of equal places, until no offset can do better
        for k in np.argsort(-total, kind="stable"):
            if total[k] < max(least, best[0]):
                break
            if total[k] == best[0] and best[1] == best[0]:
                break
            there = np.flatnonzero(inside[spots[k]])
            found = best_run(equal[k, there[0] : there[-1] + 1])
            if found[0] >= least and (found[0], -found[1]) > (best[0], -best[1]):
                best = found
    return best


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``(id, block, item_id, text)``: a document's text, with a null item_id, and then its items."""
    doc, key, texts = None, None, []
    for batch in batches:
        out = []
        ids, blocks, items = (batch.column(i).to_pylist() for i in range(3))
        for n, (d, b, i) in enumerate(zip(ids, blocks, items, strict=True)):
            if (d, b) != key:
                key, texts = (d, b), []
            if i is None:
                texts.append(_tokens(batch.column(3).slice(n, 1)))
                continue
            item = _tokens(batch.column(3).slice(n, 1))
            for doc in texts:  # more than one only where documents share an id
                equal, length = best_overlap(doc, item)
                if equal:
                    out.append((d, i, equal, length))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_equal", "n_aligned"])


def overlaps(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, item_id, n_equal, n_aligned``: the best aligned run of every document and item that overlap.

    Tokens are the texts' words, A-Z read as a-z and ``DROP`` left out. Items with fewer than ``shortest`` tokens, and null
    and empty ones, overlap with nothing; items with fewer tokens than the shortest mask are found where all their tokens
    stand in a row. Rows that share an id count as one document or item. Rows without an id have no name to be reported
    under and are left out here; :func:`decontaminated` compares them like all others. Other columns are not looked at;
    empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL")
    seeds = materialise(items.mapInArrow(partial(_scan_items, shortest=shortest), "id long, h long, n long"), "seeds")
    lengths = tuple(sorted(r.n for r in seeds.where("n > 0").select("n").distinct().collect()))  # under the shortest mask's length
    bits = spark.sparkContext.broadcast(_bit_table(seeds))
    hits = rows.mapInArrow(partial(_scan, bits=bits, lengths=lengths), "id long, h long")
    pairs = materialise(hits.join(seeds.select("h", F.col("id").alias("item_id")), "h").select("id", "item_id").distinct(), "pairs")
    discard(seeds)
    sizes = pairs.groupBy("id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    marks = spark.sparkContext.broadcast(_bit_table(sizes.select("id").mapInArrow(_mixed_ids, "h long")))
    texts = rows.mapInArrow(partial(_marked, bits=marks), "id long, text string").join(sizes, "id")
    texts = texts.select("id", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("item_id"), "text")
    placed = pairs.join(sizes, "id").select("id", F.pmod(F.xxhash64("item_id"), F.col("n_blocks")).cast("int").alias("block"), "item_id")
    placed = placed.join(items.select(F.col("id").alias("item_id"), "text"), "item_id").select("id", "block", "item_id", "text")
    meet = texts.unionByName(placed).repartition(F.col("id"), F.col("block")).sortWithinPartitions("id", "block", F.col("item_id").asc_nulls_first())
    good = meet.mapInArrow(_verify, "doc_id long, item_id long, n_equal long, n_aligned long")
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", (-F.col("n_aligned")).alias("short"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_equal").alias("n_equal"), (-F.col("b.short")).alias("n_aligned"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` that overlap with no row of ``benchmark``, with all their columns, whether they have ids or not.

    Rows that share a doc_id count as one document. Rows without one are numbered in a stored table of their own and
    compared apart, so that no other row is copied.
    """
    items = materialise(benchmark.select(F.monotonically_increasing_id().alias("item_id"), "text"), "items")
    bad = materialise(overlaps(docs, items, shortest).select(F.col("doc_id").alias("_bad")).distinct(), "bad")
    number, id_ = free_prefix(docs) + "row", docs["doc_id"].cast("long")
    kept = docs.where(id_.isNotNull()).join(bad, id_ == bad["_bad"], "left_anti")
    nameless = materialise(docs.where(id_.isNull()).withColumn(number, F.monotonically_increasing_id()), "nameless")
    if nameless.isEmpty():
        discard(items, nameless)
        return kept
    found = overlaps(nameless.select(F.col(number).alias("doc_id"), "text"), items, shortest).select(F.col("doc_id").alias(number)).distinct()
    return kept.unionByName(nameless.join(found, number, "left_anti").select(*docs.columns))
