"""Alignment of two tokenizers by pointer jumping.

Both tokenizers' tokens cover the same bytes. Every token points to the token that overlaps it and reaches farthest to the
right; doubling all pointers at once (``next = next[next]``) until nothing moves brings each token to the last token of its
component, which names its group. Groups are therefore the stretches between offsets where tokens of both end.

Texts are read once and cut at single spaces between letters, where neither tokenizer joins what lies on both sides, so a
long text is encoded piece by piece. Token ids are kept as small arrays and aligned in blocks of many texts. What is stored
is, for each document, its linked id pairs with their numbers. Their corpus-wide counts come from one aggregate; the
few pairs with over 1 / ``HOT_PAIRS`` of all links meet their documents by broadcast, all others by a join, and only sums
by document move after that.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import discard, materialise, ship
from .text import whole

#: The two tokenizers' files, on every machine under the same paths.
A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the first tokenizer's split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a piece that is encoded at once, if there is a place to cut.
PIECE = 8_000
#: Tokens that are aligned at once, if no single piece has more.
BLOCK = 400_000
#: Pairs with a larger part of all links than one in so many are broadcast: there are fewer of them than this.
HOT_PAIRS = 50_000
#: Id pairs are stored as ``a * SPAN + b``.
SPAN = 1 << 15

_OUT = "doc_id {0}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, ns array<int>"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both encoders with the bytes of their tokens.

    The first vocabulary runs on the engine of tiktoken, whose merges by rank are those of the file, as ids are in order
    of merging; a test compares it with the engine that the file is written for.
    """

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        import tiktoken

        with open(a_file, encoding="utf-8") as f:
            said = json.load(f)
        special = {x["content"] for x in said.get("added_tokens", [])}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        n = self.b.get_piece_size()
        if n > SPAN or len(self.a_bytes) * SPAN >= 1 << 31:
            raise ValueError("vocabularies are too large for codes of 31 bits")
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # a piece with a space after something else would join what lies on both sides of a cut
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.shown = [f"{i}{mark}".encode() for i in range(len(self.a_bytes)) for mark in ",|"] + [f"{i}{mark}".encode() for i in range(n) for mark in ",;"]

    def encoded(self, text: str) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids of both for each piece of a text, or None where the joined bytes of either aren't a space and the text."""
        out = []
        for piece in self._pieces(" " + text) if text else ():
            data, a, b = piece.encode(), self.a.encode_ordinary(piece), self.b.encode(piece[1:])
            if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
                return None
            out.append((np.array(a, np.int32), np.array(b, np.int32)))
        return out or None

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while self.cuts and len(text) - at > PIECE:
            cut = text.find(" ", at + PIECE // 2, len(text) - 1)
            while cut > 0 and not (text[cut - 1].isalpha() and text[cut + 1].isalpha()):
                cut = text.find(" ", cut + 1, len(text) - 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]


@cache
def pair(a_file: str = A_FILE, b_file: str = B_FILE) -> Pair:
    return Pair(a_file, b_file)


def terminals(a_ends: np.ndarray, a_starts: np.ndarray, b_ends: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the number of the A token that ends its group, by pointer jumping."""
    n = len(a_ends)
    last_b = np.searchsorted(b_starts, a_ends, "left") - 1
    last_a = np.searchsorted(a_starts, b_ends, "left") - 1
    # of the two tokens that end together, that of A is the one to arrive at
    to = np.concatenate([np.where(b_ends[last_b] > a_ends, n + last_b, np.arange(n)), last_a]) if n else np.empty(0, np.int64)
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            return to[:n], to[n:]
        to = farther


def links(a_ends: np.ndarray, a_starts: np.ndarray, b_ends: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token that share a byte, as two arrays of numbers of tokens."""
    first = np.searchsorted(b_ends, a_starts, "right")
    count = np.searchsorted(b_starts, a_ends, "left") - first
    i = np.repeat(np.arange(len(a_ends)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class _Block:
    """Pieces of one or more documents, aligned together; documents may go on in the next block."""

    def __init__(self, both: Pair):
        self.both, self.docs, self.a, self.b, self.tokens = both, [], [], [], 0

    def add(self, doc: int, a: np.ndarray, b: np.ndarray) -> None:
        self.docs.append((doc, len(a), len(b)))
        self.a.append(a)
        self.b.append(b)
        self.tokens += len(a) + len(b)

    def aligned(self) -> Iterator[tuple]:
        """``doc, n_a, n_b, n_groups, n_links, shown, codes, ns`` for each document; ``shown`` are the bytes of its groups."""
        both, a, b = self.both, np.concatenate(self.a), np.concatenate(self.b)
        a_ends, b_ends = np.cumsum(both.a_len[a]), np.cumsum(both.b_len[b])
        spans = a_ends, a_ends - both.a_len[a], b_ends, b_ends - both.b_len[b]
        of_a, of_b = terminals(*spans)
        i, j = links(*spans)
        # where each token is shown: group by group, A before B
        ends = of_a == np.arange(len(a))
        group_a, b_before = np.cumsum(ends) - ends, np.searchsorted(of_b, np.flatnonzero(ends), "left")
        place_a = np.arange(len(a)) + b_before[group_a]
        place_b = np.arange(len(b)) + of_b + 1
        last_b = np.append(of_b[1:] != of_b[:-1], True)
        shown = np.empty(len(a) + len(b), np.int64)
        shown[place_a] = 2 * a.astype(np.int64) + ends
        shown[place_b] = 2 * (len(both.a_bytes) + b.astype(np.int64)) + last_b
        shown = shown.tolist()
        docs = np.array([d for d, *_ in self.docs])
        order = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        n_a, n_b = (np.add.reduceat([x[k] for x in self.docs], order) for k in (1, 2))
        a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
        own = np.searchsorted(a_to, i, "right")  # the document of each link
        keys, ns = np.unique(own.astype(np.int64) << 31 | a[i].astype(np.int64) * SPAN + b[j], return_counts=True)
        ends_at, link_to, key_to = np.cumsum(ends), np.searchsorted(own, np.arange(len(order)), "right"), np.searchsorted(keys >> 31, np.arange(len(order)), "right")
        codes, ns = (keys & (1 << 31) - 1).astype(np.int32), ns.astype(np.int32)
        get, groups, seen, key, link = both.shown.__getitem__, 0, 0, 0, 0
        for k, at in enumerate(order):
            upto = int(a_to[k] + b_to[k])
            yield int(docs[at]), int(n_a[k]), int(n_b[k]), int(ends_at[a_to[k] - 1]) - groups, int(link_to[k]) - link, b"".join(map(get, shown[seen:upto])), codes[key : key_to[k]], ns[key : key_to[k]]
            groups, seen, key, link = int(ends_at[a_to[k] - 1]), upto, int(key_to[k]), int(link_to[k])


def align(texts: list[str | None], both: Pair) -> Iterator[tuple]:
    """``doc, n_a, n_b, n_groups, n_links, groups_sha256, codes, ns`` for each text in turn.

    A text that needs several blocks comes in several rows; all but the last have no hash.
    """
    state: dict[int, list] = {}

    def given(block: _Block, ended: int) -> Iterator[tuple]:
        for doc, n_a, n_b, n_groups, n_links, shown, codes, ns in block.aligned():
            digest = state.setdefault(doc, [hashlib.sha256(), b""])
            digest[0].update(digest[1] + shown[:-1])
            digest[1] = shown[-1:]  # the last mark stands between groups only
            done = doc < ended
            yield doc, n_a, n_b, n_groups, n_links, digest[0].hexdigest() if done else None, codes, ns
            if done:
                del state[doc]

    block = _Block(both)
    for doc, text in enumerate(texts):
        pieces = both.encoded(text or "")
        if pieces is None:
            yield doc, 0, 0, 0, 0, "", (), ()
            continue
        for a, b in pieces:
            if block.tokens > BLOCK:
                yield from given(block, doc)
                block = _Block(both)
            block.add(doc, a, b)
    if block.docs:
        yield from given(block, len(texts))


def _batches(batches: Iterator[pa.RecordBatch], files: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    both = pair(*files)
    for batch in batches:
        held, pending, size = batch.columns[:-1], [], 0
        for row in align(batch.column(batch.num_columns - 1).to_pylist(), both):
            pending.append(row)
            size += len(row[6])
            if size > BLOCK:
                yield _rows(held, pending)
                pending, size = [], 0
        if pending:
            yield _rows(held, pending)


def _rows(held: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
    at = pa.array([r[0] for r in rows], pa.int64())
    numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 5)]
    offsets = pa.array(np.cumsum([0, *(len(r[6]) for r in rows)]), pa.int32())
    flat = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.asarray(r[k], np.int32) for r in rows]), pa.int32())) for k in (6, 7)]
    names = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "ns"]
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in held), *numbers, pa.array([r[5] for r in rows], pa.string()), *flat], names=names)


def linked_pairs(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """``doc_id, row, n_a, n_b, n_groups, n_links, groups_sha256, codes, ns``, stored: alignment of every text by itself.

    ``codes`` are the document's linked id pairs as ``a * SPAN + b``, ``ns`` how many links hold each. ``row`` tells rows of
    ``docs`` apart. A text of very many tokens has several rows, whose numbers add up; the last carries the hash.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), whole("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialise(rows.mapInArrow(partial(_batches, files=(a_file, b_file)), _OUT.format(kind)), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``code, count, best``, stored: how many links of the corpus hold each id pair, and whether no pair of its B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("codes", "ns")).alias("x")).select("x.codes", "x.ns")
    sums = each.groupBy(F.col("codes").alias("code")).agg(F.sum("ns").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("code") % SPAN))  # at most as many rows as A has ids
    return materialise(sums.withColumn("best", F.when(F.col("count") == most, 1).otherwise(0)), "pairs")


def alignments(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs(doc_id, text)``.

    Texts that are null or empty, or that a tokenizer doesn't give back byte by byte, have no tokens: zeros and an empty
    hash. Rows without doc_id and repeated rows are aligned and counted each; other columns aren't looked at; an empty
    table gives an empty result.
    """
    aligned = linked_pairs(docs, a_file, b_file)
    pairs = pair_counts(aligned)
    least = (pairs.agg(F.sum("count")).first()[0] or 0) // HOT_PAIRS + 1
    hot, cold = pairs.where(F.col("count") >= least), pairs.where(F.col("count") < least)
    each = aligned.select("row", F.explode(F.arrays_zip("codes", "ns")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.ns").alias("n"))
    sums = lambda df: df.groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    warm = sums(each.join(F.broadcast(hot), "code"))
    rest = sums(each.join(F.broadcast(hot.select("code")), "code", "left_anti").join(cold, "code"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    own = aligned.select("doc_id", "row", *numbers[:4], "groups_sha256").withColumns({c: F.lit(0).cast("long") for c in numbers[4:]})
    found = [x.withColumns({"doc_id": F.lit(None).cast(docs.schema["doc_id"].dataType), "groups_sha256": F.lit(None).cast("string"), **{c: F.lit(0).cast("long") for c in numbers[:4]}}) for x in (warm, rest)]
    every = own.unionByName(found[0]).unionByName(found[1])
    out = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).cast("long").alias(c) for c in numbers], F.max("groups_sha256").alias("groups_sha256"))
    out = materialise(out.select("doc_id", *numbers, "groups_sha256"), "alignments")
    discard(aligned, pairs)
    return out
