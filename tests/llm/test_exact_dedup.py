"""Exact duplicates by polynomial fingerprints."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, key string, f1 int"


def slow_hash(data, prime):
    out = []
    for x in X.points(prime):
        h = 0
        for b in data:
            h = (h * x + b) % prime
        out.append(h)
    return tuple(out)


@pytest.mark.parametrize("prime", [X.PRIME, 251])
def test_hashes_are_polynomials_and_compose(prime, monkeypatch):
    if prime == 251:
        monkeypatch.setattr(X, "points", lambda p=prime: (7, 12))
        X._powers.cache_clear()
    rnd = random.Random(1)
    for n in (0, 1, 2, 255, 4000, X.CHUNK, X.CHUNK + 1, 3 * X.CHUNK + 17):
        data = rnd.randbytes(n)
        want = slow_hash(data, prime)
        assert X.fingerprint(data, prime) == want
        cut = rnd.randrange(n + 1)
        assert X.combined(X.fingerprint(data[:cut], prime), X.fingerprint(data[cut:], prime), n - cut, prime) == want
    full = np.full(X.CHUNK, 255, np.uint8)
    assert X.chunk_hash(full, prime) == slow_hash(full.tolist(), prime)
    X._powers.cache_clear()


def brute(rows):
    groups = {}
    for i, (d, t, *_) in enumerate(rows):
        groups.setdefault(t or "", []).append((d is not None, d, i))
    out = []
    for d, t, *_ in rows:
        g = groups[t or ""]
        best = max(g, key=lambda x: (x[0], x[1] or 0))[1]
        out.append((d, best, len(g), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str), {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def docs():
    rnd = random.Random(5)
    texts = ["", "a", "b", "a ", "ä" * 10, "x" * 300_000, "x" * 299_999 + "y", "y" + "x" * 299_999, "long " * 40_000, "w" * X.CHUNK, "w" * (X.CHUNK + 1)]
    texts += ["".join(rnd.choice("ab") for _ in range(8)) for _ in range(150)]
    rows = [(i, rnd.choice(texts), "k", i) for i in range(300)] + [(i, t, None, None) for i, t in enumerate(texts, 1000)]
    return rows + [(None, "a", "k", 1), (None, None, "k", 1), (None, "only without id", "k", 1), (None, "only without id", "k", 1), (1, "a", "k", 1), (1007, rows[0][1], "k", 1), (1007, rows[0][1], "k", 1), (-5, None, "k", 1)]


@pytest.mark.parametrize("options", [{}, {"huge": 100_000}, {"prime": 1033, "huge": 100_000}, {"prime": 1033}])
def test_groups_equal_brute_force(spark, options):
    """Small moduli make different texts meet; a low bound sends long texts through dealt-out pieces."""
    rows = docs()
    if "prime" in options:  # among 8-letter texts some share both hashes
        assert X.points(1033)[0] != X.points(1033)[1]
    got = X.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(5), **options).collect()
    want, shas = brute(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == want
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) and set(kept) == shas
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_colliding_fingerprints_are_told_apart(spark):
    """Texts of two chunks, given equal fingerprints by hand, are divided by their bytes."""
    rows = [(i, "ab"[i % 2] * 5 + "c" * X.CHUNK + "de"[i // 2 % 2], "k", 0) for i in range(12)]
    frame = spark.createDataFrame(rows, SCHEMA)
    texts = X._Texts(frame, None, X.PRIME, X.HUGE)
    held = texts.chunks(texts.fingerprints()).withColumns({"f1": F.lit(1).cast("long"), "f2": F.lit(2).cast("long")})
    parts = {r.doc_id: r.part for r in X._divided(held).collect()}
    for i in range(12):
        for j in range(12):
            assert (parts[i] == parts[j]) == (rows[i][1] == rows[j][1])


def test_empty_table_and_rows_that_stay(spark):
    assert X.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = docs()
    left = X.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert left.columns == ["doc_id", "text", "key", "f1"]
    got = left.collect()
    assert sorted(r.text or "" for r in got) == sorted({t or "" for _, t, *_ in rows})


def test_query_equals_sql_semantics_on_documents(spark, tiny):
    from ledgerlens.llm import queries

    got = {r.doc_id: r for r in queries.QUERIES["op11_exact_dedup"](spark, tiny).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = brute(rows)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.values()], key=str) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.values())
