"""Near duplicates, quality rules and the pipeline against brute force."""

import hashlib
import random

from pyspark.sql import functions as F

import brute
import pytest

from test_other import raked_by_hand, tempered

from ledgerlens.llm import ipf_mixing, minhash_dedup, quality_llr
from ledgerlens.llm.components import components

VOCAB = [f"w{i}" for i in range(500)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    docs, hub = [], prose(rng, 200)
    docs += [(i, edited(rng, hub, 1 + i % 6)) for i in range(120)]  # a large group, many pairs near the threshold
    chain = prose(rng, 150)
    for i in range(30):
        docs.append((200 + i, chain))
        chain = edited(rng, chain, 3)
    docs += [(300 + i, prose(rng, 60)) for i in range(40)]
    docs += [(400 + i, docs[i][1].upper()) for i in range(10)]
    docs += [(500, None), (501, ""), (502, " \n\t"), (503, "one"), (504, "ONE"), (505, "a b"), (506, "a  b"), (507, "a b c"), (508, prose(rng, 30000))]
    return docs


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, k, percent, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)  # several blocks even here
    monkeypatch.setattr(minhash_dedup, "TEXT_BLOCK", 8)
    rows = [(d, t, "extra", 1) for d, t in corpus]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string, u int").repartition(5), k, percent).collect()
    want = brute.near(corpus, k, percent)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(brute.shingles(t, k)) for d, t in corpus}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(empty).count() == 0
    rows = [(None, "x y z"), (None, "unlike any other"), (7, "x y z"), (7, "x y z"), (9, "x y z")]
    got = sorted(map(tuple, minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(None, 7, False), (None, None, True), (7, 7, True), (7, 7, True), (9, 7, False)], key=str)


def test_deduplicated_leaves_one_row_of_each_group(spark):
    rng = random.Random(8)
    text = prose(rng, 200)
    near = " ".join([*text.split(" ")[:-1], "changed"])
    alone = [prose(rng, 60) for _ in range(3)]
    rows = [
        (None, "x y z"), (7, "x y z"), (9, "x y z"), (None, "unlike any other"), (None, "unlike any other"),  # null ids beside others and alone
        (5, text), (5, text), (4, near), (None, near), (None, text),  # repeated in full, near copies
        (20, alone[0]), (20, "p q r"), (19, "p q r"),  # one id, two texts
        (None, alone[1]), (None, alone[1] + " more"), (None, alone[2]), (None, None), (None, ""), (30, ""),
    ]
    rows = [(d, t, n) for n, (d, t) in enumerate(rows)]
    own = {"_row": F.lit(7), "row": F.lit(8), "__row": F.lit(9)}  # the caller's columns come back as they were
    got = minhash_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns(own).repartition(3)).collect()
    assert {(r["_row"], r["row"], r["__row"]) for r in got} == {(7, 8, 9)}
    want = [(7, "x y z"), (None, "unlike any other"), (4, near), (20, alone[0]), (19, "p q r"), (None, alone[2]), (None, None), (None, ""), (30, "")]
    left = [(r.doc_id, r.text) for r in got if r.text not in (alone[1], alone[1] + " more")]
    assert sorted(left, key=str) == sorted(want, key=str) and len(got) == len(want) + 1
    assert all(rows[r.n] == (r.doc_id, r.text, r.n) for r in got)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 4)]
    # a star whose centre is hot, tied to a small component, and enough pairs that other nodes are not
    edges += [(2000, i) for i in range(2001, 4000)] + [(3999, 7)] + [(i, i + 1) for i in range(5000, 8000, 2)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_quality(spark):
    rng = random.Random(3)
    docs = [(i, prose(rng, 5 + 3 * i)) for i in range(40)]
    docs += [(100 + i, " ".join(x.upper() + "!!" for x in prose(rng, 80).split())) for i in range(10)]
    docs += [(200, None), (201, ""), (202, "a b c d e " * 40), (203, "x\nx\ny\n \n x\n#*$%&|<>"), (204, "é😀 ü\x0bz\x0cq\r\n" * 8), (205, prose(rng, 20000)), (206, "a a a a a a"), (207, "1 2 3 4 5 6 1 2 3 4 5 7 8 9")]
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(41, 1, None), (100, 0, 0), (2, 1, 0), (None, 1, 0)]
    clash = ["kept", "n_words", "_trusted", "_w", "__w", "t", "id", "b", "good", "n.n"]
    frame = spark.createDataFrame([(d, t, *["x"] * len(clash)) for d, t in docs], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in clash))
    got = {r.doc_id: r for r in quality_llr.quality_rules(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = brute.quality(docs, {d for d, q, _ in labels if q == 1})
    for d, t in docs:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base(t), d
        assert (r.llr_sum, r.kept, r._trusted, r._w, r["__w"], r.t, r.good) == (*want[d], *"xxxxx"), d
    none = quality_llr.quality_rules(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0


def test_pipeline(spark, tiny):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{tiny}/labels.parquet").collect() if r.quality == 1 and not r.toxic}
    want = [(d, t) for d, t in rows if brute.quality(rows, trusted)[d][1]] if len(rows) < 5 else None
    scores = brute.quality(rows, trusted)
    want = [(d, t) for d, t in rows if scores[d][1]]
    first = P.quality(spark, docs, tiny)
    assert sorted(r.doc_id for r in first.collect()) == sorted(d for d, _ in want)
    comp = brute.near(want, 5, 80)
    second = P.near_duplicates(spark, first, tiny)
    kept = sorted(d for d, c in comp.items() if d == c)
    assert sorted(r.doc_id for r in second.collect()) == kept
    items = [brute.words(brute.lower(r.text)) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    leaks = {d for d, t in want if any(tuple(g) in grams for g in zip(*[brute.words(brute.lower(t))[j:] for j in range(10)], strict=False))}
    third = {r.doc_id for r in P.decontamination(spark, second, tiny).collect()}
    assert not third & leaks and set(kept) - third <= leaks
    last = P.run(spark, tiny).collect()
    fourth = [r for r in P.mixing(spark, P.decontamination(spark, second, tiny), tiny).collect()]
    texts = {r.doc_id: r for r in docs.collect()}
    cells, cell_of = {}, {}
    for d in third:
        t, n = texts[d].text or "", len(brute.words(texts[d].text))
        form = "empty" if not n else "table" if t.count("|") * 8 > n else "list" if t.count("\n") * 15 > n else "brief" if n < 100 else "article" if n < 1000 else "long"
        cell_of[d] = ((texts[d].source, texts[d].lang, form), n)
        cells[cell_of[d][0]] = cells.get(cell_of[d][0], 0) + n
    w = raked_by_hand(cells, tempered(cells), ipf_mixing.BUDGET)
    drawn = lambda d: int(hashlib.md5(f"{d}:{ipf_mixing.SEED}".encode()).hexdigest()[:8], 16) / 2**32
    picked = {d for d, (k, n) in cell_of.items() if not n or drawn(d) < min(1.0, ipf_mixing.BUDGET * w[k] / cells[k])}
    assert {r.doc_id for r in fourth} == picked and {r.doc_id for r in last} == picked and len(last) == len(picked)
    order = [r.hilbert_index for r in sorted(last, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    sizes = [sum(r.shard == s for r in last) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1


def test_pipeline_edges(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows and a text of very many words."""
    import corpus_pipeline as P

    docs, labels, items = "doc_id long, text string, lang string, source string, n_chars long", "doc_id long, quality int, toxic int", "item_id long, text string"
    rng = random.Random(2)
    good = [(i, prose(rng, 80), "en", "s", 400) for i in range(30)]
    rows = [*good, good[0], good[0], (None, good[1][1], None, None, None), (None, None, None, None, None), (40, "", "", "", 0), (41, prose(rng, 60_000), None, "s", None), (None, prose(rng, 50), "en", None, 1)]
    for name, some in (("full", rows), ("empty", [])):
        at = f"file://{tmp_path}/{name}"
        spark.createDataFrame(some, docs).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(10)][: len(some)], labels).write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, good[5][1]), (None, "x"), (2, None)][: len(some)], items).write.parquet(f"{at}/benchmark.parquet")
        got = P.run(spark, at).collect()
        ids = [r.doc_id for r in got]
        assert sorted(r.slot for r in got if r.shard == 0) == list(range(sum(r.shard == 0 for r in got)))
        assert not some or (ids.count(0) <= 1 and 5 not in ids and 40 not in ids and 1 in [*ids, 1])
        assert all(r.text for r in got) and len({r.text for r in got}) == len(got)
