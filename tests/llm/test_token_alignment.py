"""Alignment of two tokenizers."""

import hashlib
import random
from collections import Counter
from functools import cache

import pytest

from ledgerlens.llm import token_alignment as T


@cache
def engines():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(T.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=T.B_FILE)


def token_bytes(text):
    """Ids and bytes of both tokenizers' tokens, by the engines that the files are written for."""
    a, b = engines()
    alphabet = T.byte_alphabet()
    enc = a.encode(" " + text, add_special_tokens=False)
    ids = b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids]
    as_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces, strict=True)]
    return list(zip(enc.ids, [bytes(alphabet[c] for c in t) for t in enc.tokens], strict=True)), list(zip(ids, as_bytes, strict=True))


def spans(tokens):
    out, at = [], 0
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def one(text):
    """Groups as text, and the links as id pairs."""
    if not text:
        return 0, 0, [], [], ""
    a, b = token_bytes(text)
    data = (" " + text).encode()
    if b"".join(t for _, t in a) != data or b"".join(t for _, t in b) != data:
        return 0, 0, [], [], ""
    a, b = spans(a), spans(b)
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    groups, low = [], 0
    for cut in cuts:
        inside = lambda xs: [str(i) for i, _, e in xs if low < e <= cut]  # noqa: B023, E731
        groups.append(",".join(inside(a)) + "|" + ",".join(inside(b)))
        low = cut
    found, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            found.append((i, b[k][0]))
            k += 1
    return len(a), len(b), groups, found, hashlib.sha256(";".join(groups).encode()).hexdigest()


def brute(docs):
    each = [(d, one(t)) for d, t, *_ in docs]
    counts = Counter(p for _, x in each for p in x[3])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        ((d, na, nb, len(g), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for d, (na, nb, g, ls, sha) in each), key=str
    )


def docs():
    rnd = random.Random(3)
    odd = [None, "", " ", "  ", "\n", "hello  world", " two\n\nlines\t x", "é—ünï 漢字 😀 <s> <unk> <0x0A>", "x ", "a\x00b", "ﬁ ½ ▁ zz", "<|endoftext|>", "don't we'll", "a" * 3000, "éä", "tab\tend\r\n"]
    letters = "abcdefghij klmno  pqr\nstéü漢😀.,'0123"
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 120))) for _ in range(60)]
    rows = [(i, t, "k", 1) for i, t in enumerate(odd + made)]
    return rows + [(None, "hello world", None, 2), (None, "hello world", None, 2), (3, "hello world", "k", 1), (3, "hello world", "k", 1), (-1, "The cat sat on the mat. " * 3000, "k", 1)]


def test_equal_to_brute_force(spark):
    frame = spark.createDataFrame(docs(), "doc_id long, text string, row string, n_a int").repartition(3)
    got = sorted((tuple(r) for r in T.alignments(frame).collect()), key=str)
    assert T.alignments(frame).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got == brute(docs())


def test_whole_table(spark, tiny):
    from ledgerlens.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op12_token_alignment"](spark, tiny).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert T.alignments(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("piece", "block"), [(50, 30), (200, 1), (50, 10**6)])
def test_pieces_and_blocks_change_nothing(piece, block, monkeypatch):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(["ab", "cat ", " the", "éü ", "1 2", ". ", "\n", "  x"]) for _ in range(400)) for _ in range(6)] + [None, "short"]
    both = T.pair()
    want = list(T.align(texts, both))
    monkeypatch.setattr(T, "PIECE", piece)
    monkeypatch.setattr(T, "BLOCK", block)
    got = {}
    for doc, *numbers, sha, codes, ns in T.align(texts, both):
        at = got.setdefault(doc, [[0] * 4, None, Counter()])
        at[0] = [x + y for x, y in zip(at[0], numbers, strict=True)]
        at[1] = at[1] if sha is None else sha
        at[2].update(dict(zip(map(int, codes), map(int, ns), strict=True)))
    assert {d: (n, sha, c) for d, (n, sha, c) in got.items()} == {d: ([*n], sha, Counter(dict(zip(map(int, c), map(int, m), strict=True)))) for d, *n, sha, c, m in want}
    assert len(both.encoded(texts[0])) > 1


def test_engines_agree_on_every_seventh_code_point():
    """The faster engine gives the ids of the one that the file is written for (all code points were compared once)."""
    a, _ = engines()
    both = T.pair()
    for c in range(1, 0x110000, 7):
        if not 0xD800 <= c < 0xE000:
            x = f" a{chr(c)}b 1{chr(c)}2 .{chr(c)}. {chr(c)} {chr(c)}{chr(c)}"
            assert a.encode(x, add_special_tokens=False).ids == both.a.encode_ordinary(x)
