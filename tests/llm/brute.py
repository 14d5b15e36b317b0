"""Plain Python versions of what the operators compute, for small fixtures."""

import math
import re

import xxhash

from ledgerlens.llm import quality_llr as Q

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SEP.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near(docs, k, percent):
    """``{doc_id: component}`` of (doc_id, text) with distinct ids."""
    sets = {d: shingles(t, k) for d, t in docs}
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                comp[max(p, q)] = min(p, q)
    return {d: root(d) for d in sets}


def base(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {g: grams.count(g) for g in set(grams)} if len(grams) < 3000 else {}
    if not seen:
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def bucket(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64(p.encode(), seed=h & (2**64 - 1)).intdigest()
    h = h - 2**64 if h >= 2**63 else h
    return h % Q.BUCKETS


def gram_classes(text):
    w = words(text)
    return [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:], strict=False)]


def quality(docs, trusted):
    """``{doc_id: (llr_sum, kept)}``."""
    raw, target = {}, {}
    classes = {d: gram_classes(t) for d, t in docs}
    for d, cs in classes.items():
        for c in cs:
            raw[c] = raw.get(c, 0) + 1
            if d in trusted:
                target[c] = target.get(c, 0) + 1
    n_raw, n_target = sum(raw.values()), sum(target.values())
    weight = {c: round(Q.SCALE * math.log((target.get(c, 0) + Q.K) / (raw[c] * n_target / n_raw + Q.K))) if n_target else 0 for c in raw}
    out = {}
    for d, t in docs:
        n, _, _, _, rep = base(t)
        total = sum(weight[c] for c in classes[d])
        failed = n < 10 or 100 * rep > 20 * n
        out[d] = (total, not failed and total >= Q.THRESHOLD * max(2 * n - 1, 0))
    return out
