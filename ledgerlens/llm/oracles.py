"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from . import hilbert_sharding as hs, ipf_mixing as mix

WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER.format('text'))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 85 * (a.n + b.n - i)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def _chain(first: str, steps: list[str]) -> str:
    """Steps of a query, each over the one before, as named subqueries."""
    parts = [f"s0 AS ({first})"] + [f"s{i + 1} AS ({x.replace('$', f's{i}')})" for i, x in enumerate(steps)]
    return "WITH " + ",\n".join(parts)


def op1() -> str:
    key = lambda c: f"coalesce('x' || {c}, '')"
    at = [i / 2**hs.BITS for i in range(1, 2**hs.BITS)]
    crc = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, {_crc_table()}[(xor(a, b) & 255) + 1])))"""
    size = "+".join(f"(size >= {4**j})::INT" for j in range(1, 16))
    steps = [
        f"SELECT *, {key('source')} AS k0, {key('lang')} AS k1 FROM $",
        f"SELECT *, quantile_disc(k0, {at}) OVER () AS q0, quantile_disc(k1, {at}) OVER () AS q1 FROM $",
        f"""SELECT * EXCLUDE (q0, q1), len(list_filter(list_distinct(q0), lambda c: c <= k0)) AS x0, len(list_filter(list_distinct(q1), lambda c: c <= k1)) AS x1, {size} AS x2,
            ((doc_id % 1000003 + 1000003) % 1000003 * 7919) % {hs.SALTS} AS salt FROM $""",
        *(f"SELECT * REPLACE ({', '.join(f'({v}) AS {k}' for k, v in step.items())}) FROM $" for step in hs.curve_steps(["x0", "x1", "x2"], hs.BITS)[:-1]),
        f"SELECT *, {hs.curve_steps(['x0', 'x1', 'x2'], hs.BITS)[-1]['h']} AS h FROM $",
        """SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY h, salt, doc_id NULLS FIRST, text_crc32, size,
           source NULLS FIRST, lang NULLS FIRST) - 1 AS r FROM $""",
    ]
    return (
        _chain(f"SELECT doc_id, source, lang, strlen(coalesce(text, '')) + 1 AS size, ({crc})::BIGINT AS text_crc32 FROM documents", steps)
        + f"""\nSELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (r * 16 // n)::INT AS shard,
        (r - ((r * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard, h AS hilbert_index FROM s{len(steps)}"""
    )


def op10() -> str:
    dims = ["source", "lang", "topic"]
    steps = [
        f"SELECT *, len({WORDS.format('t')}) AS n_tokens FROM $",
        """SELECT *, CASE WHEN n_tokens = 0 THEN 'empty' WHEN (length(t) - length(replace(t, '|', ''))) * 8 > n_tokens THEN 'table'
           WHEN (length(t) - length(replace(t, chr(10), ''))) * 15 > n_tokens THEN 'list' WHEN n_tokens < 100 THEN 'brief'
           WHEN n_tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM $""",
    ]
    docs = len(steps)
    steps += ["SELECT source, lang, topic, sum(n_tokens) AS tokens FROM $ GROUP BY ALL HAVING sum(n_tokens) > 0", "SELECT *, tokens::DOUBLE AS w, sum(tokens) OVER ()::DOUBLE AS total FROM $"]
    for d in dims:
        steps.append(f"SELECT *, pow(sum(tokens) OVER (PARTITION BY {d}) / total, {mix.TEMPER[d]}) AS g_{d}, count(*) OVER (PARTITION BY {d}) AS c_{d} FROM $")
        steps.append(f"SELECT * REPLACE (total * g_{d} / sum(g_{d} / c_{d}) OVER () AS g_{d}) FROM $")
    steps += [f"SELECT * REPLACE (least(tokens / {mix.BUDGET}::DOUBLE, w * g_{d} / sum(w) OVER (PARTITION BY {d})) AS w) FROM $" for _ in range(mix.SWEEPS) for d in dims]
    return (
        _chain("SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents", steps)
        + f""",\np AS (SELECT d.*, CASE WHEN n_tokens = 0 THEN 1.0 ELSE least(1.0, {mix.BUDGET} * w / tokens) END AS p FROM s{docs} d LEFT JOIN s{len(steps)} c
        ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic IS NOT DISTINCT FROM c.topic)
        SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(p, 9) AS probability,
        ('0x' || left(md5(doc_id::VARCHAR || ':{mix.SEED}'), 8))::BIGINT / 4294967296.0 < p AS sampled FROM p"""
    )


OP7 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM o
"""


def op8() -> str:
    """From the kinds' definitions: a pattern and what a match must have to count."""
    quote = lambda x: x.replace("'", "''")
    word = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    keys = "|".join(map(word, ("password", "passwd", "secret", "token", "api_?key")))
    assign = rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [
        ("assign", assign, f"length(regexp_extract(m, '^{quote(assign)}$', 2)) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"), ("hex", "[0-9a-f]+", "length(m) >= 24"),
        ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"), ("github", "gh[opsur]_[A-Za-z0-9]{36,}", "true"),
    ]
    parts = []
    for k, (name, pattern, keep) in enumerate(kinds):
        parts.append(f"""SELECT doc_id, {k} AS k, '{name}' AS rule, s, s + length(m) AS e FROM (
            SELECT doc_id, m, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
            SELECT doc_id, unnest(regexp_extract_all(text, '{quote(pattern)}')) AS m, unnest(string_split_regex(text, '{quote(pattern)}')[:-2]) AS g,
            generate_subscripts(regexp_extract_all(text, '{quote(pattern)}'), 1) AS i FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {keep}""")
    return f"""WITH x AS ({' UNION ALL '.join(parts)}), a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
        count(*) FILTER (k = 2) AS n_hex, string_agg(rule || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS b,
        string_agg(rule || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM x GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN a USING (doc_id)"""


OP11 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


ORACLES = {"op7_warc": OP7, "op8_secret_ledger": op8(), "op1_hilbert_shards": op1(), "op6_near_duplicates": OP6, "op10_mixing": op10(), "op11_exact_dedup": OP11}
