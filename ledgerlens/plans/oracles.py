"""DuckDB twins of the registered queries, from shared named subqueries."""

from __future__ import annotations

from ..functions.keccak import RATE, rotations, round_constants
from ..operators.rules import RULES, rules_of, severity_sql
from ..schema import STRICTER
from ..sources import demo_chain as demo

_SEL = "CASE i % 31 WHEN 0 THEN '0xf2fde38b' WHEN 1 THEN '0xbaa2abde' WHEN 2 THEN '0x02751cec' WHEN 3 THEN '0xf305d719' WHEN 4 THEN '0xa9059cbb' ELSE '0x' || left(md5((i % 13)::VARCHAR), 8) END"

EVENTS = f"""e AS (SELECT event_id AS i, event_type AS kind, 'u' || user_id AS wallet, epoch_us(ts) // 1000000 AS ts, round(value * 100)::BIGINT AS c0 FROM events),
kk AS (SELECT wallet, 'k' || arg_min(i, (ts, i)) AS k FROM e WHERE kind = 'signup' GROUP BY wallet),
e2 AS (SELECT e.*, coalesce(kk.k, 'k-none') AS k0, CASE WHEN kind = 'view' THEN i % 4 END AS inner_, CASE WHEN i % 6 = 0 THEN c0 // 50 * 50 ELSE c0 END AS c FROM e LEFT JOIN kk USING (wallet)),
tx AS (SELECT wallet, (coalesce(inner_, 0) = 1)::INT AS stream, i AS ord, ts,
  CASE WHEN kind = 'purchase' THEN 'f' || (i % 23) WHEN inner_ = 0 THEN 'v' || (i % 51) WHEN inner_ = 1 THEN k0 ELSE wallet END AS src,
  CASE WHEN kind = 'signup' THEN '' WHEN kind = 'purchase' THEN wallet WHEN inner_ = 0 THEN k0 WHEN inner_ = 1 THEN wallet WHEN inner_ = 3 THEN k0 ELSE 'd' || (i % 37) END AS dst,
  CASE WHEN kind = 'signup' THEN 0 WHEN i % 17 = 0 THEN c::HUGEINT * 1000000000 ELSE c::HUGEINT * 10000000000000000 END AS value,
  (20 + i % 30) * 1000000000 + (i % 7) * 100000000 AS gas_price, 21000 + i % 1000 AS gas_used, i AS nonce, kind = 'error' AS is_error,
  CASE WHEN kind = 'signup' THEN '0x' || md5('c' || (i % 5)) || md5('c' || (i % 7)) ELSE {_SEL} || repeat('0', 24) || left(md5((i % 19)::VARCHAR) || md5((i % 19)::VARCHAR), 40) END AS input,
  CASE WHEN kind = 'signup' THEN 'k' || i ELSE '' END AS contract, 'h' || i AS tx_hash FROM e2)"""

ORDERS = """tx AS (SELECT 'c' || o_custkey AS wallet, 0 AS stream, (l_orderkey * 10 + l_linenumber) * 2 AS ord, epoch_us(l_shipdate) // 1000000 AS ts, 'c' || o_custkey AS src, 's' || l_suppkey AS dst,
  round(l_extendedprice * 100)::HUGEINT * 1000000000000 AS value, false AS is_error, '0x' AS input, '' AS contract, 'h' || ((l_orderkey * 10 + l_linenumber) * 2) AS tx_hash FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'c' || o_custkey, 0, o_orderkey * 20 + 1, epoch_us(o_orderdate) // 1000000, 'n' || c_nationkey, 'c' || o_custkey, round(o_totalprice * 100)::HUGEINT * 1000000000000, false, '0x', '', 'h' || (o_orderkey * 20 + 1)
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F')"""

ENT = "ent(address, type) AS (VALUES " + ", ".join(f"('{a}', '{t}')" for a, t in demo.ENTITIES) + ")"
AGES = "ages AS (SELECT p || i AS address, CASE WHEN i % 7 <> 3 THEN 1704067200 + (i * 97 % 40 - 10) * 86400 END AS first_ts FROM (SELECT 'f' AS p, unnest(range(23)) AS i UNION ALL SELECT 'd', unnest(range(37))))"
DEPLOYS = """dep AS (SELECT wallet, ord AS d_ord, ts AS d_ts, contract AS d_contract, input AS d_input, value AS d_value FROM tx WHERE stream = 0 AND src = wallet AND dst = '' AND contract <> ''),
fd AS (SELECT wallet, arg_min(d_contract, (d_ts, d_ord)) AS k0, min(d_ts) AS d0 FROM dep GROUP BY wallet),
w AS (SELECT DISTINCT wallet FROM tx)"""


def _r(cols: str, d: int = 6) -> str:
    return ", ".join(f"round({c}, {d}) AS {c}" for c in cols.split())


def q(*ctes: str, final: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


SIDE = "CASE WHEN stream = 1 THEN 'INTERNAL' WHEN dst = wallet THEN 'INCOMING' WHEN src = wallet THEN 'OUTGOING' ELSE 'INTERNAL' END"
KIND = "CASE WHEN contract <> '' THEN 'TOKEN_TRANSFER' WHEN input NOT IN ('0x', '0x0', '') THEN 'CONTRACT_CALL' ELSE 'TRANSFER' END"
STATS = f"""s AS (SELECT *, {SIDE} AS side, {KIND} AS kind, value::DOUBLE / 1e18 AS v FROM tx)"""
STATS_Q = """SELECT wallet, count(*) AS n_tx, count(*) FILTER (side = 'INCOMING') AS n_in, count(*) FILTER (side = 'OUTGOING') AS n_out, count(*) FILTER (is_error) AS n_failed,
count(*) FILTER (kind = 'CONTRACT_CALL') AS n_calls, round(coalesce(sum(v) FILTER (side = 'INCOMING'), 0), 6) AS received, round(coalesce(sum(v) FILTER (side = 'OUTGOING'), 0), 6) AS sent,
round(coalesce(sum(v) FILTER (side <> 'INTERNAL'), 0) / count(*), 6) AS average, round(coalesce(max(v) FILTER (side = 'INCOMING'), 0), 6) AS largest_in, round(coalesce(max(v) FILTER (side = 'OUTGOING'), 0), 6) AS largest_out,
count(DISTINCT nullif(CASE side WHEN 'INCOMING' THEN src WHEN 'OUTGOING' THEN dst END, '')) AS n_counterparties, min(ts) AS first_ts, max(ts) AS last_ts, round((max(ts) - min(ts)) / 86400.0, 6) AS age_days FROM s GROUP BY wallet"""

OUT = "o AS (SELECT *, value::DOUBLE / 1e18 AS v FROM tx WHERE src = wallet AND dst <> wallet AND stream = 0)"


def grade(expr: str, crit: float, high: float, names: tuple[str, str] = ("CRITICAL", "HIGH")) -> str:
    return f"CASE WHEN {expr} >= {crit} THEN '{names[0]}' WHEN {expr} >= {high} THEN '{names[1]}' END AS severity"


LARGE = "r1 AS (SELECT wallet, max(v) AS m, arg_max(tx_hash, (value, -ts, -ord)) AS h FROM o GROUP BY wallet)"


def burst(count: int) -> str:
    return f"""r2a AS (SELECT wallet, ts, count(*) OVER (PARTITION BY wallet ORDER BY ts RANGE BETWEEN CURRENT ROW AND 300 FOLLOWING) AS n FROM o),
r2 AS (SELECT wallet, max(n) AS m, arg_max(ts, (n, -ts)) AS h, {grade('max(n)', 3 * count, count)} FROM r2a GROUP BY wallet)"""


DORMANT = f"""r4a AS (SELECT wallet, ts, ts - lag(ts) OVER (PARTITION BY wallet ORDER BY ts, stream, ord) AS gap, count(*) OVER (PARTITION BY wallet ORDER BY ts RANGE BETWEEN CURRENT ROW AND 172800 FOLLOWING) AS after FROM tx),
r4 AS (SELECT wallet, max(gap) / 86400.0 AS m, arg_max(after, (gap, -ts)) AS h, {grade('max(gap) / 86400.0', 360, 180)} FROM r4a WHERE gap IS NOT NULL GROUP BY wallet)"""


def activity(days: float) -> str:
    return f"""r5a AS (SELECT wallet, (ts - min(ts) OVER (PARTITION BY wallet)) // {int(days * 86400)} AS b FROM tx), r5b AS (SELECT wallet, b, count(*) AS n FROM r5a GROUP BY ALL),
r5c AS (SELECT wallet, arg_max(n, b) AS last, sum(n) AS a, count(*) AS k FROM r5b GROUP BY wallet HAVING count(*) >= 2 AND sum(n) >= 4),
r5 AS (SELECT wallet, last / ((a - last) / (k - 1)) AS m, k AS h, {grade('last / ((a - last) / (k - 1))', 9, 3)} FROM r5c)"""


ROUND = f"""r6a AS (SELECT o.wallet, ts, ord, a FROM o JOIN (SELECT unnest([0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0])::DOUBLE AS a) ON abs(v - a) / a <= 1e-4 WHERE v >= 0.01),
r6b AS (SELECT wallet, a, count(*) AS n, min(ts) AS t, arg_min(ord, (ts, ord)) AS f FROM r6a GROUP BY ALL),
r6 AS (SELECT wallet, sum(n) AS m, arg_max(a, (n, -t, -f)) AS h, {grade('sum(n)', 9, 3, ('HIGH', 'MEDIUM'))} FROM r6b GROUP BY wallet)"""


def new(as_of: int) -> str:
    return f"""r7 AS (SELECT wallet, count(*) AS m, CASE WHEN count(*) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM o WHERE {as_of} - ts <= 86400 AND v >= 0.1 AND dst NOT IN (SELECT address FROM ent) GROUP BY wallet)"""


LARGE_G = grade("m", 100, 10)
FAN = f"r3 AS (SELECT wallet, count(DISTINCT dst) AS m, {grade('count(DISTINCT dst)', 60, 20)} FROM o WHERE dst <> '' GROUP BY wallet)"
FLAGS = """fl AS (SELECT wallet, coalesce(bool_or(type = 'MIXER'), false) AS mixer, coalesce(bool_or(type = 'CEX'), false) AS cex, coalesce(bool_or(type = 'BRIDGE'), false) AS bridge
FROM (SELECT wallet, unnest([src, dst]) AS address FROM tx) LEFT JOIN ent USING (address) GROUP BY wallet)"""

RISK = q(ORDERS, ENT, OUT, LARGE, burst(5), FAN, DORMANT, activity(30), ROUND, new(1735689600), FLAGS, f"""
al AS (SELECT wallet, {LARGE_G} FROM r1 UNION ALL SELECT wallet, severity FROM r2 UNION ALL SELECT wallet, severity FROM r3 UNION ALL SELECT wallet, severity FROM r4
  UNION ALL SELECT wallet, severity FROM r5 UNION ALL SELECT wallet, severity FROM r6 UNION ALL SELECT wallet, severity FROM r7),
n AS (SELECT wallet, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l FROM al GROUP BY wallet),
z AS (SELECT fl.*, coalesce(c, 0) AS n_critical, coalesce(h, 0) AS n_high, coalesce(m, 0) AS n_medium, coalesce(l, 0) AS n_low FROM fl LEFT JOIN n USING (wallet)),
y AS (SELECT *, least(100, n_critical * 40 + n_high * 25 + n_medium * 10 + n_low * 5 + CASE WHEN mixer THEN 30 ELSE 0 END) AS risk_score FROM z)""",
    final="SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM y")

HEX = "CASE WHEN starts_with(lower({0}), '0x') THEN substr(lower({0}), 3) ELSE lower({0}) END"
SEL = f"CASE WHEN length({HEX.format('input')}) >= 8 THEN left({HEX.format('input')}, 8) END"
LSEL = "CASE WHEN length(ltrim(lower(input), '0x')) >= 8 THEN left(ltrim(lower(input), '0x'), 8) ELSE '' END"
CHUNKS = "list_distinct([substr(replace(lower({0}), '0x', ''), j * 8 + 1, 8) for j in range(length(replace(lower({0}), '0x', '')) // 8)])"
JACC = "(len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))))"

PRE = f"""og AS (SELECT * FROM tx WHERE stream = 0 AND src = wallet), inb AS (SELECT * FROM tx WHERE dst = wallet AND value > 0),
lg1 AS (SELECT d.wallet, d_ord, d_ts, src, count(*) AS n, min(stream * 1000000000 + ord) AS p, max(ts) AS last FROM dep d JOIN inb i ON i.wallet = d.wallet AND ts >= d_ts - 259200 AND ts < d_ts GROUP BY ALL),
lags AS (SELECT wallet, d_ord, arg_max(src, (n, -p)) AS funder, (d_ts - arg_max(last, (n, -p))) / 3600.0 AS lag_hours FROM lg1 GROUP BY wallet, d_ord, d_ts),
ca AS (SELECT wallet, ts, ord, is_error, {SEL} AS sel, {CHUNKS.format('input')} AS a FROM og WHERE contract = ''), db AS (SELECT *, {CHUNKS.format('d_input')} AS b FROM dep),
dry AS (SELECT d.wallet, d_ord, least(10, count(*) FILTER (is_error OR (len(a) > 0 AND len(b) > 0 AND {JACC.format('a', 'b')} >= 0.40))) AS n_dry FROM db d JOIN ca c ON c.wallet = d.wallet AND ts >= d_ts - 21600 AND ts < d_ts GROUP BY ALL),
seqs AS (SELECT d.wallet, d_ord, list(sel ORDER BY ts, ord) AS seq FROM dep d JOIN ca c ON c.wallet = d.wallet AND ts >= d_ts - 86400 AND ts < d_ts WHERE sel IS NOT NULL GROUP BY ALL),
own AS (SELECT d.wallet, d_ord, arg_min('0x' || substr(replace(lower(input), '0x', ''), 33, 40), nonce) AS new_owner FROM dep d JOIN og c ON c.wallet = d.wallet AND ts > d_ts AND ts <= d_ts + 172800
  WHERE {SEL} IN ('f2fde38b', '13af4035', 'a6f9dae1') AND length(replace(lower(input), '0x', '')) >= 72 GROUP BY ALL),
dfe AS (SELECT d.wallet, d_ord, d_ts, d_contract, greatest(0, (d_ts - f.t) / 3600.0) AS warmup_hours, funder, lag_hours, coalesce(n_dry, 0) AS n_dry, coalesce(len(seq), 0) AS n_setup, coalesce(array_to_string(seq, ' '), '') AS seq, new_owner FROM dep d
  JOIN (SELECT wallet, min(ts) AS t FROM tx GROUP BY wallet) f USING (wallet) LEFT JOIN lags USING (wallet, d_ord) LEFT JOIN dry USING (wallet, d_ord) LEFT JOIN seqs USING (wallet, d_ord) LEFT JOIN own USING (wallet, d_ord)),
f17 AS (SELECT wallet, min(warmup_hours) AS f1_warmup_hours, CASE WHEN count(lag_hours) >= 2 AND avg(lag_hours) > 0 THEN stddev_samp(lag_hours) / avg(lag_hours) END AS f2_funding_cv, sum(n_dry)::BIGINT AS f3_dry_run_count, count(*) AS f4_deployment_count, count(new_owner) AS ownership_transfer_count FROM dfe GROUP BY wallet),
fsr AS (SELECT DISTINCT wallet, src AS funder FROM tx WHERE dst = wallet AND value > 0 AND src <> wallet AND src <> ''), fsc AS (SELECT wallet, count(*) AS n_src FROM fsr GROUP BY wallet),
bg AS (SELECT wallet, d_ts - lag(d_ts) OVER (PARTITION BY wallet ORDER BY d_ts) AS g FROM dep),
bu AS (SELECT wallet, CASE WHEN count(g) >= 2 AND avg(g) <> 0 THEN (stddev_samp(g) - avg(g)) / (stddev_samp(g) + avg(g)) END AS f4_burstiness FROM bg GROUP BY wallet),
eg AS (SELECT wallet, ts - lag(ts) OVER (PARTITION BY wallet ORDER BY ts) AS g FROM og),
en AS (SELECT wallet, CASE WHEN count(*) >= 3 THEN entropy(round_even(g / 60.0, 0)) END AS f5_nonce_entropy FROM eg WHERE g > 0 GROUP BY wallet),
kn AS (SELECT wallet, list_distinct(flatten(list(seq))) AS known FROM seqs GROUP BY wallet),
cd AS (SELECT s.wallet, d_ord, list_aggregate([chr((64 + list_position(known, x))::INT) for x in seq], 'string_agg', '') AS code FROM seqs s JOIN kn USING (wallet)),
f7 AS (SELECT a.wallet, avg(1.0 - levenshtein(a.code, b.code) / greatest(length(a.code), length(b.code))) AS f7_within_wallet_sim FROM cd a JOIN cd b ON a.wallet = b.wallet AND a.d_ord < b.d_ord GROUP BY a.wallet),
pre AS (SELECT w.wallet, f1_warmup_hours, f2_funding_cv, coalesce(f3_dry_run_count, 0) AS f3_dry_run_count, coalesce(f4_deployment_count, 0) AS f4_deployment_count, coalesce(ownership_transfer_count, 0) AS ownership_transfer_count,
  f4_burstiness, f5_nonce_entropy, f7_within_wallet_sim, coalesce(n_src, 0) AS funding_source_count, coalesce(f4_deployment_count, 0) = 1 AS new_a_single_deploy FROM w LEFT JOIN fsc USING (wallet) LEFT JOIN f17 USING (wallet) LEFT JOIN bu USING (wallet) LEFT JOIN en USING (wallet) LEFT JOIN f7 USING (wallet))"""

_CAT = "CASE WHEN type IS NOT NULL THEN type WHEN ({0} - first_ts) / 3600.0 <= 48 THEN 'FRESH_WALLET' ELSE 'UNKNOWN_EOA' END"
FUND = f"""fs1 AS (SELECT wallet, arg_min(src, (ts, stream, ord)) AS src FROM tx WHERE dst = wallet AND value > 0 GROUP BY wallet),
fp1 AS (SELECT w.wallet, coalesce({_CAT.format('d0')}, 'UNKNOWN_EOA') AS fp_first_inbound_source_type FROM w LEFT JOIN fs1 USING (wallet) LEFT JOIN ent ON address = src LEFT JOIN ages g ON g.address = src LEFT JOIN fd USING (wallet)),
sd AS (SELECT t.*, type, first_ts, {_CAT.format('ts')} AS source FROM tx t JOIN fd USING (wallet) LEFT JOIN ent ON address = src LEFT JOIN ages g ON g.address = src WHERE dst = wallet AND value > 0 AND ts < d0),
sx AS (SELECT wallet, source, sum(value)::DOUBLE AS x FROM sd GROUP BY ALL), sp AS (SELECT wallet, x / sum(x) OVER (PARTITION BY wallet) AS p FROM sx), sh AS (SELECT wallet, (0.0 - sum(p * log2(p))) / log2(7) AS fp_entropy_norm FROM sp GROUP BY wallet),
sf AS (SELECT wallet, coalesce(sum(value) FILTER ((ts - first_ts) / 3600.0 <= 48), 0)::DOUBLE / sum(value)::DOUBLE AS fp_fraction_fresh, any_value(fp_entropy_norm) AS fp_entropy_norm, median(value::DOUBLE / 1e18) AS fp_median_seed_eth, count(*) AS fp_seed_count,
  max(value) FILTER (gas_price > 0)::DOUBLE / arg_max(gas_price, (value, -ts, -stream, -ord)) FILTER (gas_price > 0) AS fp_seed_gas_units FROM sd JOIN sh USING (wallet) GROUP BY wallet),
ed AS (SELECT DISTINCT wallet, src, dst FROM tx WHERE value > 0 AND src <> '' AND dst <> ''),
wk AS (SELECT wallet, wallet AS node, 0 AS hops FROM w UNION SELECT k.wallet, ed.src, hops + 1 FROM wk k JOIN ed ON ed.wallet = k.wallet AND ed.dst = k.node WHERE hops < 5),
hp AS (SELECT w.wallet, min(hops) AS fp_min_hops FROM w LEFT JOIN (SELECT * FROM wk WHERE node IN (SELECT address FROM ent)) USING (wallet) GROUP BY w.wallet),
e3 AS (SELECT DISTINCT wallet, src, dst FROM tx WHERE value >= 5000000000000000 AND src <> '' AND dst <> '' AND src NOT IN (SELECT address FROM ent) AND src NOT IN ('f4')),
uw AS (SELECT wallet, wallet AS node, 0 AS depth FROM w UNION SELECT k.wallet, e3.src, depth + 1 FROM uw k JOIN e3 ON e3.wallet = k.wallet AND e3.dst = k.node WHERE depth < 3),
up AS (SELECT wallet, node AS funder, min(depth) AS depth FROM uw WHERE node <> wallet GROUP BY ALL),
upn AS (SELECT wallet, count(*) AS n FROM up GROUP BY wallet),
ij AS (SELECT a.wallet, b.wallet AS other, count(*) AS i FROM up a JOIN up b ON a.funder = b.funder AND a.wallet <> b.wallet GROUP BY ALL),
shf AS (SELECT upn.wallet, count(DISTINCT other) AS n_shared FROM upn LEFT JOIN ij USING (wallet) GROUP BY upn.wallet),
jc AS (SELECT a.wallet, coalesce(max(i / (a.n + b.n - i)), 0.0) AS fp_max_funder_jaccard FROM upn a LEFT JOIN ij ON ij.wallet = a.wallet LEFT JOIN upn b ON b.wallet = other GROUP BY a.wallet),
fund AS (SELECT fp1.*, fp_fraction_fresh, fp_entropy_norm, fp_median_seed_eth, coalesce(fp_seed_count, 0) AS fp_seed_count, fp_seed_gas_units, fp_min_hops, fp_max_funder_jaccard, coalesce(n_shared > 0, false) AS fp_shared_funder
  FROM fp1 LEFT JOIN sf USING (wallet) LEFT JOIN hp USING (wallet) LEFT JOIN shf USING (wallet) LEFT JOIN jc USING (wallet))"""

_RND = "round(({0}) % 0.5, 6) = 0"
CASH = f"""cr AS (SELECT t.*, k0, d0, e.type AS dt, g.first_ts AS df, value::DOUBLE / 1e18 AS v, src = wallet AS sent, {LSEL} AS sel FROM tx t JOIN fd USING (wallet) LEFT JOIN ent e ON e.address = dst LEFT JOIN ages g ON g.address = dst),
cf AS (SELECT *, dst = k0 AND NOT sent AND value > 0 AS victim, src = k0 AND dst = wallet AND value > 0 AS drawn, sent AND dst <> '' AND dst <> k0 AND value > 0 AND ts >= d0 AND contract = '' AS out_,
  min(CASE WHEN sent AND ts >= d0 AND sel IN ('baa2abde', '02751cec', 'af2979eb', 'ded9382a', 'a9059cbb') THEN ts END) OVER (PARTITION BY wallet ORDER BY ts, stream, ord) AS at_,
  (src = k0 OR src = wallet) AS si, (dst = k0 OR dst = wallet) AS di FROM cr),
cg AS (SELECT *, sent AND dt = 'DEX' AND at_ IS NOT NULL AND ts - at_ BETWEEN 0 AND 86399 AS swap FROM cf),
ch AS (SELECT wallet, min(ts) FILTER (victim) AS v1, min(ts) FILTER (drawn) AS w1, max(ts) FILTER (drawn) AS w2, count(*) FILTER (drawn) AS nw, coalesce(sum(value) FILTER (victim), 0) AS vic, coalesce(sum(value) FILTER (drawn), 0) AS drw,
  count(*) FILTER (out_) AS no, avg(v) FILTER (out_) AS m, stddev_samp(v) FILTER (out_) AS s, avg(({_RND.format('v')})::INT) FILTER (out_) AS rr, count(DISTINCT dst) FILTER (out_) AS nd, count(DISTINCT dst) FILTER (out_ AND dt IS NULL) AS nu,
  count(DISTINCT dst) FILTER (out_ AND dt IS NULL AND (d0 - df) / 86400.0 < 7) AS ny, coalesce(sum(value) FILTER (out_), 0) AS ov, coalesce(sum(value) FILTER (out_ AND dt IN ('CEX', 'MIXER')), 0) AS cv, coalesce(bool_or(out_ AND dt = 'MIXER'), false) AS mx,
  bool_or(coalesce(swap, false)) AS sw, arg_min(ts - at_, (ts, stream, ord)) FILTER (swap) AS sl,
  sum(CASE WHEN di AND NOT si AND value > 0 THEN value WHEN si AND NOT di AND value > 0 THEN -value - gas_used::HUGEINT * gas_price ELSE 0 END) AS lft FROM cg GROUP BY wallet),
cash AS (SELECT wallet, CASE WHEN w1 >= v1 THEN w1 - v1 END::DOUBLE AS cp1_withdrawal_latency_sec, nw AS cp2_withdrawal_count, CASE WHEN vic > 0 AND nw > 0 THEN drw::DOUBLE / vic::DOUBLE END AS cp2_drain_ratio,
  CASE WHEN vic > 0 AND nw >= 2 THEN (w2 - w1) / 3600.0 END AS cp2_withdrawal_span_hours, CASE WHEN no >= 4 AND m > 0 THEN s / m END AS cp3_outflow_cv, CASE WHEN no >= 4 THEN rr END AS cp3_round_number_ratio, no AS cp3_outflow_count,
  nu AS cp4_suspicious_destination_count, CASE WHEN nd > 0 THEN ny / nd END AS cp4_fresh_wallet_ratio, CASE WHEN ov > 0 THEN cv::DOUBLE / ov::DOUBLE END AS cp5_concentration_ratio, mx AS cp5_mixer_contact, sw AS cp6_swap_detected, sl::DOUBLE AS cp6_swap_latency_sec,
  CASE WHEN vic > 0 THEN greatest(0, lft)::DOUBLE / vic::DOUBLE END AS cp7_retained_ratio, CASE WHEN vic > 0 THEN vic END::DOUBLE AS cp_victim_inflow_wei FROM ch)"""

VALUE = f"""vr AS (SELECT t.*, k0, d0, value::DOUBLE / 1e18 AS v, src = wallet AS sent, dst = wallet AS got, {LSEL} AS sel, gas_price / 1e9 AS gw FROM tx t LEFT JOIN fd USING (wallet)),
vf AS (SELECT *, got AND NOT sent AND value > 0 AS fresh, stream = 0 AND sent AND gas_price > 0 AS priced, value > 0 AND value < 100000000000000 AS dust, coalesce(src = k0 AND got AND value > 0, false) AS drawn FROM vr),
vg AS (SELECT *, min(ts) FILTER (drawn) OVER (PARTITION BY wallet) AS cash_, fresh AND (d0 IS NULL OR ts < d0) AS seed, sent AND sel IN ('f305d719', 'e8e33700', '2f2d783d') AND value > 0 AS added,
  got AND sel IN ('baa2abde', '02751cec', 'af2979eb', 'ded9382a') AND value > 0 AS removed FROM vf),
va AS (SELECT wallet, max(k0) AS k0, count(*) FILTER (fresh) AS n1, count(*) FILTER (seed) AS n2, avg(({_RND.format('v')})::INT) FILTER (seed) AS r2, count(*) FILTER (priced) AS n3, avg(gw) FILTER (priced) AS m, stddev_samp(gw) FILTER (priced) AS s,
  avg((round(gw % 1.0, 4) = 0)::INT) FILTER (priced) AS r3, count(*) FILTER (dust AND sent) AS od, count(*) FILTER (dust AND sent AND ts BETWEEN cash_ - 86400 AND cash_) AS pd, count(DISTINCT dst) FILTER (dust AND sent) AS ud, count(*) FILTER (dust AND got) AS idd,
  count(*) FILTER (stream = 0 AND sent AND dst = '' AND contract <> '') AS n5, coalesce(sum(value) FILTER (stream = 0 AND sent AND dst = '' AND contract <> ''), 0)::DOUBLE / 1e18 AS d, coalesce(sum(value) FILTER (sent AND dst = k0 AND value > 0 AND ts >= d0), 0)::DOUBLE / 1e18 AS f,
  coalesce(sum(value) FILTER (drawn), 0)::DOUBLE / 1e18 AS c, coalesce(sum(value) FILTER (added), 0)::DOUBLE / 1e18 AS a, coalesce(sum(value) FILTER (removed), 0)::DOUBLE / 1e18 AS b FROM vg GROUP BY wallet),
vc AS (SELECT wallet, value, count(*) AS n FROM vg WHERE fresh GROUP BY ALL), vt AS (SELECT wallet, list(n ORDER BY n DESC) AS l FROM vc GROUP BY wallet),
v5 AS (SELECT d.wallet, d_ord, d_ts, coalesce(list(DISTINCT round(v, 2)) FILTER (v IS NOT NULL), []) AS s FROM dep d LEFT JOIN (SELECT * FROM vg WHERE fresh) t ON t.wallet = d.wallet AND ts >= d_ts - 259200 AND ts < d_ts GROUP BY ALL),
v6 AS (SELECT wallet, s, lag(s) OVER (PARTITION BY wallet ORDER BY d_ts, d_ord) AS p FROM v5), v7 AS (SELECT wallet, avg({JACC.format('s', 'p')}) AS j FROM v6 WHERE p IS NOT NULL AND len(s) + len(p) > 0 GROUP BY wallet),
val AS (SELECT va.wallet, CASE WHEN n1 >= 2 THEN l[1] / n1 END AS vs1_mode_freq_ratio, CASE WHEN n1 >= 2 THEN (l[1] + coalesce(l[2], 0)) / n1 END AS vs1_top2_coverage, n1 AS vs1_inbound_count, CASE WHEN n2 >= 2 THEN r2 END AS vs2_round_funding_ratio,
  n2 AS vs2_pre_deploy_funding_count, CASE WHEN n3 >= 2 AND m > 0 THEN s / m END AS vs3_cv_gas, CASE WHEN n3 >= 2 THEN r3 END AS vs3_round_gas_ratio, n3 AS vs3_gas_tx_count, od AS vs4_outbound_dust_count, pd AS vs4_pre_cashout_dust_count,
  ud AS vs4_unique_dust_destinations, idd AS vs4_inbound_dust_count, CASE WHEN n5 >= 2 THEN j END AS vs5_avg_cross_deploy_jaccard, n5 AS vs5_deployment_count_for_vs5, CASE WHEN k0 IS NOT NULL THEN d END AS vs6_v_deploy_eth,
  CASE WHEN k0 IS NOT NULL THEN f END AS vs6_v_self_fund_eth, CASE WHEN k0 IS NOT NULL THEN c END AS vs6_v_cashout_eth, CASE WHEN k0 IS NOT NULL THEN c / greatest(d + f, 0.001) END AS vs6_extraction_multiplier,
  CASE WHEN k0 IS NOT NULL AND (a > 0 OR b > 0) THEN a END AS vs6_lp_eth_added, CASE WHEN k0 IS NOT NULL AND (a > 0 OR b > 0) THEN b END AS vs6_lp_eth_removed, CASE WHEN k0 IS NOT NULL AND (a > 0 OR b > 0) THEN b - a END AS vs6_lp_net_eth,
  NULL::DOUBLE AS vs6_creator_token_fraction, NULL::BIGINT AS vs6_mint_to_lp_latency_sec FROM va LEFT JOIN vt USING (wallet) LEFT JOIN v7 USING (wallet))"""


def silence(as_of: int) -> str:
    sig = ", ".join(f"'{x}'" for x in ("0xa9059cbb", "0xbaa2abde", "0x02751cec", "0x7ff36ab5", "0x18cbafe5", "0x791ac947", "0xfb3bdb41"))
    return f"""x1a AS (SELECT wallet, min(ts) AS a, max(ts) AS b FROM tx WHERE src = wallet AND (value > 1000000000000000 OR lower(left(input, 10)) IN ({sig})) GROUP BY wallet HAVING count(*) >= 2),
x1 AS (SELECT wallet, round(({as_of} - b) / 86400.0, 1) AS exit1_silence_days, round(CASE WHEN {as_of} - a > 0 THEN (({as_of} - b) / 86400.0) / (({as_of} - a) / 86400.0) ELSE 0.0 END, 3) AS exit1_silence_ratio FROM x1a)"""


DORM = """x2a AS (SELECT t.*, CASE WHEN dst = '' THEN 2 ELSE 0 END + CASE WHEN type = 'MIXER' THEN 2 ELSE 0 END AS p FROM tx t LEFT JOIN ent ON address = dst WHERE stream = 0 AND src = wallet),
x2b AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY wallet ORDER BY ts, stream, ord)) / 86400.0 AS gap, sum(p) OVER (PARTITION BY wallet ORDER BY ts, stream, ord ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS rcs FROM x2a),
x2 AS (SELECT wallet, count(*) FILTER (gap > 30) AS exit2_dormancy_event_count, max(round(gap, 1)) FILTER (gap > 30) AS exit2_max_gap_days, max(rcs) FILTER (gap > 30)::BIGINT AS exit2_reactivation_context_score,
  coalesce(string_agg(ts || ':' || round(gap, 1) || ':' || rcs, ';' ORDER BY ts) FILTER (gap > 30), '') AS exit2_events FROM x2b GROUP BY wallet)"""

MIGR = """x4a AS (SELECT t.wallet, round((ts - first_ts) / 86400.0, 2) AS age, ts >= first_ts AS ok, round(value::DOUBLE / 1e18, 4) AS v FROM tx t JOIN cash USING (wallet) LEFT JOIN ages ON address = dst
  WHERE cp_victim_inflow_wei > 0 AND stream = 0 AND src = wallet AND dst <> '' AND value > floor(cp_victim_inflow_wei::DOUBLE * 0.30)::HUGEINT),
x4b AS (SELECT wallet, count(*) AS n, min(age) FILTER (ok) AS y, CASE WHEN count(age) FILTER (ok) > 0 THEN round(coalesce(sum(v) FILTER (ok AND age < 7), 0.0), 4) END AS f FROM x4a GROUP BY wallet),
x4 AS (SELECT cash.wallet, coalesce(n, 0) AS exit4_bulk_transfer_count, y AS exit4_youngest_dest_age_days, f AS exit4_total_eth_to_fresh_wallets FROM cash LEFT JOIN x4b USING (wallet))"""

BASE = [EVENTS, ENT, AGES, DEPLOYS]
FEATURES = [*BASE, PRE, FUND, CASH, VALUE, silence(1_706_572_800), DORM, MIGR, """feat AS (SELECT * REPLACE (coalesce(cp2_withdrawal_count, 0) AS cp2_withdrawal_count, coalesce(cp3_outflow_count, 0) AS cp3_outflow_count,
  coalesce(cp4_suspicious_destination_count, 0) AS cp4_suspicious_destination_count, coalesce(exit4_bulk_transfer_count, 0) AS exit4_bulk_transfer_count, coalesce(cp5_mixer_contact, false) AS cp5_mixer_contact, coalesce(cp6_swap_detected, false) AS cp6_swap_detected)
  FROM pre LEFT JOIN fund USING (wallet) LEFT JOIN cash USING (wallet) LEFT JOIN val USING (wallet) LEFT JOIN x1 USING (wallet) LEFT JOIN x2 USING (wallet) LEFT JOIN x4 USING (wallet))""",
    "res AS (" + " UNION ALL ".join(f"SELECT wallet, '{n}' AS rule_id, {severity_sql(c)} AS severity FROM feat" for n, c in RULES) + ")",
    "lab AS (SELECT wallet, CASE WHEN substr(wallet, 2)::BIGINT % 3 = 0 THEN 'bad' ELSE 'good' END AS label FROM w)"]
VERDICT = """vd1 AS (SELECT wallet, least(100, sum(CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 10 WHEN 'LOW' THEN 5 ELSE 0 END))::BIGINT AS raw, count(severity) AS n_fired, count(*) FILTER (severity IN ('HIGH', 'CRITICAL') AND rule_id <> 'RUG-NEW-A') AS n_high,
  bool_or(rule_id = 'RUG-FP4' AND severity IS NOT NULL) AS fp4, bool_or(rule_id = 'RUG-NEW-A' AND severity IS NOT NULL) AS na, bool_or(rule_id = 'RUG-NEW-B' AND severity IS NOT NULL) AS nb, string_agg(rule_id, ',' ORDER BY rule_id) FILTER (severity IS NOT NULL) AS fired,
  string_agg(rule_id || ':' || CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 10 ELSE 5 END, ',' ORDER BY rule_id) FILTER (severity IS NOT NULL) AS breakdown FROM res GROUP BY wallet),
vd AS (SELECT wallet, CASE WHEN fp4 THEN greatest(raw, 80) WHEN nb AND raw < 36 THEN 36 ELSE raw END AS score, CASE WHEN fp4 THEN 'HIGH_CONFIDENCE_RUGPULL' WHEN nb AND raw < 36 THEN 'MODERATE_PATTERN' WHEN na AND n_high = 0 AND NOT nb THEN 'INSUFFICIENT_DEPLOYMENT_HISTORY'
  WHEN raw < 20 THEN 'CLEAN' WHEN raw < 36 THEN 'WEAK_PATTERN' WHEN raw < 50 THEN 'MODERATE_PATTERN' WHEN raw < 100 THEN 'STRONG_PATTERN' ELSE 'HIGH_CONFIDENCE_RUGPULL' END AS verdict,
  CASE WHEN fp4 THEN 'shared_funder' WHEN nb AND raw < 36 THEN 'ownership' WHEN na AND n_high = 0 AND NOT nb THEN 'single_deployment' END AS override, n_fired, n_high, coalesce(fired, '') AS fired, coalesce(breakdown, '') AS breakdown FROM vd1)"""

_SENDERS = "SELECT wallet, src AS other, value::DOUBLE / 1e18 AS value, ts, ord FROM tx WHERE stream = 0 AND dst = wallet AND src <> '' AND src <> wallet"
_RECEIVERS = "SELECT wallet, dst AS other, value::DOUBLE / 1e18 AS value, ts, ord FROM tx WHERE src = wallet AND dst <> '' AND dst <> wallet"
_CAND = """
cq AS (SELECT *, CASE WHEN max(value) OVER (PARTITION BY wallet) > 0 THEN max(value) OVER (PARTITION BY wallet) ELSE 1.0 END AS top FROM cp),
cs AS (SELECT cq.*, e.type, CASE WHEN value <= 1e-9 THEN 0.0 ELSE least(1.0, ln(1 + value) / ln(1 + top)) END AS value_score, pow(2.0, -greatest(0.0, (1706572800 - ts) / 86400.0) / 90.0) AS recency_score,
  CASE WHEN e.type = 'CEX' THEN 0.0 ELSE 1.0 END AS novelty_score, CASE WHEN e.type = 'MIXER' THEN 1.0 ELSE 0.0 END AS rule_score FROM cq LEFT JOIN ent e ON e.address = other),
ct AS (SELECT *, 0.3 * value_score + 0.2 * recency_score + 0.3 * novelty_score + 0.2 * rule_score AS score FROM cs), cu AS (SELECT * FROM ct QUALIFY row_number() OVER (PARTITION BY wallet, other ORDER BY score DESC, ts, ord) = 1)"""
CAND, CAND_BACK, CAND_BOTH = (f"cp AS ({rows})," + _CAND for rows in (_RECEIVERS, _SENDERS, f"{_SENDERS} UNION ALL {_RECEIVERS}"))

MIRROR = "mx AS (SELECT * FROM tx UNION ALL SELECT * REPLACE (CASE WHEN src = wallet THEN dst WHEN dst = wallet THEN src END AS wallet) FROM tx WHERE CASE WHEN src = wallet THEN dst WHEN dst = wallet THEN src END <> '')"


def links(table: str) -> str:
    return f"""lk AS (SELECT wallet, other, max(v) AS v FROM (SELECT wallet, CASE WHEN src = wallet THEN dst WHEN dst = wallet THEN src END AS other, value::DOUBLE / 1e18 AS v FROM {table}) WHERE other <> '' AND other <> wallet GROUP BY ALL),
lp AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY v DESC, other) AS place FROM lk), wd AS (SELECT wallet, count(*) AS n FROM lk GROUP BY wallet)"""


def trace_levels(depth: int, most: int) -> list[str]:
    """A trace level by level: ``tsN`` is all that was reached up to level N."""
    out = ["ts0 AS (SELECT DISTINCT wallet AS root, wallet AS node, 0 AS depth, 'EXPAND' AS decision, 'ok' AS reason FROM tx)"]
    for n in range(1, depth + 1):
        p = f"ts{n - 1}"
        out.append(f"""ta{n} AS (SELECT root, other, max(v) AS v FROM {p} JOIN lp ON lp.wallet = {p}.node WHERE depth = {n - 1} AND (decision = 'EXPAND' OR (decision = 'SAMPLE' AND place <= 10)) GROUP BY ALL),
tb{n} AS (SELECT t.*, type, coalesce(wd.n, 0) AS wide, used FROM ta{n} t LEFT JOIN ent ON address = other LEFT JOIN wd ON wd.wallet = other JOIN (SELECT root, count(*) FILTER (decision IN ('EXPAND', 'SAMPLE')) AS used FROM {p} GROUP BY root) USING (root)
  WHERE NOT EXISTS (SELECT 1 FROM {p} x WHERE x.root = t.root AND x.node = t.other)),
tc{n} AS (SELECT *, CASE WHEN v < 0.05 THEN 'dust' WHEN used >= {most} THEN 'budget' WHEN type IN ('CEX', 'MIXER', 'BRIDGE') THEN 'entity' WHEN type = 'DEX' THEN 'dex' WHEN wide > 50 THEN 'fanout' ELSE 'ok' END AS reason FROM tb{n}),
td{n} AS (SELECT *, CASE WHEN reason IN ('dust', 'budget') THEN 'SKIP' WHEN reason = 'entity' THEN 'HALT' WHEN reason = 'ok' THEN 'EXPAND' ELSE 'SAMPLE' END AS decision FROM tc{n}),
te{n} AS (SELECT *, decision IN ('EXPAND', 'SAMPLE') AND used + row_number() OVER (PARTITION BY root, decision IN ('EXPAND', 'SAMPLE') ORDER BY v DESC, other) > {most} AS over_ FROM td{n}),
ts{n} AS (SELECT * FROM {p} UNION ALL SELECT root, other, {n}, CASE WHEN over_ THEN 'SKIP' ELSE decision END, CASE WHEN over_ THEN 'budget' ELSE reason END FROM te{n})""")
    return out


TRACE = q(EVENTS, ENT, MIRROR, links("mx"), *trace_levels(3, 60), final="SELECT * FROM ts3")

_ST = ["vs1_mode_freq_ratio", "vs2_round_funding_ratio", "vs3_cv_gas", "vs6_extraction_multiplier"]
LONG = "lg AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, label, {n}::DOUBLE AS x FROM val JOIN lab USING (wallet) WHERE {n} IS NOT NULL" for n in _ST) + "), st AS (SELECT feature, label, count(*) AS n, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, min(x) AS min, max(x) AS max, avg(x) AS mean FROM lg GROUP BY ALL)"
LAB = FEATURES[-1]

_PRE = "f1_warmup_hours f2_funding_cv f4_burstiness f5_nonce_entropy f7_within_wallet_sim"
_CASH = "cp2_drain_ratio cp2_withdrawal_span_hours cp3_outflow_cv cp3_round_number_ratio cp4_fresh_wallet_ratio cp5_concentration_ratio cp7_retained_ratio"
_VAL = "vs1_mode_freq_ratio vs1_top2_coverage vs2_round_funding_ratio vs3_cv_gas vs3_round_gas_ratio vs5_avg_cross_deploy_jaccard vs6_v_deploy_eth vs6_v_self_fund_eth vs6_v_cashout_eth vs6_extraction_multiplier vs6_lp_eth_added vs6_lp_eth_removed vs6_lp_net_eth"
_SEED = "fp_fraction_fresh fp_entropy_norm fp_median_seed_eth fp_seed_gas_units"


def rep(cols: str, table: str) -> str:
    return f"SELECT * REPLACE ({_r(cols)}) FROM {table}"


def _rule_q(name: str, *ctes: str, evidence: str = "h::VARCHAR", severity: str = "severity", extra: str = EVENTS) -> str:
    return q(extra, ENT, OUT, *ctes, final=f"SELECT wallet, round(m::DOUBLE, 6) AS metric, {evidence} AS evidence, {severity} FROM {name}")


TOKENS = """tk AS (SELECT 'u' || user_id AS wallet, event_id AS ord, epoch_us(ts) // 1000000 AS ts, CASE WHEN event_id % 3 = 0 THEN '0x' || repeat('0', 40) ELSE 'u' || user_id END AS src, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 'd' || (event_id % 37) END AS dst,
  round(value * 100)::BIGINT AS amount FROM events WHERE event_type = 'click'),
tm AS (SELECT wallet, sum(amount) AS all_, coalesce(sum(amount) FILTER (dst = wallet), 0) AS own_, arg_min(ts, ord) AS mint FROM tk WHERE src = '0x' || repeat('0', 40) AND amount > 0 GROUP BY wallet),
lp_ AS (SELECT wallet, min(ts) AS lp FROM vg WHERE added GROUP BY wallet)"""
_FIRED = f"""fi AS (SELECT wallet, 'RULE-001' AS rule_id, {LARGE_G}, h AS evidence, printf('one transfer moved %.6f ETH (%s)', m, h) AS reasoning FROM r1
  UNION ALL SELECT wallet, 'RULE-002', severity, h::VARCHAR, printf('%d transfers went out within one window from %d on', m, h) FROM r2
  UNION ALL SELECT wallet, 'RULE-003', severity, '', printf('funds went to %d different addresses', m) FROM r3
  UNION ALL SELECT wallet, 'RULE-004', severity, h::VARCHAR, printf('after %.3f silent days, %d transactions followed within two days', round(m, 3), h) FROM r4
  UNION ALL SELECT wallet, 'RULE-005', severity, h::VARCHAR, printf('the last period has %.3f times the usual number of transactions, over %d active periods', round(m, 3), h) FROM r5
  UNION ALL SELECT wallet, 'RULE-006', severity, h::VARCHAR, printf('%d transfers of round amounts, most often %s ETH', m::BIGINT, h::VARCHAR) FROM r6
  UNION ALL SELECT wallet, 'RULE-007', severity, '', printf('%d recent transfers to addresses that nobody knows', m) FROM r7),
fo AS (SELECT * FROM fi WHERE severity IS NOT NULL)"""
_SCORE = """n_ AS (SELECT wallet, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m FROM fo GROUP BY wallet),
rk AS (SELECT wallet, least(100, coalesce(c, 0) * 40 + coalesce(h, 0) * 25 + coalesce(m, 0) * 10 + CASE WHEN mixer THEN 30 ELSE 0 END) AS risk_score FROM fl LEFT JOIN n_ USING (wallet)),
rl AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM rk)"""
_RISKS = RISK.removeprefix("WITH RECURSIVE ")
_INVEST = f"""WITH RECURSIVE risks AS (SELECT * FROM (WITH {_RISKS})), v_ AS (SELECT *, substr(wallet, 2)::BIGINT AS k FROM risks),
o_ AS (SELECT *, CASE WHEN k % 3 = 0 THEN k % 101 ELSE 0 END AS own, CASE WHEN k % 3 = 0 THEN [1, 1, 2, 3, 4][k % 5 + 1] ELSE 1 END AS lift, list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], risk_level) AS lv FROM v_),
p_ AS (SELECT *, greatest(risk_score, own) AS score, greatest(lv, lift) AS level FROM o_)
SELECT 'case' || (k % 40) AS case_id, max(score) AS risk_score, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][arg_max(level, (score, level))] AS risk_level, count(*) AS n_wallets, sum(n_critical)::BIGINT AS n_critical, sum(n_high)::BIGINT AS n_high, sum(n_medium)::BIGINT AS n_medium,
sum(n_low)::BIGINT AS n_low, bool_or(mixer) AS mixer, bool_or(cex) AS cex, bool_or(bridge) AS bridge FROM p_ GROUP BY k % 40"""

def checksums() -> str:
    """Keccak-256 of 40 bytes in SQL: a list of 25 lanes, reduced over the rounds."""
    turned = lambda x, n: x if not n else f"((({x} & {(1 << (64 - n)) - 1}) << {n}) | ({x} >> {64 - n}))"
    let = lambda value, name, use: f"list_transform([{value}], lambda {name}: {use})[1]"
    xor = lambda *xs: xs[0] if len(xs) == 1 else f"xor({xs[0]}, {xor(*xs[1:])})"
    columns = "[" + ", ".join(xor(*[f"s[{x + 5 * y + 1}]" for y in range(5)]) for x in range(5)) + "]"
    mixed = "[" + ", ".join(xor(f"c[{(x + 4) % 5 + 1}]", turned(f"c[{(x + 1) % 5 + 1}]", 1)) for x in range(5)) + "]"
    laid = "[" + ", ".join(xor(f"s[{i + 1}]", f"d[{i % 5 + 1}]") for i in range(25)) + "]"
    moved = "[" + ", ".join(turned(f"t[{a + 1}]", n) for a, _, n in sorted(rotations(), key=lambda r: r[1])) + "]"
    ones = (1 << 64) - 1
    out = "[" + ", ".join(xor(f"m[{i + 1}]", f"(xor(m[{i // 5 * 5 + (i + 1) % 5 + 1}], {ones}) & m[{i // 5 * 5 + (i + 2) % 5 + 1}])", *(["r[1]"] if i == 0 else [])) for i in range(25)) + "]"
    step = let(columns, "c", let(mixed, "d", let(laid, "t", let(moved, "m", out))))
    byte = lambda k: f"ord(x[{k + 1}])::UBIGINT" if k < 40 else "1::UBIGINT" if k == 40 else "128::UBIGINT" if k == RATE - 1 else "0::UBIGINT"
    lanes = ", ".join("(" + " | ".join(f"({byte(8 * i + j)} << {8 * j})" for j in range(8)) + ")" if i < RATE // 8 else "0::UBIGINT" for i in range(25))
    rounds = ", ".join(f"[{c}::UBIGINT]" for c in round_constants())
    nibble = lambda k: f"((h[{k // 16 + 1}] >> {8 * (k // 2 % 8) + (0 if k % 2 else 4)}) & 15)"
    letters = " || ".join(f"CASE WHEN {nibble(k)} > 7 THEN upper(x[{k + 1}]) ELSE x[{k + 1}] END" for k in range(40))
    return f"""WITH a AS (SELECT event_id, md5(event_id::VARCHAR) || left(md5('b' || event_id), 8) AS d FROM events),
f AS (SELECT event_id, '0x' || CASE event_id % 7 WHEN 1 THEN upper(d) WHEN 2 THEN upper(left(d, 20)) || right(d, 20) WHEN 3 THEN left(d, 39) WHEN 4 THEN left(d, 39) || 'g' ELSE d END AS address FROM a),
g AS MATERIALIZED (SELECT event_id, lower(address[3:]) AS x FROM f WHERE regexp_full_match(address, '0x[0-9a-fA-F]{{40}}')),
k AS MATERIALIZED (SELECT event_id, x, list_reduce(list_prepend([{lanes}], [{rounds}]), lambda s, r: {step}) AS h FROM g),
c AS (SELECT event_id, '0x' || {letters} AS checksum FROM k)
SELECT f.event_id, address, checksum, CASE WHEN checksum IS NULL THEN 'invalid' WHEN checksum = address THEN 'checksummed' WHEN address = lower(address) THEN 'lower'
WHEN address[3:] = upper(address[3:]) THEN 'upper' ELSE 'wrong' END AS form FROM f LEFT JOIN c USING (event_id)"""


_CRC = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c
CRC32 = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({{0}})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, {_CRC}[(xor(a, b) & 255) + 1])))"""
LANDED = (
    "b AS (SELECT *, ts - 1704000000 AS block, (ts - 1704000000) // 100000 * 100000 AS lo FROM tx)",
    "pg AS (SELECT *, (row_number() OVER (PARTITION BY wallet, lo ORDER BY block, ord) - 1) // 5 + 1 AS page FROM b)",
    f"""pf AS MATERIALIZED (SELECT wallet, lo, page, count(*) AS n, ({CRC32.format("wallet || ':' || lo || ':' || page")}) % 10 AS fault FROM pg WHERE lo <= 1250000 AND lo > 250000 GROUP BY wallet, lo, page)""",
)

THRESHOLDS = """tm AS (SELECT feature, feature = 'vs6_extraction_multiplier' AS up, n, p25, p50, p75 FROM st WHERE label = 'bad'),
tw AS (SELECT feature, count(*) AS n_negative, count(*) FILTER (CASE WHEN up THEN x >= p50 ELSE x <= p50 END) AS n_wrong FROM lg JOIN tm USING (feature) WHERE label <> 'bad' GROUP BY feature),
th AS (SELECT tm.feature, CASE WHEN up THEN 'above' ELSE 'below' END AS direction, tm.n AS n_positive, coalesce(n_negative, 0) AS n_negative, tm.p50 AS high, CASE WHEN up THEN tm.p25 ELSE tm.p75 END AS medium,
  CASE WHEN up THEN g.p75 ELSE g.p25 END AS clean, coalesce(n_wrong, 0) AS n_wrong, CASE WHEN n_negative IS NULL THEN 'UNKNOWN' WHEN n_wrong < 0.2 * n_negative THEN 'GOOD' WHEN n_wrong < 0.4 * n_negative THEN 'FAIR' ELSE 'WEAK' END AS quality
  FROM tm LEFT JOIN tw USING (feature) LEFT JOIN st g ON g.feature = tm.feature AND g.label <> 'bad')"""
_SIDE = "CASE WHEN direction = 'above' THEN 'MIN' ELSE 'MAX' END"
_LINE = "upper(feature) || '_{}_' || " + _SIDE + " || ' = ' || coalesce(({}::DECIMAL(38, 4))::VARCHAR, 'None')"

ORACLES = {
    "threshold_derivation": q(*BASE, VALUE, LAB, LONG, THRESHOLDS, final=rep("high medium clean", "th")),
    "threshold_settings": q(*BASE, VALUE, LAB, LONG, THRESHOLDS, final="SELECT feature, 0::INT AS place, '# ' || feature || ': ' || quality || ', ' || n_wrong || ' of ' || n_negative || ' others on the suspicious side' AS line FROM th"
      + "".join(f" UNION ALL SELECT feature, {i}::INT, {_LINE.format(c.upper(), c)} FROM th" for i, c in enumerate(("high", "medium", "clean"), 1))),
    "rule_report": q(*FEATURES, """rp AS (SELECT rule_id, count(*) FILTER (severity IS NOT NULL) AS f, count(*) AS n FROM res JOIN lab USING (wallet) WHERE label = 'bad' GROUP BY rule_id),
      rq AS (SELECT *, (2000 * f + n) // (2 * n) AS t FROM rp), rr AS (SELECT *, (t // 10) || '.' || (t % 10) || '%' AS rate FROM rq)""",
      final="""SELECT rule_id, 0::INT AS part, '' AS wallet, rule_id || '  fired on ' || f || ' of ' || n || ' (' || rate || ')' AS line FROM rr UNION ALL SELECT rule_id, 2::INT, '', rpad(rule_id, 12, ' ') || lpad(rate, 8, ' ') FROM rr
      UNION ALL SELECT rule_id, 1::INT, wallet, '  ' || wallet || '  [' || severity || ']' FROM res JOIN lab USING (wallet) WHERE label = 'bad' AND severity IS NOT NULL"""),
    "report_store": q(EVENTS, ENT, OUT, LARGE, burst(2), FAN, DORMANT, activity(7), ROUND, new(1_706_572_800), FLAGS, _FIRED, _SCORE, """gl AS (SELECT DISTINCT wallet, src, dst, tx_hash FROM tx WHERE src <> '' AND dst <> ''),
      gn AS (SELECT wallet, count(DISTINCT node) AS n_nodes FROM (SELECT wallet, unnest([src, dst]) AS node FROM gl) GROUP BY wallet), ge AS (SELECT wallet, count(*) AS n_edges FROM gl GROUP BY wallet),
      rs AS (SELECT *, substr(wallet, 2)::BIGINT AS k FROM rl)""", final="""SELECT wallet AS investigation_id, CASE WHEN k % 2 = 0 THEN 'a-' ELSE 'b-' END || wallet AS report_id, risk_level, CASE WHEN k % 2 = 0 THEN risk_score ELSE -1 END::INT AS risk_score,
      k * 60 AS generated_at, wallet || ' ' || risk_level AS summary, CASE WHEN n_nodes IS NOT NULL THEN '{"n_nodes":' || n_nodes || ',"n_edges":' || n_edges || '}' END AS graph
      FROM rs LEFT JOIN gn USING (wallet) LEFT JOIN ge USING (wallet) WHERE risk_level <> 'HIGH'"""),
    "fanout_by_sketch": q(ORDERS, OUT, final="SELECT wallet, count(DISTINCT dst) AS fanout, true AS close FROM o WHERE dst <> '' AND ts // 86400 BETWEEN 10000 AND 10400 GROUP BY wallet"),
    "wallet_age_incremental": q(EVENTS, final="SELECT address, min(ts) AS first_ts FROM (SELECT unnest([src, dst]) AS address, ts FROM tx) WHERE address <> '' GROUP BY address"),
    "case_store_upserts": """WITH r AS (SELECT user_id AS case_id, ntile(3) OVER (PARTITION BY user_id ORDER BY event_id) AS part, epoch_us(ts) // 1000000 AS tm, event_id AS seq,
      CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'DONE' WHEN 'view' THEN 'RUNNING' END AS status FROM events),
      p AS (SELECT case_id, part, arg_max(status, (tm, seq)) FILTER (status IS NOT NULL) AS status, min(tm) FILTER (status = 'RUNNING') AS started_at, count(*) AS n FROM r GROUP BY ALL),
      c AS (SELECT case_id, max(status) FILTER (part = 1) AS s1, max(status) FILTER (part = 2) AS s2, max(status) FILTER (part = 3) AS s3, arg_min(started_at, part) FILTER (started_at IS NOT NULL) AS started_at, sum(n)::BIGINT AS n_events FROM p GROUP BY case_id),
      d AS (SELECT *, CASE WHEN s1 IN ('DONE', 'FAILED') THEN s1 ELSE coalesce(s2, s1) END AS t FROM c)
      SELECT case_id, CASE WHEN t IN ('DONE', 'FAILED') THEN t ELSE coalesce(s3, t) END AS status, started_at, n_events FROM d WHERE NOT coalesce(CASE WHEN t IN ('DONE', 'FAILED') THEN t ELSE coalesce(s3, t) END NOT IN ('DONE', 'FAILED'), false)""",
    "explorer_scan": q(EVENTS, *LANDED, final="""SELECT wallet, place::INT AS place, block, tx_hash, value::DOUBLE AS value FROM (SELECT pg.*, row_number() OVER (PARTITION BY wallet ORDER BY block DESC, lo DESC, page DESC, ord DESC) AS place
      FROM pg JOIN pf USING (wallet, lo, page) WHERE fault > 1 AND block BETWEEN 350000 AND 1250000) WHERE place BETWEEN 21 AND 40"""),
    "explorer_errors": q(EVENTS, *LANDED, final="""SELECT wallet, 'txlist' AS action, lo, page::INT AS page, CASE fault WHEN 0 THEN 'refused: Max rate limit reached' ELSE 'unreadable' END AS problem FROM pf WHERE fault < 2
      UNION ALL SELECT wallet, 'txlist', lo, page::INT + 1, 'unfinished' FROM (SELECT *, row_number() OVER (PARTITION BY wallet, lo ORDER BY page DESC) AS k FROM pf) WHERE k = 1 AND fault > 1 AND n = 5"""),
    "checksum_addresses": checksums(),
    "aml_risk_orders": RISK,
    "tx_classified": q(EVENTS, ENT, final=f"SELECT wallet, ord, {SIDE} AS direction, {KIND} AS tx_type, round(value::DOUBLE / 1e18, 9) AS amount, gas_used * gas_price AS gas_wei, a.type AS src_type, b.type AS dst_type FROM tx LEFT JOIN ent a ON a.address = src LEFT JOIN ent b ON b.address = dst"),
    "wallet_stats": q(EVENTS, STATS, final=STATS_Q), "wallet_stats_orders": q(ORDERS, STATS, f"st AS ({STATS_Q})", final="SELECT * EXCLUDE (average) FROM st"),
    "rule_large_transfer": _rule_q("r1", LARGE, severity=LARGE_G), "rule_rapid_burst": _rule_q("r2", burst(2)), "rule_high_fanout": _rule_q("r3", FAN, evidence="''", extra=ORDERS), "rule_dormant_activation": _rule_q("r4", DORMANT, extra=ORDERS),
    "rule_activity_burst": _rule_q("r5", activity(7)), "rule_round_numbers": _rule_q("r6", ROUND), "rule_new_wallet": _rule_q("r7", new(1_706_572_800), evidence="''"),
    "entity_flags": q(EVENTS, ENT, FLAGS, final="SELECT * FROM fl"),
    "deploy_features": q(*BASE, PRE, final="SELECT * REPLACE (round(warmup_hours, 6) AS warmup_hours, round(lag_hours, 6) AS lag_hours) FROM dfe"),
    "pre_features": q(*BASE, PRE, final=rep(_PRE, "pre")), "ownership_transfers": q(*BASE, PRE, final="SELECT * FROM own"),
    "fp1_first_source": q(*BASE, FUND, final="SELECT * FROM fp1"), "fp_seed_features": q(*BASE, FUND, final=rep(_SEED, "sf")), "fp2_min_hops": q(*BASE, FUND, final="SELECT * FROM hp"), "upstream_funders": q(*BASE, FUND, final="SELECT * FROM up"),
    "fp4_shared_funders": q(*BASE, FUND, final="SELECT * FROM shf"), "funder_jaccard": q(*BASE, FUND, final=rep("fp_max_funder_jaccard", "jc")),
    "fp4_shared_sequential": q(*BASE, FUND, final="SELECT u.wallet, count(DISTINCT other) FILTER (substr(other, 2)::BIGINT < substr(u.wallet, 2)::BIGINT) AS n_shared FROM upn u LEFT JOIN ij USING (wallet) GROUP BY u.wallet"),
    "cashout_features": q(*BASE, CASH, final=rep(_CASH, "cash")), "value_features": q(*BASE, VALUE, final=rep(_VAL, "val")),
    "exit1_silence": q(ORDERS, silence(1735689600), final="SELECT * FROM x1"), "exit2_dormancy": q(ORDERS, ENT, DORM, final="SELECT * FROM x2"), "exit4_migration": q(*BASE, CASH, MIGR, final="SELECT * FROM x4"),
    "retirement": q(ORDERS, ENT, silence(1735689600), DORM, """y AS (SELECT wallet, CASE WHEN substr(wallet, 2)::BIGINT % 100 >= 36 THEN round(least(0.99, CASE WHEN exit2_dormancy_event_count >= 2 THEN 0.88 WHEN exit2_dormancy_event_count = 1 THEN 0.70 ELSE 0.50 END
      + CASE WHEN exit1_silence_days > 180 THEN 0.10 WHEN exit1_silence_days > 60 THEN 0.07 WHEN exit1_silence_days > 30 THEN 0.04 ELSE 0.0 END)::DOUBLE, 2) END AS likelihood FROM x1 JOIN x2 USING (wallet))""",
      final="SELECT wallet, likelihood, CASE WHEN likelihood >= 0.90 THEN 'VERY_LIKELY_RETIRED' WHEN likelihood >= 0.70 THEN 'PROBABLY_RETIRED' WHEN likelihood IS NOT NULL THEN 'UNCERTAIN_MONITOR_ACTIVE' END AS label FROM y"),
    "rule_matrix": q(*FEATURES, final="SELECT * FROM res"),
    "verdict": q(*FEATURES, VERDICT, final="SELECT *, NOT (verdict = 'CLEAN' OR starts_with(verdict, 'INSUFFICIENT')) AS suspicious, printf('%s: %d of 100, %d rules fired, %d of them grave', verdict, score, n_fired, n_high) AS summary FROM vd"),
    "trace_rank": q(EVENTS, ENT, CAND, final="SELECT wallet, other, round(value, 6) AS value, round(value_score, 6) AS value_score, round(recency_score, 6) AS recency_score, novelty_score, rule_score, round(score, 6) AS score, row_number() OVER (PARTITION BY wallet ORDER BY round(score, 9) DESC, ts, ord) AS rank FROM cu QUALIFY rank <= 3"),
    "trace_rank_backward": q(EVENTS, ENT, CAND_BACK, final="SELECT wallet, other, round(value, 6) AS value, round(value_score, 6) AS value_score, round(recency_score, 6) AS recency_score, novelty_score, rule_score, round(score, 6) AS score, row_number() OVER (PARTITION BY wallet ORDER BY round(score, 9) DESC, ts, ord) AS rank FROM cu QUALIFY rank <= 3"),
    "trace_rank_both": q(EVENTS, ENT, CAND_BOTH, final="SELECT wallet, other, round(value, 6) AS value, round(value_score, 6) AS value_score, round(recency_score, 6) AS recency_score, novelty_score, rule_score, round(score, 6) AS score, row_number() OVER (PARTITION BY wallet ORDER BY round(score, 9) DESC, ts, ord) AS rank FROM cu QUALIFY rank <= 3"),
    "rules_with_other_thresholds": q(*[x for x in FEATURES if not x.startswith("res AS")], "res AS (" + " UNION ALL ".join(f"SELECT wallet, '{n}' AS rule_id, {severity_sql(c)} AS severity FROM feat" for n, c in rules_of(STRICTER)) + ")", final="SELECT * FROM res"),
    "prune_decision": q(EVENTS, ENT, CAND, """cv AS (SELECT *, substr(other, 2)::INT AS k FROM cu), cw AS (SELECT *, CASE WHEN type = 'CEX' THEN 'already_traced' WHEN value < 0.05 THEN 'dust' WHEN 480 + k >= 500 THEN 'budget' WHEN type IN ('MIXER', 'BRIDGE') THEN 'entity' WHEN type = 'DEX' THEN 'dex' WHEN k * 3 > 50 THEN 'fanout' ELSE 'ok' END AS reason FROM cv),
      cx AS (SELECT *, CASE WHEN reason IN ('already_traced', 'dust', 'budget') THEN 'SKIP' WHEN reason = 'entity' THEN 'HALT' WHEN reason IN ('dex', 'fanout') THEN 'SAMPLE' ELSE 'EXPAND' END AS decision FROM cw), cy AS (SELECT wallet, other, k, row_number() OVER (PARTITION BY wallet ORDER BY value DESC, other) AS rank FROM cx WHERE decision = 'EXPAND')""",
      final="SELECT cx.wallet, cx.other, decision, reason, CASE WHEN decision = 'SAMPLE' THEN 10 END AS sample_size, rank FROM cx LEFT JOIN (SELECT * FROM cy WHERE 480 + k + rank <= 500) y ON y.wallet = cx.wallet AND y.other = cx.other"),
    "bfs_trace": TRACE,
    "graph_nodes": q(EVENTS, OUT, LARGE, final="SELECT node, node IN (SELECT wallet FROM r1 WHERE m >= 10) AS is_flagged FROM (SELECT DISTINCT unnest([src, dst]) AS node FROM tx WHERE src <> '' AND dst <> '')"),
    "graph_edges": q(EVENTS, final="SELECT src, dst, tx_hash, round(arg_min(value, (ts, stream, ord))::DOUBLE / 1e18, 6) AS value, min(ts) AS ts FROM tx WHERE src <> '' AND dst <> '' GROUP BY src, dst, tx_hash"),
    "feature_percentiles": q(*BASE, VALUE, LAB, LONG, final=rep("p25 p50 p75 min max mean", "st")),
    "separation_quality": q(*BASE, VALUE, LAB, LONG, """sa AS (SELECT a.feature, greatest(0.0, least(a.p75, b.p75) - greatest(a.p25, b.p25)) AS i, greatest(a.p75, b.p75) - least(a.p25, b.p25) AS s FROM st a JOIN st b ON a.feature = b.feature AND a.label = 'bad' AND b.label = 'good'),
      sb AS (SELECT feature, CASE WHEN s > 0 THEN i / s ELSE 1.0 END AS o FROM sa)""", final="SELECT feature, round(o, 6) AS overlap, CASE WHEN o < 0.2 THEN 'GOOD' WHEN o < 0.4 THEN 'FAIR' ELSE 'WEAK' END AS quality FROM sb"),
    "rule_metrics": q(*FEATURES, """rm AS (SELECT rule_id, severity IS NOT NULL AS f, label = 'bad' AS p FROM res JOIN lab USING (wallet)), rn AS (SELECT rule_id, count(*) FILTER (f) AS n_fired, count(*) FILTER (f AND p) AS tp, count(*) FILTER (f AND NOT p) AS fp, count(*) FILTER (p) AS np, count(*) FILTER (NOT p) AS nn FROM rm GROUP BY rule_id)""",
      final="SELECT rule_id, n_fired, round(tp / nullif(np, 0), 6) AS tp_rate, round(fp / nullif(nn, 0), 6) AS fp_rate, round(tp / nullif(tp + fp, 0), 6) AS precision FROM rn"),
    "verdict_distribution": q(*FEATURES, VERDICT, final="SELECT label, verdict, count(*) AS n, count(*) FILTER (score >= 25) AS n_detected, round(avg(score), 6) AS mean_score FROM vd JOIN lab USING (wallet) GROUP BY ALL"),
    "severity_cube": q(*FEATURES, final="SELECT label, rule_id, severity, count(*) AS n, grouping(label, rule_id, severity)::BIGINT AS level FROM res JOIN lab USING (wallet) WHERE severity IS NOT NULL GROUP BY CUBE (label, rule_id, severity)"),
    "evidence_page": """SELECT event_id AS evidence_id, 'u' || user_id AS case_id, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'][event_id % 5 + 1] AS severity, epoch_us(ts) // 1000000 AS detected_at FROM events ORDER BY event_id % 5, epoch_us(ts) // 1000000 DESC, event_id LIMIT 50 OFFSET 100""",
    "latest_status": """WITH s AS (SELECT user_id AS case_id, epoch_us(ts) // 1000000 AS t_, event_id AS seq, CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'DONE' ELSE 'RUNNING' END AS st FROM events)
      SELECT case_id, arg_max(st, (t_, seq)) AS status, min(t_) FILTER (st = 'RUNNING') AS started_at, max(t_) FILTER (st IN ('DONE', 'FAILED')) AS ended_at, count(*) AS n_events FROM s GROUP BY case_id""",
    "internal_dedup": q(EVENTS, final="SELECT wallet, count(*) AS n, 0::BIGINT AS n_second FROM tx GROUP BY wallet"),
    "funding_sources": q(*BASE, PRE, final="SELECT * FROM fsr"),
    "narrative": q(*BASE, PRE, final="""SELECT wallet, CASE WHEN f4_burstiness IS NOT NULL THEN printf('%.4f', round(f4_burstiness, 4)) || CASE WHEN f4_burstiness > 0.1 THEN ' high: deployments come in clusters' ELSE ' low: deployments are spread out' END END AS burstiness,
      CASE WHEN f5_nonce_entropy IS NOT NULL THEN printf('%.4f', round(f5_nonce_entropy, 4)) || CASE WHEN f5_nonce_entropy < 3 THEN ' bits: gaps look scripted' ELSE ' bits: gaps vary' END END AS entropy,
      CASE WHEN f7_within_wallet_sim IS NOT NULL THEN printf('%.4f', round(f7_within_wallet_sim, 4)) || ' mean likeness of setups' END AS similarity, printf('%d sources of funds', funding_source_count) AS sources FROM pre"""),
    "value_features_tokens": q(*BASE, VALUE, TOKENS, final="""SELECT w.wallet, round(CASE WHEN k0 IS NOT NULL AND all_ > 0 THEN own_::DOUBLE / all_::DOUBLE END, 6) AS vs6_creator_token_fraction, CASE WHEN k0 IS NOT NULL AND lp >= mint THEN lp - mint END AS vs6_mint_to_lp_latency_sec
      FROM w LEFT JOIN fd USING (wallet) LEFT JOIN tm USING (wallet) LEFT JOIN lp_ USING (wallet)"""),
    "cashout_without_gas": q(*BASE, CASH.replace(" - gas_used::HUGEINT * gas_price", ""), final="SELECT wallet, round(cp7_retained_ratio, 6) AS cp7_retained_ratio FROM cash"),
    "trace_rank_by_depth": q(EVENTS, ENT, CAND, final="""SELECT wallet, 1 + substr(wallet, 2)::INT % 4 AS depth, other, row_number() OVER (PARTITION BY wallet ORDER BY round(score, 9) DESC, ts, ord) AS rank FROM cu
      QUALIFY rank <= CASE 1 + substr(wallet, 2)::INT % 4 WHEN 3 THEN 7 ELSE 3 END"""),
    "graph_summary": q(EVENTS, """gl AS (SELECT DISTINCT wallet, src, dst, tx_hash FROM tx WHERE src <> '' AND dst <> ''), gn AS (SELECT wallet, count(DISTINCT node) AS n_nodes FROM (SELECT wallet, unnest([src, dst]) AS node FROM gl) GROUP BY wallet), ge AS (SELECT wallet, count(*) AS n_edges FROM gl GROUP BY wallet)""",
      final="SELECT wallet, n_nodes, n_edges, CASE WHEN n_nodes >= 5000 THEN 'webgl' WHEN n_nodes >= 500 THEN 'canvas' ELSE 'svg' END AS renderer FROM gn JOIN ge USING (wallet)"),
    "investigation_risk": _INVEST,
    "aml_findings": q(ORDERS, ENT, OUT, LARGE, burst(5), FAN, DORMANT, activity(30), ROUND, new(1735689600), _FIRED, final="SELECT * FROM fo"),
    "template_reports": f"""WITH RECURSIVE risks AS (SELECT * FROM (WITH {_RISKS})), c_ AS (SELECT wallet, count(*) AS n_tx FROM (WITH {ORDERS} SELECT wallet FROM tx) GROUP BY wallet)
      SELECT wallet, 'Wallet ' || left(wallet, 10) AS title, printf('%s scores %d of 100 (%s): %d findings in %d transactions.', wallet, risk_score, risk_level, n_critical + n_high + n_medium + n_low, n_tx) AS summary,
      CASE risk_level WHEN 'CRITICAL' THEN 'Freeze what can be frozen and report the case.' WHEN 'HIGH' THEN 'Review all large and recent transfers by hand.' WHEN 'MEDIUM' THEN 'Watch the wallet and its counterparties.' ELSE 'No action is needed.' END AS advice FROM risks JOIN c_ USING (wallet)""",
    "report_context": q(EVENTS, ENT, OUT, LARGE, burst(2), FAN, DORMANT, activity(7), ROUND, new(1_706_572_800), FLAGS, _FIRED, _SCORE, STATS, f"st_ AS ({STATS_Q})", links("tx"), *trace_levels(1, 500), """
ff AS (SELECT wallet, count(*) AS n_findings, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM fo GROUP BY wallet),
tr AS (SELECT root AS wallet, count(*) AS n_traced, max(depth) AS max_depth, count(*) FILTER (type = 'MIXER') AS mixer_contacts, count(*) FILTER (type = 'CEX') AS cex_contacts, count(*) FILTER (type = 'BRIDGE') AS bridge_contacts, count(*) FILTER (reason = 'fanout') AS high_fanout_nodes FROM ts1 LEFT JOIN ent ON address = node GROUP BY root),
nb AS (SELECT root AS wallet, type || ' ' || node AS x, row_number() OVER (PARTITION BY root ORDER BY depth, type || ' ' || node) AS k FROM ts1 JOIN ent ON address = node), na_ AS (SELECT wallet, string_agg(x, '; ' ORDER BY k) AS notable FROM nb WHERE k <= 10 GROUP BY wallet),
lg_ AS (SELECT wallet, ord || ' ' || CASE WHEN is_error THEN 'failed' ELSE 'read' END AS x, row_number() OVER (PARTITION BY wallet ORDER BY ord DESC) AS k FROM tx), lh AS (SELECT wallet, string_agg(x, '; ' ORDER BY k) AS recent_steps FROM lg_ WHERE k <= 5 GROUP BY wallet)""",
      final="""SELECT rl.*, n_tx, n_counterparties, coalesce(n_findings, 0) AS n_findings, coalesce(rules, '') AS rules, n_traced, max_depth, mixer_contacts, cex_contacts, bridge_contacts, high_fanout_nodes, coalesce(notable, '') AS notable, coalesce(recent_steps, '') AS recent_steps
      FROM rl LEFT JOIN st_ USING (wallet) LEFT JOIN ff USING (wallet) LEFT JOIN tr USING (wallet) LEFT JOIN na_ USING (wallet) LEFT JOIN lh USING (wallet)"""),
    "request_faults": """SELECT event_id AS request_id, array_to_string(list_filter([CASE WHEN event_id % 5 = 0 THEN 'wallet_address' END, CASE WHEN event_id % 5 NOT BETWEEN 1 AND 3 THEN 'depth' END, CASE WHEN event_id % 4000 NOT BETWEEN 1 AND 3650 THEN 'lookback_days' END,
      CASE WHEN event_id % 1200 NOT BETWEEN 10 AND 1000 THEN 'max_transactions' END], lambda x: x IS NOT NULL), ',') AS faults FROM events""",
    "evidence_counts": """SELECT user_id AS case_id, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO', 'ODD'][event_id % 6 + 1] AS severity, count(*) AS n FROM events WHERE event_id % 6 <> 4 GROUP BY ALL""",
    "evidence_assertions": """WITH r AS (SELECT event_id - event_id % 97 % 2 AS k, user_id, event_id % 6 = 5 AS odd FROM events), p AS (SELECT 'no case' AS problem, count(*) AS n FROM r WHERE user_id % 10 = 0 UNION ALL SELECT 'severity', count(*) FROM r WHERE odd
      UNION ALL SELECT 'repeated id', count(*) FROM (SELECT k FROM r GROUP BY k HAVING count(*) > 1)) SELECT * FROM p WHERE n > 0""",
    "rules_primary": q(*FEATURES, final="SELECT wallet, least(100, sum(CASE severity WHEN 'CRITICAL' THEN 40 WHEN 'HIGH' THEN 25 WHEN 'MEDIUM' THEN 10 WHEN 'LOW' THEN 5 ELSE 0 END))::BIGINT AS rule_score FROM res WHERE rule_id <> 'RUG-FP4' GROUP BY wallet HAVING rule_score >= 25"),
}
