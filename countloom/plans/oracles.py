"""DuckDB twins of the registered queries.

Written from the definitions, the plain way: neighbours by comparing all rows,
support by building every cell, top-k by window functions.
"""

from __future__ import annotations


def _out(source: str, spec: str) -> str:
    """A final SELECT; spec: names with :s text, :i integer, :d double (6 places), :b boolean; name=expression allowed."""
    cols = []
    for part in spec.split():
        name, kind = part.rsplit(":", 1)
        name, _, expr = name.partition("=")
        expr = expr or name
        cols.append({"s": f"CAST({expr} AS VARCHAR) AS {name}", "i": f"CAST({expr} AS BIGINT) AS {name}", "d": f"round(CAST({expr} AS DOUBLE), 6) AS {name}", "b": f"CAST({expr} AS BOOLEAN) AS {name}"}[kind])
    return f"SELECT {', '.join(cols)} FROM {source}"


def _matrix(value: str = "l_quantity") -> str:
    return f"""
s AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_suppkey, CAST(s_nationkey AS DOUBLE) AS x, CAST(s_acctbal AS DOUBLE) AS y FROM supplier),
gn AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS g, p_partkey FROM part),
samples AS (SELECT DISTINCT l_returnflag AS sample_id FROM lineitem),
counts AS (SELECT * FROM (SELECT l_returnflag AS sample_id, i, g, CAST(sum({value}) AS BIGINT) AS v FROM lineitem JOIN s ON l_suppkey = s_suppkey JOIN gn ON l_partkey = p_partkey GROUP BY 1, 2, 3) WHERE v > 0),
spots AS (SELECT sample_id, i, CAST(s_suppkey AS VARCHAR) AS spot_id, x, y FROM s, samples),
nrow AS (SELECT sample_id, count(*) AS n FROM spots GROUP BY 1)"""


QUANTITY, COUNT, TENS = _matrix(), _matrix("1"), _matrix("floor(l_quantity / 10)")


def _graph(width: int = 6) -> str:
    return f""",
allpairs AS (SELECT a.sample_id, a.i, b.i AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM spots a JOIN spots b ON a.sample_id = b.sample_id AND b.i < a.i),
graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, i ORDER BY d2, j) AS r FROM allpairs) WHERE r <= {width})"""


GRAPH = _graph()


def _bucket(q: str, edges: tuple[int, ...] = (1, 4, 16, 64, 256, 1024, 2048, 3072)) -> str:
    return "CASE " + " ".join(f"WHEN {q} >= {e} THEN {i}" for i, e in reversed(list(enumerate(edges)))) + " ELSE 0 END"


def _q_of(q: str, odds: str) -> str:
    num = f"(CAST({q} AS BIGINT) * {odds})"
    den = f"({num} + (4096 - {q}) * 65536)"
    return f"greatest(1, least(4095, (4096 * {num} + {den} // 2) // {den}))"


def _marginals(edges: tuple[int, ...] = (1, 4, 16, 64, 256, 1024, 2048, 3072)) -> str:
    return f""",
marg AS (SELECT *, {_bucket("q0", edges)} AS b FROM (SELECT n.sample_id, gn.g, n.n, count(c.v) AS ones, CAST(greatest(1, least(4095, floor((count(c.v) + CAST(0.5 AS DOUBLE)) / (n.n + CAST(1 AS DOUBLE)) * 4096 + CAST(0.5 AS DOUBLE)))) AS BIGINT) AS q0
  FROM nrow n CROSS JOIN gn LEFT JOIN counts c ON c.sample_id = n.sample_id AND c.g = gn.g GROUP BY 1, 2, 3))"""


MARG = _marginals()
KK = """,
kk AS (SELECT gr.sample_id, gr.i, c.g, count(*) AS k FROM graph gr JOIN counts c ON c.sample_id = gr.sample_id AND c.i = gr.j GROUP BY 1, 2, 3)"""


def _cells(width: int = 6) -> str:
    return f""",
cells AS (SELECT sp.sample_id, sp.i, gn.g, coalesce(kk.k, 0) AS k, CASE WHEN c.v IS NULL THEN 0 ELSE 1 END AS y
  FROM spots sp CROSS JOIN gn LEFT JOIN kk ON kk.sample_id = sp.sample_id AND kk.i = sp.i AND kk.g = gn.g LEFT JOIN counts c ON c.sample_id = sp.sample_id AND c.i = sp.i AND c.g = gn.g),
stats AS (SELECT c.sample_id, m.b, c.k, m.q0 AS q, count(*) AS n, sum(c.y) AS y FROM cells c JOIN marg m ON m.sample_id = c.sample_id AND m.g = c.g WHERE c.i >= {width} GROUP BY 1, 2, 3, 4)"""


CELLS = _cells()


def _fit(source: str, name: str, by: str) -> str:
    """Odds of each group of (q, n, y) by 48 bisections."""
    slope = "(list_sum(list_transform(l, lambda r: r.n / (1 + exp(-(r.o + {b}))) - r.y)) + {b})"
    return f""",
{name}_l AS (SELECT {by}, list({{'o': ln(CAST(q AS DOUBLE) / (4096 - q)), 'n': CAST(n AS DOUBLE), 'y': CAST(y AS DOUBLE)}} ORDER BY q) AS l FROM {source} GROUP BY {by}),
{name}_b AS (SELECT {by}, l, CAST(-8 AS DOUBLE) AS lo, CAST(8 AS DOUBLE) AS hi, 0 AS step FROM {name}_l
  UNION ALL SELECT {by}, l, CASE WHEN {slope.format(b="((lo + hi) / 2)")} > 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN {slope.format(b="((lo + hi) / 2)")} > 0 THEN (lo + hi) / 2 ELSE hi END, step + 1 FROM {name}_b WHERE step < 48),
{name} AS (SELECT {by}, CAST(floor(exp(CASE WHEN {slope.format(b="CAST(-8 AS DOUBLE)")} >= 0 THEN CAST(-8 AS DOUBLE) WHEN {slope.format(b="CAST(8 AS DOUBLE)")} <= 0 THEN CAST(8 AS DOUBLE) ELSE (lo + hi) / 2 END) * 65536 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS odds FROM {name}_b WHERE step = 48)"""


SUPPORT_ODDS = _fit("stats", "sodds", "sample_id, b, k")


def _support_bits(width: int = 6) -> str:
    q = _q_of("m.q0", "coalesce(o.odds, 65536)")
    return f""",
sbits AS (SELECT c.sample_id, c.g, sum(12 - log2(CASE WHEN c.y = 1 THEN p ELSE 4096 - p END)) AS bits
  FROM (SELECT c.*, CASE WHEN c.i < {width} THEN m.q0 ELSE {q} END AS p FROM cells c JOIN marg m ON m.sample_id = c.sample_id AND m.g = c.g LEFT JOIN sodds o ON o.sample_id = c.sample_id AND o.b = m.b AND o.k = c.k) c GROUP BY 1, 2)"""


SBITS = _support_bits()
PLAIN_BITS = """,
pbits AS (SELECT sample_id, g, ones * (12 - log2(q0)) + (n - ones) * (12 - log2(4096 - q0)) AS bits FROM marg)"""


def _tail_bounds(k: int) -> list[float]:
    if k == 8:
        return [1, 2, 4, 8, 16, 64, 256]
    knots, out = (-1, 0, 1, 2, 3, 4, 6, 8, 10), []
    for j in range(1, k):
        lo = (j * 8) // k
        out.append(2.0 ** (knots[lo] + (j * 8 / k - lo) * (knots[lo + 1] - knots[lo])))
    return out


def _profiles(k: int = 8) -> str:
    group = "CASE WHEN n - a = 0 THEN 0 " + " ".join(f"WHEN tail_sum <= CAST({u!r} AS DOUBLE) * (n - a) THEN {i}" for i, u in enumerate(_tail_bounds(k))) + f" ELSE {k - 1} END"
    return f""",
glb AS (SELECT sample_id, (count(*) FILTER (WHERE v = 1) + CAST(0.5 AS DOUBLE)) / (count(*) + 1) AS one FROM counts GROUP BY 1),
prof AS (SELECT sample_id, g, n, a, tail_sum, {group} AS grp, CAST(greatest(1, least(4095, floor(CAST(4096 AS DOUBLE) * (a + CAST(0.5 AS DOUBLE) + CAST(16 AS DOUBLE) * one) / (n + 17) + CAST(0.5 AS DOUBLE)))) AS BIGINT) AS q
  FROM (SELECT s.sample_id, gn.g, count(c.v) AS n, count(*) FILTER (WHERE c.v = 1) AS a, coalesce(sum(CASE WHEN c.v > 1 THEN c.v - 1 END), 0) AS tail_sum
        FROM samples s CROSS JOIN gn LEFT JOIN counts c ON c.sample_id = s.sample_id AND c.g = gn.g GROUP BY 1, 2) JOIN glb USING (sample_id))"""


def _pooled(k: int = 8) -> str:
    return f""",
pool AS (SELECT sample_id, b, k, c, (c + CAST(0.03125 AS DOUBLE)) / (sum(c) OVER (PARTITION BY sample_id, b) + 1) AS p FROM (
  SELECT s.sample_id, CAST(bb AS BIGINT) AS b, CAST(kk_ AS BIGINT) AS k, count(h.v) AS c FROM samples s CROSS JOIN range({k}) t1(bb) CROSS JOIN range(32) t2(kk_)
  LEFT JOIN (SELECT counts.sample_id, counts.g, v, grp, CAST(floor(log2(v - 1)) AS BIGINT) AS m FROM counts JOIN prof ON prof.sample_id = counts.sample_id AND prof.g = counts.g WHERE v > 1) h
    ON h.sample_id = s.sample_id AND h.grp = bb AND h.m = kk_ GROUP BY 1, 2, 3))"""


def _quantise(source: str, name: str, by: str) -> str:
    return f""",
{name}_f AS (SELECT *, floor(4064 * p) + 1 AS f, 4064 * p - floor(4064 * p) AS rem FROM {source}),
{name} AS (SELECT {by}, k, CAST(f AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY {by} ORDER BY rem DESC, k) <= 4096 - sum(f) OVER (PARTITION BY {by}) THEN 1 ELSE 0 END AS freq FROM {name}_f)"""


BASE = _quantise("pool", "base", "sample_id, b")
NSUM = """,
nsum AS (SELECT c.sample_id, c.i, c.g, c.v, coalesce(sum(d.v), 0) AS s FROM counts c LEFT JOIN graph gr ON gr.sample_id = c.sample_id AND gr.i = c.i
  LEFT JOIN counts d ON d.sample_id = c.sample_id AND d.i = gr.j AND d.g = c.g GROUP BY 1, 2, 3, 4)"""
PLAIN_SUM = """,
nsum AS (SELECT sample_id, i, g, v, 0 AS s FROM counts)"""


def _events(context: str) -> str:
    return f""",
ev AS (SELECT n.sample_id, n.i, n.g, n.v, p.grp AS b, {context} AS c, p.q FROM nsum n JOIN prof p ON p.sample_id = n.sample_id AND p.g = n.g)"""


CONTEXT = "CASE WHEN n.i < 6 THEN 7 WHEN s = 0 THEN 0 WHEN s < 12 THEN 1 WHEN s < 24 THEN 2 WHEN s < 48 THEN 3 WHEN s < 96 THEN 4 WHEN s < 384 THEN 5 ELSE 6 END"
EV = _events(CONTEXT)
VSTAT = """,
vstat AS (SELECT sample_id, b, c, q, count(*) AS n, count(*) FILTER (WHERE v = 1) AS y FROM ev WHERE c < 7 GROUP BY 1, 2, 3, 4),
tstat AS (SELECT sample_id, b, c, CAST(floor(log2(v - 1)) AS BIGINT) AS k, count(*) AS t FROM ev WHERE c < 7 AND v > 1 GROUP BY 1, 2, 3, 4)"""
VODDS = _fit("vstat", "vodds", "sample_id, b, c")


def _centres(k: int = 8) -> str:
    return f""",
cent AS (SELECT sample_id, b, n, a, greatest(1, least(4095, (4096 * (2 * a + 1) + n + 1) // (2 * (n + 1)))) AS s FROM (
  SELECT s.sample_id, CAST(bb AS BIGINT) AS b, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS n, CAST(coalesce(sum(p.a), 0) AS BIGINT) AS a FROM samples s CROSS JOIN range({k}) t(bb) LEFT JOIN prof p ON p.sample_id = s.sample_id AND p.grp = bb GROUP BY 1, 2))"""


def _tails(k: int = 8) -> str:
    return (
        f""",
tdense AS (SELECT s.sample_id, CAST(bb AS BIGINT) AS b, CAST(cc AS BIGINT) AS c, CAST(kk_ AS BIGINT) AS k, coalesce(t, 0) AS t FROM samples s CROSS JOIN range({k}) t1(bb) CROSS JOIN range(7) t3(cc) CROSS JOIN range(32) t2(kk_)
  LEFT JOIN tstat x ON x.sample_id = s.sample_id AND x.b = bb AND x.c = cc AND x.k = kk_),
tp AS (SELECT d.sample_id, d.b, d.c, d.k, (d.t + 16 * p.p) / (sum(d.t) OVER (PARTITION BY d.sample_id, d.b, d.c) + 16) AS p FROM tdense d JOIN pool p ON p.sample_id = d.sample_id AND p.b = d.b AND p.k = d.k)"""
        + _quantise("tp", "cond", "sample_id, b, c")
        + """,
tails AS (SELECT sample_id, b, c, k, freq FROM cond UNION ALL SELECT sample_id, b, 7, k, freq FROM base)"""
    )


VCDF = f""",
vcdf AS (SELECT c.sample_id, c.b, CAST(cc AS BIGINT) AS c, CASE WHEN cc = 7 THEN c.s ELSE {_q_of("c.s", "coalesce(o.odds, 65536)")} END AS q FROM cent c CROSS JOIN range(8) t(cc) LEFT JOIN vodds o ON o.sample_id = c.sample_id AND o.b = c.b AND o.c = cc)"""
VBITS = """,
vbits AS (SELECT e.sample_id, sum(12 - log2(CASE WHEN e.v = 1 THEN q.q ELSE 4096 - q.q END)) AS singleton_bits, coalesce(sum(12 - log2(t.freq)), 0) AS magnitude_bits, coalesce(sum(t.k), 0) AS raw_bits
  FROM ev e JOIN vcdf q ON q.sample_id = e.sample_id AND q.b = e.b AND q.c = e.c LEFT JOIN tails t ON e.v > 1 AND t.sample_id = e.sample_id AND t.b = e.b AND t.c = e.c AND t.k = CASE WHEN e.v > 1 THEN floor(log2(e.v - 1)) END GROUP BY 1)"""
OWN_BITS = f""",
vbits AS (SELECT e.sample_id, sum(12 - log2(CASE WHEN e.v = 1 THEN e.p ELSE 4096 - e.p END)) AS singleton_bits, coalesce(sum(12 - log2(t.freq)), 0) AS magnitude_bits, coalesce(sum(t.k), 0) AS raw_bits
  FROM (SELECT ev.*, CASE WHEN ev.c = 7 THEN ev.q ELSE {_q_of("ev.q", "coalesce(o.odds, 65536)")} END AS p FROM ev LEFT JOIN vodds o ON o.sample_id = ev.sample_id AND o.b = ev.b AND o.c = ev.c) e
  LEFT JOIN tails t ON e.v > 1 AND t.sample_id = e.sample_id AND t.b = e.b AND t.c = e.c AND t.k = CASE WHEN e.v > 1 THEN floor(log2(e.v - 1)) END GROUP BY 1)"""


def _value_model(k: int, spatial: bool = True, shared: bool = True) -> str:
    events = EV if spatial else _events("7")
    return _profiles(k) + (NSUM if spatial else PLAIN_SUM) + events + VSTAT + VODDS + _pooled(k) + BASE + _centres(k) + _tails(k) + (VCDF + VBITS if shared else OWN_BITS)


SUPPORT = GRAPH + MARG + KK + CELLS + SUPPORT_ODDS + SBITS


def _w(body: str, final: str) -> str:
    return "WITH RECURSIVE " + body.lstrip() + "\n" + final


TOTALS = "(SELECT s.sample_id, s.bits AS support_bits, v.singleton_bits + v.magnitude_bits + v.raw_bits AS value_bits FROM (SELECT sample_id, sum(bits) AS bits FROM {s} GROUP BY 1) s JOIN vbits v USING (sample_id))"
TOTAL_SPEC = "sample_id:s support_bits:d value_bits:d total_bits=support_bits+value_bits:d"


def _arm(name: str, body: str, s: str) -> str:
    return f"SELECT *, '{name}' AS arm FROM ({_w(body, _out(TOTALS.format(s=s), TOTAL_SPEC))})"


def _bucket_arm(n: int, edges: tuple[int, ...]) -> str:
    body = QUANTITY + GRAPH + _marginals(edges) + KK + CELLS + SUPPORT_ODDS + SBITS
    return f"SELECT *, CAST({n} AS BIGINT) AS buckets FROM ({_w(body, _out('(SELECT sample_id, sum(bits) AS bits FROM sbits GROUP BY 1)', 'sample_id:s bits:d'))})"


def _width_arm(n: int) -> str:
    body = QUANTITY + MARG + PLAIN_BITS if not n else QUANTITY + _graph(n) + MARG + KK + _cells(n) + SUPPORT_ODDS + _support_bits(n)
    return f"SELECT *, CAST({n} AS BIGINT) AS neighbours FROM ({_w(body, _out(f'(SELECT sample_id, sum(bits) AS bits FROM {"sbits" if n else "pbits"} GROUP BY 1)', 'sample_id:s bits:d'))})"


RESULTS = """WITH r0 AS (SELECT CAST(l_orderkey % 40 AS BIGINT) AS s, 'L' || CAST(l_linenumber AS VARCHAR) AS arm, count(*) AS n_lines, CAST(sum(l_quantity) AS BIGINT) AS n_counts, CAST(sum(l_linenumber) AS BIGINT) AS model FROM lineitem GROUP BY 1, 2),
r AS (SELECT 's' || lpad(CAST(s AS VARCHAR), 2, '0') AS sample_id, arm, CASE WHEN n_counts % 11 <> 0 THEN 'success' ELSE 'failed' END AS status, CASE s % 3 WHEN 0 THEN 'ST' WHEN 1 THEN 'Visium' ELSE 'Xenium' END AS platform,
  CASE WHEN s % 2 = 0 THEN 'human' ELSE 'mouse' END AS species, 'o' || CAST(s % 5 AS VARCHAR) AS organ, CASE WHEN n_counts % 11 <> 0 THEN n_counts * 3 + model + n_lines * 2 END AS total_bytes, CASE WHEN n_counts % 11 <> 0 THEN n_counts * 3 END AS payload,
  CASE WHEN n_counts % 11 <> 0 THEN model END AS model, CASE WHEN n_counts % 11 <> 0 THEN n_lines * 2 END AS framing, n_counts, n_lines, s % 7 AS identity FROM r0),
ok AS (SELECT * FROM r WHERE status = 'success'),
pr AS (SELECT x.sample_id, x.platform, x.species, x.organ, x.arm, b.total_bytes AS base_bytes, x.total_bytes AS bytes, x.total_bytes - b.total_bytes AS delta, 100.0::DOUBLE * (x.total_bytes - b.total_bytes) / b.total_bytes AS percent
  FROM ok x JOIN ok b ON b.sample_id = x.sample_id AND b.arm = 'L1' WHERE x.arm <> 'L1'),
cov AS (SELECT s.sample_id, a.arm, coalesce(r2.status, 'not_run') AS status FROM (SELECT DISTINCT sample_id FROM r) s CROSS JOIN (SELECT DISTINCT arm FROM r) a LEFT JOIN (SELECT * FROM r WHERE n_lines % 3 <> 0) r2 ON r2.sample_id = s.sample_id AND r2.arm = a.arm)
"""
MEMBERS = """WITH m0 AS (SELECT CAST(l_orderkey % 25 AS BIGINT) AS archive_id, 'm' || CAST(l_linenumber AS VARCHAR) AS member, count(*) AS bytes, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
a AS (SELECT archive_id, member, bytes, sha256(member || ':' || CAST(q AS VARCHAR) || ':' || CASE WHEN q % 5 = 0 THEN 'a' ELSE '' END) AS sha256 FROM m0),
b AS (SELECT archive_id, member, bytes, sha256(member || ':' || CAST(q AS VARCHAR) || ':' || CASE WHEN q % 5 = 0 THEN 'b' ELSE '' END) AS sha256 FROM m0 WHERE q % 7 <> 0),
j AS (SELECT coalesce(a.archive_id, b.archive_id) AS archive_id, coalesce(a.member, b.member) AS member, a.bytes AS want, b.bytes AS have, a.sha256 AS x, b.sha256 AS y FROM a FULL JOIN b ON a.archive_id = b.archive_id AND a.member = b.member)
"""
PEOPLE = "WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS species, CAST(c_nationkey % 5 AS BIGINT) AS organ, CAST(c_acctbal AS DOUBLE) AS balance FROM customer)\n"
LEDGER = """, led AS (SELECT archive_id, CASE member WHEN 'm1' THEN 'payload' WHEN 'm2' THEN 'payload' WHEN 'm3' THEN 'model' WHEN 'm4' THEN 'graph' WHEN 'm5' THEN 'identity' WHEN 'm6' THEN 'manifest' ELSE 'other' END AS category, sum(bytes) AS bytes FROM a GROUP BY 1, 2
  UNION ALL SELECT archive_id, 'framing', count(*) * 3 FROM a GROUP BY 1), tot AS (SELECT archive_id, sum(bytes) + count(*) * 3 AS total FROM a GROUP BY 1)
"""
DIFFERENCE = "SELECT archive_id, count(*) FILTER (WHERE x IS NULL) AS added, count(*) FILTER (WHERE y IS NULL) AS removed, count(*) FILTER (WHERE x <> y) AS changed, count(*) FILTER (WHERE x = y) AS equal FROM j GROUP BY 1"


def _m(final: str, spec: str, *parts: str, base: str = QUANTITY) -> str:
    return _w(base + "".join(parts), _out(f"({final})", spec))


of_matrix = _m


SIXTEEN = (1, 2, 4, 10, 16, 40, 64, 160, 256, 640, 1024, 1536, 2048, 2560, 3072, 3584)
EDGES = {1: (1,), 2: (1, 256), 4: (1, 16, 256, 2048), 8: (1, 4, 16, 64, 256, 1024, 2048, 3072), 16: SIXTEEN, 32: tuple(sorted({x for i, a in enumerate(SIXTEEN) for x in (a, (a + (SIXTEEN + (4096,))[i + 1]) // 2)}))}


def _joint_arm(n: int, width: int) -> str:
    body = QUANTITY + _graph(width) + _marginals(EDGES[n]) + KK + _cells(width) + SUPPORT_ODDS + _support_bits(width)
    return f"SELECT *, 'B{n}_M{width}' AS arm FROM ({_w(body, _out('(SELECT sample_id, sum(bits) AS bits FROM sbits GROUP BY 1)', 'sample_id:s bits:d'))})"


#: Groups by rank of rates, and what their description costs.
RANKS = f""",
rk AS (SELECT sample_id, g, n, a, grp AS b, q, row_number() OVER (PARTITION BY sample_id ORDER BY (a + CAST(0.5 AS DOUBLE)) / (n + 1), g) - 1 AS place, count(*) OVER (PARTITION BY sample_id) AS total FROM prof),
lb AS (SELECT rk.*, CAST(kk_ AS BIGINT) AS k, CASE WHEN n = 0 THEN 0 ELSE place * kk_ // total END AS label FROM rk CROSS JOIN (SELECT unnest([1, 2, 4, 8, 16, 32]) AS kk_)),
ce AS (SELECT sample_id, k, label, CASE WHEN sum(n) = 0 THEN 2048 ELSE greatest(1, least(4095, (4096 * (2 * CAST(sum(a) AS BIGINT) + 1) + CAST(sum(n) AS BIGINT) + 1) // (2 * (CAST(sum(n) AS BIGINT) + 1)))) END AS s FROM lb GROUP BY 1, 2, 3),
ge AS (SELECT lb.*, ce.s FROM lb JOIN ce USING (sample_id, k, label)),
gc AS (SELECT ge.sample_id, ge.k, ge.g, ge.n, ge.a, CAST(CASE WHEN cc = 7 THEN ge.q ELSE {_q_of("ge.q", "coalesce(o.odds, 65536)")} END AS DOUBLE) AS o1, CAST(CASE WHEN cc = 7 THEN ge.s ELSE {_q_of("ge.s", "coalesce(o.odds, 65536)")} END AS DOUBLE) AS o2
  FROM ge CROSS JOIN range(8) t(cc) LEFT JOIN vodds o ON o.sample_id = ge.sample_id AND o.b = ge.b AND o.c = cc),
bd AS (SELECT sample_id, k, g, CASE WHEN bool_or(o1 <> o2) THEN a * max(log2(o1 / o2)) + (n - a) * max(log2((4096 - o1) / (4096 - o2))) + CAST(1e-10 AS DOUBLE) * n ELSE 0 END > 12 AS exception FROM gc GROUP BY sample_id, k, g, n, a),
ar AS (SELECT ge.sample_id, ge.k, ge.g, ge.b, f AS exceptions, f AND exception AS kept, CASE WHEN f AND exception THEN ge.q ELSE ge.s END AS q FROM ge JOIN bd USING (sample_id, k, g) CROSS JOIN (SELECT unnest([false, true]) AS f)),
se AS (SELECT sample_id, g, c, count(*) FILTER (WHERE v = 1) AS ones, count(*) FILTER (WHERE v <> 1) AS more FROM ev GROUP BY 1, 2, 3),
co AS (SELECT sample_id, k, exceptions, sum(ones * (12 - log2(p)) + more * (12 - log2(4096 - p))) AS bits FROM (
  SELECT ar.*, se.ones, se.more, CASE WHEN se.c = 7 THEN ar.q ELSE {_q_of("ar.q", "coalesce(o.odds, 65536)")} END AS p FROM ar JOIN se ON se.sample_id = ar.sample_id AND se.g = ar.g LEFT JOIN vodds o ON o.sample_id = ar.sample_id AND o.b = ar.b AND o.c = se.c) GROUP BY 1, 2, 3),
dl AS (SELECT sample_id, k, exceptions, n_exceptions, genes * log2(k) + 12 * k + CASE WHEN exceptions THEN genes + 12 * n_exceptions ELSE 0 END AS model_bits, bits AS singleton_bits
  FROM (SELECT sample_id, k, exceptions, count(*) AS genes, count(*) FILTER (WHERE kept) AS n_exceptions FROM ar GROUP BY 1, 2, 3) JOIN co USING (sample_id, k, exceptions)),
db AS (SELECT *, ceil(round(model_bits + singleton_bits, 5) / 8) AS bytes FROM dl)"""


ORACLE: dict[str, str] = {
    "io5_compressed_to_all_cells": _m("SELECT sample_id, i, g, v FROM counts", "sample_id:s i:i g:i v:i"),
    "io8_compressed_rows": _m("SELECT sp.sample_id, sp.i, sum(count(c.v)) OVER w - count(c.v) AS ptr_lo, sum(count(c.v)) OVER w AS ptr_hi, coalesce(string_agg(CAST(c.g AS VARCHAR), ',' ORDER BY c.g), '') AS minors, coalesce(string_agg(CAST(c.v AS VARCHAR), ',' ORDER BY c.g), '') AS vals FROM spots sp LEFT JOIN counts c ON c.sample_id = sp.sample_id AND c.i = sp.i GROUP BY 1, 2 WINDOW w AS (PARTITION BY sp.sample_id ORDER BY sp.i)", "sample_id:s i:i ptr_lo:i ptr_hi:i minors:s vals:s"),
    "io2_label_decode": "SELECT CAST(c_custkey AS BIGINT) AS pos, n_name AS label, n_name IS NULL AS fault FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + CASE WHEN c_custkey % 50 = 0 THEN 100 ELSE 0 END",
    "io3_axis_lengths": _m("SELECT sample_id, n, n AS with_x, (SELECT count(*) FROM gn) AS genes, (SELECT max(i) FROM counts c WHERE c.sample_id = nrow.sample_id) < n AND (SELECT max(g) FROM counts c WHERE c.sample_id = nrow.sample_id) < (SELECT count(*) FROM gn) AS fits FROM nrow", "sample_id:s n:i with_x:i genes:i fits:b"),
    "io19_content_addressed": MEMBERS + "SELECT sha256, count(*) AS copies, min(member) AS member FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1",
    "p1_invalid_values": "SELECT CAST(l_linenumber AS BIGINT) AS i, count(*) AS n, round(sum(CASE l_linenumber WHEN 1 THEN CAST(l_quantity AS DOUBLE) + 0.5 WHEN 2 THEN -CAST(l_quantity AS DOUBLE) ELSE 4294967296 END), 6) AS total FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1",
    "p2_budget": _m("SELECT n.sample_id, n.n, (SELECT count(*) FROM gn) AS genes, count(c.v) AS nnz FROM nrow n LEFT JOIN counts c USING (sample_id) GROUP BY 1, 2", "sample_id:s n:i genes:i nnz:i cells=n*genes:i within=n*genes<=500000000:b"),
    "p3_pointer_faults": _m("SELECT * FROM (SELECT sample_id, i, ptr, lag(ptr) OVER (PARTITION BY sample_id ORDER BY i) AS before FROM (SELECT sample_id, i, CASE WHEN i % 7 = 0 AND i > 0 THEN p - 1000 ELSE p END AS ptr FROM (SELECT sp.sample_id, sp.i, sum(count(c.v)) OVER (PARTITION BY sp.sample_id ORDER BY sp.i) - count(c.v) AS p FROM spots sp LEFT JOIN counts c ON c.sample_id = sp.sample_id AND c.i = sp.i GROUP BY 1, 2))) WHERE (before IS NULL AND ptr <> 0) OR ptr < before", "sample_id:s i:i ptr:i before:i"),
    "p5_graph_faults": _m("SELECT sample_id, i FROM spots WHERE i >= 2 AND i % 9 = 0", "sample_id:s i:i"),
    "p7_exact_compare": _w(QUANTITY + ", tens AS (SELECT * FROM (SELECT l_returnflag AS sample_id, i, g, CAST(sum(floor(l_quantity / 10)) AS BIGINT) AS v FROM lineitem JOIN s ON l_suppkey = s_suppkey JOIN gn ON l_partkey = p_partkey GROUP BY 1, 2, 3) WHERE v > 0)", _out("(SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, count(*) FILTER (WHERE a.v = b.v) AS equal, count(*) FILTER (WHERE a.v <> b.v) AS changed, count(*) FILTER (WHERE b.v IS NULL) AS only_a, count(*) FILTER (WHERE a.v IS NULL) AS only_b FROM counts a FULL JOIN tens b ON a.sample_id = b.sample_id AND a.i = b.i AND a.g = b.g GROUP BY 1)", "sample_id:s equal:i changed:i only_a:i only_b:i identical=changed+only_a+only_b=0:b").replace("CAST(changed+only_a+only_b=0 AS BOOLEAN) AS identical", "changed + only_a + only_b = 0 AS identical")),
    "p9_safe_names": "SELECT CAST(p_partkey AS BIGINT) AS k, CASE p_partkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN 'a\\b' WHEN 3 THEN 'c:' ELSE 'dir/' END || CAST(p_partkey AS VARCHAR) || '.bin' AS name, p_partkey % 5 = 4 AS safe FROM part",
    "p10_release_gate": "SELECT CAST(release AS BIGINT) AS release, CASE WHEN min(CASE WHEN door = 0 THEN ok ELSE 1 END) = 0 OR count(*) FILTER (WHERE door = 0) = 0 THEN 'pending' WHEN min(ok) = 0 OR count(*) < 4 THEN 'blocked' ELSE 'passed' END AS status FROM (SELECT o_orderkey % 37 AS release, o_orderkey % 4 AS door, CASE WHEN min(o_orderkey) % 5 = 0 THEN 0 ELSE 1 END AS ok FROM orders GROUP BY 1, 2) GROUP BY 1",
    "p12_failure_outcomes": "SELECT CASE WHEN k % 11 = 0 THEN 'success' WHEN k % 13 = 0 THEN 'pending_adapter' WHEN k % 8 IN (0, 5, 6) THEN CASE WHEN k % 3 = 0 THEN 'shared_numba_runtime_crash' ELSE 'native_runtime_crash' END WHEN k % 8 = 1 THEN 'ivcsc_native_duplicate_index' WHEN k % 8 = 2 THEN 'ivcsc_native_index_width' WHEN k % 8 = 3 THEN 'python_package_compatibility' WHEN k % 8 = 4 THEN 'python_extension_nonzero' ELSE 'unclassified_nonzero_exit' END AS outcome, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1",
    "canonical_counts": _m("SELECT sample_id, i, g, v FROM counts", "sample_id:s i:i g:i v:i", base=TENS),
    "j1_causal_neighbours": _m("SELECT * FROM graph", "sample_id:s i:i r:i j:i", GRAPH),
    "j2_wide_neighbours": _m("SELECT * FROM graph", "sample_id:s i:i r:i j:i", _graph(12)),
    "j3_previous_rows": _m("SELECT a.sample_id, a.i, row_number() OVER (PARTITION BY a.sample_id, a.i ORDER BY b.i) AS r, b.i AS j FROM spots a JOIN spots b ON b.sample_id = a.sample_id AND b.i < a.i AND b.i >= a.i - 6", "sample_id:s i:i r:i j:i"),
    "a25_edge_statistics": _m("SELECT sample_id, count(*) AS edges, avg(sqrt(d2)) AS mean_edge, quantile_cont(sqrt(d2), 0.5) AS median_edge, max(sqrt(d2)) AS longest_edge FROM graph GROUP BY 1", "sample_id:s edges:i mean_edge:d median_edge:d longest_edge:d", GRAPH),
    "a25_neighbour_histogram": _m("SELECT sample_id, k AS neighbours, count(*) AS rows FROM (SELECT sp.sample_id, sp.i, count(gr.j) AS k FROM spots sp LEFT JOIN graph gr ON gr.sample_id = sp.sample_id AND gr.i = sp.i GROUP BY 1, 2) GROUP BY 1, 2", "sample_id:s neighbours:i rows:i", GRAPH),
    "j5_neighbour_support": _m("SELECT * FROM kk", "sample_id:s i:i g:i k:i", GRAPH, KK, base=COUNT),
    "a1_gene_marginals": _m("SELECT * FROM marg", "sample_id:s g:i ones:i q0:i b:i", MARG, base=COUNT),
    "a2_gene_contexts": _m("SELECT x.sample_id, x.g, x.ctx, x.seen, x.ones, greatest(1, least(4095, floor((x.ones + CAST(8 AS DOUBLE) * ((m.ones + CAST(0.5 AS DOUBLE)) / (m.n + CAST(1 AS DOUBLE)))) / (x.seen + CAST(8 AS DOUBLE)) * 4096 + CAST(0.5 AS DOUBLE)))) AS q FROM (SELECT sample_id, g, least(i, 6) * 7 + k AS ctx, count(*) AS seen, sum(y) AS ones FROM cells GROUP BY 1, 2, 3) x JOIN marg m ON m.sample_id = x.sample_id AND m.g = x.g", "sample_id:s g:i ctx:i seen:i ones:i q:i", GRAPH, MARG, KK, CELLS, base=COUNT),
    "a8_sufficient_statistics": _m("SELECT * FROM stats", "sample_id:s b:i k:i q:i n:i y:i", GRAPH, MARG, KK, CELLS, base=COUNT),
    "m1_support_odds": _m("SELECT * FROM sodds", "sample_id:s b:i k:i odds:i", GRAPH, MARG, KK, CELLS, SUPPORT_ODDS, base=COUNT),
    "m2_support_cdf": _m(f"SELECT m.sample_id, m.g, t.k, {_q_of('m.q0', 'coalesce(o.odds, 65536)')} AS q FROM marg m CROSS JOIN range(7) t(k) LEFT JOIN sodds o ON o.sample_id = m.sample_id AND o.b = m.b AND o.k = t.k", "sample_id:s g:i k:i q:i", GRAPH, MARG, KK, CELLS, SUPPORT_ODDS, base=COUNT),
    "m7_support_bits": _m("SELECT sample_id, sum(bits) AS bits FROM sbits GROUP BY 1", "sample_id:s bits:d", SUPPORT, base=COUNT),
    "a3_value_profiles": _m("SELECT * FROM prof", "sample_id:s g:i n:i a:i tail_sum:i grp:i q:i", _profiles()),
    "a3_value_histograms": _m("SELECT sample_id, g, floor(log2(v - 1)) AS k, count(*) AS c FROM counts WHERE v > 1 GROUP BY 1, 2, 3", "sample_id:s g:i k:i c:i"),
    "a6_groups_32": _m("SELECT * FROM prof", "sample_id:s g:i grp:i", _profiles(32)),
    "a7_pooled_tails": _m("SELECT * FROM pool", "sample_id:s b:i k:i c:i p:d", _profiles(), _pooled()),
    "w2_quantised_tails": _m("SELECT * FROM base", "sample_id:s b:i k:i freq:i", _profiles(), _pooled(), BASE),
    "w3_cumulative": _m("SELECT *, coalesce(sum(freq) OVER (PARTITION BY sample_id, b ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM base", "sample_id:s b:i k:i freq:i start:i", _profiles(), _pooled(), BASE),
    "j6_neighbour_sums": _m("SELECT * FROM nsum", "sample_id:s i:i g:i v:i s:i", GRAPH, NSUM),
    "j7_cell_gene_lookup": _m("SELECT * FROM ev", "sample_id:s i:i g:i v:i b:i c:i q:i", GRAPH, _profiles(), NSUM, EV),
    "a9_value_statistics": _m("SELECT * FROM vstat", "sample_id:s b:i c:i q:i n:i y:i", GRAPH, _profiles(), NSUM, EV, VSTAT),
    "a9_tail_statistics": _m("SELECT * FROM tstat", "sample_id:s b:i c:i k:i t:i", GRAPH, _profiles(), NSUM, EV, VSTAT),
    "m1_value_odds": _m("SELECT * FROM vodds", "sample_id:s b:i c:i odds:i", GRAPH, _profiles(), NSUM, EV, VSTAT, VODDS),
    "a10_centres": _m("SELECT * FROM cent", "sample_id:s b:i n:i a:i s:i", _profiles(), _centres()),
    "m4_tail_tables": _m("SELECT * FROM tails", "sample_id:s b:i c:i k:i freq:i", GRAPH, _profiles(), NSUM, EV, VSTAT, _pooled(), BASE, _tails()),
    "m2_value_cdf": _m("SELECT * FROM vcdf", "sample_id:s b:i c:i q:i", GRAPH, _profiles(), NSUM, EV, VSTAT, VODDS, _centres(), VCDF),
    "a11_exception_bound": _m(
        "SELECT sample_id, g, bound, bound > 12 AS exception FROM (SELECT sample_id, g, CASE WHEN max(CASE WHEN old <> new THEN 1 ELSE 0 END) = 1 THEN a * max(log2(old / new)) + (n - a) * max(log2((4096 - old) / (4096 - new))) + CAST(1e-10 AS DOUBLE) * n ELSE 0 END AS bound FROM (SELECT p.sample_id, p.g, p.n, p.a, "
        f"CAST(CASE WHEN t.c = 7 THEN p.q ELSE {_q_of('p.q', 'coalesce(o.odds, 65536)')} END AS DOUBLE) AS old, CAST(CASE WHEN t.c = 7 THEN ce.s ELSE {_q_of('ce.s', 'coalesce(o.odds, 65536)')} END AS DOUBLE) AS new FROM prof p JOIN cent ce ON ce.sample_id = p.sample_id AND ce.b = p.grp CROSS JOIN range(8) t(c) LEFT JOIN vodds o ON o.sample_id = p.sample_id AND o.b = p.grp AND o.c = t.c) GROUP BY sample_id, g, n, a)",
        "sample_id:s g:i bound:d exception:b", GRAPH, _profiles(), NSUM, EV, VSTAT, VODDS, _centres(),
    ),
    "m7_value_bits": _m("SELECT * FROM vbits", "sample_id:s singleton_bits:d magnitude_bits:d raw_bits:d", GRAPH, _value_model(8)),
    "a23_group_diagnostics": _m("SELECT sample_id, grp, count(*) AS genes, sum(n) AS events FROM prof GROUP BY 1, 2", "sample_id:s grp:i genes:i events:i", _profiles(32)),
    "a24_sample_profile": _m("SELECT c.sample_id, count(*) AS nnz, count(*) / CAST(any_value(n.n) * (SELECT count(*) FROM gn) AS DOUBLE) AS density, avg(CASE WHEN v = 1 THEN 1 ELSE 0 END) AS ones, avg(CASE WHEN v <= 3 THEN 1 ELSE 0 END) AS upto3, max(v) AS most FROM counts c JOIN nrow n USING (sample_id) GROUP BY 1", "sample_id:s nnz:i density:d ones:d upto3:d most:i"),
    "m10_code_length_k32": _w(QUANTITY + SUPPORT + _value_model(32), _out(TOTALS.format(s="sbits"), TOTAL_SPEC)),
    "m15_context_arms": " UNION ALL ".join(_arm(f"S{s}V{v}", QUANTITY + (SUPPORT if s else GRAPH + MARG + PLAIN_BITS) + _value_model(32, bool(v)), "sbits" if s else "pbits") for s in (0, 1) for v in (0, 1)),
    "m16_bucket_arms": " UNION ALL ".join(_bucket_arm(n, e) for n, e in EDGES.items()),
    "m16_joint_arms": " UNION ALL ".join(_joint_arm(n, w) for n in (16, 32) for w in (4, 6, 8)),
    "j2_width_arms": " UNION ALL ".join(_width_arm(n) for n in (0, 2, 4, 6, 8, 12, 16)),
    "m19_module_arms": " UNION ALL ".join(
        [
            _arm("full", QUANTITY + SUPPORT + _value_model(32), "sbits"), _arm("no_support", QUANTITY + GRAPH + MARG + PLAIN_BITS + _value_model(32), "pbits"),
            f"SELECT *, 'no_value' AS arm FROM ({_w(QUANTITY + SUPPORT, _out('(SELECT s.sample_id, s.bits AS support_bits, c.n * 32 AS value_bits FROM (SELECT sample_id, sum(bits) AS bits FROM sbits GROUP BY 1) s JOIN (SELECT sample_id, count(*) AS n FROM counts GROUP BY 1) c USING (sample_id))', TOTAL_SPEC))})",
            _arm("no_spatial", QUANTITY + MARG + PLAIN_BITS + _value_model(32, False), "pbits"), _arm("no_sharing", QUANTITY + SUPPORT + _value_model(32, True, False), "sbits"),
        ]
    ),
    "w4_row_pointers": _m("SELECT sp.sample_id, sp.i, sum(count(c.v)) OVER w - count(c.v) AS ptr_lo, sum(count(c.v)) OVER w AS ptr_hi FROM spots sp LEFT JOIN counts c ON c.sample_id = sp.sample_id AND c.i = sp.i GROUP BY 1, 2 WINDOW w AS (PARTITION BY sp.sample_id ORDER BY sp.i)", "sample_id:s i:i ptr_lo:i ptr_hi:i"),
    "w5_gaps": _m("SELECT sample_id, i, row_number() OVER w AS p, g - coalesce(lag(g) OVER w, 0) AS gap FROM counts WINDOW w AS (PARTITION BY sample_id, i ORDER BY g)", "sample_id:s i:i p:i gap:i"),
    "w5_gaps_decoded": _m("SELECT sample_id, i, g FROM counts", "sample_id:s i:i g:i"),
    "w6_rank_labels": _m("SELECT sample_id, g, floor((row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN n > 0 THEN a / CAST(n AS DOUBLE) ELSE 0 END, g) - 1) * 8 / CAST(count(*) OVER (PARTITION BY sample_id) AS DOUBLE)) AS label FROM prof", "sample_id:s g:i label:i", _profiles()),
    "w7_canonical_order": _m("SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY x, y, spot_id, i) - 1 AS place, i FROM spots", "sample_id:s place:i i:i"),
    "w8_inverse_order": _m("SELECT sample_id, i AS place, row_number() OVER (PARTITION BY sample_id ORDER BY x, y, spot_id, i) - 1 AS i FROM spots", "sample_id:s place:i i:i"),
    "w9_mean_sort": _m("SELECT sample_id, g, row_number() OVER (PARTITION BY sample_id ORDER BY t, g) - 1 AS place FROM (SELECT s.sample_id, gn.g, coalesce(sum(c.v), 0) AS t FROM samples s CROSS JOIN gn LEFT JOIN counts c ON c.sample_id = s.sample_id AND c.g = gn.g GROUP BY 1, 2)", "sample_id:s g:i place:i"),
    "c11_value_runs": _m("SELECT sample_id, g, v, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS is_text FROM counts GROUP BY 1, 2, 3", "sample_id:s g:i v:i n:i is_text:s", base=COUNT),
    "j9_coverage": RESULTS + "SELECT sample_id, arm, status FROM cov",
    "a20_status_counts": RESULTS + "SELECT arm, status, count(*) AS runs FROM cov GROUP BY 1, 2",
    "j10_pairs": RESULTS + _out("pr", "sample_id:s platform:s species:s organ:s arm:s base_bytes:i bytes:i delta:i percent:d"),
    "a15_paired_summary": RESULTS + ", t AS (SELECT arm, sum(base_bytes) AS bt, sum(bytes) AS tt, count(*) AS n FROM pr GROUP BY 1), loo AS (SELECT arm, min(x) AS loo_low, max(x) AS loo_high FROM (SELECT p.arm, 100.0::DOUBLE * ((t.tt - p.bytes) - (t.bt - p.base_bytes)) / (t.bt - p.base_bytes) AS x FROM pr p JOIN t USING (arm) WHERE t.n > 1) GROUP BY 1) " + _out("(SELECT arm, count(*) AS n, sum(base_bytes) AS base_total, sum(bytes) AS total, count(*) FILTER (WHERE delta > 0) AS wins, count(*) FILTER (WHERE delta < 0) AS losses, count(*) FILTER (WHERE delta = 0) AS ties, quantile_cont(percent, 0.25) AS q1, quantile_cont(percent, 0.5) AS median, quantile_cont(percent, 0.75) AS q3, min(percent) AS low, max(percent) AS high, first(sample_id ORDER BY delta, sample_id) AS best, 100.0::DOUBLE * (sum(bytes) - sum(base_bytes)) / sum(base_bytes) AS pooled FROM pr GROUP BY 1) LEFT JOIN loo USING (arm)", "arm:s n:i base_total:i total:i wins:i losses:i ties:i q1:d median:d q3:d low:d high:d best:s pooled:d loo_low:d loo_high:d"),
    "a16_stratified": RESULTS + _out("(" + " UNION ALL ".join(f"SELECT arm, '{n}' AS stratum, {c} AS level, count(*) AS n, sum(base_bytes) AS base_total, sum(bytes) AS total, count(*) FILTER (WHERE delta > 0) AS wins FROM pr GROUP BY 1, 2, 3" for n, c in (("all", "'all'"), ("platform", "platform"), ("species", "species"), ("organ", "organ"))) + ")", "arm:s stratum:s level:s n:i base_total:i total:i wins:i"),
    "a13_pooled_summary": RESULTS + _out("(SELECT arm, count(*) AS n, sum(total_bytes) AS total, avg(total_bytes) AS mean, sum(payload) AS payload, sum(model) AS model, sum(framing) AS framing FROM ok GROUP BY 1)", "arm:s n:i total:i mean:d payload:i model:i framing:i"),
    "a14_complete_summary": RESULTS + _out("(SELECT arm, count(*) AS n_expected, count(*) FILTER (WHERE status = 'success') AS n_success, sum(total_bytes) AS total, quantile_cont(total_bytes, 0.5) AS median FROM r GROUP BY 1)", "arm:s n_expected:i n_success:i total:i median:d complete=n_success=n_expected:b").replace("CAST(n_success=n_expected AS BOOLEAN) AS complete", "n_success = n_expected AS complete"),
    "a17_module_summary": RESULTS + _out("(SELECT arm, sum(payload) / CAST(sum(total_bytes) AS DOUBLE) AS payload_share FROM ok GROUP BY 1) LEFT JOIN (SELECT arm, avg(percent) AS mean_change, quantile_cont(percent, 0.5) AS median_change, count(*) FILTER (WHERE delta > 0) AS n_increase, min(percent) AS least, max(percent) AS most FROM pr GROUP BY 1) USING (arm)", "arm:s payload_share:d mean_change:d median_change:d n_increase:i least:d most:d"),
    "j11_pivoted": RESULTS + 'SELECT sample_id, CAST(sum(total_bytes) FILTER (WHERE arm = \'L1\') AS BIGINT) AS "L1", CAST(sum(total_bytes) FILTER (WHERE arm = \'L2\') AS BIGINT) AS "L2", CAST(sum(total_bytes) FILTER (WHERE arm = \'L3\') AS BIGINT) AS "L3", CAST(sum(total_bytes) FILTER (WHERE arm = \'L4\') AS BIGINT) AS "L4" FROM ok WHERE arm IN (\'L1\', \'L2\', \'L3\', \'L4\') GROUP BY 1 HAVING count(*) = 4',
    "a18_factorial": RESULTS + ", w AS (SELECT sample_id, sum(total_bytes) FILTER (WHERE arm = 'L1') AS n, sum(total_bytes) FILTER (WHERE arm = 'L2') AS f, sum(total_bytes) FILTER (WHERE arm = 'L3') AS s, sum(total_bytes) FILTER (WHERE arm = 'L4') AS b FROM ok WHERE arm IN ('L1', 'L2', 'L3', 'L4') GROUP BY 1 HAVING count(*) = 4) " + _out("(SELECT * FROM w UNION ALL SELECT 'POOLED', sum(n), sum(f), sum(s), sum(b) FROM w)", "sample_id:s effect_first=f-n:i effect_second=s-n:i interaction=b-f-s+n:i"),
    "a19_weighted_ratios": RESULTS + _out("(SELECT arm, sum(total_bytes) * 8 / CAST(sum(n_counts) AS DOUBLE) AS bits_per_count, sum(total_bytes) * 8 / CAST(sum(n_lines) AS DOUBLE) AS bits_per_nonzero FROM ok GROUP BY 1)", "arm:s bits_per_count:d bits_per_nonzero:d"),
    "a21_uniqueness": RESULTS + "SELECT count(*) AS rows, count(DISTINCT (sample_id, arm)) AS keys, count(*) = count(DISTINCT (sample_id, arm)) AS \"unique\" FROM r",
    "c1_quota": PEOPLE + ", st AS (SELECT species, organ, count(*) AS c FROM p GROUP BY 1, 2), t AS (SELECT count(*) AS strata FROM st), tot AS (SELECT count(*) AS total FROM p), seats AS (SELECT species, organ, row_number() OVER (ORDER BY 60 * c - q * (SELECT total FROM tot) DESC, species, organ) AS rk FROM (SELECT species, organ, c, unnest(range(1, c)) AS q FROM st)), quo AS (SELECT st.species, st.organ, 1 + count(s.rk) AS quota FROM st LEFT JOIN seats s ON s.species = st.species AND s.organ = st.organ AND s.rk <= greatest(0, 60 - (SELECT strata FROM t)) GROUP BY 1, 2) SELECT id, species, organ FROM (SELECT p.*, row_number() OVER (PARTITION BY p.species, p.organ ORDER BY sha256('v1:' || id), id) AS pl, quota FROM p JOIN quo ON quo.species = p.species AND quo.organ = p.organ) WHERE pl <= quota",
    "w11_hash_ranked": PEOPLE + "SELECT id, sha256('v1:' || id) AS digest FROM p ORDER BY 2, 1 LIMIT 50",
    "c2_queue": "SELECT 'L' || CAST(l_linenumber AS VARCHAR) AS arm, 'ready' AS state, (SELECT count(*) FROM customer) AS n FROM lineitem GROUP BY 1",
    "c3_reconcile": PEOPLE + "SELECT id, coalesce(organ % 3 = 0 AND balance > 0, false) AS ready, organ % 3 = 0 AND (organ % 2 = 0 OR balance > 0) AS exposed FROM p",
    "j13_manifest_faults": MEMBERS + "SELECT archive_id, member, CASE WHEN x IS NULL THEN 'unexpected' WHEN y IS NULL THEN 'missing' WHEN want <> have THEN 'size' ELSE 'digest' END AS fault FROM j WHERE x IS NULL OR y IS NULL OR want <> have OR x <> y",
    "j14_member_difference": MEMBERS + DIFFERENCE,
    "j15_pin_bridge": MEMBERS + "SELECT CAST(a.archive_id AS VARCHAR) || '/' || a.member AS path, a.sha256 = b.sha256 AS kept_match, CASE WHEN a.archive_id % 2 = 0 THEN true END AS released_match FROM a LEFT JOIN b ON b.archive_id = a.archive_id AND b.member = a.member",
    "j16_outstanding": RESULTS + "SELECT sample_id, arm FROM r WHERE status <> 'success'",
    "u2_member_sets": MEMBERS + "SELECT 'a_minus_b' AS op, count(*) AS n FROM (SELECT member, sha256 FROM a EXCEPT ALL SELECT member, sha256 FROM b) UNION ALL SELECT 'b_minus_a', count(*) FROM (SELECT member, sha256 FROM b EXCEPT ALL SELECT member, sha256 FROM a) UNION ALL SELECT 'both', count(*) FROM (SELECT member, sha256 FROM a INTERSECT SELECT member, sha256 FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT member, sha256 FROM a UNION SELECT member, sha256 FROM b)",
    "c5_ledger": MEMBERS + LEDGER + _out("led", "archive_id:i category:s bytes:i"),
    "c22_conservation": MEMBERS + LEDGER + _out("(SELECT t.archive_id, any_value(t.total) AS total, sum(l.bytes) AS s FROM tot t JOIN led l ON l.archive_id = t.archive_id AND NOT (l.category = 'graph' AND l.archive_id % 6 = 0) GROUP BY 1 HAVING sum(l.bytes) <> any_value(t.total))", "archive_id:i total:i sum=s:i"),
    "c12_coverage_audit": RESULTS + "SELECT sample_id, count(*) AS rows, count(DISTINCT arm) AS arms, count(DISTINCT identity) AS identities FROM r WHERE n_lines % 3 <> 0 GROUP BY 1 HAVING count(*) <> 7 OR count(DISTINCT arm) <> 7 OR count(DISTINCT identity) <> 1",
    "c15_recompute_audit": RESULTS + "SELECT sample_id, arm FROM ok WHERE n_lines % 5 = 0",
    "c19_near_minimum": RESULTS + ", t AS (SELECT arm, CAST(sum(total_bytes) AS BIGINT) AS total, count(*) AS n FROM ok GROUP BY 1) SELECT arm, total, n FROM t WHERE total <= (SELECT min(total) FROM t) * 1.02 ORDER BY arm LIMIT 1",
    "w12_argmin": RESULTS + "SELECT sample_id, first(arm ORDER BY total_bytes, n_counts, arm) AS arm FROM ok GROUP BY 1",
    "c20_three_way": RESULTS + "SELECT arm, CASE WHEN min(delta) > 0 THEN 'supported' WHEN max(delta) < 0 THEN 'not_supported' ELSE 'inconclusive' END AS verdict FROM pr GROUP BY 1",
    "c21_effective": RESULTS + "SELECT sample_id, arm, CASE WHEN status = 'success' OR n_lines % 2 = 0 THEN 'success' ELSE 'failed' END AS status, CASE WHEN status <> 'success' AND n_lines % 2 = 0 THEN 'retry' ELSE 'main' END AS origin FROM r",
    "c17_distributions": RESULTS + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM r GROUP BY 2" for c in ("status", "platform", "species", "organ")),
    "c18_legacy": RESULTS + _out("(SELECT sample_id, arm, coalesce(CASE WHEN n_lines % 2 = 0 THEN total_bytes END, payload) AS bytes, CASE WHEN n_lines % 2 = 0 AND total_bytes IS NOT NULL THEN 2 WHEN payload IS NOT NULL THEN 1 END AS schema FROM r)", "sample_id:s arm:s bytes:i schema:i"),
    "l1_stop_point": "SELECT CAST(lane AS BIGINT) AS lane, CAST(min(attempt) AS BIGINT) AS stop_at FROM (SELECT lane, attempt, f + coalesce(lag(f) OVER (PARTITION BY lane ORDER BY attempt), 0) AS two FROM (SELECT o_orderkey % 16 AS lane, o_orderkey AS attempt, CASE WHEN (o_orderkey // 16) % 5 < 2 THEN 1 ELSE 0 END AS f FROM orders)) WHERE two = 2 GROUP BY 1",
    "f_scalars": "WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey * 37 + 2 AS BIGINT) AS v, CAST(p_partkey % 4095 + 1 AS BIGINT) AS q, CAST(p_partkey * 977 % 195360042 + 22 AS BIGINT) AS odds FROM part) SELECT k, CAST(floor(log2(v - 1)) AS BIGINT) AS mag, v - 1 - (CAST(1 AS BIGINT) << CAST(floor(log2(v - 1)) AS INT)) AS rem, v AS back, CAST(" + _bucket("q") + " AS BIGINT) AS bucket, CAST(" + _q_of("q", "odds") + " AS BIGINT) AS q, CAST(CASE WHEN k % 40 < 6 THEN 7 WHEN k % 500 = 0 THEN 0 WHEN k % 500 < 12 THEN 1 WHEN k % 500 < 24 THEN 2 WHEN k % 500 < 48 THEN 3 WHEN k % 500 < 96 THEN 4 WHEN k % 500 < 384 THEN 5 ELSE 6 END AS BIGINT) AS ctx, CAST(floor(k / CAST(4 AS DOUBLE) + 0.5) AS BIGINT) AS half, CAST(CASE WHEN k % 11 = 0 THEN 0 " + " ".join(f"WHEN k * 3 <= CAST({u!r} AS DOUBLE) * (k % 11) THEN {i}" for i, u in enumerate(_tail_bounds(32))) + " ELSE 31 END AS BIGINT) AS grp FROM p",
    "f_code_inverse": "SELECT DISTINCT CAST(p_partkey % 33 AS BIGINT) AS k, CAST(p_partkey % 7 AS BIGINT) AS rem, CASE WHEN (CAST(1 AS BIGINT) << CAST(p_partkey % 33 AS INT)) + p_partkey % 7 + 1 <= 4294967295 THEN (CAST(1 AS BIGINT) << CAST(p_partkey % 33 AS INT)) + CAST(p_partkey % 7 AS BIGINT) + 1 END AS v FROM part",
}


def _start(width: int) -> str:
    return CONTEXT.replace("n.i < 6", f"n.i < {width}")


def _narrow(n: int) -> str:
    model = _profiles(32) + (NSUM if n else PLAIN_SUM) + (_events(_start(n)) if n else _events("7")) + VSTAT + VODDS + _pooled(32) + BASE + _centres(32) + _tails(32) + VCDF + VBITS
    body = _w(QUANTITY + (_graph(n) if n else "") + model, _out("vbits", "sample_id:s bits=singleton_bits+magnitude_bits+raw_bits:d"))
    return f"SELECT *, CAST({n} AS BIGINT) AS neighbours FROM ({body})"


PREFIX = """,
graph AS (SELECT a.sample_id, a.i, b.i AS j FROM spots a JOIN spots b ON b.sample_id = a.sample_id AND b.i < a.i AND b.i >= a.i - 6)"""
MOVED = QUANTITY.replace("counts AS", "counts0 AS").replace("spots AS", "spots0 AS") + """,
ord AS (SELECT sample_id, i, row_number() OVER (PARTITION BY sample_id ORDER BY x, y, spot_id, i) - 1 AS place FROM spots0),
counts AS (SELECT c.sample_id, o.place AS i, c.g, c.v FROM counts0 c JOIN ord o ON o.sample_id = c.sample_id AND o.i = c.i),
spots AS (SELECT s0.sample_id, o.place AS i, spot_id, x, y FROM spots0 s0 JOIN ord o ON o.sample_id = s0.sample_id AND o.i = s0.i)"""
MOVED = MOVED.replace("FROM spots GROUP BY 1)", "FROM spots0 GROUP BY 1)")
GENE_CONTEXT_BITS = """,
gctx AS (SELECT x.sample_id, x.seen, x.ones, greatest(1, least(4095, floor((x.ones + CAST(8 AS DOUBLE) * ((m.ones + CAST(0.5 AS DOUBLE)) / (m.n + CAST(1 AS DOUBLE)))) / (x.seen + CAST(8 AS DOUBLE)) * 4096 + CAST(0.5 AS DOUBLE)))) AS q
  FROM (SELECT sample_id, g, least(i, 6) * 7 + k AS ctx, count(*) AS seen, sum(y) AS ones FROM cells GROUP BY 1, 2, 3) x JOIN marg m ON m.sample_id = x.sample_id AND m.g = x.g),
gbits AS (SELECT sample_id, ones * (12 - log2(q)) + (seen - ones) * (12 - log2(4096 - q)) AS bits FROM gctx)"""
EXCEPTION_BITS = f""",
own AS (SELECT p.sample_id, p.g, p.n, p.a, CAST(CASE WHEN t.c = 7 THEN p.q ELSE {_q_of('p.q', 'coalesce(o.odds, 65536)')} END AS DOUBLE) AS old, CAST(CASE WHEN t.c = 7 THEN ce.s ELSE {_q_of('ce.s', 'coalesce(o.odds, 65536)')} END AS DOUBLE) AS new
  FROM prof p JOIN cent ce ON ce.sample_id = p.sample_id AND ce.b = p.grp CROSS JOIN range(8) t(c) LEFT JOIN vodds o ON o.sample_id = p.sample_id AND o.b = p.grp AND o.c = t.c),
exc AS (SELECT sample_id, g, CASE WHEN max(CASE WHEN old <> new THEN 1 ELSE 0 END) = 1 THEN a * max(log2(old / new)) + (n - a) * max(log2((4096 - old) / (4096 - new))) + CAST(1e-10 AS DOUBLE) * n ELSE 0 END > 12 AS exception FROM own GROUP BY sample_id, g, n, a),
ev2 AS (SELECT ev.sample_id, ev.v, ev.b, ev.c, CASE WHEN x.exception THEN ev.q ELSE ce.s END AS q FROM ev JOIN exc x ON x.sample_id = ev.sample_id AND x.g = ev.g JOIN cent ce ON ce.sample_id = ev.sample_id AND ce.b = ev.b)"""
EXCEPTION_BITS += OWN_BITS.replace("ev.", "ev2.").replace("FROM ev ", "FROM ev2 ")
SUM_BITS = "(SELECT sample_id, sum(bits) AS bits FROM {s} GROUP BY 1)"

ORACLE |= {
    "m13_gene_context_arms": " UNION ALL ".join(
        f"SELECT *, '{name}' AS arm FROM ({_w(QUANTITY + body, _out(SUM_BITS.format(s=s), 'sample_id:s bits:d'))})"
        for name, body, s in (("S0_gene", MARG + PLAIN_BITS, "pbits"), ("S1_prefix", PREFIX + MARG + KK + CELLS + GENE_CONTEXT_BITS, "gbits"), ("S2_spatial", GRAPH + MARG + KK + CELLS + GENE_CONTEXT_BITS, "gbits"))
    ),
    "m14_shared_graph_arms": " UNION ALL ".join(
        f"SELECT *, '{name}' AS arm FROM ({_w(QUANTITY + body, _out(SUM_BITS.format(s=s), 'sample_id:s bits:d'))})"
        for name, body, s in (("gene", MARG + PLAIN_BITS, "pbits"), ("P1_shared_prefix", PREFIX + MARG + KK + CELLS + SUPPORT_ODDS + SBITS, "sbits"), ("P2_shared_spatial", SUPPORT, "sbits"))
    ),
    "m6_description_of_ranks": _m(
        "SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY bytes, k, exceptions) = 1 AS selected FROM db", "sample_id:s k:i exceptions:b n_exceptions:i model_bits:d singleton_bits:d bytes:i selected:b", GRAPH, _profiles(), NSUM, EV, VSTAT, VODDS, RANKS
    ),
    "m12_code_length": _w(QUANTITY + SUPPORT + _profiles() + NSUM + EV + VSTAT + VODDS + _pooled() + BASE + _centres() + _tails() + EXCEPTION_BITS, _out(TOTALS.format(s="sbits"), TOTAL_SPEC)),
    "m17_value_width_arms": " UNION ALL ".join(_narrow(n) for n in (0, 2, 4, 6, 8, 12)),
    "m18_order_arms": " UNION ALL ".join(
        f"SELECT sample_id, '{name}' AS arm, bits, CAST({paid} * (SELECT count(*) FROM supplier) AS BIGINT) AS order_bits FROM ({_w(body + SUPPORT, _out(SUM_BITS.format(s='sbits'), 'sample_id:s bits:d'))})" for name, body, paid in (("original", QUANTITY, 0), ("canonical", MOVED, 32))
    ),
    "m12_exceptions": f"SELECT sample_id, count(*) FILTER (WHERE exception) AS exceptions, count(*) AS genes FROM ({ORACLE['a11_exception_bound']}) GROUP BY 1",
    "c7_fees": RESULTS + "SELECT arm, CAST(sum(total_bytes) AS BIGINT) AS total, CAST(sum(model) + sum(framing) AS BIGINT) AS fees FROM ok GROUP BY 1",
    "u1_union": RESULTS + "SELECT sample_id, arm, CAST(total_bytes AS BIGINT) AS total_bytes, CAST(NULL AS BIGINT) AS n_lines FROM r WHERE arm = 'L1' UNION ALL SELECT sample_id, arm, NULL, n_lines FROM r WHERE arm = 'L2'",
}
