"""DuckDB SQL for the registered queries: written from the definitions over all pairs, as an independent check."""

from __future__ import annotations

import re

_RAW = "raw AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"
_B = "b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM raw)"
_P = "p AS (SELECT id, (x - x0) / (CASE WHEN x1 = x0 THEN 1.0 ELSE x1 - x0 END) AS x, (y - y0) / (CASE WHEN y1 = y0 THEN 1.0 ELSE y1 - y0 END) AS y, label FROM raw, b)"
_D = "d AS (SELECT a.id AS i, c.id AS j, sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y)) AS d FROM p a, p c)"
_KNN = "k AS (SELECT * FROM (SELECT i, j, d, CAST(row_number() OVER (PARTITION BY i ORDER BY d, j) AS INTEGER) AS rank FROM d WHERE i <> j) WHERE rank <= 5)"
_E = "e AS (SELECT i, j, max(d) AS w FROM (SELECT i, j, d FROM k WHERE rank = 1 OR d <= 0.05 UNION ALL SELECT j, i, d FROM k WHERE rank = 1 OR d <= 0.05) GROUP BY i, j)"
_C = "c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY label)"
_R = "r AS (SELECT id, p.label, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS r FROM p JOIN c ON p.label = c.label)"
_M = "m AS (SELECT *, max(r) OVER (PARTITION BY label) AS radius FROM r)"
_TEN = "ten AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS centre, x AS cx, y AS cy FROM (SELECT * FROM p ORDER BY id LIMIT {k}))"
_NEAR = "near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dc, centre) AS n FROM (SELECT id, p.label, p.x, p.y, centre, sqrt((p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy)) AS dc FROM p, ten))"
_PRED = "q AS (SELECT id, label AS t, centre AS p FROM near WHERE n = 1), w AS (SELECT p, t, count(*) AS n FROM q GROUP BY p, t)"
_POS = "s AS (SELECT id, label = 0 AS pos, floor(x * 20) AS score FROM p)"
_PART = "l AS (SELECT id, label AS part FROM p), ep AS (SELECT e.*, a.part AS pa, c.part AS pb FROM e JOIN l a ON e.i = a.id JOIN l c ON e.j = c.id), pv AS (SELECT pa AS part, sum(w) AS vol, sum(CASE WHEN pa <> pb THEN w ELSE 0 END) AS g FROM ep GROUP BY pa), tot AS (SELECT sum(w) AS total FROM e), lv AS (SELECT i, sum(w) AS vol, sum(CASE WHEN i <> j THEN w ELSE 0 END) AS g FROM e GROUP BY i)"
_STOPS = "s AS (SELECT label AS route, id AS seq, id AS node, x, y, CAST(id % 5 + 1 AS INTEGER) AS demand FROM p)"
_BASE = (_RAW, _B, _P)


def _q(*parts: str, recursive: bool = False) -> str:
    *ctes, body = parts
    more = ", " if re.match(r"\w+(\([^)]*\))? AS \(", body) else " "  # a body may begin with CTEs of its own
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}{more}{body}"


def _p(*parts: str, **kw: bool) -> str:
    return _q(*_BASE, *parts, **kw)


def _near(k: int) -> tuple[str, str]:
    return _TEN.format(k=k), _NEAR


def _overlap(k: int, name: str, centres: str | None = None) -> str:
    """A CTE `name` (id, score) of projection overlap with the first k points as centres, or with those of a table (c, x, y)."""
    rows = f"SELECT c AS centre, x AS cx, y AS cy FROM {centres}" if centres else f"SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS centre, x AS cx, y AS cy FROM (SELECT * FROM p ORDER BY id LIMIT {k})"
    return f"""{name}t AS ({rows}),
      {name}n AS (SELECT * FROM (SELECT id, x, y, centre, cx, cy, row_number() OVER (PARTITION BY id ORDER BY sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), centre) AS n FROM p, {name}t) WHERE n = 1),
      {name} AS (SELECT a.id, greatest(0.0, max(2.0 * ((a.cx - a.x) * (a.cx - o.cx) + (a.cy - a.y) * (a.cy - o.cy)) / ((a.cx - o.cx) * (a.cx - o.cx) + (a.cy - o.cy) * (a.cy - o.cy)))) AS score FROM {name}n a JOIN {name}t o ON o.centre <> a.centre GROUP BY a.id)"""


def _dbscan(near: str, least: int) -> str:
    return _q(*_BASE, _D, f"nr AS ({near})", f"co AS (SELECT i AS id FROM nr GROUP BY i HAVING count(*) >= {least})", "ce AS (SELECT i, j FROM nr WHERE i IN (SELECT id FROM co) AND j IN (SELECT id FROM co))",
              "rc(id, root) AS (SELECT id, id FROM co UNION SELECT ce.j, rc.root FROM rc JOIN ce ON ce.i = rc.id)", "rt AS (SELECT id, min(root) AS root FROM rc GROUP BY id)",
              "bo AS (SELECT nr.i AS id, min(rt.root) AS root FROM nr JOIN rt ON rt.id = nr.j WHERE nr.i NOT IN (SELECT id FROM co) GROUP BY nr.i)", "al AS (SELECT * FROM rt UNION ALL SELECT * FROM bo)",
              "nu AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS n FROM (SELECT DISTINCT root FROM al))", "SELECT p.id, CAST(coalesce(n, -1) AS INTEGER) AS cluster FROM p LEFT JOIN al ON al.id = p.id LEFT JOIN nu ON nu.root = al.root", recursive=True)


_UP = "rho AS (SELECT i AS id, count(*) - 1 AS rho FROM d WHERE d <= 0.1 GROUP BY i), up AS (SELECT a.id, a.rho, arg_min(c.id, (d, c.id)) AS higher, min(d) AS delta FROM rho a LEFT JOIN rho c ON c.rho > a.rho OR (c.rho = a.rho AND c.id < a.id) LEFT JOIN d ON d.i = a.id AND d.j = c.id GROUP BY a.id, a.rho)"
def _draw(cols: str, seed: int) -> str:
    """A number above 0, at most 1, from the md5 of columns and a seed."""
    return f"((CAST('0x' || substr(md5(concat_ws(':', {cols}, '{seed}')), 1, 10) AS BIGINT) + 1) / 1099511627776.0)"


_SPLIT = "f(route, seq, n, part, held) AS (SELECT route, seq, n, 0, demand FROM o WHERE n = 1 UNION ALL SELECT o.route, o.seq, o.n, CASE WHEN f.held + o.demand > 12 THEN f.part + 1 ELSE f.part END, CASE WHEN f.held + o.demand > 12 THEN o.demand ELSE f.held + o.demand END FROM f JOIN o ON o.route = f.route AND o.n = f.n + 1)"

_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_DV = "d AS (SELECT a.id AS i, c.id AS j, sqrt(list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS d FROM v a, v c)"
_PLACES = "pr AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part), pb AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM pr), pl AS (SELECT min(id) AS id, (x - x0) / (x1 - x0) AS x, (y - y0) / (y1 - y0) AS y, count(*) AS w FROM pr, pb GROUP BY x, y, x0, x1, y0, y1)"


def _coreset(rounds: int, z: int) -> str:
    """Rounds of the summary; those after the last that is due have no rows."""
    out, last = [_V, _DV, "l0 AS (SELECT id FROM v)"], rounds - 1
    for n in range(rounds):
        out += [f"n{n} AS (SELECT count(*) AS n FROM l{n})", f"s{n} AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {_draw('id', n)}, id) AS k FROM l{n}), n{n} WHERE n > {z} AND k <= greatest(1, floor(ln(n))))",
                f"a{n} AS (SELECT i AS id, j AS rep, d FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM d WHERE i IN (SELECT id FROM l{n}) AND j IN (SELECT id FROM s{n})) WHERE k = 1)",
                f"r{n} AS (SELECT d AS r FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k FROM a{n}), n{n} WHERE k = CAST(ceil((n - 1) * 0.4) AS BIGINT))", f"c{n} AS (SELECT id, rep FROM a{n}, r{n} WHERE d <= r + 1e-12)",
                f"l{n + 1} AS (SELECT id FROM l{n} WHERE id NOT IN (SELECT id FROM c{n}))"]
    rows = [f"SELECT rep AS id, {n} AS round, count(*) AS weight FROM c{n} GROUP BY rep" for n in range(rounds)]
    turn = " + ".join(f"(SELECT CAST(n > {z} AS INTEGER) FROM n{n})" for n in range(rounds))
    return _q(*out, " UNION ALL ".join([*rows, f"SELECT id, CAST({turn} AS INTEGER) AS round, 1 AS weight FROM l{last + 1}"]))


def _medoids(steps: int) -> str:
    near = lambda n: f"(SELECT * FROM (SELECT p.id, p.x, p.y, c, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)), c) AS n FROM p, c{n} k) WHERE n = 1)"
    out = ["c0 AS (SELECT row_number() OVER (ORDER BY x DESC, id DESC) - 1 AS c, x, y FROM (SELECT * FROM p ORDER BY p.x DESC, id DESC LIMIT 3))"]
    for n in range(steps):
        out += [f"a{n} AS {near(n)}", f"s{n} AS (SELECT a.c, a.id, a.x, a.y, sum(sqrt((a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y))) AS s FROM a{n} a JOIN a{n} o ON o.c = a.c GROUP BY ALL)",
                f"c{n + 1} AS (SELECT c, x, y FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(s, 9), id) AS n FROM s{n}) WHERE n = 1)"]
    return _p(*out, f"SELECT id, CAST(c AS INTEGER) AS cluster FROM {near(steps)}")


def _greedy(rows: str, k: int, body: str) -> str:
    """Farthest-first: g holds each row's distance to the chosen ones; of step n the farthest row is centre n + 1."""
    return _q(*_BASE, f"t AS ({rows})", "g(step, id, x, y, d) AS (SELECT 0, t.id, t.x, t.y, sqrt((t.x - f.x) * (t.x - f.x) + (t.y - f.y) * (t.y - f.y)) FROM t, (SELECT x, y FROM t ORDER BY id LIMIT 1) f "
              f"UNION ALL SELECT step + 1, id, x, y, least(d, sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy))) FROM (SELECT *, first_value(x) OVER o AS fx, first_value(y) OVER o AS fy FROM g WHERE step < {k - 1} WINDOW o AS (ORDER BY d DESC, id)))", body, recursive=True)  # fmt: skip


def _lloyd(steps: int, k: int = 4, c: str = "c") -> tuple[str, ...]:
    out = [f"{c}0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS c, x, y FROM (SELECT * FROM p ORDER BY id LIMIT {k}))"]
    for n in range(steps):
        out.append(f"{c}a{n} AS (SELECT id, x, y, c FROM (SELECT p.id, p.x, p.y, c, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)), c) AS n FROM p, {c}{n} k) WHERE n = 1)")
        out.append(f"{c}{n + 1} AS (SELECT k.c, coalesce(avg(a.x), any_value(k.x)) AS x, coalesce(avg(a.y), any_value(k.y)) AS y FROM {c}{n} k LEFT JOIN {c}a{n} a ON a.c = k.c GROUP BY k.c)")
    return tuple(out)


_LOG = "mv AS (SELECT o_orderkey AS problem, o_orderkey // 3 AS parent, o_orderkey * 7 % 20 AS action, o_orderkey % 11 AS result FROM orders WHERE o_orderkey > 0)"
_FIRST = "s0 AS (SELECT CAST(0 AS BIGINT) AS problem, 0 AS depth, id % 30 AS route, id AS seq, id AS node, x, y, 0 AS visits FROM p)"


def _picked(name: str, state: str, picks: str, key: str = "sqrt((c.cx - o.cx) * (c.cx - o.cx) + (c.cy - o.cy) * (c.cy - o.cy))") -> tuple[str, str]:
    """CTEs of the routes of a state near each of its picks (problem, action): 15 at most, with 200 nodes at most."""
    return (f"{name}c AS (SELECT problem, route, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM {state} GROUP BY problem, route)",
            f"{name} AS (SELECT problem, action, route, k FROM (SELECT *, sum(n) OVER (PARTITION BY problem, action ORDER BY k) AS held FROM (SELECT c.problem, q.action, c.route, c.n, row_number() OVER (PARTITION BY c.problem, q.action ORDER BY {key}, c.route) AS k "
            f"FROM ({picks}) q JOIN {name}c o ON o.problem = q.problem AND o.route = q.action JOIN {name}c c ON c.problem = q.problem) WHERE k <= 15) WHERE held <= 200)")  # fmt: skip


def _replayed(depth: int) -> tuple[str, ...]:
    """States s0 to s(depth) of the log, in which no problem is reached twice."""
    out = [_LOG, _FIRST, "nr AS (SELECT r AS result, (k - 1) // 8 AS part, k + (k - 1) // 8 - 1 AS pos, k * (r + 3) % 211 AS number FROM range(1, 211) g(k), (SELECT DISTINCT result AS r FROM mv))"]
    for n in range(1, depth + 1):
        b = n - 1
        out += [*_picked(f"u{n}", f"s{b}", f"SELECT DISTINCT parent AS problem, action FROM mv WHERE parent IN (SELECT problem FROM s{b})"),
                f"h{n} AS (SELECT m.problem, m.result, s.route, s.seq, s.node, s.x, s.y, s.visits, u.route IS NOT NULL AS gone FROM mv m JOIN u{n}c e ON e.problem = m.parent AND e.route = m.action JOIN s{b} s ON s.problem = m.parent LEFT JOIN u{n} u ON u.problem = m.parent AND u.action = m.action AND u.route = s.route)",
                f"l{n} AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY node) AS number FROM h{n} WHERE gone)",
                f"a{n} AS (SELECT problem, 0 AS side, route, seq, node, x, y, visits FROM h{n} WHERE NOT gone UNION ALL SELECT l.problem, 1, nr.part, nr.pos, l.node, l.x, l.y, l.visits + 1 FROM l{n} l JOIN nr ON nr.result = l.result AND nr.number = l.number)",
                f"s{n} AS (SELECT problem, {n} AS depth, dense_rank() OVER (PARTITION BY problem ORDER BY side, route) - 1 AS route, seq, node, x, y, visits FROM a{n})"]
    return tuple(out)


_R6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)

ORACLE: dict[str, str] = {
    "zone_histogram": _p(_C, _R, _M, "SELECT CAST(least(floor(least(r / greatest(radius, 1e-12), 1.0) * 10), 9) + 1 AS INTEGER) AS zone, count(*) AS n FROM m GROUP BY 1"),
    "min_max_scale": _p(f"SELECT id, {_R6('x', 'y')} FROM p"),
    "standard_scale": _q(_RAW, "z AS (SELECT avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy FROM raw) SELECT id, round((x - mx) / sx, 6) AS x, round((y - my) / sy, 6) AS y FROM raw, z"),
    "block_scale": _q(_RAW, "z AS (SELECT least(min(x), min(y)) lo, greatest(max(x), max(y)) hi FROM raw) SELECT id, round(0.25 + (x - lo) / (hi - lo) * 0.25, 6) AS x, round(0.25 + (y - lo) / (hi - lo) * 0.25, 6) AS y FROM raw, z"),
    "guarded_log": _p("SELECT id, round(ln(x + 1e-15), 6) AS log_x FROM p"),
    "softmax_by_label": _p(_C, _R, "SELECT id, round(exp(-(r - min(r) OVER l) / 0.5) / sum(exp(-(r - lo) / 0.5)) OVER l, 6) AS p FROM (SELECT *, min(r) OVER (PARTITION BY label) AS lo FROM r) WINDOW l AS (PARTITION BY label)"),
    "knn_graph": _p(_D, _KNN, "SELECT i, rank, j, round(d, 6) AS d FROM k"),
    "inverse_edges": _p(_D, _KNN, "SELECT k.i, k.rank, k.j, CAST(coalesce(k.j * 5 + v.rank - 1, -1) AS BIGINT) AS inv_pos FROM k LEFT JOIN k v ON v.i = k.j AND v.j = k.i"),
    "gap_adjacency": _p(_D, _KNN, _E, "SELECT i, j, round(w, 6) AS w FROM e"),
    "k_farthest": _p(_D, "h AS (SELECT * FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d DESC, j) AS n FROM d WHERE i <> j) WHERE n <= 3 AND d >= 0.5) SELECT i, j, round(max(d), 6) AS w FROM (SELECT i, j, d FROM h UNION ALL SELECT j, i, d FROM h) GROUP BY i, j"),
    "range_counts": _p(_D, "SELECT i AS id, count(*) AS n FROM d WHERE d <= 0.1 GROUP BY i"),
    "own_range_counts": _p(_D, "SELECT i AS id, count(*) AS n FROM d JOIN p ON p.id = i WHERE d <= 0.03 + 0.005 * label GROUP BY i"),
    "mutual_range_counts": _p(_D, "SELECT i AS id, count(*) AS n FROM d JOIN p a ON a.id = i JOIN p c ON c.id = j WHERE d <= least(0.03 + 0.005 * a.label, 0.03 + 0.005 * c.label) GROUP BY i"),
    "nearest_centre": _p(*_near(10), "SELECT a.id, a.centre, round(a.dc, 6) AS d1, round(s.dc, 6) AS d2 FROM near a JOIN near s ON s.id = a.id AND s.n = 2 WHERE a.n = 1"),
    "snapped_centroids": _p(_C, "SELECT CAST(label AS BIGINT) AS label, j, round(d, 6) AS d FROM (SELECT c.label, p.id AS j, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d, row_number() OVER (PARTITION BY c.label ORDER BY sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), p.id) AS n FROM c, p) WHERE n = 1"),
    "nearest_higher": _p(_D, _UP, "SELECT id AS i, higher AS j, round(delta, 6) AS d FROM up WHERE higher IS NOT NULL"),
    "centroids": _p(_C, f"SELECT label, {_R6('cx', 'cy')} FROM c"),
    "radius_all": _p(_C, _R, _M, "SELECT id, round(radius, 6) AS radius FROM m"),
    "radius_at_centre": _p(_C, _R, _M, "SELECT id, round(CASE WHEN row_number() OVER (PARTITION BY label ORDER BY r, id) = 1 THEN radius ELSE 0 END, 6) AS radius FROM m"),
    "size_density_diameter": _p(_D, _C, _R, _M, "f AS (SELECT label, t, avg(CASE WHEN r / radius <= t / 10.0 THEN 1.0 ELSE 0.0 END) AS share FROM m, range(1, 11) g(t) GROUP BY label, t), "
        "di AS (SELECT a.label, max(d) AS diameter FROM d JOIN p a ON a.id = i JOIN p c ON c.id = j WHERE a.label = c.label GROUP BY a.label) "
        "SELECT n.label, n.size, round(CASE WHEN n.size = 1 OR n.radius < 1e-12 THEN 1.0 ELSE s.density END, 6) AS density, round(diameter, 6) AS diameter FROM (SELECT label, count(*) AS size, max(radius) AS radius FROM m GROUP BY label) n JOIN (SELECT label, sum((11 - t) * share) / 55.0 AS density FROM f GROUP BY label) s ON s.label = n.label JOIN di ON di.label = n.label"),
    "zones": _p(_C, _R, _M, "SELECT id, CAST(least(floor(least(r / greatest(radius, 1e-12), 1.0) * 10), 9) + 1 AS INTEGER) AS zone FROM m"),
    "true_zones": _p(_C, _R, _M, "SELECT id, CAST(least(greatest(ceil(least(r / greatest(radius, 1e-12), 1.0) * 10), 1), 10) AS INTEGER) AS zone FROM m"),
    "score_deciles": _p("SELECT id, CAST(CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 10) + 1, 10) ELSE 5 END AS INTEGER) AS decile FROM (SELECT *, min(x) OVER (PARTITION BY label) AS lo, max(x) OVER (PARTITION BY label) AS hi FROM p)"),
    "uniform_quantise": _p("SELECT id, round(arg_min(t / 18.0, (abs(x - t * (1.0 / 18.0)), t)), 6) AS level FROM p, range(0, 19) g(t) GROUP BY id"),
    "marked_points": _p("SELECT id, round(x, 6) AS x FROM p ORDER BY p.x DESC, id DESC LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) FROM p)"),
    "top_per_label": _p("SELECT label, CAST(n AS INTEGER) AS rank, id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY x DESC, id) AS n FROM p) WHERE n <= 5"),
    "duplicate_parts": "SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y, min(p_partkey) AS id, count(*) AS weight FROM part GROUP BY 1, 2",
    "smallest_gap": "SELECT round(min(v - o), 6) AS gap FROM (SELECT v, lag(v) OVER (ORDER BY v) AS o FROM (SELECT DISTINCT CAST(c_acctbal AS DOUBLE) AS v FROM customer)) WHERE v > o",
    "distance_quantiles": _p(_C, _R, "SELECT label, round(quantile_cont(r, 0.3), 6) AS q30, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.9), 6) AS q90 FROM r GROUP BY label"),
    "density_score": _p(_D, "z AS (SELECT sqrt(pow(greatest(max(x), max(y)) - least(min(x), min(y)), 2) * 2) / 2 AS f, count(*) AS n FROM p) SELECT i AS id, round(sum(CAST(d <= f / 4 AS INTEGER) + CAST(d <= f / 8 AS INTEGER) + CAST(d <= f / 16 AS INTEGER)) / max(n), 6) AS score FROM d, z GROUP BY i"),
    "projection_overlap": _p(_overlap(5, "o5"), "SELECT id, round(score, 6) AS score FROM o5"),
    "fringe_score": _p(_overlap(3, "oa"), _overlap(5, "ob"), _overlap(10, "oc"), "SELECT oa.id, round((oa.score + ob.score + oc.score) / 3, 6) AS score FROM oa JOIN ob ON ob.id = oa.id JOIN oc ON oc.id = oa.id"),
    "core_point_score": _p(*_near(10), "v AS (SELECT a.id, a.label, a.dc AS d1, s.dc - a.dc AS m FROM near a JOIN near s ON s.id = a.id AND s.n = 2 WHERE a.n = 1), z AS (SELECT label, quantile_cont(d1, 0.3) + 1e-8 AS core, coalesce(quantile_cont(m, 0.5) FILTER (WHERE m > 0), quantile_cont(d1, 0.5)) + 1e-8 AS scale FROM v GROUP BY label), "
        "f AS (SELECT id, 1 / (1 + exp(10 * (d1 / core - 1))) * (1 / (1 + exp(-5 * greatest(m, 0) / scale))) AS s FROM v JOIN z ON z.label = v.label) SELECT id, round((s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER () + 1e-8), 6) AS score FROM f"),
    "aspect_ratio": _p(_D, "SELECT round(max(d) / min(d), 6) AS aspect_ratio FROM d WHERE i <> j"),
    "contingency": _p(*_near(10), _PRED, "SELECT p AS pred, t AS true, n FROM w"),
    "cluster_accuracy": _p(*_near(10), _PRED, "dp(i, mask, best) AS (SELECT 0, 0, CAST(0 AS HUGEINT) UNION ALL SELECT i + 1, mask | (1 << t), max(best + coalesce(n, 0)) FROM dp CROSS JOIN range(0, 10) g(t) LEFT JOIN w ON w.p = i AND w.t = g.t WHERE i < 10 AND (mask & (1 << g.t)) = 0 GROUP BY 1, 2) SELECT round(max(best) / (SELECT count(*) FROM q), 6) AS accuracy FROM dp WHERE i = 10".replace("(1 << t)", "(1 << g.t)"), recursive=True),
    "nmi": _p(*_near(10), _PRED, "pa AS (SELECT p, sum(n) AS a FROM w GROUP BY p), ta AS (SELECT t, sum(n) AS c FROM w GROUP BY t), tt AS (SELECT sum(n) AS s FROM w) SELECT round((SELECT sum(n / s * ln(n * s / (a * c))) FROM w JOIN pa ON pa.p = w.p JOIN ta ON ta.t = w.t, tt) / (((SELECT sum(-a / s * ln(a / s)) FROM pa, tt) + (SELECT sum(-c / s * ln(c / s)) FROM ta, tt)) / 2), 6) AS nmi"),
    "ari": _p(*_near(10), _PRED, "z AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM w) AS s, (SELECT sum(a * (a - 1) / 2.0) FROM (SELECT sum(n) AS a FROM w GROUP BY p)) AS sa, (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT sum(n) AS c FROM w GROUP BY t)) AS sb, (SELECT sum(n) FROM w) AS t) SELECT round((s - sa * sb / (t * (t - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2.0)), 6) AS ari FROM z"),
    "roc_auc": _p(_POS, "SELECT round(sum(CASE WHEN a.score > c.score THEN 1.0 WHEN a.score = c.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc FROM s a JOIN s c ON a.pos AND NOT c.pos"),
    "average_precision": _p(_POS, "g AS (SELECT score, sum(CAST(pos AS INTEGER)) AS k, count(*) AS n FROM s GROUP BY score), u AS (SELECT k, sum(k) OVER o AS tp, sum(n) OVER o AS al FROM g WINDOW o AS (ORDER BY score DESC)) SELECT round(sum(k * tp / al) / sum(k), 6) AS average_precision FROM u"),
    "top_z": _p(_POS, "z AS (SELECT (SELECT sum(CAST(pos AS INTEGER)) FROM (SELECT pos FROM s ORDER BY score DESC, id DESC LIMIT 50)) AS hit, (SELECT sum(CAST(pos AS INTEGER)) FROM s) AS al) SELECT round(hit / 50.0, 6) AS precision, round(hit / al, 6) AS recall, round(2 * (hit / 50.0) * (hit / al) / (hit / 50.0 + hit / al), 6) AS f1 FROM z"),
    "zone_accuracy": _p(_C, _R, _M, "SELECT round(avg(CASE WHEN least(floor(least(r / greatest(radius, 1e-12), 1.0) * 10), 9) + 1 = least(greatest(ceil(least(r / greatest(radius, 1e-12), 1.0) * 10), 1), 10) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM m"),
    "class_weights": _p("SELECT label, round(CAST((SELECT count(*) FROM p) AS DOUBLE) / ((SELECT count(DISTINCT label) FROM p) * count(*)), 6) AS weight FROM p GROUP BY label"),
    "graph_volumes": _p(_D, _KNN, _E, _PART, "SELECT i, round(vol, 6) AS vol, round(g, 6) AS g FROM lv"),
    "cut_volumes": _p(_D, _KNN, _E, _PART, "SELECT pa AS a, pb AS b, round(sum(w), 6) AS cut FROM ep WHERE pa < pb GROUP BY pa, pb"),
    "partition_entropy": _p(_D, _KNN, _E, _PART, "SELECT round((SELECT sum(-g / total * log2(vol / total)) FROM pv, tot) + (SELECT sum(-lv.g / total * log2(lv.vol / pv.vol)) FROM lv JOIN l ON l.id = lv.i JOIN pv ON pv.part = l.part, tot), 6) AS entropy"),
    "point_level_entropy": _p(_D, _KNN, _E, _PART, "SELECT lv.i AS point_id, round(-lv.g / total * log2(lv.vol / pv.vol), 6) AS e1, round(-pv.g / total * log2(pv.vol / total), 6) AS e2 FROM lv JOIN l ON l.id = lv.i JOIN pv ON pv.part = l.part, tot"),
    "combine_deltas": _p(_D, _KNN, _E, _PART, "cu AS (SELECT pa, pb, sum(w) AS cut FROM ep WHERE pa < pb GROUP BY pa, pb) SELECT pa AS a, pb AS b, round(((a.vol - a.g) * log2((a.vol + c.vol) / a.vol) + (c.vol - c.g) * log2((a.vol + c.vol) / c.vol) - 2 * cut * log2(total / (a.vol + c.vol))) / total, 6) AS delta FROM cu JOIN pv a ON a.part = pa JOIN pv c ON c.part = pb, tot"),
    "dbscan": _dbscan("SELECT i, j FROM d WHERE d <= 0.04", 4),
    "adaptive_dbscan": _dbscan("SELECT i, j FROM d JOIN p a ON a.id = i JOIN p c ON c.id = j WHERE d <= least(0.06 - (1 - a.label / 10) * 0.03, 0.06 - (1 - c.label / 10) * 0.03)", 4),
    "variable_eps_dbscan": _q(*_BASE, _D, "nr AS (SELECT i, j FROM d JOIN p a ON a.id = i WHERE d <= 0.03 + 0.005 * a.label)", "co AS (SELECT i AS id FROM nr GROUP BY i HAVING count(*) >= 5)", "ce AS (SELECT i, j FROM nr WHERE i IN (SELECT id FROM co) AND j IN (SELECT id FROM co))",
        "rc(id, root) AS (SELECT id, id FROM co UNION SELECT ce.j, rc.root FROM rc JOIN ce ON ce.i = rc.id)", "rt AS (SELECT id, min(root) AS root FROM rc GROUP BY id)", "bo AS (SELECT nr.j AS id, min(rt.root) AS root FROM nr JOIN rt ON rt.id = nr.i WHERE nr.j NOT IN (SELECT id FROM co) AND (rt.root < nr.j OR rt.root = nr.i) GROUP BY nr.j)",
        "al AS (SELECT * FROM rt UNION ALL SELECT * FROM bo)", "nu AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS n FROM (SELECT DISTINCT root FROM rt))", "SELECT p.id, CAST(coalesce(n, -1) AS INTEGER) AS cluster FROM p LEFT JOIN al ON al.id = p.id LEFT JOIN nu ON nu.root = al.root", recursive=True),
    "density_peaks": _p(_D, _UP, "od AS (SELECT list(coalesce(delta, 1e18) ORDER BY coalesce(delta, 1e18)) AS l, (1 - 5.0 / count(*)) * (count(*) - 1) AS pos FROM up), th AS (SELECT l[CAST(floor(pos) AS BIGINT) + 1] + (pos - floor(pos)) * (l[CAST(floor(pos) AS BIGINT) + 2] - l[CAST(floor(pos) AS BIGINT) + 1]) AS t FROM od), ce AS (SELECT id FROM up, th WHERE coalesce(delta, 1e18) > t), tr(id, root) AS (SELECT id, id FROM ce UNION ALL SELECT up.id, tr.root FROM tr JOIN up ON up.higher = tr.id WHERE up.id NOT IN (SELECT id FROM ce)), nu AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM ce) SELECT up.id, up.rho, CAST(coalesce(n, -1) AS INTEGER) AS cluster FROM up LEFT JOIN tr ON tr.id = up.id LEFT JOIN nu ON nu.id = tr.root", recursive=True),
    "k_center_greedy": _greedy("SELECT id, x, y FROM p", 5, "SELECT CAST(s AS INTEGER) AS step, id, (SELECT round(max(d), 6) FROM g WHERE step = 4) AS radius FROM (SELECT 0 AS s, min(id) AS id FROM t UNION ALL SELECT step + 1, arg_max(id, (d, -id)) FROM g WHERE step < 4 GROUP BY step)"),
    "top_score_farthest": _greedy("SELECT id, x, y FROM p ORDER BY p.x DESC, id DESC LIMIT 15", 5, "SELECT CAST(s AS INTEGER) AS step, id FROM (SELECT 0 AS s, min(id) AS id FROM t UNION ALL SELECT step + 1, arg_max(id, (d, -id)) FROM g WHERE step < 4 GROUP BY step)"),
    "coverage": _q(*_BASE, "g(step, id, x, y, r, cluster) AS (SELECT 0, id, x, y, 0.1 + x / 10, -1 FROM p UNION ALL SELECT step + 1, id, x, y, r, CASE WHEN cluster = -1 AND free AND (x - fx) * (x - fx) + (y - fy) * (y - fy) <= fr * fr THEN step ELSE cluster END FROM (SELECT *, first_value(x) OVER o AS fx, first_value(y) OVER o AS fy, first_value(r) OVER o AS fr, first_value(cluster) OVER o = -1 AS free FROM g WHERE step < 4 WINDOW o AS (ORDER BY CASE WHEN cluster = -1 THEN 0 ELSE 1 END, r DESC, id)))", "SELECT id, cluster FROM g WHERE step = 4", recursive=True),
    "k_medoids": _medoids(10),
    "knn_64d": _q(_V, _DV, "SELECT i, j, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d WHERE i <> j) WHERE rank <= 5"),
    "range_counts_64d": _q(_V, _DV, "SELECT i AS id, count(*) AS n FROM d WHERE d <= 1.25 GROUP BY i"),
    "nearest_centre_64d": _q(_V, _DV, "t AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS c FROM (SELECT id FROM v ORDER BY id LIMIT 10))", "o AS (SELECT i AS id, c, d, row_number() OVER (PARTITION BY i ORDER BY d, c) AS n FROM d JOIN t ON t.id = d.j)", "SELECT a.id, a.c AS centre, round(a.d, 6) AS d1, round(b.d, 6) AS d2 FROM o a JOIN o b ON b.id = a.id AND b.n = 2 WHERE a.n = 1"),
    "coreset_64d": _coreset(12, 50),
    "swap_costs_pairs": _q(_PLACES, "t AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS c, x, y FROM (SELECT * FROM pl ORDER BY id LIMIT 4))", "n AS (SELECT a.c AS a, b.c AS b, t.x, t.y FROM t a JOIN t b ON b.c > a.c JOIN t ON t.c <> a.c AND t.c <> b.c UNION ALL SELECT a.c, b.c, m.x, m.y FROM t a JOIN t b ON b.c > a.c, (VALUES (0.5, 0.5), (0.25, 0.75)) m(x, y))",
        "SELECT a, b, round(sum(w * m), 6) AS cost FROM (SELECT n.a, n.b, pl.id, pl.w, min((pl.x - n.x) * (pl.x - n.x) + (pl.y - n.y) * (pl.y - n.y)) AS m FROM pl, n GROUP BY n.a, n.b, pl.id, pl.w) GROUP BY a, b"),
    "ranking_grid": _p("s AS (SELECT c AS cell, id, label = 0 AS pos, floor(x * 5 * c) AS score FROM p, (VALUES (1), (2), (3), (4)) g(c))", "o AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY score DESC, id DESC) AS k FROM s)", "a AS (SELECT cell, sum(CASE WHEN pos AND k <= 50 THEN 1 ELSE 0 END) AS hit, sum(CASE WHEN pos THEN 1 ELSE 0 END) AS np, sum(CASE WHEN pos THEN 0 ELSE 1 END) AS nn FROM o GROUP BY cell)",
        "g AS (SELECT cell, score, sum(CASE WHEN pos THEN 1 ELSE 0 END) AS p, count(*) AS n FROM s GROUP BY cell, score)", "h AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (PARTITION BY cell ORDER BY score DESC ROWS UNBOUNDED PRECEDING))", "ap AS (SELECT cell, sum(p * tp / seen) AS ap FROM h GROUP BY cell)", "u AS (SELECT a.cell, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS wins FROM s a JOIN s b ON a.cell = b.cell AND a.pos AND NOT b.pos GROUP BY a.cell)",
        "SELECT CAST(a.cell AS INTEGER) AS cell, round(hit / 50.0, 6) AS precision, round(hit / np, 6) AS recall, round(CASE WHEN hit > 0 THEN 2 * (hit / 50.0) * (hit / np) / (hit / 50.0 + hit / np) ELSE 0 END, 6) AS f1, round(wins / (np * nn), 6) AS auc, round(ap / np, 6) AS average_precision FROM a JOIN ap ON ap.cell = a.cell JOIN u ON u.cell = a.cell"),
    "lloyd": _p(*_lloyd(2), "SELECT c AS centre, round(x, 6) AS x, round(y, 6) AS y FROM c2"),
    "k_means_cost": _p(*_near(10), "SELECT round(sum(dc * dc), 6) AS cost FROM near WHERE n = 1"),
    "swap_costs": _p(*_near(4), "SELECT o.centre AS out, round(sum(least(CASE WHEN a.centre = o.centre THEN s.dc * s.dc ELSE a.dc * a.dc END, (a.x - 0.5) * (a.x - 0.5) + (a.y - 0.5) * (a.y - 0.5))), 6) AS cost FROM near a JOIN near s ON s.id = a.id AND s.n = 2, ten o WHERE a.n = 1 GROUP BY o.centre"),
    "route_distances": _p(_STOPS, "SELECT route, round(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py)) + CASE WHEN last THEN sqrt(x * x + y * y) ELSE 0 END), 6) AS distance FROM (SELECT *, lag(x, 1, 0.0) OVER o AS px, lag(y, 1, 0.0) OVER o AS py, lead(seq) OVER o IS NULL AS last FROM s WINDOW o AS (PARTITION BY route ORDER BY seq)) GROUP BY route"),
    "route_features": _p(_STOPS, "di AS (SELECT route, sum(sqrt((x - px) * (x - px) + (y - py) * (y - py)) + CASE WHEN last THEN sqrt(x * x + y * y) ELSE 0 END) AS distance FROM (SELECT *, lag(x, 1, 0.0) OVER o AS px, lag(y, 1, 0.0) OVER o AS py, lead(seq) OVER o IS NULL AS last FROM s WINDOW o AS (PARTITION BY route ORDER BY seq)) GROUP BY route) "
        "SELECT s.route, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y, round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(count(*) / 100.0, 6) AS size, round(sum(demand) / 100.0, 6) AS load, round(any_value(distance), 6) AS distance FROM s JOIN di ON di.route = s.route GROUP BY s.route"),
    "subproblem_features": _p(_STOPS, "f AS (SELECT s.*, sqrt(x * x + y * y) AS dd, sqrt((x - avg(x) OVER r) * (x - avg(x) OVER r) + (y - avg(y) OVER r) * (y - avg(y) OVER r)) AS dc FROM s WINDOW r AS (PARTITION BY route)) "
        "SELECT route, count(*) AS size, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(stddev_pop(x), 6) AS std_x, round(stddev_pop(y), 6) AS std_y, round(max(x), 6) AS max_x, round(max(y), 6) AS max_y, round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(avg(dd), 6) AS depot_mean, round(stddev_pop(dd), 6) AS depot_std, round(avg(demand), 6) AS demand_mean, round(stddev_pop(demand), 6) AS demand_std, "
        + ", ".join(f"round(quantile_cont({c}, {n / 10}), 6) AS {p}_d{n}" for p, c in (("depot", "dd"), ("centre", "dc")) for n in (0, 5, 10)) + " FROM f GROUP BY route"),
    "route_neighbors": _p(_C, "SELECT route, other, CAST(row_number() OVER (PARTITION BY route ORDER BY d, other) - 1 AS INTEGER) AS rank FROM (SELECT a.label AS route, o.label AS other, sqrt((a.cx - o.cx) * (a.cx - o.cx) + (a.cy - o.cy) * (a.cy - o.cy)) AS d FROM c a, c o)"),
    "route_clusters": _p(_C, "z AS (SELECT label, count(*) AS n FROM p GROUP BY label), w AS (SELECT a.label AS route, o.label AS other, z.n, sqrt((a.cx - o.cx) * (a.cx - o.cx) + (a.cy - o.cy) * (a.cy - o.cy)) AS d FROM c a, c o JOIN z ON z.label = o.label) SELECT route, other FROM (SELECT route, other, sum(n) OVER (PARTITION BY route ORDER BY d, other ROWS UNBOUNDED PRECEDING) AS held FROM w) WHERE held <= 200"),
    "angular_split": _p("SELECT id, label AS problem, CAST(ntile(4) OVER (PARTITION BY label ORDER BY CASE WHEN atan2(x, y) < 0 THEN atan2(x, y) + 2 * pi() ELSE atan2(x, y) END, id) - 1 AS INTEGER) AS part FROM p"),
    "capacity_split": _p(_STOPS, "o AS (SELECT route, seq, demand, row_number() OVER (PARTITION BY route ORDER BY seq) AS n FROM s)", _SPLIT, "SELECT route AS problem, seq, CAST(part AS INTEGER) AS route FROM f", recursive=True),
    "packed_routes": _p(_STOPS, "o AS (SELECT route, seq, demand, row_number() OVER (PARTITION BY route ORDER BY seq) AS n FROM s)", _SPLIT, "SELECT problem, string_agg(nodes || ',0', ',' ORDER BY part) AS packed FROM (SELECT route AS problem, part, string_agg(CAST(seq + 1 AS VARCHAR), ',' ORDER BY seq) AS nodes FROM f GROUP BY route, part) GROUP BY problem", recursive=True),
    "cyclic_neighbors": _p(_STOPS, "SELECT route, node, coalesce(lag(node) OVER o, last_value(node) OVER f) AS before, coalesce(lead(node) OVER o, first_value(node) OVER f) AS after FROM s WINDOW o AS (PARTITION BY route ORDER BY seq), f AS (PARTITION BY route ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "rotated_stops": _p(_STOPS, "SELECT node, round(x * cos(0.5) - y * sin(0.5), 6) AS x, round(-(x * sin(0.5) + y * cos(0.5)), 6) AS y FROM s"),
    "batch_ids": _p("SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 125) AS BIGINT) AS batch FROM p"),
    "swap_tuples": _p("l AS (SELECT DISTINCT label FROM p) SELECT a.label AS c1, b.label AS c2, c.label AS c3 FROM l a JOIN l b ON b.label > a.label JOIN l c ON c.label > b.label"),
    "edge_rank": _p(_D, _KNN, "SELECT round(avg(n), 6) AS mean_rank FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY 1 - d DESC, j) AS n FROM k) WHERE (i + j) % 3 = 0"),
    "city_block_routes": _p("c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(x) AS w0, avg(x + y) AS w1 FROM p GROUP BY label)", "SELECT route, other, CAST(row_number() OVER (PARTITION BY route ORDER BY d, other) - 1 AS INTEGER) AS rank FROM (SELECT a.label AS route, o.label AS other, sqrt((a.cx - o.cx) * (a.cx - o.cx) + (a.cy - o.cy) * (a.cy - o.cy)) + 0.5 * (abs(a.w0 - o.w0) + abs(a.w1 - o.w1)) AS d FROM c a, c o)"),
    "node_features": _p("z AS (SELECT label, min(id) AS depot FROM p GROUP BY label)", "SELECT p.label AS problem, CASE WHEN p.id = depot THEN 0 ELSE p.id + 1 END AS node, round(p.x - o.x, 6) AS f0, round(p.y - o.y, 6) AS f1, round((p.id % 5 + 1) / 20, 6) AS f2, round(p.x, 6) AS f3, round(p.x + 0.5, 6) AS f4, round(CAST(p.id % 3 AS DOUBLE), 6) AS f5 FROM p JOIN z ON z.label = p.label JOIN p o ON o.id = depot"),
    "padded_routes": _p(_STOPS, "o AS (SELECT route, seq, demand, row_number() OVER (PARTITION BY route ORDER BY seq) AS n FROM s)", _SPLIT, "g AS (SELECT route AS problem, part, list(seq ORDER BY seq) AS v FROM f GROUP BY route, part), m AS (SELECT max(len(v)) AS most FROM g) SELECT problem, CAST(part AS INTEGER) AS route, array_to_string(list_resize(v, most, 0), ',') AS nodes FROM g, m", recursive=True),
    "beam_top": _p("SELECT id, round(x, 6) AS cost FROM (SELECT * FROM p ORDER BY p.x, id LIMIT 3)"),
    "search_replay": "WITH RECURSIVE m AS (SELECT CAST(floor(o_orderkey / 3) AS BIGINT) AS p, CAST(o_orderkey % 3 AS BIGINT) AS a, CAST(o_orderkey AS BIGINT) AS n FROM orders WHERE o_orderkey > 0), t(problem, parent, action, depth) AS (SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), 0 UNION ALL SELECT n, p, a, depth + 1 FROM t JOIN m ON m.p = t.problem WHERE depth < 4) SELECT * FROM t",
    "replayed_routes": _p(*_replayed(3), " UNION ALL ".join(f"SELECT problem, depth, CAST(route AS BIGINT) AS route, seq, node, visits FROM s{n}" for n in range(4))),
    "replayed_labels": _p(*_replayed(2), "st AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2)", *_picked("z", "st", "SELECT DISTINCT parent AS problem, action FROM mv"),
        "lg AS (SELECT problem, route, sum(sqrt((x - px) * (x - px) + (y - py) * (y - py)) + CASE WHEN last THEN sqrt(x * x + y * y) ELSE 0 END) AS d FROM (SELECT *, lag(x, 1, 0.0) OVER w AS px, lag(y, 1, 0.0) OVER w AS py, lead(seq) OVER w IS NULL AS last FROM st WINDOW w AS (PARTITION BY problem, route ORDER BY seq)) GROUP BY problem, route)",
        "be AS (SELECT z.problem, z.action, sum(d) AS d FROM z JOIN lg ON lg.problem = z.problem AND lg.route = z.route GROUP BY z.problem, z.action)", "af AS (SELECT result, CAST(max(problem) AS DOUBLE) AS d FROM mv GROUP BY result)",
        "SELECT mv.parent AS problem, mv.action, mv.result, round(af.d - be.d, 6) AS label, mv.action = min(mv.action) OVER (PARTITION BY mv.parent, mv.result) AS is_first FROM mv JOIN be ON be.problem = mv.parent AND be.action = mv.action JOIN af ON af.result = mv.result"),
    "sampled_clusters": _p(_FIRST, *_picked("z", "s0", "SELECT DISTINCT problem, route AS action FROM s0", f"sqrt((c.cx - o.cx) * (c.cx - o.cx) + (c.cy - o.cy) * (c.cy - o.cy)) / 0.1 + ln(greatest(-ln({_draw('c.problem, q.action, c.route', 1)}), 1e-300))"), "SELECT action, route, CAST(k AS INTEGER) AS rank FROM z"),
    "action_labels": "WITH o AS (SELECT o_orderkey AS seq, o_custkey % 50 AS problem, o_orderkey % 7 AS action, o_orderkey % 11 AS result, CAST(o_totalprice AS DOUBLE) AS price FROM orders), r AS (SELECT result, min(price) AS f FROM o GROUP BY result), b AS (SELECT problem, action, max(price) AS g, arg_max(result, seq) AS result FROM o GROUP BY problem, action) SELECT problem, action, result, round(f - g, 6) AS label, action = min(action) OVER (PARTITION BY problem, result) AS is_first FROM b JOIN r USING (result)",
    "trial_comparison": "WITH o AS (SELECT o_orderkey % 120 + 1 AS trial, CAST(o_totalprice AS DOUBLE) AS v FROM orders), a AS (SELECT trial, avg(v) AS objective, sum(CAST(trial AS DOUBLE)) AS seconds FROM o GROUP BY trial), c AS (SELECT trial AS other_trial, avg(v * 0.5) AS other_objective, sum(trial * 2.0) + 5 AS other_seconds FROM o WHERE trial <= 60 GROUP BY trial), k AS (SELECT * FROM a WHERE trial IN (1, 10, 100)), z AS (SELECT max(other_trial) AS most FROM c), "
        "y AS (SELECT 'trial' AS rule, k.*, least(trial, most) AS other_trial FROM k, z UNION ALL SELECT 'time', k.*, coalesce((SELECT min(other_trial) FROM c WHERE other_seconds >= k.seconds), most) FROM k, z) SELECT rule, trial, round(objective, 6) AS objective, round(seconds, 6) AS seconds, y.other_trial, round(other_objective, 6) AS other_objective, round(other_seconds, 6) AS other_seconds FROM y JOIN c ON c.other_trial = y.other_trial",
    "renumbered_tree": _p("t AS (SELECT id + 1000 AS node, CAST(label + 10 AS BIGINT) AS up, 0 AS h FROM p UNION ALL SELECT DISTINCT label + 10, 10000000, 1 FROM p UNION ALL SELECT 10000000, NULL, 2), n AS (SELECT *, row_number() OVER (ORDER BY h, node) - 1 AS k FROM t) SELECT CAST(0 AS BIGINT) AS graph_id, n.k AS node_id, coalesce(u.k, -1) AS parent_id, n.h AS height FROM n LEFT JOIN n u ON u.node = n.up"),
    "level_order": _p("SELECT CAST(0 AS BIGINT) AS graph_id, node AS node_id, level, row_number() OVER (ORDER BY level, up, node) - 1 AS pos FROM (SELECT CAST(10000000 AS BIGINT) AS node, 0 AS level, CAST(0 AS BIGINT) AS up UNION ALL SELECT DISTINCT CAST(label + 10 AS BIGINT), 1, 10000000 FROM p UNION ALL SELECT id + 1000, 2, label + 10 FROM p)"),
    "weighted_graph": _p(_D, _KNN, _E, "SELECT i, j, round(w * (label + 1), 6) AS w FROM e JOIN p ON p.id = e.i"),
    "block_graph": _p(_D, _KNN, _E, _PART, "SELECT CAST(pa AS BIGINT) AS graph_id, i, j, round(w, 6) AS w FROM ep WHERE pa = pb UNION ALL SELECT pa, i, i, round(sum(w), 6) FROM ep WHERE pa <> pb GROUP BY pa, i UNION ALL SELECT -1, pa, pb, round(sum(w), 6) FROM ep GROUP BY pa, pb"),
    "generated_tours": f"WITH r AS (SELECT CAST(floor(id / 51) AS BIGINT) AS sample, CAST(id % 51 AS INTEGER) AS i FROM range(0, 1020) t(id)) SELECT sample, i, round({_draw('sample, i', 2)}, 6) AS x, round({_draw('sample, i', 3)}, 6) AS y FROM r",
    "problem_files": _p(_STOPS, "f AS (SELECT row_number() OVER (PARTITION BY route ORDER BY seq) - 1 AS node, floor(x * 10000 + 0.5) AS x, floor(y * 10000 + 0.5) AS y, demand FROM s) SELECT 20 AS capacity, CAST(node AS INTEGER) AS node, count(*) AS n, sum(x) AS x, sum(y) AS y, CAST(sum(demand) AS BIGINT) AS demand FROM f GROUP BY node"),
    "window_problem_files": _p(_STOPS, "SELECT CAST(route AS INTEGER) AS label, CAST(row_number() OVER (PARTITION BY route ORDER BY seq) - 1 AS INTEGER) AS node, 'CVRPTW' AS type, 20 AS capacity, 2500.0::DOUBLE AS service_time, floor(x * 10000 + 0.5) AS x, floor(y * 10000 + 0.5) AS y, demand, floor(x * 10000 + 0.5) AS window_start, floor((x + y) * 10000 + 0.5) AS window_end FROM s"),
    "pickup_problem_files": _p(_STOPS, "SELECT CAST(route AS INTEGER) AS label, CAST(row_number() OVER (PARTITION BY route ORDER BY seq) - 1 AS INTEGER) AS node, 'VRPMPD' AS type, 20 AS capacity, floor(x * 10000 + 0.5) AS x, floor(y * 10000 + 0.5) AS y, demand, CAST(seq % 3 = 0 AS INTEGER) AS is_pickup FROM s"),
    "fringe_score_lloyd": _p(*_lloyd(5, 3, "ka"), *_lloyd(5, 5, "kb"), *_lloyd(5, 10, "kc"), _overlap(3, "oa", "ka5"), _overlap(5, "ob", "kb5"), _overlap(10, "oc", "kc5"), "SELECT oa.id, round((oa.score + ob.score + oc.score) / 3, 6) AS score FROM oa JOIN ob ON ob.id = oa.id JOIN oc ON oc.id = oa.id"),
    "true_zones_lloyd": _p(*_lloyd(5, 10), "q AS (SELECT id, c, r, max(r) OVER (PARTITION BY c) AS radius FROM (SELECT p.id, k.c, sqrt((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)) AS r, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)), c) AS n FROM p, c5 k) WHERE n = 1)", "SELECT id, c AS centre, CAST(least(greatest(ceil(least(r / greatest(radius, 1e-12), 1.0) * 10), 1), 10) AS INTEGER) AS zone FROM q"),
    "feature_table": _p(_D, "z AS (SELECT sqrt(pow(greatest(max(x), max(y)) - least(min(x), min(y)), 2) * 2) / 2 AS f, count(*) AS n FROM p), de AS (SELECT i AS id, sum(CAST(d <= f / 4 AS INTEGER) + CAST(d <= f / 8 AS INTEGER) + CAST(d <= f / 16 AS INTEGER)) / max(n) AS dense FROM d, z GROUP BY i)", _overlap(5, "o5"),
        "t AS (SELECT p.id, x, y, dense, o5.score AS overlap, 0.0 + dense + o5.score AS total FROM p JOIN de ON de.id = p.id JOIN o5 ON o5.id = p.id)", "u AS (SELECT *, (dense - min(dense) OVER ()) / (max(dense) OVER () - min(dense) OVER ()) AS s_dense, (overlap - min(overlap) OVER ()) / (max(overlap) OVER () - min(overlap) OVER ()) AS s_overlap, (total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()) AS s_total FROM t)",
        "v AS (SELECT *, ln(s_total + 1e-15) AS lt FROM u)", "w AS (SELECT u.id, arg_min(g.t / 18.0, (abs(s_total - g.t * (1.0 / 18.0)), g.t)) AS level FROM u, range(0, 19) g(t) GROUP BY u.id)",
        "SELECT v.id, round(x, 6) AS d_x, round(y, 6) AS d_y, round(dense, 6) AS dense, round(overlap, 6) AS overlap, round(total, 6) AS total, round(s_dense, 6) AS s_dense, round(s_overlap, 6) AS s_overlap, round(s_total, 6) AS s_total, round((lt - min(lt) OVER ()) / (max(lt) OVER () - min(lt) OVER ()), 6) AS log_total, round(2 * s_overlap, 6) AS twice, round(w.level, 6) AS level FROM v JOIN w ON w.id = v.id"),
    "weighted_sample": _p(f"SELECT id FROM (SELECT id, -ln({_draw('id', 1)}) / x AS k FROM p WHERE x > 0) ORDER BY k, id LIMIT 20"),
    "poisson_sample": _p(f"SELECT id FROM p WHERE {_draw('id', 1)} <= least(30 * x / (SELECT sum(x) FROM p), 1.0)"),
    "d2_seeding": _p(f"c0 AS (SELECT 0 AS c, x, y FROM p ORDER BY -ln({_draw('id', 1)}), id LIMIT 1)", *[f"c{n} AS (SELECT * FROM c{n - 1} UNION ALL (SELECT {n}, x, y FROM (SELECT p.id, p.x, p.y, min((p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y)) AS m FROM p, c{n - 1} k GROUP BY ALL) WHERE m > 0 ORDER BY -ln({_draw('id', 1 + n)}) / m, id LIMIT 1))" for n in range(1, 5)], "SELECT c AS centre, round(x, 6) AS x, round(y, 6) AS y FROM c4"),
}
