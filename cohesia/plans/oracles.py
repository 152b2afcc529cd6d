"""SQL for DuckDB beside the queries: each computes the index from its definition."""

from __future__ import annotations

from cohesia.functions.external import METHODS
from cohesia.plans.queries import LABEL_SET_METRICS, LARGE, PAIRS

#: point frames as (row_id, x as a list of doubles, label)
POINTS = {
    "embeddings": "SELECT vec_id AS row_id, embedding::DOUBLE[] AS x, label FROM embeddings",
    "part": "SELECT p_partkey AS row_id, [p_size::DOUBLE, p_retailprice::DOUBLE] AS x, dense_rank() OVER (ORDER BY p_brand) - 1 AS label FROM part",
    "supplier": "SELECT s_suppkey AS row_id, [s_acctbal::DOUBLE, s_nationkey::DOUBLE] AS x, n_regionkey AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "lineitem": "SELECT row_number() OVER () AS row_id, [l_quantity::DOUBLE, l_extendedprice::DOUBLE] AS x, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS label FROM lineitem",
    "customer": "SELECT c_custkey AS row_id, [c_acctbal::DOUBLE, c_nationkey::DOUBLE] AS x, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS label FROM customer",
}
DIMS = {"embeddings": 64, "part": 2, "supplier": 2, "lineitem": 2, "customer": 2}


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _scaled(name: str) -> str:
    """Distinct points of a plane frame, first by row_id, in [-1, 1]."""
    return f"""(WITH raw AS ({POINTS[name]}), one AS (SELECT min(row_id) AS row_id, arg_min(label, row_id) AS label, x FROM raw GROUP BY x),
      box AS (SELECT min(x[1]) AS a, max(x[1]) AS b, min(x[2]) AS c, max(x[2]) AS d FROM one)
      SELECT row_id, [(x[1] - a) / (b - a) * 2 - 1, (x[2] - c) / (d - c) * 2 - 1] AS x, label FROM one, box)"""


def _clusters(points: str, dim: int) -> str:
    """p, c (label, n, mu), g (big_n, k, mu_all), s (label, n, mu, msq, md, ssw, sd, sd_all), w (n, k, ssw, ssb, ...), pr (pairs)."""
    mean = "[" + ", ".join(f"avg(x[{i + 1}])" for i in range(dim)) + "]"
    return f"""WITH p AS ({points}),
    c AS (SELECT label, count(*) AS n, {mean} AS mu FROM p GROUP BY label),
    g AS (SELECT count(*) AS big_n, count(DISTINCT label) AS k, {mean} AS mu_all FROM p),
    q AS (SELECT p.label, {_d2("p.x", "c.mu")} AS d2, {_d2("p.x", "g.mu_all")} AS da FROM p JOIN c USING (label), g),
    s AS (SELECT label, any_value(c.n) AS n, any_value(c.mu) AS mu, sum(d2) AS ssw, sum(sqrt(d2)) AS sd, sum(sqrt(da)) AS sd_all, sum(d2) / any_value(c.n) AS msq, sum(sqrt(d2)) / any_value(c.n) AS md FROM q JOIN c USING (label) GROUP BY label),
    w AS (SELECT any_value(big_n) AS n, any_value(k) AS k, sum(ssw) AS ssw, sum(n * {_d2("mu", "mu_all")}) AS ssb, sum(sd) AS sd, sum(sd_all) AS sd_all, max(msq) AS max_msq, sum(msq) AS sum_msq, sum(md) AS sum_md FROM s, g),
    pr AS (SELECT a.label AS i, b.label AS j, a.n AS n_i, b.n AS n_j, a.ssw AS ssw_i, b.ssw AS ssw_j, a.msq AS msq_i, b.msq AS msq_j, a.md AS md_i, b.md AS md_j, {_d2("a.mu", "b.mu")} AS d2 FROM s a JOIN s b ON a.label <> b.label),
    e AS (SELECT min(d2) AS min_d2, max(sqrt(d2)) AS max_dc, min(sqrt(d2)) AS min_dc FROM pr)
    """


#: index -> SELECT over the tables of _clusters
LINEAR_SQL = {
    "ch": "(ssb / (k - 1)) / nullif(ssw / (n - k), 0) FROM w",
    "sse": "ssw FROM w",
    "bh": "ssw / k FROM w",
    "wb": "k * ssw / nullif(ssb, 0) FROM w",
    "rs": "1 - sum_msq / nullif((ssw + ssb) / n, 0) FROM w",
    "xb": "ssw / nullif(n * min_d2, 0) FROM w, e",
    "xb_star": "max_msq / nullif(min_d2, 0) FROM w, e",
    "gd43": "min_dc / nullif(2 * max_msq, 0) FROM w, e",
    "gd53": "(SELECT min((ssw_i + ssw_j) / (n_i + n_j)) FROM pr) / nullif(2 * max_msq, 0) FROM w",
    "i_index": "power(sd_all / nullif(sd, 0) / k * max_dc, 2) FROM w, e",
    "db": "avg(r) FROM (SELECT i, max((md_i + md_j) / nullif(sqrt(d2), 0)) AS r FROM pr GROUP BY i)",
    "np_silhouette": "avg((b - m) / nullif(greatest(b, m), 0)) FROM (SELECT p.row_id, p.label, min(sqrt({d})) AS b FROM p JOIN c ON p.label <> c.label GROUP BY p.row_id, p.label) JOIN (SELECT label, md AS m FROM s) USING (label)",
    "csil": "avg((b - a) / nullif(greatest(a, b), 0)) FROM (SELECT i, max(msq_i) AS a, min(msq_j + d2) AS b FROM pr GROUP BY i)",
    "h": "sum(a / nullif(b, 0)) FROM (SELECT i, max(msq_i) AS a, min(msq_i + d2) AS b FROM pr GROUP BY i)",
    "sf": "1 - exp(-exp(ssb / (n * k) - sum_md)) FROM w",
    "ps": "sum(n_i::DOUBLE / (SELECT max(n) FROM c) - exp(-d2 / nullif((SELECT avg({m}) FROM c, (SELECT {avg} AS mid FROM c)), 0))) FROM (SELECT i, any_value(n_i) AS n_i, min(d2) AS d2 FROM pr GROUP BY i)",
}


def _linear(name: str, points: str, dim: int, digits: int = 6) -> str:
    avg = "[" + ", ".join(f"avg(mu[{i + 1}])" for i in range(dim)) + "]"
    body = LINEAR_SQL[name].replace("{d}", _d2("p.x", "c.mu")).replace("{m}", _d2("mu", "mid")).replace("{avg}", avg)
    value, source = body.split(" FROM ", 1) if name not in ("gd53", "ps") else body.rsplit(" FROM ", 1) if name == "gd53" else (body[: body.index(" FROM (SELECT i,")], body[body.index("(SELECT i,") :])
    return f"{_clusters(points, dim)} SELECT round(({value})::DOUBLE, {digits}) AS value FROM {source}"


def _pairs(points: str) -> str:
    """p, c, pp (i, li, j, lj, d: all ordered pairs), sz (label, nk), pc (i, li, lj, n, s, lo, hi)."""
    return f"""WITH p AS ({points}), sz AS (SELECT label, count(*) AS nk FROM p GROUP BY label),
    pp AS MATERIALIZED (SELECT a.row_id AS i, a.label AS li, b.row_id AS j, b.label AS lj, sqrt({_d2("a.x", "b.x")}) AS d FROM p a JOIN p b ON a.row_id <> b.row_id),
    pc AS (SELECT i, li, lj, count(*) AS n, sum(d) AS s, min(d) AS lo, max(d) AS hi FROM pp GROUP BY i, li, lj)
    """


def _mean_list(dim: int) -> str:
    return "[" + ", ".join(f"avg(x[{i + 1}])" for i in range(dim)) + "]"


def _pairwise(dim: int) -> dict[str, str]:
    c = f", c AS (SELECT label, count(*) AS nk, {_mean_list(dim)} AS mu FROM p GROUP BY label), cc AS (SELECT a.label AS i, b.label AS j, sqrt({_d2('a.mu', 'b.mu')}) AS dc FROM c a JOIN c b ON a.label <> b.label)"
    mirror = "[" + ", ".join(f"2 * mu[{i + 1}] - x[{i + 1}]" for i in range(dim)) + "]"
    ps = c + f""", r AS (SELECT row_id, label, {mirror} AS y, sqrt({_d2("x", "mu")}) AS dm FROM p JOIN c USING (label)),
      rd AS (SELECT r.row_id, r.label, any_value(dm) AS dm, list_sort(list(sqrt({_d2("r.y", "p.x")}))) AS ds FROM r JOIN p ON r.label = p.label GROUP BY r.row_id, r.label),
      ps AS (SELECT row_id, label, dm * (ds[1] + ds[2]) / 2 AS ps FROM rd)"""
    inner = f"(SELECT label, count(*) AS n, avg(sqrt({_d2('x', 'mu')})) AS m FROM p JOIN c USING (label) GROUP BY label)"
    head = "(SELECT x AS hx, row_number() OVER (ORDER BY row_id) AS pos FROM p)"
    return {
        "silhouette": """, ab AS (SELECT i, max(CASE WHEN li = lj THEN s / n END) AS a, min(CASE WHEN li <> lj THEN s / n END) AS b FROM pc GROUP BY i)
          SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / nullif(greatest(a, b), 0) END), 6) AS value FROM ab""",
        "c_index": """, u AS (SELECT d, li = lj AS same FROM pp WHERE i < j), t AS (SELECT sum(CASE WHEN same THEN d END) AS sw, count(*) FILTER (same) AS nw FROM u),
          k AS (SELECT d, row_number() OVER (ORDER BY d) AS up, row_number() OVER (ORDER BY d DESC) AS down FROM u)
          SELECT round((any_value(sw) - sum(CASE WHEN up <= nw THEN d END)) / nullif(sum(CASE WHEN down <= nw THEN d END) - sum(CASE WHEN up <= nw THEN d END), 0), 6) AS value FROM k, t""",
        "cs": c + """, f AS (SELECT label, avg(hi) AS m FROM (SELECT i, li AS label, coalesce(max(CASE WHEN li = lj THEN hi END), 0) AS hi FROM pc GROUP BY i, li) GROUP BY label)
          SELECT round((SELECT sum(m) FROM f) / nullif((SELECT sum(dc) FROM (SELECT i, min(dc) AS dc FROM cc GROUP BY i)), 0), 6) AS value""",
        "dunn_paper": " SELECT round(min(CASE WHEN li <> lj THEN d END) / nullif(max(CASE WHEN li = lj THEN d END), 0), 6) AS value FROM pp",
        "dunn": c + f" SELECT round((SELECT min(sqrt({_d2('x', 'mu')})) FROM p JOIN c ON c.label < p.label) / nullif((SELECT max(d) FROM pp WHERE li = lj), 0), 6) AS value",
        "duda_hart": """, t AS (SELECT li, sum(CASE WHEN li = lj THEN s ELSE 0 END) / (any_value(nk) * any_value(nk)) AS a, sum(CASE WHEN li <> lj THEN s END) / sum(CASE WHEN li <> lj THEN n END) AS b FROM pc JOIN sz ON li = label GROUP BY li)
          SELECT round(sum(a) / nullif(sum(b), 0), 6) AS value FROM t""",
        "sym": ps + " SELECT round((SELECT max(dc) FROM cc) / nullif((SELECT count(*) FROM c) * (SELECT sum(ps) FROM ps), 0), 6) AS value",
        "sym_db": ps + ", a AS (SELECT label, avg(ps) AS s FROM ps GROUP BY label) SELECT round(sum((x.s + y.s) / nullif(dc, 0)) / (SELECT count(*) FROM c), 6) AS value FROM cc JOIN a x ON cc.i = x.label JOIN a y ON cc.j = y.label WHERE cc.i < cc.j",
        "sym33": ps + " SELECT round((SELECT min(d) FROM (SELECT sum(s) / sum(n) AS d FROM pc WHERE li < lj GROUP BY li, lj)) / nullif((SELECT max(m) FROM (SELECT 2 * avg(ps) AS m FROM ps GROUP BY label)), 0), 6) AS value",
        "cop": c + f", f AS (SELECT label, min(d) AS sep FROM (SELECT p.label, pos, max(sqrt({_d2('p.x', 'hx')})) AS d FROM p, {head} WHERE pos < (SELECT count(*) FROM c) GROUP BY p.label, pos) GROUP BY label) SELECT round(sum(n * m / nullif(sep, 0)) / sum(n), 6) AS value FROM {inner} JOIN f USING (label)",
        "cop_paper": c + f", f AS (SELECT lj AS label, min(hi) AS sep FROM pc WHERE li <> lj GROUP BY lj) SELECT round(sum(n * m / nullif(sep, 0)) / sum(n), 6) AS value FROM {inner} JOIN f USING (label)",
    }


_VIASCKDE = """, kd AS (SELECT i, ln(1 + sum(exp(-d * d / (2 * 0.05 * 0.05)))) AS den FROM pp GROUP BY i), nf AS (SELECT i, li, min(CASE WHEN li = lj THEN d END) AS a, min(CASE WHEN li <> lj THEN d END) AS b FROM pp GROUP BY i, li),
  m AS (SELECT nf.*, den, min(den) OVER (PARTITION BY li) AS lo, max(den) OVER (PARTITION BY li) AS hi FROM nf JOIN kd USING (i)),
  v AS (SELECT li, (b - a) / nullif(greatest(a, b), 0) * CASE WHEN hi > lo THEN (den - lo) / (hi - lo) ELSE 0 END AS one FROM m)
  """


def _margins(t: str, p: str, table: str) -> str:
    return f"""WITH ct AS (SELECT {t} AS t, {p} AS p, count(*) AS nij FROM {table} WHERE {t} IS NOT NULL AND {p} IS NOT NULL GROUP BY 1, 2),
    ra AS (SELECT t, sum(nij) AS ai FROM ct GROUP BY t), cb AS (SELECT p, sum(nij) AS bj FROM ct GROUP BY p), nn AS (SELECT sum(nij) AS n FROM ct)"""


_TWO = "({0} * ({0} - 1) / 2.0)"


def _ari_value(cells: str, a: str, b: str, n: str) -> str:
    e = f"coalesce(({a}) * ({b}) / nullif({_TWO.format(n)}, 0), 0)"
    bottom, top = f"((({a}) + ({b})) / 2 - {e})", f"(({cells}) - {e})"
    return f"CASE WHEN abs({bottom}) < 1e-10 THEN CASE WHEN abs({top}) < 1e-10 THEN 1.0 ELSE 0.0 END ELSE {top} / {bottom} END"


def _ari(table: str, t: str, p: str) -> str:
    return f"""{_margins(t, p, table)}, z AS (SELECT (SELECT sum({_TWO.format("nij")}) FROM ct) AS s, (SELECT sum({_TWO.format("ai")}) FROM ra) AS a, (SELECT sum({_TWO.format("bj")}) FROM cb) AS b, n FROM nn)
    SELECT round(({_ari_value("s", "a", "b", "n")})::DOUBLE, 6) AS value FROM z"""


_CLASSES = f""", best AS (SELECT t, arg_min(p, (-nij, p)) AS p FROM ct GROUP BY t),
    k AS (SELECT best.t, nij::DOUBLE AS nij, ai::DOUBLE AS ai, bj::DOUBLE AS bj, n::DOUBLE AS n FROM best JOIN ct USING (t, p) JOIN ra USING (t) JOIN cb USING (p), nn),
    sc AS (SELECT t, ai, {_ari_value(f"{_TWO.format('nij')} + {_TWO.format('(ai - nij)')} + {_TWO.format('(bj - nij)')} + {_TWO.format('(n - ai - bj + nij)')}", f"{_TWO.format('ai')} + {_TWO.format('(n - ai)')}", f"{_TWO.format('bj')} + {_TWO.format('(n - bj)')}", "n")} AS v FROM k)"""
_WEIGHTS = {"macro": "1.0", "weighted": "ai", "sqrt_weighted": "sqrt(ai)", "harmonic": "1.0 / ai"}


def _ami_body(ct: str) -> str:
    """The value for the table ct (t, p, nij)."""
    f = lambda e: f"lgamma(({e})::DOUBLE + 1)"
    return f"""(WITH ct AS ({ct}), ra AS (SELECT t, sum(nij)::DOUBLE AS ai FROM ct GROUP BY t), cb AS (SELECT p, sum(nij)::DOUBLE AS bj FROM ct GROUP BY p), nn AS (SELECT sum(nij)::DOUBLE AS n FROM ct),
      mi AS (SELECT sum(nij / n * ln(n * nij / (ai * bj))) AS mi FROM ct JOIN ra USING (t) JOIN cb USING (p), nn), ha AS (SELECT -sum(ai / n * ln(ai / n)) AS h FROM ra, nn), hb AS (SELECT -sum(bj / n * ln(bj / n)) AS h FROM cb, nn),
      x AS (SELECT ai, bj, n, unnest(range(greatest(1, ai + bj - n)::BIGINT, least(ai, bj)::BIGINT + 1)) AS m FROM ra, cb, nn),
      em AS (SELECT sum(m / n * ln(n * m / (ai * bj)) * exp({f("ai")} + {f("bj")} + {f("n - ai")} + {f("n - bj")} - {f("n")} - {f("m")} - {f("ai - m")} - {f("bj - m")} - {f("n - ai - bj + m")})) AS emi FROM x)
      SELECT CASE WHEN ha.h = 0 AND hb.h = 0 THEN 1.0 ELSE (mi - emi) / nullif((ha.h + hb.h) / 2 - emi, 0) END FROM mi, ha, hb, em)"""


def _closure(points: str) -> str:
    """p, m (medoids), bn (i, j, w: largest edge on the tree path, by seven squarings), tr (u, v, w: tree edges). For up to 128 points."""
    parts = [f"""WITH p AS ({points}), e0 AS MATERIALIZED (SELECT a.row_id AS i, b.row_id AS j, sqrt({_d2("a.x", "b.x")}) AS w FROM p a, p b)"""]
    for k in range(7):
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT a.i, b.j, min(greatest(a.w, b.w)) AS w FROM e{k} a JOIN e{k} b ON a.j = b.i GROUP BY a.i, b.j)")
    parts.append("bn AS (SELECT * FROM e7), tr AS (SELECT e0.i AS u, e0.j AS v, e0.w FROM e0 JOIN bn USING (i, j) WHERE e0.i < e0.j AND e0.w = bn.w)")
    parts.append(f"c AS (SELECT label, [avg(x[1]), avg(x[2])] AS mu FROM p GROUP BY label), m AS (SELECT label, arg_min(row_id, (round({_d2('x', 'mu')}, 12), row_id)) AS mid FROM p JOIN c USING (label) GROUP BY label)")
    parts.append("d AS (SELECT p.row_id, p.label, m.label AS o, bn.w AS d FROM p JOIN bn ON p.row_id = bn.i JOIN m ON bn.j = m.mid)")
    return ", ".join(parts)


def oracle_sql() -> dict[str, str]:
    emb, sup = POINTS["embeddings"], POINTS["supplier"]
    out: dict[str, str] = {}
    for name in LINEAR_SQL:
        out[name] = _linear(name, emb, 64)
        out[f"{name}_lineitem"] = _linear(name, POINTS["lineitem"], 2, LARGE.get(name, 4))
    out["imbalance_ratio"] = f"SELECT round(max(n)::DOUBLE / min(n), 6) AS value FROM (SELECT count(*) AS n FROM ({POINTS['lineitem']}) GROUP BY label)"
    for key, name in (("overlap_ratio", "embeddings"), ("overlap_ratio_lineitem", "lineitem")):
        near = f"(SELECT row_id, any_value(a) AS a, min(b) AS b FROM (SELECT p.row_id, sqrt({_d2('p.x', 'own.mu')}) AS a, sqrt({_d2('p.x', 'c.mu')}) AS b FROM p JOIN c own ON own.label = p.label JOIN c ON c.label <> p.label) GROUP BY row_id)"
        out[key] = f"{_clusters(POINTS[name], DIMS[name])} SELECT round(avg(CASE WHEN b <= 1.2 * a THEN 1.0 ELSE 0.0 END), 6) AS value FROM {near}"
    out |= {name: _pairs(emb) + sql for name, sql in _pairwise(64).items()}
    out["silhouette_customer"] = _pairs(POINTS["customer"]) + _pairwise(2)["silhouette"]
    out["viasckde"] = _pairs(_scaled("customer")) + _VIASCKDE + "SELECT round(CASE WHEN count(one) = count(*) THEN avg(one) END, 6) AS value FROM v"
    out["viasckde_cumulative"] = _pairs(_scaled("customer")) + _VIASCKDE + ", r AS (SELECT sum(s) OVER (ORDER BY li) AS rs, sum(n) OVER (ORDER BY li) AS rn FROM (SELECT li, sum(one) AS s, count(*) AS n FROM v GROUP BY li)) SELECT round(sum(rs) / sum(rn), 6) AS value FROM r"
    for name, (table, t, p) in PAIRS.items():
        out[f"ari_{name}"] = _ari(table, t, p)
        if name in ("labels", "documents"):
            out[f"ami_{name}"] = f"SELECT round({_ami_body(f'SELECT {t} AS t, {p} AS p, count(*) AS nij FROM {table} WHERE {t} IS NOT NULL AND {p} IS NOT NULL GROUP BY 1, 2')}, 6) AS value"
    docs = _margins("lang", "source", "documents")
    for m in METHODS:
        out[f"balanced_ari_{m}"] = f"{docs}{_CLASSES} SELECT round(CASE WHEN count(*) = 1 THEN 1.0 ELSE sum(v * {_WEIGHTS[m]}) / sum({_WEIGHTS[m]}) END, 6) AS value FROM sc"
    out["minmax_balanced"] = f"{docs}{_CLASSES} SELECT round(0.5 * avg(v) + 0.5 * min(v), 6) AS value FROM sc WHERE ai >= 2"
    pair = f"""{docs}, pq AS (SELECT x.t AS a, y.t AS b FROM ra x JOIN ra y ON x.t <= y.t), cl AS (SELECT a, b, t, p, nij FROM ct JOIN pq ON t = a OR t = b),
      z AS (SELECT a, b, sum(nij) AS n, sum({_TWO.format("nij")}) AS s FROM cl GROUP BY a, b), za AS (SELECT a, b, sum({_TWO.format("q")}) AS sa FROM (SELECT a, b, t, sum(nij) AS q FROM cl GROUP BY a, b, t) GROUP BY a, b),
      zb AS (SELECT a, b, sum({_TWO.format("q")}) AS sb FROM (SELECT a, b, p, sum(nij) AS q FROM cl GROUP BY a, b, p) GROUP BY a, b), y AS (SELECT a, b, ({_ari_value("s", "sa", "sb", "n")})::DOUBLE AS v FROM z JOIN za USING (a, b) JOIN zb USING (a, b) WHERE n >= 2)"""
    out["pairwise_classes_all"] = pair + " SELECT round(avg(v), 6) AS value FROM y"
    out["pairwise_classes_within"] = pair + " SELECT round((coalesce(avg(v) FILTER (a = b), 0) + coalesce(avg(v) FILTER (a < b), 0)) / 2, 6) AS value FROM y"
    # prepared frames
    out["dedup_points"] = f"SELECT min(row_id) AS row_id, x[1] AS x0, x[2] AS x1, arg_min(label, row_id)::BIGINT AS label FROM ({POINTS['part']}) GROUP BY x"
    out["reencode_labels"] = "SELECT p_partkey AS row_id, dense_rank() OVER (ORDER BY p_size) - 1 AS label FROM part"
    out["minmax_scale"] = f"WITH p AS ({POINTS['part']}), b AS (SELECT min(x[1]) AS a, max(x[1]) AS b, min(x[2]) AS c, max(x[2]) AS d FROM p) SELECT row_id, round((x[1] - a) / (b - a) * 2 - 1, 6) AS x0, round((x[2] - c) / (d - c) * 2 - 1, 6) AS x1 FROM p, b"
    sides = """SELECT 'dfl' AS labelset, row_id, CASE WHEN y > (d - c) / (b - a) * x + (c - (d - c) / (b - a) * a) THEN 1 ELSE 0 END AS label FROM q UNION ALL
      SELECT 'dsl', row_id, CASE WHEN y > (c - d) / (b - a) * x + (d - (c - d) / (b - a) * a) THEN 1 ELSE 0 END FROM q UNION ALL
      SELECT 'vl', row_id, CASE WHEN x < (a + b) / 2 THEN 1 ELSE 0 END FROM q UNION ALL SELECT 'hl', row_id, CASE WHEN y < (c + d) / 2 THEN 1 ELSE 0 END FROM q"""
    box = "b AS (SELECT min(x[1]) AS a, max(x[1]) AS b, min(x[2]) AS c, max(x[2]) AS d FROM p), q AS (SELECT row_id, x[1] AS x, x[2] AS y, a, b, c, d FROM p, b)"
    out["label_sets_lines"] = f"WITH p AS ({POINTS['part']}), {box} SELECT labelset, label::BIGINT AS label, count(*) AS n, sum(row_id)::BIGINT AS ids FROM ({sides}) GROUP BY 1, 2"
    out["label_sets_midpoint"] = f"WITH p AS ({POINTS['part']}), {box} SELECT 'hl' AS labelset, row_id, CASE WHEN y > (c + d) / 2 THEN 1 ELSE 0 END::BIGINT AS label FROM q UNION ALL SELECT 'vl', row_id, CASE WHEN x > (a + b) / 2 THEN 1 ELSE 0 END::BIGINT FROM q"
    out["singleton_noise"] = "SELECT s_suppkey AS row_id, CASE WHEN count(*) OVER (PARTITION BY floor(s_acctbal / 50)) = 1 THEN -1 ELSE floor(s_acctbal / 50)::BIGINT END::BIGINT AS label FROM supplier"
    out["cluster_moments"] = f"SELECT label::BIGINT AS label, count(*) AS n, round(avg(x[1]), 8) AS mean0, round(avg(x[2]), 8) AS mean1, round(covar_samp(x[1], x[1]), 4) AS var0, round(covar_samp(x[1], x[2]), 4) AS cov01, round(covar_samp(x[2], x[2]), 4) AS var1 FROM ({POINTS['part']}) GROUP BY label"
    out["centroid_table"] = f"SELECT label::BIGINT AS label, n, i AS dim, round(mu[i + 1], 6) AS mean FROM (SELECT label, count(*) AS n, {_mean_list(64)} AS mu FROM ({emb}) GROUP BY label), range(64) AS r(i)"
    out["medoid_table"] = f"WITH p AS ({emb}), c AS (SELECT label, {_mean_list(64)} AS mu FROM p GROUP BY label) SELECT label::BIGINT AS label, arg_min(row_id, (round({_d2('x', 'mu')}, 12), row_id)) AS medoid_id FROM p JOIN c USING (label) GROUP BY label"
    out["contingency"] = "SELECT lang AS t, source AS p, count(*) AS nij FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2"
    out["majority"] = f"SELECT t, arg_min(p, (-nij, p)) AS best FROM ({out['contingency']}) GROUP BY t"
    # score tables over label sets: cluster moments of all label sets once, then every metric from them
    up = {"ch": True, "db": False, "sse": False, "xb": False, "wb": False, "bh": False, "rs": True}
    formulas = {
        "ch": "(ssb / nullif(k - 1, 0)) / nullif(ssw / nullif(n - k, 0), 0)", "db": "db", "sse": "ssw", "xb": "ssw / nullif(n * md, 0)", "wb": "k * ssw / nullif(ssb, 0)", "bh": "ssw / k",
        "rs": "1 - sm / nullif((ssw + ssb) / n, 0)",
    }
    scores = f"""WITH p AS MATERIALIZED ({_scaled('part')}), {box}, sides AS MATERIALIZED ({sides}),
      ls AS MATERIALIZED (SELECT 'gt' AS labelset, row_id, x, label FROM p UNION ALL SELECT sides.labelset, row_id, p.x, sides.label FROM p JOIN sides USING (row_id)),
      c AS MATERIALIZED (SELECT labelset, label, count(*) AS n, [avg(x[1]), avg(x[2])] AS mu FROM ls GROUP BY 1, 2),
      s AS MATERIALIZED (SELECT labelset, label, any_value(n) AS n, any_value(mu) AS mu, sum({_d2('x', 'mu')}) AS ssw, sum(sqrt({_d2('x', 'mu')})) / any_value(n) AS sc FROM ls JOIN c USING (labelset, label) GROUP BY 1, 2),
      g AS (SELECT labelset, sum(n) AS n, count(*) AS k, [sum(mu[1] * n) / sum(n), sum(mu[2] * n) / sum(n)] AS mid, sum(ssw) AS ssw, sum(ssw / n) AS sm FROM s GROUP BY 1),
      bt AS (SELECT labelset, sum(s.n * {_d2('s.mu', 'g.mid')}) AS ssb FROM s JOIN g USING (labelset) GROUP BY 1),
      pr AS (SELECT a.labelset, a.label, {_d2('a.mu', 'b.mu')} AS d2, (a.sc + b.sc) / nullif(sqrt({_d2('a.mu', 'b.mu')}), 0) AS r FROM s a JOIN s b ON a.labelset = b.labelset AND a.label <> b.label),
      far AS (SELECT labelset, min(d2) AS md FROM pr GROUP BY 1), ds AS (SELECT labelset, avg(r) AS db FROM (SELECT labelset, label, max(r) AS r FROM pr GROUP BY 1, 2) GROUP BY 1),
      m AS MATERIALIZED (SELECT * FROM g JOIN bt USING (labelset) LEFT JOIN far USING (labelset) LEFT JOIN ds USING (labelset)),
      v AS MATERIALIZED ({' UNION ALL '.join(f"SELECT labelset, '{m}' AS metric, {up[m]} AS higher, ({formulas[m]})::DOUBLE AS value FROM m" for m in LABEL_SET_METRICS)})"""
    out["score_table"] = scores + " SELECT labelset, metric, round(value, 6) AS value FROM v"
    flagged = """, f AS (SELECT v.labelset, v.metric, v.higher, round_even(v.value, 3) AS value,
      v.labelset <> 'gt' AND CASE WHEN v.higher THEN round_even(v.value, 3) > round_even(g.value, 3) ELSE round_even(v.value, 3) < round_even(g.value, 3) END AS flagged
      FROM v JOIN v g ON v.metric = g.metric AND g.labelset = 'gt')"""
    out["flagged_metrics"] = scores + flagged + " SELECT labelset, metric, value, flagged FROM f"
    cells = ", ".join(f"max(cell) FILTER (labelset = '{c}') AS {c}" for c in ("gt", "dfl", "dsl", "vl", "hl"))
    out["score_report"] = scores + flagged + f" SELECT metric || CASE WHEN higher THEN ' (↑)' ELSE ' (↓)' END AS name, {cells} FROM (SELECT *, printf('%.3f', value) || CASE WHEN flagged THEN '*' ELSE '' END AS cell FROM f) GROUP BY 1"
    # trees
    cl = _closure(sup)
    out["mst_edges"] = cl + " SELECT u, v, round(w, 6) AS w FROM tr"
    out["bottleneck_to_medoid"] = cl + " SELECT bn.i AS row_id, bn.j AS target, round(bn.w, 6) AS d FROM bn JOIN m ON bn.j = m.mid"
    ab = "(SELECT row_id, label, max(CASE WHEN o = label THEN d END) AS a, min(CASE WHEN o <> label THEN d END) AS b FROM d GROUP BY 1, 2)"
    mean_a = f"(SELECT row_id, label, avg(a) OVER (PARTITION BY label) AS a, b FROM {ab})"
    out["mst_s"] = out["mst_s_third"] = ""
    for key, source in (("mst_s", ab), ("mst_s_first", mean_a), ("mst_s_third", mean_a)):
        out[key] = cl + f" SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS value FROM {source}"
    db = ", s AS (SELECT label, avg(d) AS s FROM d WHERE o = label GROUP BY label), mm AS (SELECT m.label AS i, d.o AS j, d.d FROM m JOIN d ON d.row_id = m.mid WHERE d.o <> m.label) SELECT round(sum(r) / (SELECT count(*) FROM m), 6) AS value FROM (SELECT i, max((x.s + y.s) / nullif(d, 0)) AS r FROM mm JOIN s x ON i = x.label JOIN s y ON j = y.label GROUP BY i)"
    out |= {k: cl + db for k in ("mst_db", "mst_db_first", "mst_db_third")}
    ch = f", g AS (SELECT arg_min(row_id, (round({_d2('x', 'mu')}, 12), row_id)) AS gid FROM p, (SELECT [avg(x[1]), avg(x[2])] AS mu FROM p)), sb AS (SELECT sum(bn.w * n) AS b, count(*) AS k, sum(n) AS n FROM m JOIN (SELECT label, count(*) AS n FROM p GROUP BY label) USING (label) JOIN bn ON bn.i = m.mid JOIN g ON bn.j = gid) SELECT round((b / (k - 1)) / nullif((SELECT sum(d) FROM d WHERE o = label) / (n - k), 0), 6) AS value FROM sb"
    out |= {k: cl + ch for k in ("mst_ch", "mst_ch_first", "mst_ch_third")}
    own = cl + ", f0 AS MATERIALIZED (SELECT e0.* FROM e0 JOIN p a ON e0.i = a.row_id JOIN p b ON e0.j = b.row_id WHERE a.label = b.label)"
    for k in range(7):
        own += f", f{k + 1} AS MATERIALIZED (SELECT a.i, b.j, min(greatest(a.w, b.w)) AS w FROM f{k} a JOIN f{k} b ON a.j = b.i GROUP BY a.i, b.j)"
    own += " SELECT round((SELECT max(w) FROM f7 JOIN m ON i = mid) / (SELECT min(w) FROM bn JOIN m x ON bn.i = x.mid JOIN m y ON bn.j = y.mid WHERE x.label <> y.label), 6) AS value"
    out |= {"mst_sep_ratio": own, "mst_idea": own}
    # merged labels
    merged = f"(SELECT label AS t, least(label, 2) AS p FROM ({POINTS['customer']}))"
    margins = _margins("t", "p", merged)
    rows = [f"SELECT 'ari' AS \"index\", value FROM ({_ari(merged, 't', 'p')})", f"SELECT 'ami', round({_ami_body(f'SELECT t, p, count(*) AS nij FROM {merged} GROUP BY 1, 2')}, 6)"]
    rows += [f"SELECT 'balanced_ari_{m}', value FROM ({margins}{_CLASSES} SELECT round(sum(v * {_WEIGHTS[m]}) / sum({_WEIGHTS[m]}), 6) AS value FROM sc)" for m in METHODS]
    out["merged_labels"] = " UNION ALL ".join(rows)
    # k-means with fixed starts
    lloyd = f"WITH p AS MATERIALIZED ({_scaled('part')}), k0 AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS label, x AS mu FROM p QUALIFY row_number() OVER (ORDER BY row_id) <= 4)"
    for r in range(3):
        lloyd += f", a{r} AS MATERIALIZED (SELECT row_id, any_value(x) AS x, arg_min(label, (d2, label)) AS label FROM (SELECT p.row_id, p.x, k{r}.label, {_d2('p.x', 'mu')} AS d2 FROM p, k{r}) GROUP BY row_id), k{r + 1} AS (SELECT k0.label, coalesce(mu2, [0.0, 0.0]) AS mu FROM k0 LEFT JOIN (SELECT label, [avg(x[1]), avg(x[2])] AS mu2 FROM a{r} GROUP BY label) USING (label))"
    out["kmeans_lloyd_fixed"] = lloyd + f" SELECT row_id, arg_min(label, (d2, label))::BIGINT AS label FROM (SELECT p.row_id, k3.label, {_d2('p.x', 'mu')} AS d2 FROM p, k3) GROUP BY row_id"
    # grid: eight levels of median splits
    levels = f"WITH q AS MATERIALIZED ({_scaled('part')}), thr AS (SELECT 0.5 / count(*) / ((max(x[1]) - min(x[1])) * (max(x[2]) - min(x[2]))) AS thr, count(*) AS all_n FROM q), b0 AS (SELECT '' AS cell, min(x[1]) AS lo0, min(x[2]) AS lo1, max(x[1]) AS hi0, max(x[2]) AS hi1 FROM q), p0 AS (SELECT row_id, x, label, '' AS cell FROM q)"
    for k in range(9):
        ax = k % 2
        levels += f", s{k} AS (SELECT cell, count(*) AS n, greatest(max(x[1]) - min(x[1]), 1e-6) * greatest(max(x[2]) - min(x[2]), 1e-6) AS volume, median(x[{ax + 1}]) AS cut, max(x[{ax + 1}]) AS top FROM p{k} GROUP BY cell), c{k} AS MATERIALIZED (SELECT s{k}.*, lo0, lo1, hi0, hi1, n / all_n / volume AS density, {k >= 8} OR n <= 8 OR n / all_n / volume < thr OR n < 2 OR top <= cut AS leaf FROM s{k} JOIN b{k} USING (cell), thr)"
        if k < 8:
            left = [f"CASE WHEN side = 'L' THEN cut ELSE hi{i} END AS hi{i}" if i == ax else f"hi{i}" for i in (0, 1)]
            right = [f"CASE WHEN side = 'R' THEN cut ELSE lo{i} END AS lo{i}" if i == ax else f"lo{i}" for i in (0, 1)]
            levels += f", b{k + 1} AS (SELECT cell || side AS cell, {', '.join(right)}, {', '.join(left)} FROM c{k}, (VALUES ('L'), ('R')) AS t(side) WHERE NOT leaf), p{k + 1} AS MATERIALIZED (SELECT row_id, x, label, cell || CASE WHEN x[{ax + 1}] <= cut THEN 'L' ELSE 'R' END AS cell FROM p{k} JOIN c{k} USING (cell) WHERE NOT leaf)"
    leaves = " UNION ALL ".join(f"SELECT cell, {k} AS depth, n, lo0, lo1, hi0, hi1, volume, density FROM c{k} WHERE leaf" for k in range(9))
    out["grid_cells"] = levels + f" SELECT cell, depth::BIGINT AS depth, n, round(lo0, 6) AS lo0, round(lo1, 6) AS lo1, round(hi0, 6) AS hi0, round(hi1, 6) AS hi1, round(volume, 6) AS volume, round(density, 4) AS density FROM ({leaves})"
    at = " UNION ALL ".join(f"SELECT row_id, label, cell FROM p{k} JOIN c{k} USING (cell) WHERE leaf" for k in range(9))
    out["grid_purity"] = levels + f", t AS (SELECT cell, label, count(*) AS c FROM ({at}) GROUP BY 1, 2), u AS (SELECT cell, label, c, sum(c) OVER (PARTITION BY cell) AS n FROM t) SELECT cell, any_value(n)::BIGINT AS n, round(max(c / n), 6) AS purity, round(-sum(c / n * log2(c / n)), 6) AS impurity, arg_min(label, (-c, label))::BIGINT AS majority FROM u GROUP BY cell"
    # further frames and sinks
    marked = f"SELECT row_id, x, CASE WHEN row_id % 7 = 0 THEN -1 ELSE label END AS label FROM ({POINTS['part']})"
    near = f"SELECT a.row_id, arg_min(b.label, (sqrt({_d2('a.x', 'b.x')}), b.row_id)) AS label FROM q a, q b WHERE a.label = -1 AND b.label <> -1 GROUP BY a.row_id"
    out["bind_noise"] = f"WITH q AS MATERIALIZED ({marked}) SELECT row_id, label::BIGINT AS label FROM ({near}) UNION ALL SELECT row_id, label::BIGINT FROM q WHERE label <> -1"
    out["comb_noise"] = f"WITH q AS (SELECT CASE WHEN label = 0 THEN -1 ELSE label END AS label FROM ({POINTS['lineitem']})), t AS (SELECT max(label) AS top FROM q) SELECT CASE WHEN label = -1 THEN top + 1 ELSE label END::BIGINT AS label, count(*) AS n FROM q, t GROUP BY 1"
    slope = "(x[1] - 0.1) * 6.0 + x[2] * -3.0 + x[3] * 1.0 > 0"  # the normal of (1, 2, 0) and (0, 1, 3)
    out["plane_sides"] = f"SELECT row_id, (x[1] < 0)::BIGINT AS vertical, (x[3] < 0)::BIGINT AS horizontal, ({slope})::BIGINT AS sloped FROM ({emb})"
    out["percent_change"] = "SELECT o_orderpriority, round((avg(o_totalprice) / nullif(min(o_totalprice), 0) - 1) * 100, 4) AS change FROM orders GROUP BY 1"
    plain = ", ".join(f"max(value) FILTER (labelset = '{c}') AS {c}" for c in ("gt", "dfl", "dsl", "vl", "hl"))
    out["plain_report"] = scores + flagged + f" SELECT metric, {plain} FROM f GROUP BY 1"
    linear = lambda name, digits: f"({_linear(name, POINTS['lineitem'], 2, digits)})"
    out["running_indices"] = "SELECT " + ", ".join(f"{linear(n, d)} AS {n}" for n, d in (("sse", LARGE["sse"]), ("ch", 3), ("wb", 3), ("bh", LARGE["bh"])))
    out["user_metric"] = f"SELECT 'largest_share' AS metric, round(max(n) / sum(n), 6) AS value FROM (SELECT count(*) AS n FROM ({POINTS['customer']}) GROUP BY label)"
    # two-dimensional forms of indices with matrices, scatter and densities
    covered = f"WITH p AS MATERIALIZED ({_scaled('customer')}), c AS (SELECT label, avg(x[1]) AS m0, avg(x[2]) AS m1, covar_samp(x[1], x[1]) AS a, covar_samp(x[1], x[2]) AS b, covar_samp(x[2], x[2]) AS d FROM p GROUP BY label)"
    joint = "SELECT i.m0 - j.m0 AS u, i.m1 - j.m1 AS v, i.a + j.a AS a, i.b + j.b AS b, i.d + j.d AS d FROM c i JOIN c j ON i.label < j.label"
    out["rcip"] = covered + f" SELECT round(sum(exp(-0.5 * ((d * u * u - 2 * b * u * v + a * v * v) / (a * d - b * b) + ln(a * d - b * b) + 2 * ln(2 * pi())))), 6) AS value FROM ({joint})"
    for key, name, dim, digits in (("sd", "embeddings", 64, 6), ("sd_lineitem", "lineitem", 2, 4), ("s_dbw", "embeddings", 64, 6), ("s_dbw_lineitem", "lineitem", 2, 4)):
        listed = lambda f, dim=dim: "[" + ", ".join(f.format(i=i + 1) for i in range(dim)) + "]"
        norm = lambda v: f"sqrt(list_sum(list_transform({v}, lambda e: e * e)))"
        head = f"""WITH p AS MATERIALIZED ({POINTS[name]}), c AS MATERIALIZED (SELECT label, {listed('avg(x[{i}])')} AS mu, {listed('var_pop(x[{i}])')} AS va FROM p GROUP BY label),
          w AS (SELECT {listed('var_pop(x[{i}])')} AS va FROM p), sc AS MATERIALIZED (SELECT sum({norm('c.va')}) / any_value({norm('w.va')}) / count(*) AS scat, sqrt(sum({norm('c.va')})) / count(*) AS sd FROM c, w),
          pr AS MATERIALIZED (SELECT a.label AS i, b.label AS j, sqrt({_d2('a.mu', 'b.mu')}) AS d, {listed('(a.mu[{i}] + b.mu[{i}]) / 2')} AS mid FROM c a JOIN c b ON a.label <> b.label)"""
        if key.startswith("sd"):
            out[key] = head + f" SELECT round((SELECT scat FROM sc) + (SELECT max(d) / nullif(min(d), 0) FROM pr) * (SELECT sum(1 / s) FROM (SELECT sum(d) AS s FROM pr GROUP BY i)), {digits}) AS value"
        else:
            out[key] = head + f""", ce AS (SELECT c.label, count(*) FILTER ({_d2('p.x', 'c.mu')} <= sc.sd * sc.sd) AS n FROM c JOIN p USING (label), sc GROUP BY c.label),
              de AS (SELECT i, j, count(*) FILTER ({_d2('p.x', 'mid')} <= sc.sd * sc.sd) AS n FROM pr JOIN p ON p.label = i OR p.label = j, sc WHERE i < j GROUP BY i, j)
              SELECT round((SELECT scat FROM sc) + CASE WHEN count(*) = count(nullif(greatest(x.n, y.n), 0)) THEN sum(de.n / nullif(greatest(x.n, y.n), 0)) / count(*) END, {digits}) AS value FROM de JOIN ce x ON x.label = i JOIN ce y ON y.label = j"""
    sizes = [int(300 + (30 - 300) * i / 9) for i in range(10)]
    out["imbalance_sweep"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, round(300.0::DOUBLE / {n}, 6))" for i, n in enumerate(sizes)) + ") AS t(step, value)"
    return out
