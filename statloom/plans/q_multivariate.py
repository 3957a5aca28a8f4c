"""Registered queries: PCA, FAMD, k-means (rows-only checks: eigen / iterative)."""

from __future__ import annotations

from statloom.operators import multivariate as M
from statloom.plans.catalog import register
from statloom.plans.fixtures import frame, sql

VEC8 = [f"x{i}" for i in range(8)]
_ROLL = ["n_lines", "sum_qty", "sum_price", "avg_disc"]


@register("pca_variance")
def pca_variance(spark, sf):
    return M.pca(frame(spark, sf, "order_rollup"), _ROLL)["pca_variance"]


@register("pca_summary")
def pca_summary(spark, sf):
    return M.pca(frame(spark, sf, "order_rollup"), _ROLL)["pca_summary"]


@register("pca_loadings")
def pca_loadings(spark, sf):
    return M.pca(frame(spark, sf, "order_rollup"), _ROLL)["pca_loadings"]


@register("pca_scores")
def pca_scores(spark, sf):
    return M.pca(frame(spark, sf, "order_rollup"), _ROLL, key="o_key")["pca_scores"]


# eigenvalues of a 3 x 3 correlation matrix in closed form
_SCREE = sql("part_numeric") + """, r AS (SELECT corr(seq_no, p_size) AS a, corr(seq_no, p_retailprice) AS b, corr(p_size, p_retailprice) AS c
  FROM part_numeric),
q AS (SELECT sqrt((a * a + b * b + c * c) / 3) AS p, a * b * c AS d FROM r),
f AS (SELECT p, acos(greatest(-1.0, least(1.0, d / (p * p * p)))) / 3 AS phi FROM q),
v AS (SELECT 1 + 2 * p * cos(phi) AS e1, 1 + 2 * p * cos(phi + 2 * pi() / 3) AS e3 FROM f),
e AS (SELECT 1 AS component, e1 AS e FROM v UNION ALL SELECT 2, 3 - e1 - e3 FROM v UNION ALL SELECT 3, e3 FROM v)
SELECT CAST(component AS INTEGER) AS component, e / 3 AS explained_ratio, sum(e) OVER (ORDER BY component) / 3 AS cumulative FROM e"""


@register("scree", sql=_SCREE, sig_cols=["explained_ratio", "cumulative"])
def scree(spark, sf):
    return M.scree(frame(spark, sf, "part_numeric"), ["seq_no", "p_size", "p_retailprice"])


@register("scree_scores")
def scree_scores(spark, sf):
    return M.score_plane(frame(spark, sf, "vec_8d"), VEC8, key="vec_id")


@register("famd_inertia")
def famd_inertia(spark, sf):
    return M.famd(frame(spark, sf, "customer_mix"), ["c_acctbal", "c_nationkey"], ["c_mktsegment"])["famd_inertia"]


@register("famd_rows")
def famd_rows(spark, sf):
    return M.famd(frame(spark, sf, "customer_mix"), ["c_acctbal", "c_nationkey"], ["c_mktsegment"],
                  key="c_custkey")["famd_rows"]


@register("famd_columns")
def famd_columns(spark, sf):
    return M.famd(frame(spark, sf, "customer_mix"), ["c_acctbal", "c_nationkey"], ["c_mktsegment"])["famd_columns"]


@register("kmeans_sweep")
def kmeans_sweep(spark, sf):
    return M.kmeans_sweep(frame(spark, sf, "vec_8d"), VEC8)


@register("kmeans_profile")
def kmeans_profile(spark, sf):
    """Of the best k of the sweep."""
    vectors = frame(spark, sf, "vec_8d")
    return M.kmeans_profile(vectors, M.kmeans_sweep(vectors, VEC8).where("is_best").first()["k"], VEC8)


_DB_SQL = sql("vec_2d") + """SELECT * FROM (WITH z AS (
  SELECT vec_id, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM vec_2d),
nb AS (SELECT a.vec_id AS a, b.vec_id AS b FROM z a JOIN z b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25),
core AS (SELECT a AS vec_id FROM nb GROUP BY a HAVING count(*) >= 5),
reach AS (SELECT DISTINCT nb.a AS vec_id FROM nb JOIN core ON nb.b = core.vec_id)
SELECT (SELECT count(*) FROM core) AS n_core,
  (SELECT count(*) FROM z WHERE vec_id NOT IN (SELECT vec_id FROM reach)) AS n_noise)"""


@register("dbscan_core_noise", sql=_DB_SQL)
def dbscan_core_noise(spark, sf):
    from statloom.operators.dbscan import dbscan_summary as db
    return db(frame(spark, sf, "vec_2d"), ["x", "y"])["summary"].select("n_core", "n_noise")


_DB_CLUSTERS = _DB_SQL.replace("WITH z AS", "WITH RECURSIVE z AS").split("SELECT (SELECT count(*) FROM core)")[0].rstrip() + """,
link AS (SELECT a, b FROM nb JOIN core c ON nb.a = c.vec_id JOIN core d ON nb.b = d.vec_id),
grow(n, root) AS (SELECT vec_id, vec_id FROM core UNION SELECT link.b, grow.root FROM grow JOIN link ON link.a = grow.n AND link.b > grow.root),
cluster AS (SELECT n AS vec_id, min(root) AS label FROM grow GROUP BY n),
member AS (SELECT nb.a AS vec_id, min(cluster.label) AS label FROM nb JOIN cluster ON nb.b = cluster.vec_id GROUP BY nb.a)
"""


@register("dbscan_summary", sql=_DB_CLUSTERS + """SELECT (SELECT count(DISTINCT label) FROM cluster) AS n_clusters,
  (SELECT count(*) FROM core) AS n_core, (SELECT count(*) FROM z WHERE vec_id NOT IN (SELECT vec_id FROM member)) AS n_noise)""")
def dbscan_summary(spark, sf):
    from statloom.operators.dbscan import dbscan_summary as db
    return db(frame(spark, sf, "vec_2d"), ["x", "y"])["summary"]


@register("dbscan_sizes")
def dbscan_sizes(spark, sf):
    from statloom.operators.dbscan import dbscan_summary as db
    return db(frame(spark, sf, "vec_2d"), ["x", "y"])["sizes"]


def _db8_sql() -> str:
    z = ", ".join(f"(x{i} - avg(x{i}) OVER ()) / stddev_pop(x{i}) OVER () AS x{i}" for i in range(8))
    d2 = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(8))
    return sql("vec_8d") + f"""SELECT * FROM (WITH z AS (SELECT vec_id, {z} FROM vec_8d),
nb AS (SELECT a.vec_id AS a, b.vec_id AS b FROM z a JOIN z b ON {d2} <= 2.25),
core AS (SELECT a AS vec_id FROM nb GROUP BY a HAVING count(*) >= 5),
reach AS (SELECT DISTINCT nb.a AS vec_id FROM nb JOIN core ON nb.b = core.vec_id)
SELECT (SELECT count(*) FROM core) AS n_core,
  (SELECT count(*) FROM z WHERE vec_id NOT IN (SELECT vec_id FROM reach)) AS n_noise)"""


@register("dbscan_core_noise_8d", sql=_db8_sql())
def dbscan_core_noise_8d(spark, sf):
    from statloom.operators.dbscan import dbscan_summary as db
    return db(frame(spark, sf, "vec_8d"), VEC8, eps=1.5)["summary"].select("n_core", "n_noise")
