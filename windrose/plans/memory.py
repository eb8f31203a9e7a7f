"""Analogue-memory, fingerprint and support queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.operators import memory as M
from windrose.operators import support as SP
from windrose.operators import summaries as SU
from windrose.plans import bridge as B
from windrose.plans.registry import query

KEYS = ["region_id", "lead_day"]
K, KMIN = 30, 5

ZVEC = B.VECTORS + """,
dims AS (SELECT list(avg_x ORDER BY i) AS m, list(CASE WHEN sd = 0 THEN 1 ELSE sd END ORDER BY i) AS s FROM (
  SELECT i, avg(x) AS avg_x, stddev_samp(x) AS sd FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vectors WHERE split = 'train') GROUP BY i)),
z AS (SELECT v.* EXCLUDE (vector), [(vector[i] - m[i]) / s[i] FOR i IN range(1, 65)] AS z FROM vectors v, dims),
cand AS (SELECT q.case_id, q.split AS q_split, q.region_id, q.lead_day, c.case_id AS neighbour, c.bust, c.norm_error, c.sig_class, c.split AS c_split, c.init_time AS nb_init,
                list_distance(q.z, c.z) AS distance
         FROM z q JOIN z c ON c.region_id = q.region_id AND c.lead_day = q.lead_day AND c.valid_time <= q.init_time)"""


def knn_sql(source: str) -> str:
    return f"""knn AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY distance, neighbour) AS rank FROM {source}
    QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY distance, neighbour) <= {K})"""


@B.memo
def standardised(spark: SparkSession, sf: str) -> DataFrame:
    return SU.standardise_vector(B.vectors(spark, sf), "vector", "z").drop("vector")


@B.memo
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    v = standardised(spark, sf)
    return M.knn_join(v, v, KEYS, "z", K)


@query("knn_join", ctes=ZVEC + "," + knn_sql("cand"), doubles="distance", sql="""
  SELECT case_id, CAST(rank AS INTEGER) AS rank, neighbour, distance FROM knn""")
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours(spark, sf).select("case_id", "rank", "neighbour", "distance")


def _features_sql(where: str) -> str:
    return ZVEC + f""", el AS (SELECT * FROM cand WHERE {where}), {knn_sql('el')},
  big AS (SELECT region_id, lead_day FROM z WHERE split = 'train' GROUP BY ALL HAVING count(*) > {K}),
  radius AS (SELECT median(distance) AS r FROM knn JOIN big USING (region_id, lead_day) WHERE q_split = 'train' AND rank = {K}),
  cnt AS (SELECT case_id, count(*) AS an_n_eligible, count(*) FILTER (distance <= r) AS an_n_within FROM el, radius GROUP BY case_id),
  near AS (SELECT case_id, count(*) AS n, min(distance) AS d1, avg(distance) AS dm, avg(bust) AS br, median(norm_error) AS em, quantile_cont(norm_error, 0.9) AS e9
           FROM knn GROUP BY case_id)"""


_FEATURES = f"""SELECT z.case_id, coalesce(an_n_eligible, 0) AS an_n_eligible, coalesce(an_n_within, 0) AS an_n_within, d1 AS an_dist1,
  CASE WHEN n >= {KMIN} THEN dm END AS an_dist_mean, CASE WHEN n >= {KMIN} THEN br END AS an_bust_rate, CASE WHEN n >= {KMIN} THEN em END AS an_err_med,
  CASE WHEN n >= {KMIN} THEN e9 END AS an_err_q90 FROM z LEFT JOIN cnt USING (case_id) LEFT JOIN near USING (case_id)"""
_FD = "an_dist1 an_dist_mean an_bust_rate an_err_med an_err_q90"


@query("analogue_memory", ctes=_features_sql("true"), doubles=_FD, sql=_FEATURES)
def analogue_memory(spark: SparkSession, sf: str) -> DataFrame:
    return M.memory_features(standardised(spark, sf), KEYS, "z", K, KMIN)


@query("analogue_memory_frozen", ctes=_features_sql("c_split IN ('train', 'validation')"), doubles=_FD, sql=_FEATURES)
def analogue_memory_frozen(spark: SparkSession, sf: str) -> DataFrame:
    return M.memory_features(standardised(spark, sf), KEYS, "z", K, KMIN, mode="frozen")


EXPECTED = ZVEC + "," + knn_sql("cand") + """,
ex AS (SELECT case_id, count(*) FILTER (bust = 1) >= 3 AS use, CASE WHEN count(*) FILTER (bust = 1) >= 3 THEN count(*) FILTER (bust = 1) ELSE count(*) END AS n,
         count(*) FILTER (sig_class = 'POSITION_PHASE' AND (bust = 1 OR nb < 3)) AS c0, count(*) FILTER (sig_class = 'AMPLITUDE_STRUCTURE' AND (bust = 1 OR nb < 3)) AS c1,
         count(*) FILTER (sig_class = 'RESIDUAL_MIXED' AND (bust = 1 OR nb < 3)) AS c2
       FROM (SELECT *, count(*) FILTER (bust = 1) OVER (PARTITION BY case_id) AS nb FROM knn) GROUP BY case_id),
expected AS (SELECT case_id, CASE WHEN use THEN 'analogue busts' ELSE 'all analogues' END AS basis, n, c0 / n AS p_position_phase, c1 / n AS p_amplitude_structure,
  c2 / n AS p_residual_mixed, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 'POSITION_PHASE' WHEN c1 >= c2 THEN 'AMPLITUDE_STRUCTURE' ELSE 'RESIDUAL_MIXED' END AS expected_top FROM ex)"""
_P3 = "p_position_phase p_amplitude_structure p_residual_mixed"


def expected(spark: SparkSession, sf: str) -> DataFrame:
    return M.expected_signature(neighbours(spark, sf), standardised(spark, sf))


@query("expected_signature", ctes=EXPECTED, doubles=_P3, sql="SELECT * FROM expected")
def expected_signature(spark: SparkSession, sf: str) -> DataFrame:
    return expected(spark, sf)


@query("nearest_analogues", ctes=ZVEC + "," + knn_sql("cand"), doubles="distance norm_error", sql="""
  SELECT case_id, CAST(rank AS INTEGER) AS rank, neighbour, nb_init, distance, bust, norm_error, CASE WHEN bust = 1 THEN sig_class END AS signature, c_split AS nb_split
  FROM knn WHERE rank <= 8""")
def nearest_analogues(spark: SparkSession, sf: str) -> DataFrame:
    return M.nearest_listing(neighbours(spark, sf), standardised(spark, sf), 8)


PRINTS = EXPECTED + """,
prints AS (SELECT z.case_id, z.sig_class AS actual, expected_top, basis, CASE z.sig_class WHEN 'POSITION_PHASE' THEN p_position_phase
  WHEN 'AMPLITUDE_STRUCTURE' THEN p_amplitude_structure ELSE p_residual_mixed END AS p_actual FROM z LEFT JOIN expected e ON e.case_id = z.case_id WHERE z.bust = 1)"""


@query("fingerprints", ctes=PRINTS, doubles="p_actual", sql="SELECT * FROM prints")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return M.fingerprints(standardised(spark, sf), expected(spark, sf))


@query("fingerprint_metrics", ctes=PRINTS, doubles="top1_agreement mean_p_actual reference_top1_agreement reference_mean_p", sql="""
  WITH f AS (SELECT sig_class, count(*) AS n FROM z WHERE split = 'train' AND bust = 1 GROUP BY 1), t AS (SELECT sig_class AS top FROM f ORDER BY n DESC, sig_class DESC LIMIT 1)
  SELECT count(*) AS n_busts, count(expected_top) AS n_with_expectation, avg(CASE WHEN expected_top = actual THEN 1e0 ELSE 0e0 END) FILTER (expected_top IS NOT NULL) AS top1_agreement,
    avg(p_actual) AS mean_p_actual, avg(CASE WHEN actual = top THEN 1e0 ELSE 0e0 END) FILTER (expected_top IS NOT NULL) AS reference_top1_agreement,
    avg(coalesce(f.n, 0) / (SELECT sum(n) FROM f)) FILTER (expected_top IS NOT NULL) AS reference_mean_p
  FROM prints LEFT JOIN f ON f.sig_class = actual CROSS JOIN t""")
def fingerprint_metrics(spark: SparkSession, sf: str) -> DataFrame:
    z = standardised(spark, sf)
    return M.fingerprint_metrics(M.fingerprints(z, expected(spark, sf)), z.where("split = 'train' AND bust = 1"))


SPACE = ["spread_m", "p_b"]
SUPPORT = B.CASES + """,
tr AS (SELECT * FROM cases WHERE split = 'train'),
mo AS (SELECT lead_day, avg(a) AS ma, avg(b) AS mb, avg(za * za) AS saa, avg(za * zb) AS sab, avg(zb * zb) AS sbb, avg(pow(za * za + zb * zb, 2)) AS f4, count(*) AS n
  FROM (SELECT lead_day, spread_m AS a, p_b AS b, spread_m - avg(spread_m) OVER w AS za, p_b - avg(p_b) OVER w AS zb FROM tr WINDOW w AS (PARTITION BY lead_day)) GROUP BY lead_day),
sh AS (SELECT *, (saa + sbb) / 2 AS mu, least((f4 - d2) / (2 * n), gap) / gap AS shrinkage FROM (
  SELECT *, saa * saa + 2 * sab * sab + sbb * sbb AS d2, (saa * saa + 2 * sab * sab + sbb * sbb - (saa + sbb) * (saa + sbb) + (saa + sbb) * (saa + sbb) / 2) / 2 AS gap FROM mo)),
co AS (SELECT *, (1 - shrinkage) * saa + shrinkage * mu AS caa, (1 - shrinkage) * sab AS cab, (1 - shrinkage) * sbb + shrinkage * mu AS cbb FROM sh),
dist AS (SELECT c.case_id, c.split, c.lead_day, sqrt((cbb * pow(spread_m - ma, 2) - 2 * cab * (spread_m - ma) * (p_b - mb) + caa * pow(p_b - mb, 2)) / (caa * cbb - cab * cab)) AS d
  FROM cases c JOIN co ON co.lead_day = c.lead_day),
th AS (SELECT lead_day, quantile_cont(d, 0.9) AS t0, quantile_cont(d, 0.975) AS t1, quantile_cont(d, 0.995) AS t2 FROM dist WHERE split = 'train' GROUP BY lead_day)"""


@B.memo
def support(spark: SparkSession, sf: str) -> DataFrame:
    return SP.fit_support(B.cases(spark, sf), SPACE)


@query("fit_support", ctes=SUPPORT, doubles="shrinkage t0 t1 t2", sql="""
  SELECT lead_day, shrinkage, n AS n_train, t0, t1, t2, 'train' AS fitted_on FROM co JOIN th USING (lead_day)""")
def fit_support(spark: SparkSession, sf: str) -> DataFrame:
    return support(spark, sf).drop("location", "precision")


@query("support_distance", ctes=SUPPORT, doubles="support_distance", sql="""
  SELECT case_id, d AS support_distance, CAST((d >= t0)::INT + (d >= t1)::INT + (d >= t2)::INT AS INTEGER) AS support_level FROM dist JOIN th USING (lead_day)""")
def support_distance(spark: SparkSession, sf: str) -> DataFrame:
    return SP.support_levels(B.cases(spark, sf), support(spark, sf), SPACE).select("case_id", "support_distance", "support_level")


@query("dq_causal", ctes=ZVEC + "," + knn_sql("cand"), sql="""
  SELECT count(*) AS n_pairs, count(*) FILTER (c.valid_time > q.init_time) AS n_violations FROM knn k JOIN z q ON q.case_id = k.case_id JOIN z c ON c.case_id = k.neighbour""")
def dq_causal(spark: SparkSession, sf: str) -> DataFrame:
    from windrose.operators.quality import causality
    return causality(neighbours(spark, sf), standardised(spark, sf))
