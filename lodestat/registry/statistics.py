"""Statistical tests and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import correlation, hypothesis
from lodestat.registry.common import GAPPY_PRICE, rounded, table

ENTRIES = {}


def _add(name, query, sql=None):
    ENTRIES[name] = (query, sql)


def _part(spark, folder):
    return table(spark, folder, "part").select("p_size", F.expr(GAPPY_PRICE).alias("price"))


_PART = f"(SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, {GAPPY_PRICE} AS price FROM part)"
_PAIR = [("p_size", "price")]

_add("e1_shapiro_wilk", lambda s, d: hypothesis.shapiro_wilk(_part(s, d)))

_POWER = """SELECT '{c}' AS "column", round((s3 / n - 3 * m * s2 / n + 2 * m * m * m) / pow(s2 / n - m * m, 1.5), 4) AS skewness,
  round((s4 / n - 4 * m * s3 / n + 6 * m * m * s2 / n - 3 * m * m * m * m) / pow(s2 / n - m * m, 2) - 3, 4) AS kurtosis
  FROM (SELECT count(v) AS n, avg(v) AS m, sum(v * v) AS s2, sum(v * v * v) AS s3, sum(v * v * v * v) AS s4
        FROM (SELECT {c} - (SELECT avg({c}) FROM {t}) AS v FROM {t}))"""
_add(
    "e2_shape_measures",
    lambda s, d: rounded(hypothesis.shape_measures(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4),
    " UNION ALL ".join(_POWER.format(c=c, t="lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")),
)
_QUART = """SELECT '{c}' AS "column", round(q[1], 4) AS q1, round(q[2], 4) AS median, round(q[3], 4) AS q3, round(q[3] - q[1], 4) AS iqr
  FROM (SELECT quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM {t})"""
_add(
    "e3_quartiles",
    lambda s, d: rounded(hypothesis.quartiles(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4),
    " UNION ALL ".join(_QUART.format(c=c, t="lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")),
)
_add("e_statistical_tests", lambda s, d: hypothesis.statistical_tests(
    table(s, d, "lineitem").select("l_quantity", "l_extendedprice")))

# --- correlation -----------------------------------------------------------


def matrix_sql(names, cell: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column1, '{b}' AS column2, " + (cell.format(a=a, b=b)) for a in names for b in names)


_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_add(
    "e4_pearson_matrix",
    lambda s, d: rounded(correlation.pearson_matrix(table(s, d, "lineitem"), list(_LINE))),
    matrix_sql(_LINE, "round(corr({a}, {b}), 6) AS r FROM lineitem"),
)
_RANKED = """round(corr(x, y), 6) AS r FROM (SELECT
  rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x,
  rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y
  FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
_add(
    "e5_spearman_matrix",
    lambda s, d: rounded(correlation.spearman_matrix(_part(s, d))),
    matrix_sql(("p_size", "price"), _RANKED.replace("{t}", _PART)),
)
_add(
    "e5_spearman_matrix_lineitem",
    lambda s, d: rounded(correlation.spearman_matrix(table(s, d, "lineitem"), list(_LINE))),
    matrix_sql(_LINE, _RANKED.replace("{t}", "lineitem")),
)


def _gaps(spark, folder):
    return table(spark, folder, "lineitem").selectExpr(*_GAPS)


_GAPS = (
    "CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS price",
    "CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS quantity",
    "CASE WHEN l_suppkey % 3 <> 0 THEN l_partkey END AS part",
    "l_tax AS tax",
)
_add(
    "e5_spearman_matrix_gaps",
    lambda s, d: rounded(correlation.spearman_matrix(_gaps(s, d))),
    f"WITH g AS (SELECT {', '.join(_GAPS)} FROM lineitem) "
    + matrix_sql(("price", "quantity", "part", "tax"), _RANKED.replace("{t}", "g")),
)
_TAU = """(SELECT round(sum(sign(a.{a} - b.{a}) * sign(a.{b} - b.{b}))
  / sqrt(CAST(count(*) FILTER (a.{a} <> b.{a}) AS DOUBLE) * count(*) FILTER (a.{b} <> b.{b})), 6)
  FROM g a JOIN g b ON a.p_partkey < b.p_partkey WHERE a.{a} IS NOT NULL AND a.{b} IS NOT NULL AND b.{a} IS NOT NULL AND b.{b} IS NOT NULL) AS r"""
_add(
    "e6_kendall_matrix",
    lambda s, d: rounded(correlation.kendall_matrix(_part(s, d))),
    f"WITH g AS {_PART} " + matrix_sql(("p_size", "price"), _TAU),
)


def _linked(spark, folder):
    return table(spark, folder, "part").select(
        "p_size", (F.lit(60) - F.col("p_size") + F.col("p_partkey") % 5).cast("double").alias("mirror"), "p_retailprice")


_LINKED = "(SELECT p_partkey, p_size, CAST(60 - p_size + p_partkey % 5 AS DOUBLE) AS mirror, p_retailprice FROM part)"
_UPPER = [("p_size", "mirror"), ("p_size", "p_retailprice"), ("mirror", "p_retailprice")]
_add(
    "e7_strong_correlations",
    lambda s, d: rounded(correlation.strong_correlations(_linked(s, d))),
    f"WITH g AS {_LINKED}, m AS (" + " UNION ALL ".join(
        [f"SELECT 'pearson' AS \"matrix\", '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 6) AS r FROM g" for a, b in _UPPER]
        + [f"SELECT 'spearman', '{a}', '{b}', " + _RANKED.format(a=a, b=b, t="g") for a, b in _UPPER]
        + [f"SELECT 'kendall', '{a}', '{b}', " + _TAU.format(a=a, b=b) for a, b in _UPPER]
    ) + ") SELECT *, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM m WHERE abs(r) > 0.7",
)

# --- tests -----------------------------------------------------------------

_add(
    "e8_one_sample_t",
    lambda s, d: rounded(hypothesis.one_sample_t(table(s, d, "customer"), "c_acctbal", mean=4500).select("column", "n", "t_statistic"), 5),
    """SELECT 'c_acctbal' AS "column", count(*) AS n,
       round((avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(*))), 5) AS t_statistic FROM customer""",
)
_add("e8_one_sample_t_decision", lambda s, d: hypothesis.hypothesis_testing(table(s, d, "customer"), "c_acctbal"))
_T = """SELECT 'p_size' AS column1, 'price' AS column2, n1, n2,
  round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 5) AS t_statistic
  FROM (SELECT count(p_size) AS n1, count(price) AS n2, avg(p_size) AS m1, avg(price) AS m2,
        var_samp(p_size) AS v1, var_samp(price) AS v2 FROM g)"""
_add(
    "e9_two_sample_t",
    lambda s, d: rounded(hypothesis.two_sample_t(_part(s, d), _PAIR).drop("p_value", "rejected"), 5),
    f"WITH g AS {_PART} {_T}",
)
_U = """WITH g AS {t}, l AS (SELECT 1 AS side, {a} AS v FROM g WHERE {a} IS NOT NULL UNION ALL SELECT 2, {b} FROM g WHERE {b} IS NOT NULL),
  r AS (SELECT side, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM l)
  SELECT '{a}' AS column1, '{b}' AS column2, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2,
  CAST(sum(r) FILTER (side = 1) - count(*) FILTER (side = 1) * (count(*) FILTER (side = 1) + 1) / 2.0 AS DOUBLE) AS u_statistic FROM r"""


def _close(spark, folder):
    return table(spark, folder, "part").select("p_size", F.expr(
        "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE floor(p_retailprice / 40) END").cast("double").alias("price"))


_CLOSE = """(SELECT CAST(p_size AS DOUBLE) AS p_size,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE floor(p_retailprice / 40) END AS price FROM part)"""
_add(
    "e10_mann_whitney",
    lambda s, d: hypothesis.mann_whitney(_close(s, d), _PAIR).drop("p_value", "significant"),
    _U.format(t=_CLOSE, a="p_size", b="price"),
)
_F = """SELECT 'p_size' AS column1, 'price' AS column2, round((n1 + n2 - 2)
  * (n1 * pow(z1 - (n1 * z1 + n2 * z2) / (n1 + n2), 2) + n2 * pow(z2 - (n1 * z1 + n2 * z2) / (n1 + n2), 2))
  / (n1 * w1 + n2 * w2), 4) AS statistic FROM (
  SELECT count(p_size) AS n1, count(price) AS n2, avg(abs(p_size - m1)) AS z1, avg(abs(price - m2)) AS z2,
  var_pop(abs(p_size - m1)) AS w1, var_pop(abs(price - m2)) AS w2
  FROM g, (SELECT median(p_size) AS m1, median(price) AS m2 FROM g))"""
_add(
    "e11_levene",
    lambda s, d: rounded(hypothesis.levene(_close(s, d), _PAIR).select("column1", "column2", "statistic"), 4),
    f"WITH g AS {_CLOSE} {_F}",
)
_add(
    "e12_all_pairs_suite",
    lambda s, d: rounded(hypothesis.hypothesis_suite(_close(s, d)).select("test", "column1", "column2", "statistic"), 4),
    f"""WITH g AS {_CLOSE} SELECT 'one_sample_ttest' AS test, 'p_size' AS column1, NULL AS column2,
      round(avg(p_size) / (stddev_samp(p_size) / sqrt(count(p_size))), 4) AS statistic FROM g
      UNION ALL SELECT 'one_sample_ttest', 'price', NULL, round(avg(price) / (stddev_samp(price) / sqrt(count(price))), 4) FROM g
      UNION ALL SELECT 'two_sample_ttest', column1, column2, t_statistic FROM ({_T.replace(', 5) AS t', ', 4) AS t')})
      UNION ALL SELECT 'mann_whitney_test', column1, column2, u_statistic FROM ({_U.format(t=_CLOSE, a="p_size", b="price")})
      UNION ALL SELECT 'levene_test', column1, column2, statistic FROM ({_F})""",
)
_add("e_hypothesis_suite_lineitem", lambda s, d: hypothesis.hypothesis_suite(table(s, d, "lineitem"), list(_LINE)))
