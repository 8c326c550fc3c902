"""Fitted results as checkable facts.

A model's numbers depend on draws and on the order of sums, so SQL cannot repeat
them. Each query here runs the whole fit and returns what must hold of its
result, next to figures that SQL does know.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lodestat.registry import anomalies, charting, cleaning, common, forecasting, modelling, profiling, statistics

ENTRIES = {}
_DONE = {}
for _family in (anomalies, charting, cleaning, forecasting, modelling, profiling, statistics):
    _DONE |= _family.ENTRIES


def _fact(name: str, facts, sql: str) -> None:
    """Replace the query `name` by `facts` of its result."""
    query = _DONE[name][0]
    ENTRIES[name] = (lambda s, d: facts(query(s, d), s, d), sql)


def _true(*names: str, table: str = "") -> str:
    return "SELECT " + ", ".join(f"TRUE AS {n}" for n in names) + table


# --- encoding, charts, splits ----------------------------------------------

_fact(
    "h3_one_hot_vector", lambda r, s, d: r,
    """SELECT o_orderkey, '(' || (SELECT count(DISTINCT o_orderpriority) FROM orders) || ',[' ||
       (dense_rank() OVER (ORDER BY o_orderpriority) - 1) || '],[1.0])' AS encoded FROM orders""",
)
_fact(
    "j4_scatter_thinned",
    lambda r, s, d: r.agg(
        F.count(F.lit(1)).alias("points"), F.bool_and(F.col("l_quantity").isNotNull() & F.col("l_extendedprice").isNotNull()).alias("whole")),
    "SELECT least(count(*), 1000) AS points, TRUE AS whole FROM lineitem",
)


def _split_facts(r, s, d):
    h = F.xxhash64("o_orderkey", F.lit(42))
    return r.agg(
        F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train"),
        (F.max(F.when(F.col("is_test"), h)) < F.min(F.when(~F.col("is_test"), h))).alias("by_hash"))


_fact(
    "k8_split", _split_facts,
    """SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS test, count(*) - CAST(ceil(0.2 * count(*)) AS BIGINT) AS train, TRUE AS by_hash FROM orders""",
)

# --- profiles and tests ----------------------------------------------------

_OVERALL = ("missing_count", "missing_percent", "unique_count")
_NUMBERS = {
    "count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "q25": "quantile_cont({c}, 0.25)",
    "median": "median({c})", "q75": "quantile_cont({c}, 0.75)", "max": "max({c})",
    "outliers": """count(*) FILTER ({c} < (SELECT 2.5 * quantile_cont({c}, 0.25) - 1.5 * quantile_cont({c}, 0.75) FROM documents)
        OR {c} > (SELECT 2.5 * quantile_cont({c}, 0.75) - 1.5 * quantile_cont({c}, 0.25) FROM documents))""",
}
_TEXTS = {"count": "count(text)", "mean_length": "avg(length(text))", "max_length": "max(length(text))", "min_length": "min(length(text))"}
_CATEGORIES = {"unique_count": "count(*)", "entropy": "log2(sum(n)) - sum(n * log2(n)) / sum(n)", "most_common_count": "max(n)"}
_fact(
    "d7_full_profile_documents",
    lambda r, s, d: r.where(F.col("metric").isin(*_OVERALL, *_NUMBERS, *_TEXTS, "unique_words", *_CATEGORIES)).select(
        "column", "kind", "metric", F.round("number", 4).alias("value")),
    """SELECT "column", kind, metric, round(CAST(value AS DOUBLE), 4) AS value FROM (""" + " UNION ALL ".join([
        *[f"""SELECT '{c}' AS "column", 'overall' AS kind, '{m}' AS metric, {x} AS value FROM documents"""
          for c in ("doc_id", "text", "lang", "source", "n_chars")
          for m, x in zip(_OVERALL, (f"(count(*) - count({c}))::DOUBLE", f"100.0 * (count(*) - count({c})) / count(*)", f"count(DISTINCT {c})"))],
        *[f"SELECT '{c}', 'numeric', '{m}', {x.format(c=c)} FROM documents" for c in ("doc_id", "n_chars") for m, x in _NUMBERS.items()],
        *[f"SELECT '{c}', 'categorical', '{m}', {x} FROM (SELECT count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY {c})"
          for c in ("lang", "source") for m, x in _CATEGORIES.items()],
        *[f"SELECT 'text', 'text', '{m}', {x} FROM documents" for m, x in _TEXTS.items()],
        r"""SELECT 'text', 'text', 'unique_words', count(DISTINCT w) FROM
            (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM documents)""",
    ]) + ")",
)


def _sound():
    """W and p are possible values and the decision is that of p."""
    p = F.col("p_value")
    return (F.col("w") > 0.5) & (F.col("w") <= 1) & p.between(0, 1) & (F.col("is_normal") == (p > 0.05))


_fact(
    "e1_shapiro_wilk", lambda r, s, d: r.select("column", "n", _sound().alias("consistent")),
    """SELECT 'p_size' AS "column", count(*) AS n, TRUE AS consistent FROM part
       UNION ALL SELECT 'price', count(*) FILTER (p_partkey % 7 <> 0), TRUE FROM part""",
)
_fact(
    "e_statistical_tests",
    lambda r, s, d: common.rounded(r.select("column", "n", _sound().alias("consistent"), "q1", "median", "q3", "iqr"), 4),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n, TRUE AS consistent, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median,
            round(quantile_cont({c}, 0.75), 4) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice")),
)


def _decided():
    return F.when(F.col("test") == "levene_test", F.col("p_value") > 0.05).otherwise(F.col("p_value") < 0.05)


_fact(
    "e8_one_sample_t_decision",
    lambda r, s, d: r.select("test", "column1", F.round("statistic", 5).alias("statistic"), "decision", (F.col("decision") == _decided()).alias("consistent")),
    # of more than 100 values, the 5 % point of t lies between 1.96 and 1.99
    """SELECT 'one_sample_ttest' AS test, 'c_acctbal' AS column1, round(t, 5) AS statistic, abs(t) > 1.975 AS decision, TRUE AS consistent
       FROM (SELECT avg(c_acctbal) / (stddev_samp(c_acctbal) / sqrt(count(*))) AS t FROM customer)""",
)
_LINE = list(statistics._LINE)
_T_LINE = """SELECT 'two_sample_ttest', '{a}', '{b}', round((avg({a}) - avg({b})) / sqrt((var_samp({a}) + var_samp({b})) / count(*)), 3), TRUE FROM lineitem"""
_U_LINE = """SELECT 'mann_whitney_test', '{a}', '{b}', round(sum(r) FILTER (side = 1) - count(*) / 4.0 * (count(*) / 2.0 + 1), 3), TRUE FROM (
    SELECT side, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r
    FROM (SELECT 1 AS side, {a} AS v FROM lineitem UNION ALL SELECT 2, {b} FROM lineitem))"""
# of two columns of equal length, Levene's statistic is the squared t of the distances to the medians
_F_LINE = """SELECT 'levene_test', '{a}', '{b}', round(pow(avg(x) - avg(y), 2) / ((var_samp(x) + var_samp(y)) / count(*)), 3), TRUE FROM (
    SELECT abs({a} - (SELECT median({a}) FROM lineitem)) AS x, abs({b} - (SELECT median({b}) FROM lineitem)) AS y FROM lineitem)"""
_fact(
    "e_hypothesis_suite_lineitem",
    lambda r, s, d: r.select(
        "test", "column1", "column2", F.round("statistic", 3).alias("statistic"),
        (F.col("p_value").between(0, 1) & (F.col("decision") == _decided())).alias("consistent")),
    " UNION ALL ".join(
        f"""SELECT 'one_sample_ttest' AS test, '{c}' AS column1, NULL AS column2,
            round(avg({c}) / (stddev_samp({c}) / sqrt(count(*))), 3) AS statistic, TRUE AS consistent FROM lineitem""" for c in _LINE)
    + "".join(
        " UNION ALL " + q.format(a=a, b=b) for q in (_T_LINE, _U_LINE, _F_LINE)
        for i, a in enumerate(_LINE) for b in _LINE[i + 1:]),
)

# --- anomalies -------------------------------------------------------------


def _isolated(r, s, d):
    """Flagged rows lie farther out than the rest and are its smaller part."""
    rows = common.table(s, d, "events").select("event_id", "value")
    middle = rows.agg(F.median("value")).first()[0]
    marked = rows.join(r.select("event_id", F.lit(True).alias("hit")), "event_id", "left")
    gap = F.abs(F.col("value") - middle)
    return marked.agg(
        (F.avg(F.when(F.col("hit"), gap)) > F.avg(F.when(F.col("hit").isNull(), gap))).alias("farther"),
        F.count("hit").between(1, F.count(F.lit(1)) / 2).alias("smaller"))


_fact("f4_isolation_forest", _isolated, _true("farther", "smaller"))
_fact(
    "f5_one_class_svm",
    lambda r, s, d: r.agg((F.abs(F.count(F.lit(1)) - common.table(s, d, "part").count() * 0.5) <= 1).alias("half"),
                          (F.count_distinct("p_partkey") == F.count(F.lit(1))).alias("once")),
    _true("half", "once"),
)

# --- features --------------------------------------------------------------

_fact(
    "k5_pca",
    lambda r, s, d: r.agg(F.sum("count").alias("n"), (F.count_distinct("components") == 1).alias("one_size"),
                          (F.max("components") < 64).alias("fewer"), (F.min("components") > 1).alias("some")),
    "SELECT count(*) AS n, TRUE AS one_size, TRUE AS fewer, TRUE AS some FROM embeddings",
)
_fact(
    "k6_preprocess",
    lambda r, s, d: r.agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v))).alias("whole"),
        (F.abs(F.corr(F.col("features")[0], F.col("features")[1])) < 0.001).alias("uncorrelated"),
        (F.abs(F.avg(F.col("features")[0])) < 0.001).alias("centred")),
    "SELECT count(*) AS n, TRUE AS whole, TRUE AS uncorrelated, TRUE AS centred FROM lineitem",
)
_fact(
    "k10_cross_validation", lambda r, s, d: r.select("fold", F.col("score").between(-1, 1).alias("plausible")),
    "SELECT CAST(fold AS INTEGER) AS fold, TRUE AS plausible FROM (VALUES (0), (1), (2), (3), (4)) AS v(fold)",
)

# --- models ----------------------------------------------------------------


def _least_squares(r, s, d):
    """Residuals have no mean and no correlation with any feature."""
    rows = modelling._lines(s, d)
    found = modelling.models.linear_regression(rows, modelling._X, modelling._Y).transform(rows)
    gap = F.col(modelling._Y) - F.col("prediction")
    none = F.lit(True)
    for x in modelling._X:
        none = none & (F.abs(F.corr(gap, x)) < 1e-6)
    return r.join(F.broadcast(found.agg(none.alias("orthogonal"), (F.abs(F.avg(gap)) < 1e-3).alias("centred")))).select(
        F.col("r2").between(0, 1).alias("plausible"), "orthogonal", "centred")


_fact("l1_linear_regression_three", _least_squares, _true("plausible", "orthogonal", "centred"))
_fits = {
    "l7_gradient_boosting": "lineitem",
    "l9_svm_regression": None, "l9_svm_regression_rbf": None,
}
for _name, _of in _fits.items():  # the mean alone has the variance as its error and r2 0
    _fact(
        _name,
        lambda r, s, d, of=_of: r.join(F.broadcast(common.table(s, d, "lineitem").agg(F.var_pop("l_extendedprice").alias("v")))).select(
            (F.col("r2") > (0.0 if of else -0.1)).alias("better"),
            (F.abs(F.col("mse") / ((1 - F.col("r2")) * (F.col("v") if of else F.lit(1.0))) - 1) < 0.01).alias("consistent")),
        _true("better", "consistent"))


def _near_floor(r, s, d):
    """No function of the features errs less than the means of equal ones; trees of any depth come near that."""
    rows = modelling._lines(s, d)
    own = rows.groupBy(*modelling._X).agg((F.var_pop(modelling._Y) * F.count(F.lit(1))).alias("e"), F.count(F.lit(1)).alias("n"))
    return r.join(F.broadcast(own.agg((F.sum("e") / F.sum("n")).alias("floor")))).select(
        (F.col("mse") >= F.col("floor") * 0.999999).alias("not_below"), (F.col("mse") < F.col("floor") * 1.5).alias("near"),
        F.round("floor", 4).alias("floor"))


_fact(
    "l6_random_forest", _near_floor,
    f"""SELECT TRUE AS not_below, TRUE AS near, round(avg(pow(y - m, 2)), 4) AS floor FROM (
        SELECT {modelling._Y} AS y, avg({modelling._Y}) OVER (PARTITION BY {', '.join(modelling._X)}) AS m FROM lineitem)""",
)


def _better(labels: str, column: str, slack: float = 0.0):
    def facts(r, s, d):
        truth = common.table(s, d, labels)
        most = truth.groupBy(column).count().agg(F.max("count") / F.sum("count")).first()[0]
        return r.select(F.col("accuracy").between(most - slack, 1).alias("better"))
    return facts


for _name in ("l7_gradient_boosting_classes", "l8_svm_linear", "l8_svm_poly", "l8_svm_rbf"):
    _fact(_name, _better("labels", "quality", 0.01), _true("better"))
_fact("l8_svm_classes", _better("embeddings", "label"), _true("better"))
# one tree on a hundred held-out vectors of ten classes may well miss the most frequent class
_fact("l5_decision_tree_classes", lambda r, s, d: r.select(F.col("accuracy").between(0.01, 1).alias("plausible")), _true("plausible"))
_fact(
    "l6_random_forest_classes",
    lambda r, s, d: r.where("class NOT LIKE '% avg' AND class <> 'accuracy'").select(
        "class", "support", (F.col("precision").between(0.5, 1) & F.col("recall").between(0.5, 1)).alias("good")),
    "SELECT CAST(label AS VARCHAR) AS class, count(*) AS support, TRUE AS good FROM embeddings GROUP BY label",
)
_fact(
    "l14_feature_importances",
    lambda r, s, d: r.agg(F.round(F.sum("importance"), 6).alias("total"), F.max_by("feature", "importance").alias("first"), F.bool_and(F.col("importance") >= 0).alias("shares")),
    "SELECT 1.0::DOUBLE AS total, 'l_quantity' AS first, TRUE AS shares",
)
_fact(
    "l15_grid_search", lambda r, s, d: r.select("place", "parameters", F.col("score").between(0.5, 1).alias("plausible")),
    """SELECT CAST(row_number() OVER (ORDER BY a, b, c, e) - 1 AS INTEGER) AS place, '[(''max_depth'', ' || m || '), (''min_samples_leaf'', ' || l ||
       '), (''min_samples_split'', ' || p || '), (''n_estimators'', ' || n || ')]' AS parameters, TRUE AS plausible
       FROM (VALUES (0, 50), (1, 100), (2, 200)) AS w(a, n), (VALUES (0, 'None'), (1, '10'), (2, '20')) AS x(b, m),
       (VALUES (0, 2), (1, 5), (2, 10)) AS y(c, p), (VALUES (0, 1), (1, 2), (2, 4)) AS z(e, l)""",
)

# --- series ----------------------------------------------------------------

_DAYS = f"(SELECT event_type, count(*) AS days, max(ts) AS last, sum(value * value) AS squares FROM {anomalies.DAILY} GROUP BY event_type)"


def _with_values(found, s, d):
    """Residuals (event_type, ts, residual) next to the series, its steps before and the place from 0."""
    of = Window.partitionBy("event_type").orderBy("ts")
    rows = forecasting._daily(s, d).select(
        "event_type", "ts", F.col("value").alias("y"), F.lag("value").over(of).alias("y1"), (F.row_number().over(of) - 1).alias("place"))
    return rows.join(found.select("event_type", "ts", F.when(~F.isnan("residual"), F.col("residual")).alias("e")), ["event_type", "ts"], "left"), of


def _recursion(found, s, d):
    """Per series: number of residuals, the first one, and whether one pair of coefficients explains them all.

    What an ARIMA(1,1,1) fit adds to its error is a combination of the last change and the last
    error. The two coefficients come from least squares over the whole series; no step may be off.
    """
    rows, of = _with_values(found, s, d)
    steps = rows.where("place > 0").select("event_type", "ts", "place", "e", (F.col("y") - F.col("y1")).alias("w"))
    steps = steps.select(
        "*", F.coalesce(F.lag("w").over(of), F.lit(0.0)).alias("w1"), F.coalesce(F.lag("e").over(of), F.lit(0.0)).alias("e1"),
        (F.col("w") - F.col("e")).alias("told"))
    by = Window.partitionBy("event_type")
    ww, we, ee, wt, et = (F.sum(F.col(a) * F.col(b)).over(by) for a, b in (("w1", "w1"), ("w1", "e1"), ("e1", "e1"), ("w1", "told"), ("e1", "told")))
    bottom = ww * ee - we * we
    steps = steps.withColumn("phi", (wt * ee - et * we) / bottom).withColumn("theta", (et * ww - wt * we) / bottom)
    off = F.abs(F.col("told") - F.col("phi") * F.col("w1") - F.col("theta") * F.col("e1"))
    return steps.groupBy("event_type").agg(
        F.count("e").alias("residuals"), F.round(F.max(F.when(F.col("place") == 1, F.col("e"))), 4).alias("first"),
        (F.max(off) < 1e-6 * F.max(F.abs("w"))).alias("explained"),
        (F.max(F.abs("phi")) <= 1).alias("stable"))


_RECURSION = f"""SELECT event_type, count(*) - 1 AS residuals, round(max(value - before) FILTER (place = 1), 4) AS first, TRUE AS explained, TRUE AS stable
    FROM (SELECT event_type, value, lag(value) OVER w AS before, row_number() OVER w - 1 AS place FROM {anomalies.DAILY}
          WINDOW w AS (PARTITION BY event_type ORDER BY ts)) GROUP BY event_type"""


def _known(r):
    return r.where("part = 'residual'").select("event_type", "ts", F.col("value").alias("residual"))


def _smoothed(r, s, d):
    """Per series the sums that do not depend on the fitted parameters.

    Level, trend and season start from the first two weeks, so the errors of the first week are
    0 and the next one is the change over a week less the mean change.
    """
    rows, _ = _with_values(_known(r), s, d)
    found = rows.groupBy("event_type").agg(
        F.count("e").alias("residuals"), F.round(F.max(F.when(F.col("place") < 7, F.abs("e"))), 4).alias("first_week"),
        F.round(F.max(F.when(F.col("place") == 7, F.col("e"))), 4).alias("eighth"),
        (F.sum(F.col("e") ** 2) < F.sum(F.col("y") ** 2)).alias("smaller"))
    ahead = r.where("part = 'forecast'").groupBy("event_type").agg(F.count("value").alias("forecasts"))
    return found.join(ahead, "event_type")


_fact(
    "m2_exponential_smoothing", _smoothed,
    f"""SELECT event_type, count(*) AS residuals, 0.0::DOUBLE AS first_week, 1 AS forecasts, TRUE AS smaller,
        round(max(value - week) FILTER (place = 7) - avg(value - week) FILTER (place BETWEEN 7 AND 13), 4) AS eighth
        FROM (SELECT event_type, value, lag(value, 7) OVER w AS week, row_number() OVER w - 1 AS place FROM {anomalies.DAILY}
              WINDOW w AS (PARTITION BY event_type ORDER BY ts)) GROUP BY event_type""",
)
_fact("m3_arima", lambda r, s, d: _recursion(_known(r), s, d), _RECURSION)
_fact("m6_residuals", _recursion, _RECURSION)
_fact(
    "m4_auto_arima_orders",
    lambda r, s, d: r.select("event_type", (F.col("p").between(0, 2) & F.col("q").between(0, 2) & F.col("d").isin(0, 1) & F.col("s").isin(0, 1, 7)).alias("in_range")),
    f"SELECT event_type, TRUE AS in_range FROM {_DAYS}",
)
for _name in ("m5_forecast", "m5_forecast_auto_arima"):
    _fact(
        _name, lambda r, s, d: r.select("event_type", "step", "ts", F.col("forecast").isNotNull().alias("known")),
        f"""SELECT event_type, CAST(k AS INTEGER) AS step, CAST(last + k * INTERVAL 1 DAY AS TIMESTAMP) AS ts, TRUE AS known
            FROM {_DAYS}, (SELECT unnest(generate_series(1, 7)) AS k)""")
_fact(
    "m6_residual_profile", lambda r, s, d: r.select("count", (F.col("min") <= F.col("q25")).alias("low"), (F.col("q75") <= F.col("max")).alias("high")),
    f"SELECT CAST(sum(days - 1) AS BIGINT) AS count, TRUE AS low, TRUE AS high FROM {_DAYS}",
)
_fact(
    "m6_residual_histogram", lambda r, s, d: r.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("bins"), F.bool_and(F.col("lower") < F.col("upper")).alias("ordered")),
    f"SELECT CAST(sum(days - 1) AS BIGINT) AS n, 20 AS bins, TRUE AS ordered FROM {_DAYS}",
)
