"""Anomaly detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import anomaly, normalize
from lodestat.operators.series import decompose, prepare_series
from lodestat.registry.common import rounded, table

ENTRIES = {}


def _add(name, query, sql=None):
    ENTRIES[name] = (query, sql)


def _events(spark, folder):
    return table(spark, folder, "events").select("event_id", "value")


_add(
    "f1_three_sigma", lambda s, d: anomaly.three_sigma(_events(s, d), "value"),
    """SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
       WHERE value < m - 3 * s OR value > m + 3 * s""",
)
_add(
    "f2_iqr", lambda s, d: anomaly.iqr(_events(s, d), "value"),
    """SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
       WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
)
_add(
    "f3_z_score", lambda s, d: anomaly.z_score(_events(s, d), "value", 2.5),
    """SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
       WHERE abs((value - m) / s) > 2.5""",
)
_add(
    "f_detect_by_name",
    lambda s, d: anomaly.detect_anomalies(table(s, d, "lineitem").select("l_orderkey", "l_extendedprice"), "zscore", "l_extendedprice", threshold=1.7),
    """SELECT l_orderkey, l_extendedprice FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem)
       WHERE abs((l_extendedprice - m) / s) > 1.7""",
)


def _scaled(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice")
    return part.withColumns({"x": F.col("p_size") / 2.0, "y": F.col("p_retailprice") / 20.0})


_SCALED = "(SELECT p_partkey, p_size / 2.0 AS x, p_retailprice / 20.0 AS y FROM part)"
_add("f4_isolation_forest", lambda s, d: anomaly.isolation_forest(
    table(s, d, "events").select("event_id", "value", "user_id"), ["value", "user_id"], key="event_id"))
_add("f5_one_class_svm", lambda s, d: anomaly.one_class_svm(
    normalize.z_score(table(s, d, "part").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y")), ["x", "y"]), ["x", "y"]))
_add(
    "f6_dbscan_noise",
    lambda s, d: anomaly.dbscan_noise(_scaled(s, d), ["x", "y"], eps=0.4, min_samples=4).select("p_partkey"),
    f"""WITH g AS {_SCALED}, pairs AS (SELECT a.p_partkey AS k, b.p_partkey AS other FROM g a JOIN g b
          ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.4 * 0.4),
        core AS (SELECT k FROM pairs GROUP BY k HAVING count(*) >= 4)
        SELECT p_partkey FROM g WHERE p_partkey NOT IN (SELECT k FROM pairs WHERE other IN (SELECT k FROM core))""",
)
_add(
    "f7_knn_distance",
    lambda s, d: anomaly.knn_distance(_scaled(s, d), ["x", "y"], n_neighbors=5, threshold=0.22).select("p_partkey"),
    f"""WITH g AS {_SCALED}, ranked AS (SELECT a.p_partkey AS k,
          sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist,
          row_number() OVER (PARTITION BY a.p_partkey ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS r
          FROM g a CROSS JOIN g b)
        SELECT k AS p_partkey FROM ranked WHERE r <= 5 GROUP BY k HAVING avg(dist) > 0.22""",
)


def _daily(spark, folder):
    return prepare_series(table(spark, folder, "events"), "ts", "value", "event_type")


DAILY = """(SELECT c.event_type, c.ts, coalesce(v.value, 0) AS value FROM
  (SELECT event_type, unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)), INTERVAL 1 DAY)) AS ts
   FROM events GROUP BY event_type) c
  LEFT JOIN (SELECT event_type, date_trunc('day', ts) AS ts, sum(value) AS value FROM events GROUP BY ALL) v
  ON c.event_type = v.event_type AND c.ts = v.ts)"""
_TREND = {
    7: "avg(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)",
    4: """(sum(value) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
         - 0.5 * lag(value, 2) OVER (PARTITION BY event_type ORDER BY ts)
         - 0.5 * lead(value, 2) OVER (PARTITION BY event_type ORDER BY ts)) / 4""",
}


def _parts_sql(period: int) -> str:
    return f"""WITH v AS {DAILY},
      i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM v),
      t AS (SELECT *, CASE WHEN i >= {period // 2} AND i < n - {period // 2} THEN {_TREND[period]} END AS trend FROM i),
      p AS (SELECT event_type, i % {period} AS ph, avg(value - trend) AS m FROM t GROUP BY ALL),
      s AS (SELECT event_type, ph, m - avg(m) OVER (PARTITION BY event_type) AS seasonal FROM p),
      r AS (SELECT t.event_type, t.ts, t.value, trend, seasonal, value - trend - seasonal AS residual
            FROM t JOIN s ON t.event_type = s.event_type AND i % {period} = ph)"""


_add(
    "f8_seasonal_residual",
    lambda s, d: rounded(anomaly.seasonal_residual(_daily(s, d), "value", "ts", 7, 400.0, "event_type"), 2),
    _parts_sql(7) + " SELECT event_type, ts, round(value, 2) AS value FROM r WHERE abs(residual) > 400",
)
_add(
    "f8_decompose_even_period",
    lambda s, d: rounded(decompose(_daily(s, d), "value", "ts", 4, "event_type"), 6),
    _parts_sql(4) + """ SELECT event_type, ts, round(value, 6) AS value, round(trend, 6) AS trend,
      round(seasonal, 6) AS seasonal, round(residual, 6) AS residual FROM r""",
)
