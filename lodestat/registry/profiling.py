"""Profiles and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import profile, validate
from lodestat.registry.common import GAPPY_PRICE, GAPPY_QUANTITY, GAPPY_TEXT, rounded, table

ENTRIES = {}


def _add(name, query, sql=None):
    ENTRIES[name] = (query, sql)


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", F.expr(GAPPY_QUANTITY).alias("l_quantity"), "l_discount", "l_returnflag", "l_shipdate")


_LINES = f"WITH g AS (SELECT l_orderkey, {GAPPY_QUANTITY} AS l_quantity, l_discount, l_returnflag, l_shipdate FROM lineitem)"
_NAMES = ("l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
_NUMBERS = ("l_orderkey", "l_quantity", "l_discount")


def _per_column(template: str, names=_NAMES) -> str:
    return _LINES + " " + " UNION ALL ".join(template.format(c=c) for c in names)


_add(
    "d1a_shape", lambda s, d: profile.table_shape(_lines(s, d)),
    _LINES + " SELECT count(*) AS rows, 5::BIGINT AS columns FROM g",
)
_add(
    "d1c_missing_report", lambda s, d: rounded(profile.missing_report(_lines(s, d))),
    _per_column("""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
                   round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_percent FROM g"""),
)
_add(
    "d1d_duplicate_rows",
    lambda s, d: profile.duplicate_count(table(s, d, "lineitem").select("l_partkey", "l_quantity", "l_discount")),
    """SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_quantity, l_discount FROM lineitem)) AS BIGINT)
       AS duplicates FROM lineitem""",
)
_add(
    "d1e_size_estimate", lambda s, d: profile.size_estimate(_lines(s, d)),
    _LINES + " " + " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", count(*) * 8 AS bytes FROM g" for c in _NAMES if c != "l_returnflag"]
        + ["SELECT 'l_returnflag', CAST(sum(strlen(l_returnflag)) AS BIGINT) FROM g"]),
)
_add(
    "d1g_unique_counts", lambda s, d: profile.unique_counts(_lines(s, d)),
    _per_column("SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM g"),
)
_RANGE = "SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS \"min\", CAST(max({c}) AS DOUBLE) AS \"max\" FROM g"
_add(
    "d1h_value_ranges", lambda s, d: profile.value_ranges(_lines(s, d)),
    _per_column(_RANGE, _NUMBERS)
    + " UNION ALL SELECT 'l_returnflag', NULL, NULL UNION ALL SELECT 'l_shipdate', NULL, NULL",
)
_TYPES = "(VALUES ('l_orderkey', 'bigint', false), ('l_quantity', 'double', false), ('l_discount', 'double', false), " \
    "('l_returnflag', 'string', true), ('l_shipdate', 'timestamp_ntz', false)) AS k(\"column\", \"type\", categorical)"
_add(
    "d1_overall_report",
    lambda s, d: rounded(profile.overall_report(_lines(s, d)).drop("bytes")),
    _LINES + f""" SELECT k."column", k."type", k.categorical, m.missing_count, m.missing_percent, m.unique_count, m."min", m."max"
    FROM {_TYPES} JOIN ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_percent, count(DISTINCT {c}) AS unique_count,
        {f'CAST(min({c}) AS DOUBLE)' if c in _NUMBERS else 'NULL'} AS "min",
        {f'CAST(max({c}) AS DOUBLE)' if c in _NUMBERS else 'NULL'} AS "max" FROM g""" for c in _NAMES)
    + ') AS m ON m."column" = k."column"',
)


def numeric_profile_sql(source: str, columns: dict[str, int]) -> str:
    """SQL for the numeric profile of columns of a subquery named g."""
    one = """SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), {r}) AS mean,
        round(stddev_samp({c}), {r}) AS std, round(min({c}), {r}) AS "min", round(max({c}), {r}) AS "max",
        round(any_value(q[1]), {r}) AS q25, round(any_value(q[2]), {r}) AS median, round(any_value(q[3]), {r}) AS q75,
        round(skewness({c}), 5) AS skewness, round(kurtosis({c}), 5) AS kurtosis,
        count(*) FILTER ({c} < q[1] - 1.5 * (q[3] - q[1]) OR {c} > q[3] + 1.5 * (q[3] - q[1])) AS outliers
        FROM g, (SELECT quantile_cont({c}, [0.25, 0.5, 0.75]) AS q FROM g)"""
    return f"WITH g AS ({source}) " + " UNION ALL ".join(one.format(c=c, r=r) for c, r in columns.items())


_add(
    "d2_numeric_profile",
    lambda s, d: rounded(profile.numeric_profile(table(s, d, "lineitem").select(
        F.expr(GAPPY_QUANTITY).alias("l_quantity"), "l_extendedprice", "l_discount", "l_tax")), 4, skewness=5, kurtosis=5),
    numeric_profile_sql(f"SELECT {GAPPY_QUANTITY} AS l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
                        dict.fromkeys(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 4)),
)
_add(
    "d2_numeric_profile_events",
    lambda s, d: rounded(profile.numeric_profile(table(s, d, "events"), "value"), 4, skewness=5, kurtosis=4),
    numeric_profile_sql("SELECT value FROM events", {"value": 4}).replace("kurtosis(value), 5", "kurtosis(value), 4"),
)
_COUNTS = """(SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY ALL)"""
_add(
    "d3_categorical_profile",
    lambda s, d: rounded(profile.categorical_profile(table(s, d, "orders"))),
    f"""SELECT "column", count(*) AS unique_count, round(-sum(n / total * log2(n / total)), 6) AS entropy,
        arg_min(value, (-n, value)) AS most_common, max(n) AS most_common_count
        FROM (SELECT *, sum(n) OVER (PARTITION BY "column") AS total FROM {_COUNTS}) GROUP BY "column" """,
)
_add(
    "d3_top_values", lambda s, d: profile.top_values(table(s, d, "part").select("p_brand", "p_type")),
    """SELECT "column", CAST(p AS INTEGER) AS position, value, n AS "count" FROM (
       SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS p FROM (
       SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL
       SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL)) WHERE p <= 10""",
)
_add(
    "d4_datetime_profile",
    lambda s, d: profile.datetime_profile(table(s, d, "events")),
    """SELECT 'ts' AS "column", min(ts) AS min_date, max(ts) AS max_date,
       CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS range_seconds, count(ts) AS "count" FROM events""",
)
_add(
    "d4_datetime_profile_text",
    lambda s, d: profile.datetime_profile(table(s, d, "events").select(
        F.expr("CASE WHEN event_id % 13 = 0 THEN 'never' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END").alias("at")), "at"),
    """WITH g AS (SELECT date_trunc('second', ts) AS ts FROM events WHERE event_id % 13 <> 0)
       SELECT 'at' AS "column", min(ts) AS min_date, max(ts) AS max_date,
       CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS range_seconds, count(ts) AS "count" FROM g""",
)
_add(
    "d4_weekday_counts", lambda s, d: profile.weekday_counts(table(s, d, "events")),
    "SELECT 'ts' AS \"column\", dayname(ts) AS weekday, count(*) AS \"count\" FROM events GROUP BY ALL",
)
_WORDS = r"(SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS word FROM documents)"


def _spaced(spark, folder):
    return table(spark, folder, "documents").select("text")


_add(
    "d5_text_profile", lambda s, d: rounded(profile.text_profile(_spaced(s, d)), 4),
    f"""SELECT 'text' AS "column", count(*) AS "count", round(avg(length(text)), 4) AS mean_length,
        CAST(max(length(text)) AS INTEGER) AS max_length, CAST(min(length(text)) AS INTEGER) AS min_length,
        (SELECT count(DISTINCT word) FROM {_WORDS}) AS unique_words FROM documents""",
)
_add(
    "d5_top_words", lambda s, d: profile.top_words(_spaced(s, d)),
    f"""SELECT 'text' AS "column", CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER) AS position, word, n AS "count"
        FROM (SELECT word, count(*) AS n FROM {_WORDS} GROUP BY word) ORDER BY position LIMIT 10""",
)
_add(
    "d6_missing_report",
    lambda s, d: rounded(profile.missing_report(table(s, d, "documents").select("doc_id", F.expr(GAPPY_TEXT).alias("text")))),
    f"""WITH g AS (SELECT doc_id, {GAPPY_TEXT} AS text FROM documents)
        SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS missing_count, 0.0::DOUBLE AS missing_percent FROM g UNION ALL
        SELECT 'text', count(*) - count(text), round((count(*) - count(text)) * 100.0::DOUBLE / count(*), 6) FROM g""",
)


def _profile_rows(query):
    return query.select("column", "kind", "metric", F.round("number", 4).alias("number"), "text")


_WIDE = numeric_profile_sql("SELECT o_totalprice FROM orders", {"o_totalprice": 12}).replace("), 5) AS", "), 12) AS")
_add(
    "d7_full_profile",
    lambda s, d: _profile_rows(profile.full_profile(
        table(s, d, "orders").select("o_totalprice", "o_orderdate", "o_orderpriority"))),
    f"""WITH overall AS (
      SELECT 'o_totalprice' AS c, count(DISTINCT o_totalprice) AS u FROM orders UNION ALL
      SELECT 'o_orderdate', count(DISTINCT o_orderdate) FROM orders UNION ALL
      SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders),
    num AS ({_WIDE}),
    cat AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)
    SELECT c AS "column", 'overall' AS kind, 'missing_count' AS metric, 0.0::DOUBLE AS number, NULL AS text FROM overall
    UNION ALL SELECT c, 'overall', 'missing_percent', 0.0, NULL FROM overall
    UNION ALL SELECT c, 'overall', 'unique_count', u, NULL FROM overall
    UNION ALL SELECT "column", 'numeric', metric, round(number, 4), NULL FROM
      (UNPIVOT (SELECT "column", CAST("count" AS DOUBLE) AS "count", mean, std, "min", q25, median, q75, "max",
        skewness, kurtosis, CAST(outliers AS DOUBLE) AS outliers FROM num) ON COLUMNS(* EXCLUDE ("column")) INTO NAME metric VALUE number)
    UNION ALL SELECT 'o_orderdate', 'datetime', 'count', count(*), NULL FROM orders
    UNION ALL SELECT 'o_orderdate', 'datetime', 'range_seconds', epoch(max(o_orderdate)) - epoch(min(o_orderdate)), NULL FROM orders
    UNION ALL SELECT 'o_orderdate', 'datetime', 'min_date', NULL, CAST(min(o_orderdate) AS VARCHAR) FROM orders
    UNION ALL SELECT 'o_orderdate', 'datetime', 'max_date', NULL, CAST(max(o_orderdate) AS VARCHAR) FROM orders
    UNION ALL SELECT 'o_orderdate', 'datetime', 'weekday: ' || dayname(o_orderdate), count(*), NULL FROM orders GROUP BY ALL
    UNION ALL SELECT 'o_orderpriority', 'categorical', 'unique_count', count(*), NULL FROM cat
    UNION ALL SELECT 'o_orderpriority', 'categorical', 'entropy',
        round(-sum(n / t * log2(n / t)), 4), NULL FROM cat, (SELECT sum(n) AS t FROM cat)
    UNION ALL SELECT 'o_orderpriority', 'categorical', 'most_common', NULL, arg_min(v, (-n, v)) FROM cat
    UNION ALL SELECT 'o_orderpriority', 'categorical', 'most_common_count', max(n), NULL FROM cat
    UNION ALL SELECT 'o_orderpriority', 'categorical', 'value: ' || v, n, NULL FROM cat""",
)
_add(
    "d7_full_profile_documents",
    lambda s, d: _profile_rows(profile.full_profile(table(s, d, "documents"))),
)
_add(
    "d8_load_summary", lambda s, d: profile.load_summary(_lines(s, d)),
    _LINES + """ SELECT c AS "column", t AS "type", k AS kind, (SELECT count(*) FROM g) AS rows,
      CASE WHEN c = 'l_quantity' THEN (SELECT count(*) - count(l_quantity) FROM g) ELSE 0 END AS missing
      FROM (VALUES ('l_orderkey', 'bigint', 'numeric'), ('l_quantity', 'double', 'numeric'), ('l_discount', 'double', 'numeric'),
      ('l_returnflag', 'string', 'text'), ('l_shipdate', 'timestamp_ntz', 'other')) AS v(c, t, k)""",
)

# --- validation ------------------------------------------------------------

_ODD = "CASE WHEN event_id % 101 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 103 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END"


def _odd_values(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", F.expr(_ODD).alias("value"))


def _verdict(df, *columns):
    return df.select("is_valid", F.array_join("errors", "; ").alias("errors"), *columns)


_add(
    "i1a_numeric_check",
    lambda s, d: _verdict(validate.validate_1d(table(s, d, "part").select(F.col("p_brand").alias("x")), "x"), "not_numeric"),
    "SELECT false AS is_valid, 'data must be numeric' AS errors, count(*) AS not_numeric FROM part",
)
_add(
    "i1_values_check",
    lambda s, d: rounded(_verdict(validate.validate_1d(_odd_values(s, d), "value"), "points", "nan", "infinite"), 6),
    f"""WITH g AS (SELECT {_ODD} AS value FROM events)
        SELECT false AS is_valid, 'NaN values present; infinite values present' AS errors, count(*) AS points,
        count(*) FILTER (isnan(value)) AS nan, count(*) FILTER (isinf(value)) AS infinite FROM g""",
)
_add(
    "i1e_outlier_check",
    lambda s, d: rounded(validate.validate_1d(
        table(s, d, "part").select(F.expr("CASE WHEN p_partkey % 8 = 0 THEN p_retailprice * 9 ELSE p_retailprice END").alias("x")), "x")
        .select("is_valid", "outlier_percentage"), 6),
    """WITH g AS (SELECT CASE WHEN p_partkey % 8 = 0 THEN p_retailprice * 9 ELSE p_retailprice END AS x FROM part),
       s AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM g),
       o AS (SELECT count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) * 100.0::DOUBLE / count(*) AS p FROM g, s)
       SELECT p <= 10 AS is_valid, round(p, 6) AS outlier_percentage FROM o""",
)
_add(
    "i2_pair_check",
    lambda s, d: _verdict(validate.validate_2d(
        table(s, d, "part").select("p_size", F.expr(GAPPY_PRICE).alias("price")), "p_size", "price"), "points", "count_0", "count_1", "nan"),
    f"""SELECT false AS is_valid, 'columns must have equal length; NaN values present' AS errors, count(*) AS points,
        count(*) AS count_0, count({GAPPY_PRICE}) AS count_1, count(*) - count({GAPPY_PRICE}) AS nan FROM part""",
)
_add(
    "i2c_ordered_x_check",
    lambda s, d: _verdict(validate.validate_2d(
        table(s, d, "part"), "p_retailprice", "p_size", "line", order_by="p_partkey"), "order_breaks"),
    """WITH b AS (SELECT count(*) FILTER (p_retailprice <= prev) AS n FROM
       (SELECT p_retailprice, lag(p_retailprice) OVER (ORDER BY p_partkey) AS prev FROM part))
       SELECT n = 0 AS is_valid, CASE WHEN n > 0 THEN 'x must be ordered for line' ELSE '' END AS errors, n AS order_breaks FROM b""",
)
_add(
    "i2c_ordered_key_check",
    lambda s, d: _verdict(validate.validate_2d(
        table(s, d, "orders"), "o_orderkey", "o_totalprice", "bar", order_by="o_orderkey"), "order_breaks"),
    "SELECT true AS is_valid, '' AS errors, CAST(0 * count(*) AS BIGINT) AS order_breaks FROM orders",
)
_add(
    "i3a_points_check",
    lambda s, d: _verdict(validate.validate_3d_points(_odd_values(s, d), "event_id", "user_id", "value"), "points", "nan", "infinite"),
    f"""WITH g AS (SELECT {_ODD} AS value FROM events)
        SELECT false AS is_valid, 'NaN values present; infinite values present' AS errors, count(*) AS points,
        count(*) FILTER (isnan(value)) AS nan, count(*) FILTER (isinf(value)) AS infinite FROM g""",
)


def _cells(spark, folder):
    return table(spark, folder, "part").groupBy(
        (F.col("p_size") % 5).alias("row"), (F.col("p_partkey") % 4).cast("int").alias("col")
    ).agg(F.avg("p_retailprice").alias("z"))


_add(
    "i3b_grid_check",
    lambda s, d: _verdict(validate.validate_3d_grid(_cells(s, d), "row", "col", "z"), "cells", "area", "repeated"),
    """WITH g AS (SELECT DISTINCT p_size % 5 AS r, p_partkey % 4 AS c FROM part)
       SELECT count(*) = (max(r) + 1) * (max(c) + 1) AS is_valid, '' AS errors, count(*) AS cells,
       CAST((max(r) + 1) * (max(c) + 1) AS BIGINT) AS area, CAST(0 AS BIGINT) AS repeated FROM g""",
)
_add(
    "i_validate_by_chart",
    lambda s, d: validate.validate(table(s, d, "part"), "scatter3d", "p_partkey", "p_size", "p_retailprice")
    .select("is_valid", F.array_join("errors", "; ").alias("errors")),
    "SELECT count(*) > 0 AS is_valid, '' AS errors FROM part",
)
