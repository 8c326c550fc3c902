"""Chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import charts
from lodestat.registry.common import GAPPY_PRICE, rounded, table

ENTRIES = {}


def _add(name, query, sql=None):
    ENTRIES[name] = (query, sql)


_BIN = "CAST(least(floor(({v} - {lo}) / ({hi} - {lo}) * {k}), {k} - 1) AS INTEGER)"
_add(
    "j1_histogram",
    lambda s, d: rounded(charts.histogram(table(s, d, "lineitem"), "l_extendedprice", 20), 4),
    f"""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
        c AS (SELECT {_BIN.format(v='l_extendedprice', lo='lo', hi='hi', k=20)} AS b, count(*) AS n FROM lineitem, s GROUP BY 1)
        SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 20), 4) AS lower, round(lo + (i + 1) * ((hi - lo) / 20), 4) AS upper,
        coalesce(n, 0) AS "count" FROM range(20) AS r(i) JOIN s ON true LEFT JOIN c ON b = i""",
)
_H = "0.9 * least(sd, (q3 - q1) / 1.34) * pow(n, -0.2)"
_add(
    "j2_kde",
    lambda s, d: rounded(charts.kde(table(s, d, "part").select(F.expr(GAPPY_PRICE).alias("x")), "x"), 4, density=9),
    f"""WITH v AS (SELECT {GAPPY_PRICE} AS x FROM part),
        s AS (SELECT count(x) AS n, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q1,
              quantile_cont(x, 0.75) AS q3 FROM v),
        g AS (SELECT i, lo + i * ((hi - lo) / 49) AS p, {_H} AS h, n FROM s, range(50) AS r(i))
        SELECT CAST(i AS INTEGER) AS point, round(any_value(p), 4) AS x,
        round(sum(exp(-0.5 * pow((p - v.x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
        FROM g, v WHERE v.x IS NOT NULL GROUP BY i""",
)
_add(
    "j3_distribution",
    lambda s, d: rounded(charts.distribution(table(s, d, "orders"), "o_totalprice"), 9, x=4),
    "SELECT DISTINCT round(o_totalprice, 4) AS x, round(cume_dist() OVER (ORDER BY o_totalprice), 9) AS share FROM orders",
)
_add(
    "j4_scatter", lambda s, d: charts.scatter(table(s, d, "part"), "p_size", "p_retailprice"),
    "SELECT p_size, p_retailprice FROM part",
)
_add(
    "j4_scatter_thinned",
    lambda s, d: charts.scatter(table(s, d, "lineitem").withColumn(
        "id", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey")), "l_quantity", "l_extendedprice", "id", 1000),
)
_add(
    "j5_line", lambda s, d: charts.line(table(s, d, "orders"), "o_orderkey", "o_totalprice"),
    "SELECT o_orderkey, o_totalprice FROM orders",
)
_add(
    "j5_line_buckets",
    lambda s, d: charts.line(table(s, d, "orders"), "o_orderkey", "o_totalprice", buckets=100),
    f"""WITH s AS (SELECT min(o_orderkey)::DOUBLE AS lo, max(o_orderkey)::DOUBLE AS hi FROM orders)
        SELECT {_BIN.format(v='o_orderkey', lo='lo', hi='hi', k=100)} AS bucket, CAST(min(o_orderkey) AS DOUBLE) AS x,
        arg_min(o_totalprice, o_orderkey) AS "first", arg_max(o_totalprice, o_orderkey) AS "last",
        min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS "count" FROM orders, s GROUP BY 1""",
)
_add(
    "j6_bar", lambda s, d: rounded(charts.bar(table(s, d, "orders"), "o_orderpriority", "o_totalprice"), 2),
    "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS height FROM orders GROUP BY 1",
)
_add(
    "j7_area", lambda s, d: rounded(charts.area(table(s, d, "orders"), "o_orderdate", "o_totalprice"), 2),
    "SELECT o_orderdate, round(sum(o_totalprice), 2) AS height FROM orders GROUP BY 1 ORDER BY 1",
)
_GROUPS = """(SELECT o_orderpriority, count(*) AS n, stddev_samp(o_totalprice) AS sd, min(o_totalprice) AS low,
    max(o_totalprice) AS high, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
    quantile_cont(o_totalprice, 0.75) AS q3 FROM o GROUP BY 1)"""
_SKEWED = "SELECT o_orderpriority, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 4 ELSE o_totalprice END AS o_totalprice FROM orders"


def _skewed(spark, folder):
    return table(spark, folder, "orders").select("o_orderpriority", F.expr(
        "CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 4 ELSE o_totalprice END").alias("o_totalprice"))


_add(
    "j8_box", lambda s, d: rounded(charts.box(_skewed(s, d), "o_orderpriority", "o_totalprice"), 4),
    f"""WITH o AS ({_SKEWED}), g AS {_GROUPS}
        SELECT o_orderpriority, count(*) AS "count", round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
        round(any_value(q3), 4) AS q3, round(min(o_totalprice) FILTER (o_totalprice >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low,
        round(max(o_totalprice) FILTER (o_totalprice <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
        count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM o JOIN g USING (o_orderpriority) GROUP BY 1""",
)
_add(
    "j9_violin", lambda s, d: rounded(charts.violin(_skewed(s, d), "o_orderpriority", "o_totalprice"), 3, density=12),
    f"""WITH o AS ({_SKEWED}), g AS {_GROUPS},
        p AS (SELECT o_orderpriority, i, low + i * ((high - low) / 29) AS y, {_H} AS h, n FROM g, range(30) AS r(i))
        SELECT o_orderpriority, CAST(i AS INTEGER) AS point, round(any_value(y), 3) AS y,
        round(sum(exp(-0.5 * pow((y - o_totalprice) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 12) AS density
        FROM o JOIN p USING (o_orderpriority) GROUP BY o_orderpriority, i""",
)
_add(
    "j10_scatter_3d", lambda s, d: charts.scatter_3d(table(s, d, "part"), "p_partkey", "p_size", "p_retailprice"),
    "SELECT p_partkey, p_size, p_retailprice FROM part",
)
_CELLS = f"""(SELECT {_BIN.format(v='l_quantity', lo='x0', hi='x1', k=10)} AS row,
    {_BIN.format(v='l_discount', lo='y0', hi='y1', k=5)} AS col, avg(l_extendedprice) AS z FROM lineitem,
    (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem) GROUP BY 1, 2)"""
_GRID = ("l_quantity", "l_discount", "l_extendedprice")
_add(
    "j11_surface", lambda s, d: rounded(charts.surface(table(s, d, "lineitem"), *_GRID, 10, 5), 4),
    f"SELECT row, col, round(z, 4) AS z FROM {_CELLS}",
)
_add(
    "j11_surface_matrix",
    lambda s, d: rounded(charts.surface_matrix(charts.surface(table(s, d, "lineitem"), *_GRID, 10, 5), 5), 4),
    "SELECT row, " + ", ".join(f"round(max(z) FILTER (col = {i}), 4) AS c{i}" for i in range(5)) + f" FROM {_CELLS} GROUP BY row",
)
_add(
    "j12_contour",
    lambda s, d: rounded(charts.contour(table(s, d, "lineitem"), *_GRID, levels=6, x_bins=10, y_bins=5), 4),
    f"""WITH c AS {_CELLS}, s AS (SELECT min(z) AS lo, max(z) AS hi FROM c)
        SELECT row, col, round(z, 4) AS z, {_BIN.format(v='z', lo='lo', hi='hi', k=6)} AS level FROM c, s""",
)
_add(
    "j13_heatmap", lambda s, d: rounded(charts.heatmap(table(s, d, "part"), "p_brand", "p_type", "p_retailprice"), 7),
    "SELECT p_brand, p_type, round(avg(p_retailprice), 7) AS z FROM part GROUP BY ALL",
)
_add(
    "j_chart_data",
    lambda s, d: rounded(charts.chart_data(table(s, d, "part"), "histogram", "p_retailprice", bins=10).select("bin", "count")),
    f"""WITH s AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
        SELECT {_BIN.format(v='p_retailprice', lo='lo', hi='hi', k=10)} AS bin, count(*) AS "count" FROM part, s GROUP BY 1""",
)
