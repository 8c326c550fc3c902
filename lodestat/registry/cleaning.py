"""Sources, edits, cleaning, normalization and conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.operators import clean, convert, edit, normalize
from lodestat.registry.common import GAPPY_QUANTITY, GAPPY_TEXT, rounded, table

ENTRIES = {}


def _add(name, query, sql=None):
    ENTRIES[name] = (query, sql)


# --- reading and editing ---------------------------------------------------

_add(
    "a2_table_source",
    lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")),
    "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag",
)
_add(
    "a5_preview",
    lambda s, d: edit.preview(table(s, d, "part"), "p_partkey"),
    "SELECT * FROM part ORDER BY p_partkey LIMIT 10",
)
_add(
    "b1_column_filter",
    lambda s, d: edit.filter_columns(table(s, d, "orders"), [
        ("o_totalprice", ">", 100000.0), ("o_orderpriority", "contains", "URGENT"),
        ("o_orderdate", "datestartswith", "1996"),
    ]).select("o_orderkey", "o_totalprice", "o_orderpriority"),
    """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 100000
       AND contains(o_orderpriority, 'URGENT') AND starts_with(strftime(o_orderdate, '%Y-%m-%d'), '1996')""",
)


def _first_sorted(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    keys = ["o_orderpriority", "o_totalprice", "o_orderkey"]
    return edit.sort_by(rows, keys, [True, False, True])


_add(
    "b2_multi_column_sort", _first_sorted,
    "SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders ORDER BY 1, 2 DESC, 3",
)
_add(
    "b3_single_column_sort",
    lambda s, d: edit.sort_by(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", False),
    "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST",
)
_add(
    "b5_page",
    lambda s, d: edit.page(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 7),
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 70",
)
_KEYS = "o_totalprice > 300000"
_add(
    "b6_row_delete",
    lambda s, d: edit.delete_rows(
        table(s, d, "orders").select("o_orderkey", "o_totalprice"),
        table(s, d, "orders").where(_KEYS).select("o_orderkey")),
    f"SELECT o_orderkey, o_totalprice FROM orders WHERE NOT ({_KEYS})",
)
_add(
    "b7_row_select",
    lambda s, d: edit.select_rows(
        table(s, d, "orders").select("o_orderkey", "o_totalprice"),
        table(s, d, "orders").where(_KEYS).select("o_orderkey")),
    f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_KEYS}",
)
_add(
    "b8_column_delete",
    lambda s, d: edit.delete_columns(table(s, d, "customer"), ["c_name", "c_mktsegment"]),
    "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
)
_add(
    "b9_column_rename",
    lambda s, d: edit.rename_columns(table(s, d, "supplier"), {"s_suppkey": "id", "s_acctbal": "balance"}),
    "SELECT s_suppkey AS id, s_name, s_nationkey, s_acctbal AS balance FROM supplier",
)
_add(
    "b10_column_select",
    lambda s, d: edit.select_columns(table(s, d, "part"), ["p_partkey", "p_brand"]),
    "SELECT p_partkey, p_brand FROM part",
)


def _edited(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    corrected = orders.where("o_totalprice > 200000").select("o_orderkey", F.inline(F.array(
        F.struct(F.lit("o_orderstatus").alias("column"), F.lit("X").alias("value")),
        F.struct(F.lit("o_totalprice").alias("column"), F.when(
            F.col("o_orderstatus") == "F", "bad").otherwise("1.5").alias("value")),
    )))
    return edit.apply_edits(orders, corrected, "o_orderkey", ["o_orderstatus", "o_totalprice"])


_add(
    "b11_cell_edits", _edited,
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_totalprice > 200000 AND o_orderstatus <> 'F' THEN 1.5 ELSE o_totalprice END AS o_totalprice
       FROM orders""",
)

# --- missing values --------------------------------------------------------


def _documents(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.expr(GAPPY_TEXT).alias("text"), "lang", "n_chars")


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", F.expr(GAPPY_QUANTITY).alias("l_quantity"), "l_discount", "l_returnflag")


_GAPPY_LINES = f"(SELECT l_orderkey, {GAPPY_QUANTITY} AS l_quantity, l_discount, l_returnflag FROM lineitem)"
_GAPPY_DOCS = f"(SELECT doc_id, {GAPPY_TEXT} AS text, lang, n_chars FROM documents)"
_BLANK = r"(text IS NULL OR regexp_full_match(text, '\s*'))"

_add(
    "c1_find_missing",
    lambda s, d: clean.find_missing(_documents(s, d), keep=["doc_id"]),
    f"SELECT doc_id, {_BLANK} AS text, lang IS NULL AS lang, n_chars IS NULL AS n_chars FROM {_GAPPY_DOCS}",
)
_add(
    "c1_find_missing_only_null",
    lambda s, d: clean.find_missing(_documents(s, d), "text", only_null=True, keep=["doc_id"]),
    f"SELECT doc_id, text IS NULL AS text FROM {_GAPPY_DOCS}",
)
_add(
    "c2_drop_missing",
    lambda s, d: clean.drop_missing(_documents(s, d)).select("doc_id", "lang"),
    f"SELECT doc_id, lang FROM {_GAPPY_DOCS} WHERE NOT {_BLANK}",
)
_add(
    "c2_drop_missing_column",
    lambda s, d: clean.drop_missing(_documents(s, d), "text", only_null=True).select("doc_id", "lang"),
    f"SELECT doc_id, lang FROM {_GAPPY_DOCS} WHERE text IS NOT NULL",
)

for _letter, _method, _sql in (
    ("a", "mean", "avg(l_quantity)"), ("b", "median", "quantile_cont(l_quantity, 0.5)"),
    ("c", "min", "min(l_quantity)"), ("d", "max", "max(l_quantity)"),
    ("e", "mode", "(SELECT l_quantity FROM g WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
    ("f", "constant", "-1.0"),
):
    _value = f"(SELECT {_sql} FROM g)" if _method not in ("mode", "constant") else _sql
    _add(
        f"c3{_letter}_fill_{_method}",
        lambda s, d, m=_method: rounded(clean.fill_missing(
            _lines(s, d), method=m, value=-1.0 if m == "constant" else None)),
        f"""WITH g AS {_GAPPY_LINES} SELECT l_orderkey, round(coalesce(l_quantity, {_value}), 6) AS l_quantity,
            round(l_discount, 6) AS l_discount, l_returnflag FROM g""",
    )

# --- duplicates ------------------------------------------------------------

_FLAGGED = {
    "first": "row_number() OVER (PARTITION BY {c} ORDER BY {k}) > 1",
    "last": "row_number() OVER (PARTITION BY {c} ORDER BY {k} DESC) > 1",
    False: "count(*) OVER (PARTITION BY {c}) > 1",
}
for _keep, _flag in _FLAGGED.items():
    _rows = f"(SELECT doc_id, lang, {_flag.format(c='text', k='doc_id')} AS dup FROM documents)"
    _word = _keep or "none"
    _add(
        f"c4_find_duplicates_{_word}",
        lambda s, d, k=_keep: clean.find_duplicates(
            table(s, d, "documents"), "doc_id", "text", keep=k).select("doc_id", "lang"),
        f"SELECT doc_id, lang FROM {_rows} WHERE dup",
    )
    _add(
        f"c5_drop_duplicates_{_word}",
        lambda s, d, k=_keep: clean.clean_duplicates(
            table(s, d, "documents"), "doc_id", "text", keep=k).select("doc_id", "lang"),
        f"SELECT doc_id, lang FROM {_rows} WHERE NOT dup",
    )
_WHOLE = _FLAGGED["first"].format(c="user_id, event_type, minute", k="event_id")
_add(
    "c4_find_duplicates_whole_rows",
    lambda s, d: clean.find_duplicates(table(s, d, "events").select(
        "event_id", "user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("minute")), "event_id"),
    f"""SELECT event_id, user_id, event_type, minute FROM (SELECT *, {_WHOLE} AS dup FROM
        (SELECT event_id, user_id, event_type, date_trunc('hour', ts) AS minute FROM events)) WHERE dup""",
)

# --- normalization ---------------------------------------------------------

_SCALED = "l_orderkey, round({q}, 6) AS l_quantity, round({p}, 6) AS l_extendedprice"


def _measures(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", F.expr(GAPPY_QUANTITY).alias("l_quantity"), "l_extendedprice")


def _add_scaling(name, method, formula, stats, **options):
    cols = {"q": "l_quantity", "p": "l_extendedprice"}
    terms = {k: formula.format(x=c) for k, c in cols.items()}
    made = ", ".join(f"{e.format(x=c)} AS {a}_{c}" for c in cols.values() for a, e in stats.items())
    source = f"(SELECT l_orderkey, {GAPPY_QUANTITY} AS l_quantity, l_extendedprice FROM lineitem)"
    with_stats = f", (SELECT {made} FROM g)" if stats else ""
    _add(
        name,
        lambda s, d: rounded(normalize.normalize_data(
            _measures(s, d), method, ["l_quantity", "l_extendedprice"], **options)),
        f"WITH g AS {source} SELECT {_SCALED.format(**terms)} FROM g{with_stats}",
    )


_add_scaling("g1_min_max", "min_max", "({x} - lo_{x}) / (hi_{x} - lo_{x}) * 3 - 1",
             {"lo": "min({x})", "hi": "max({x})"}, feature_range=(-1, 2))
_add_scaling("g2_z_score", "zscore", "({x} - m_{x}) / sd_{x}", {"m": "avg({x})", "sd": "stddev_samp({x})"})
_add_scaling("g3_max_abs", "max_abs", "{x} / top_{x}", {"top": "max(abs({x}))"})
_add_scaling("g4_robust", "robust", "({x} - m_{x}) / (c_{x} - a_{x})", {
    "a": "quantile_cont({x}, 0.25)", "m": "quantile_cont({x}, 0.5)", "c": "quantile_cont({x}, 0.75)"})
_add_scaling("g5_log", "log", "ln(1 + {x})", {})

# --- conversion ------------------------------------------------------------


def _numbers_as_text(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_quantity").cast("int").cast("string").alias("whole"),
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("real"),
        F.expr("CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE cast(cast(l_quantity AS int) AS string) END").alias("gappy"),
        F.concat(F.col("l_returnflag"), F.col("l_linenumber").cast("string")).alias("bad"),
    )


_add(
    "h1_to_numeric",
    lambda s, d: rounded(convert.to_numeric(_numbers_as_text(s, d))),
    """SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS whole, round(l_extendedprice, 6) AS real,
       CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS gappy,
       l_returnflag || CAST(l_linenumber AS VARCHAR) AS bad FROM lineitem""",
)


def _times_as_text(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 13 = 5 THEN 'soon' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END").alias("ts"),
        F.date_format("ts", "dd.MM.yyyy").alias("day"))


_TIMES = """(SELECT event_id, CASE WHEN event_id % 13 = 5 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts,
             strftime(ts, '%d.%m.%Y') AS day FROM events)"""
_add(
    "h2_to_datetime",
    lambda s, d: convert.to_datetime(_times_as_text(s, d), "ts", "%Y-%m-%d %H:%M:%S"),
    f"SELECT event_id, try_strptime(ts, '%Y-%m-%d %H:%M:%S') AS ts, day FROM {_TIMES}",
)
_LONG_ID = 1_000_000_000_000_000_000
_add(
    "h1_long_ids",
    lambda s, d: convert.to_numeric(table(s, d, "orders").select(
        "o_orderkey", F.expr(f"CASE WHEN o_orderkey % 7 <> 0 THEN cast(o_orderkey + {_LONG_ID} AS string) END").alias("id"),
        F.concat(F.lit("99"), F.col("o_orderkey") + _LONG_ID).alias("wide"))),
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey + {_LONG_ID} END AS id,
        '99' || CAST(o_orderkey + {_LONG_ID} AS VARCHAR) AS wide FROM orders""",
)
_add(
    "h2_iso_zone",
    lambda s, d: convert.to_datetime(table(s, d, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.date_format("ts", "MMM d, yyyy").alias("day"),
        F.lit("no date").alias("none")).withColumn("none", F.concat("none", F.col("event_id")))),
    """SELECT event_id, date_trunc('second', ts) AS ts, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
       'no date' || CAST(event_id AS VARCHAR) AS none FROM events""",
)
_add(
    "h2_to_datetime_inferred",
    lambda s, d: convert.to_datetime(_times_as_text(s, d), order_by="event_id"),
    f"""SELECT event_id, try_strptime(ts, '%Y-%m-%d %H:%M:%S') AS ts, try_strptime(day, '%d.%m.%Y') AS day
        FROM {_TIMES}""",
)
_add(
    "h3_one_hot",
    lambda s, d: convert.one_hot(table(s, d, "orders").select("o_orderkey", "o_orderstatus")),
    """SELECT o_orderkey, o_orderstatus = 'O' AS "o_orderstatus_O", o_orderstatus = 'P' AS "o_orderstatus_P" FROM orders""",
)
_add(
    "h3_one_hot_vector",
    lambda s, d: convert.one_hot_vector(table(s, d, "orders").select("o_orderkey", "o_orderpriority"))
    .selectExpr("o_orderkey", "cast(o_orderpriority_vector as string) AS encoded"),
)
_add(
    "h4_label_encode",
    lambda s, d: convert.label_encode(
        table(s, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END").alias("o_orderpriority"))),
    """SELECT o_orderkey, CASE WHEN p IS NULL THEN (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderkey % 7 <> 0)
       ELSE dense_rank() OVER (ORDER BY p NULLS LAST) - 1 END AS o_orderpriority FROM
       (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders)""",
)
_add(
    "h4_label_encode_names",
    lambda s, d: convert.label_encode(table(s, d, "customer").select("c_custkey", "c_name")),
    "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name FROM customer",
)


def _narrowed_types(spark, folder):
    rows = convert.narrowing_plan(table(spark, folder, "lineitem"))
    return spark.createDataFrame(rows, "column string, old_type string, new_type string, categorical boolean")


_WIDTHS = """CASE WHEN min({c}) >= -32768 AND max({c}) < 32768 THEN 'smallint'
    WHEN min({c}) >= -2147483648 AND max({c}) < 2147483648 THEN 'int' ELSE 'bigint' END"""
_add(
    "h5_narrowing_plan", _narrowed_types,
    " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", 'bigint' AS old_type, {_WIDTHS.format(c=c)} AS new_type, false AS categorical FROM lineitem"
         for c in ("l_orderkey", "l_partkey", "l_suppkey")]
        + [f"SELECT '{c}', 'double', 'float', false" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
        + [f"SELECT '{c}', 'string', 'string', count(DISTINCT {c}) < 0.5 * count(*) FROM lineitem"
           for c in ("l_returnflag", "l_linestatus")]
        + ["SELECT 'l_linenumber', 'int', 'int', false", "SELECT 'l_shipdate', 'timestamp_ntz', 'timestamp_ntz', false"]
    ),
)
_add(
    "h5_narrow_types",
    lambda s, d: convert.narrow_types(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))
    .select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"),
            F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"), "o_orderstatus"),
    "SELECT o_orderkey, o_custkey, round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 2) AS o_totalprice, o_orderstatus FROM orders",
)
