"""Sources and sinks, feature preparation, models and metrics."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lodestat.operators import features, metrics, models
from lodestat.plans.lineage import checkpoint_folder
from lodestat.registry.common import GAPPY_PRICE, GAPPY_QUANTITY, rounded, table
from lodestat.sources import models as saved, tables

ENTRIES = {}
_X = ["l_quantity", "l_discount", "l_tax"]
_Y = "l_extendedprice"


def _add(name, query, sql=None):
    ENTRIES[name] = (query, sql)


def _scratch(spark) -> str:
    """A new folder beside the checkpoints, which every executor reaches."""
    return f"{checkpoint_folder(spark)}/lodestat-{uuid.uuid4().hex}"


# --- sources and sinks -----------------------------------------------------

_PART = f"SELECT p_partkey, p_name, p_size, {GAPPY_PRICE} AS p_retailprice FROM part"


def _part(spark, folder):
    return table(spark, folder, "part").select("p_partkey", "p_name", "p_size", F.expr(GAPPY_PRICE).alias("p_retailprice"))


def _csv_round_trip(spark, folder):
    path = _scratch(spark)
    _part(spark, folder).write.csv(path, header=True, nullValue="NA")
    return tables.read_csv(spark, path)


def _delimited_round_trip(spark, folder):
    path = _scratch(spark)
    _part(spark, folder).write.csv(path, header=True, nullValue="", sep=";")
    return tables.read_delimited(spark, path)


_add("a1_csv_source", _csv_round_trip, _PART.replace("p_size,", "CAST(p_size AS BIGINT) AS p_size,"))


def _text_round_trip(spark, folder):
    """Texts with line breaks and quotes, written as quoted values and read in splits."""
    path = _scratch(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    docs.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return tables.read_csv(spark, path, schema="doc_id long, text string, n_chars long", multi_line=True)


_add("a1_csv_line_breaks", _text_round_trip, "SELECT doc_id, CASE WHEN text <> '' THEN text END AS text, n_chars FROM documents")
_add("a3_delimiter_detecting_source", _delimited_round_trip, _PART.replace("p_size,", "CAST(p_size AS BIGINT) AS p_size,"))


def _documents(spark, folder):
    """One small JSON document per part, in one of five layouts by key."""
    a, b = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    forms = (
        F.concat(F.lit('[{"id": '), a, F.lit(', "size": '), b, F.lit('}, {"id": '), a, F.lit(', "size": null}]')),
        F.concat(F.lit('{"columns": ["id", "size"], "index": [0], "data": [['), a, F.lit(", "), b, F.lit("]]}")),
        F.concat(F.lit('{"id": ['), a, F.lit('], "size": ['), b, F.lit("]}")),
        F.concat(F.lit('{"id": '), a, F.lit("}")),
        F.concat(F.lit('{"id": ['), a),
    )
    kind = F.col("p_partkey") % 5
    text = F.coalesce(*[F.when(kind == i, f) for i, f in enumerate(forms)])
    return table(spark, folder, "part").select("p_partkey", text.alias("document"))


_add(
    "a4_json_orientation",
    lambda s, d: _documents(s, d).select("p_partkey", tables.json_orientation(F.col("document")).alias("orientation")),
    """SELECT p_partkey, ['records', 'split', 'index', 'unknown', 'invalid JSON'][p_partkey % 5 + 1] AS orientation FROM part""",
)
_add(
    "a4_json_source",
    lambda s, d: tables.json_rows(_documents(s, d), "document", "id long, size int"),
    """SELECT p_partkey AS id, p_size AS size FROM part WHERE p_partkey % 5 < 3
       UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 5 = 0""",
)


def _json_files(spark, folder):
    path = _scratch(spark)
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    # every line of the written files is a document of its own
    rows.select(F.to_json(F.array(F.struct("id", "size"))).alias("value")).write.text(path)
    return tables.json_rows(spark.read.text(path), "value", "id long, size int")


_add("a4_json_files", _json_files, "SELECT p_partkey AS id, p_size AS size FROM part")
_add("a6_save_table", lambda s, d: tables.save_table(_part(s, d), _scratch(s)), _PART)


def _save_over_source(spark, folder):
    path = _scratch(spark)
    _part(spark, folder).write.parquet(path)
    edited = spark.read.parquet(path).withColumn("p_size", F.col("p_size") + 1)
    return tables.save_table(edited, path)


_add("a6_save_over_source", _save_over_source, _PART.replace("p_size,", "p_size + 1 AS p_size,"))



def _saved_model(spark, folder):
    lines = table(spark, folder, "lineitem")
    path = _scratch(spark)
    saved.save_model(models.linear_regression(lines, ["l_quantity"], _Y), path)
    scored = saved.score_saved(lines, path)
    return rounded(metrics.regression_metrics(scored, _Y).select("r2"), 6)


_add("a7_saved_model", _saved_model, f"SELECT round(regr_r2({_Y}, l_quantity), 6) AS r2 FROM lineitem")

# --- feature preparation ---------------------------------------------------


def _gappy(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", F.expr(GAPPY_QUANTITY).alias("l_quantity"))


_GAPPY = f"(SELECT l_orderkey, {GAPPY_QUANTITY} AS l_quantity FROM lineitem)"
for _kind, _sql in (("mean", "avg(l_quantity)"), ("median", "quantile_cont(l_quantity, 0.5)"), ("mode", None)):
    _value = f"(SELECT {_sql} FROM g)" if _sql else (
        "(SELECT l_quantity FROM g WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
    _add(
        f"k1_impute_{_kind}", lambda s, d, k=_kind: rounded(features.impute(_gappy(s, d), "l_quantity", k)),
        f"WITH g AS {_GAPPY} SELECT l_orderkey, round(coalesce(l_quantity, {_value}), 6) AS l_quantity FROM g",
    )
_add(
    "k2_standard_scale",
    lambda s, d: rounded(features.scale(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "standard")),
    """SELECT p_partkey, round((p_retailprice - m) / s, 6) AS p_retailprice FROM part,
       (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part)""",
)
_add(
    "k3_min_max_scale",
    lambda s, d: rounded(features.scale(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "minmax")),
    """SELECT p_partkey, round((p_retailprice - a) / (b - a), 6) AS p_retailprice FROM part,
       (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part)""",
)
_add(
    "k4_feature_scores",
    lambda s, d: features.feature_scores(table(s, d, "lineitem"), _Y, _X).select("feature", F.round("correlation", 6).alias("correlation"), "place"),
    f"""SELECT feature, round(r, 6) AS correlation, CAST(row_number() OVER (ORDER BY abs(r) DESC, feature) AS INTEGER) AS place FROM (
        {' UNION ALL '.join(f"SELECT '{c}' AS feature, corr({c}, {_Y}) AS r FROM lineitem" for c in _X)})""",
)
_add(
    "k4_select_k_best",
    lambda s, d: rounded(features.select_k_best(
        table(s, d, "lineitem").select(*_X, (F.col(_Y) * 2 + F.col("l_quantity")).alias("twice"), _Y), _Y, k=1), 4),
    f"SELECT round({_Y} * 2 + l_quantity, 4) AS twice, {_Y} FROM lineitem",
)


def _dimensions(rows, dims=64):
    return rows.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])


def _embedded(spark, folder):
    return _dimensions(table(spark, folder, "embeddings"))


_E = [f"e{i}" for i in range(64)]


def _components(spark, folder):
    rows = features.preprocess(_embedded(spark, folder).drop("vec_id"), "label", {"select": None})
    return rows.select(F.size(vector_to_array("features")).alias("components"), "label").groupBy("components", "label").count()


def _vectors(df):
    return df.select("vec_id", *[F.round(vector_to_array("features")[i], 5).alias(f"f{i}") for i in range(3)])


_add("k5_pca", _components)
_add("k6_preprocess", lambda s, d: features.preprocess(
    table(s, d, "lineitem").select(F.expr(GAPPY_QUANTITY).alias("l_quantity"), "l_discount", "l_tax", _Y), _Y,
).select(F.transform(vector_to_array("features"), lambda v: F.round(v, 4)).alias("features"), _Y))


def _custom(spark, folder):
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=["p_size", "p_retailprice"], outputCol="raw"),
        MinMaxScaler(inputCol="raw", outputCol="features")])
    rows = features.preprocess(table(spark, folder, "part"), pipeline=pipeline)
    return rows.select("p_partkey", *[F.round(vector_to_array("features")[i], 6).alias(c) for i, c in enumerate(("size", "price"))])


_add(
    "k7_user_pipeline", _custom,
    """SELECT p_partkey, round((p_size - a) / (b - a), 6) AS size, round((p_retailprice - c) / (d - c), 6) AS price FROM part,
       (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)""",
)
_add(
    "k8_split_sizes",
    lambda s, d: features.mark_test(table(s, d, "orders"), "o_orderkey").groupBy("is_test").agg(F.count(F.lit(1)).alias("n")),
    """SELECT is_test, CASE WHEN is_test THEN k ELSE n - k END AS n FROM
       (SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS k FROM orders), (VALUES (true), (false)) AS v(is_test)""",
)
_add("k8_split", lambda s, d: features.mark_test(table(s, d, "orders").select("o_orderkey"), "o_orderkey"))
_add(
    "k9_stratified_split_sizes",
    lambda s, d: features.mark_test(table(s, d, "orders"), "o_orderkey", stratify="o_orderstatus")
    .groupBy("o_orderstatus", "is_test").agg(F.count(F.lit(1)).alias("n")),
    """SELECT o_orderstatus, is_test, CASE WHEN is_test THEN k ELSE n - k END AS n FROM
       (SELECT o_orderstatus, count(*) AS n, CAST(round(0.2 * count(*)) AS BIGINT) AS k FROM orders GROUP BY 1),
       (VALUES (true), (false)) AS v(is_test)""",
)


def _r2(target):
    return lambda scored: metrics.regression_metrics(scored, target).first()["r2"]


_add("k10_cross_validation", lambda s, d: features.cross_validation(
    table(s, d, "orders").withColumn("day", F.dayofyear("o_orderdate")).select("o_orderkey", "day", "o_custkey", "o_totalprice"),
    lambda rows: models.linear_regression(rows, ["day", "o_custkey"], "o_totalprice"), _r2("o_totalprice"), "o_orderkey"))

# --- models ----------------------------------------------------------------


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(*_X, _Y)


def _gappy_lines(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", F.expr(GAPPY_QUANTITY).alias("l_quantity"), "l_tax", _Y)


_add(
    "l1_linear_regression",
    lambda s, d: rounded(models.linear_regression(_lines(s, d), ["l_quantity"], _Y).coefficients(), 4),
    f"""SELECT 'l_quantity' AS term, round(regr_slope({_Y}, l_quantity), 4) AS coefficient FROM lineitem
        UNION ALL SELECT 'intercept', round(regr_intercept({_Y}, l_quantity), 4) FROM lineitem""",
)
# rises with the quantity and falls with the tax, whose weight must then be 0
_RISING = f"({_Y} + 1000 * l_quantity - 1000000 * l_tax)"
_add("l1_linear_regression_three", lambda s, d: models.linear_regression(_lines(s, d), _X, _Y).scores(_lines(s, d)))
_add(
    "l2_non_negative_regression",
    lambda s, d: rounded(models.linear_regression(
        _lines(s, d).withColumn("y", F.expr(_RISING)), ["l_quantity", "l_tax"], "y", positive=True).coefficients(), 3),
    f"""SELECT 'l_quantity' AS term, round(regr_slope({_RISING}, l_quantity), 3) AS coefficient FROM lineitem
        UNION ALL SELECT 'intercept', round(regr_intercept({_RISING}, l_quantity), 3) FROM lineitem UNION ALL SELECT 'l_tax', 0.0""",
)
_add(
    "l3_polynomial_regression",
    lambda s, d: rounded(models.polynomial_regression(_lines(s, d), ["l_discount"], _Y, 2).coefficients(), 1),
    f"""WITH c AS (SELECT l_discount AS x, l_discount * l_discount AS q, {_Y} AS y FROM lineitem),
        m AS (SELECT covar_pop(x, x) AS xx, covar_pop(x, q) AS xq, covar_pop(q, q) AS qq, covar_pop(x, y) AS xy, covar_pop(q, y) AS qy,
              avg(x) AS mx, avg(q) AS mq, avg(y) AS my FROM c),
        b AS (SELECT (xy * qq - qy * xq) / (xx * qq - xq * xq) AS b1, (qy * xx - xy * xq) / (xx * qq - xq * xq) AS b2, mx, mq, my FROM m)
        SELECT 'l_discount' AS term, round(b1, 1) AS coefficient FROM b UNION ALL SELECT 'l_discount^2', round(b2, 1) FROM b
        UNION ALL SELECT 'intercept', round(my - b1 * mx - b2 * mq, 1) FROM b""",
)
_TWELVE = [f"x{i}" for i in range(12)]


def _twelve(spark, folder):
    """Twelve features, an exact polynomial of three of them as the label."""
    part = table(spark, folder, "part")
    digits = [((F.col("p_partkey") * 7919 * (i + 3) + F.col("p_size") * (i + 1) * 31) % (101 + 6 * i)).cast("double").alias(c) for i, c in enumerate(_TWELVE)]
    rows = part.select(*digits)
    return rows.withColumn("y", 3 + 2 * F.col("x0") - F.col("x11") * F.col("x4") + 0.5 * F.col("x7") * F.col("x7"))


_add(
    "l3_twelve_features",
    lambda s, d: rounded(models.polynomial_regression(_twelve(s, d), _TWELVE, "y", 2).coefficients(), 3).where("abs(coefficient) > 0.001"),
    """SELECT * FROM (VALUES ('intercept', 3.0::DOUBLE), ('x0', 2.0), ('x4*x11', -1.0), ('x7^2', 0.5)) AS v(term, coefficient)""",
)
_add(
    "l1_rows_kept",
    lambda s, d: models.linear_regression(_gappy_lines(s, d), ["l_quantity", "l_tax"], _Y).transform(_gappy_lines(s, d))
    .groupBy(F.col("prediction").isNull().alias("unknown")).agg(F.count(F.lit(1)).alias("n")),
    """SELECT l_orderkey % 7 = 0 AS unknown, count(*) AS n FROM lineitem GROUP BY 1""",
)
_add(
    "l4_ridge_regression",
    lambda s, d: rounded(models.ridge_regression(_lines(s, d), ["l_quantity"], _Y, alpha=1000.0).coefficients(), 4),
    f"""WITH r AS (SELECT regr_sxy({_Y}, l_quantity) / (regr_sxx({_Y}, l_quantity) + 1000.0) AS w, avg({_Y}) AS my, avg(l_quantity) AS mx FROM lineitem)
        SELECT 'l_quantity' AS term, round(w, 4) AS coefficient FROM r UNION ALL SELECT 'intercept', round(my - w * mx, 4) FROM r""",
)
_add(
    "l5_decision_tree",
    lambda s, d: rounded(models.decision_tree(_lines(s, d), _X, _Y).scores(_lines(s, d)), 4),
    # a whole tree tells all different features apart and answers with the mean of equal ones
    f"""SELECT round(avg(pow(y - m, 2)), 4) AS mse, round(1 - sum(pow(y - m, 2)) / (var_pop(y) * count(*)), 4) AS r2
        FROM (SELECT {_Y} AS y, avg({_Y}) OVER (PARTITION BY {', '.join(_X)}) AS m FROM lineitem)""",
)
_add(
    "l5_decision_tree_stump",
    lambda s, d: rounded(models.decision_tree(_lines(s, d), _X, _Y, max_depth=1).scores(_lines(s, d)), 2).select("mse"),
    f"""WITH v AS ({' UNION ALL '.join(f"SELECT '{x}' AS f, {x} AS x, {_Y} AS y FROM lineitem" for x in _X)}),
        g AS (SELECT f, x, count(*) AS n, sum(y) AS s FROM v GROUP BY ALL),
        c AS (SELECT sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER (PARTITION BY f) AS tn, sum(s) OVER (PARTITION BY f) AS ts
              FROM g WINDOW w AS (PARTITION BY f ORDER BY x))
        SELECT round((SELECT avg({_Y} * {_Y}) FROM lineitem) - max((s * s / n + (ts - s) * (ts - s) / (tn - n)) / tn), 2) AS mse FROM c WHERE n < tn""",
)
_add(
    "l5_decision_tree_split_size",
    lambda s, d: rounded(models.decision_tree(
        _lines(s, d), ["l_discount"], _Y, min_samples_split=s.read.parquet(f"{d}/lineitem.parquet").count()).scores(_lines(s, d)), 2).select("mse"),
    # nodes below the root have fewer rows than asked for, so one split is made
    f"""WITH g AS (SELECT l_discount AS x, count(*) AS n, sum({_Y}) AS s FROM lineitem GROUP BY 1),
        c AS (SELECT sum(n) OVER (ORDER BY x) AS n, sum(s) OVER (ORDER BY x) AS s, sum(n) OVER () AS tn, sum(s) OVER () AS ts FROM g)
        SELECT round((SELECT avg({_Y} * {_Y}) FROM lineitem) - max((s * s / n + (ts - s) * (ts - s) / (tn - n)) / tn), 2) AS mse FROM c WHERE n < tn""",
)


def _tree_classes(spark, folder):
    train, test = (_dimensions(part) for part in features.split(table(spark, folder, "embeddings"), "vec_id", stratify="label"))
    return models.decision_tree(train, _E, "label", "classification").scores(test)


_add("l5_decision_tree_classes", _tree_classes)
_add("l6_random_forest", lambda s, d: models.random_forest(_lines(s, d), _X, _Y).scores(_lines(s, d)))
_add("l6_random_forest_classes", lambda s, d: models.random_forest(
    _embedded(s, d), _E, "label", "classification").report(_embedded(s, d)))
_add("l7_gradient_boosting", lambda s, d: models.gradient_boosting(_lines(s, d), _X, _Y).scores(_lines(s, d)))


def _quality(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", r"\s+")).cast("double").alias("words"))
    return table(spark, folder, "labels").select("doc_id", "quality").join(docs, "doc_id")


_add("l7_gradient_boosting_classes", lambda s, d: models.gradient_boosting(
    _quality(s, d), ["n_chars", "words"], "quality", "classification").scores(_quality(s, d)))
for _kernel in ("linear", "poly", "rbf"):
    _add(f"l8_svm_{_kernel}", lambda s, d, k=_kernel: models.svm_classifier(
        _quality(s, d), ["n_chars", "words"], "quality", kernel=k).scores(_quality(s, d)))
_add("l8_svm_classes", lambda s, d: models.svm_classifier(
    _embedded(s, d), _E, "label", kernel="linear").scores(_embedded(s, d)))


def _prices(spark, folder):
    return features.scale(_lines(spark, folder), _Y)


_add("l9_svm_regression", lambda s, d: models.svm_regression(_prices(s, d), _X, _Y, kernel="linear").scores(_prices(s, d)))
_add("l9_svm_regression_rbf", lambda s, d: models.svm_regression(_prices(s, d), _X, _Y, kernel="rbf").scores(_prices(s, d)))


def _neighbours(spark, folder, **options):
    known = table(spark, folder, "part").withColumns({"x": F.col("p_size") / 2.0, "y": F.col("p_retailprice") / 20.0})
    asked = known.withColumns({"x": F.col("x") + 0.125, "y": F.col("y") + 0.0625})
    return models.knn_predict(known, asked, ["x", "y"], key="p_partkey", scaled=False, **options)


_PAIRS = """WITH b AS (SELECT *, p_size / 2.0 AS x, p_retailprice / 20.0 AS y FROM part),
  a AS (SELECT p_partkey, x + 0.125 AS x, y + 0.0625 AS y FROM b),
  ranked AS (SELECT a.p_partkey AS k, b.p_retailprice, b.p_brand, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
    row_number() OVER (PARTITION BY a.p_partkey ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.p_partkey) AS r
    FROM a CROSS JOIN b),
  near AS (SELECT *, min(d2) OVER (PARTITION BY k) = 0 AS touching FROM ranked WHERE r <= 5),
  w AS (SELECT *, CASE WHEN touching THEN CASE WHEN d2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END ELSE 1 / sqrt(d2) END AS w FROM near)"""
_add(
    "l10_knn_regression",
    lambda s, d: rounded(_neighbours(s, d, target="p_retailprice").select("p_partkey", "prediction"), 4),
    _PAIRS + " SELECT k AS p_partkey, round(avg(p_retailprice), 4) AS prediction FROM near GROUP BY k",
)
_add(
    "l10_knn_regression_distance",
    lambda s, d: rounded(_neighbours(s, d, target="p_retailprice", weights="distance").select("p_partkey", "prediction"), 4),
    _PAIRS + " SELECT k AS p_partkey, round(sum(p_retailprice * w) / sum(w), 4) AS prediction FROM w GROUP BY k",
)
_add(
    "l10_knn_classes",
    lambda s, d: _neighbours(s, d, target="p_brand", task="classification").select("p_partkey", "prediction"),
    _PAIRS + """ SELECT k AS p_partkey, arg_min(p_brand, (-n, p_brand)) AS prediction FROM
      (SELECT k, p_brand, count(*) AS n FROM near GROUP BY ALL) GROUP BY k""",
)



def _gappy_neighbours(spark, folder):
    known = _part(spark, folder).withColumn("x", F.col("p_size") / 2.0)
    return models.knn_predict(known.na.fill(0.0), known, ["x", "p_retailprice"], "p_size", "p_partkey")


_add(
    "l10_rows_kept",
    lambda s, d: _gappy_neighbours(s, d).select("p_partkey", F.col("prediction").isNull().alias("unknown")),
    "SELECT p_partkey, p_partkey % 7 = 0 AS unknown FROM part",
)


def _named_labels(fit):
    """Predictions are the labels' own words and better than the most frequent one."""
    def query(spark, folder):
        rows = _embedded(spark, folder).withColumn("label", F.concat(F.lit("class "), F.col("label") % 3)).drop("vec_id")
        found = fit(rows).transform(rows)
        most = rows.groupBy("label").count().agg(F.max("count")).first()[0]
        return found.agg(
            F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction").rlike("^class [012]$")).alias("named"),
            (F.count_if(F.col("prediction") == F.col("label")) > most).alias("better"))
    return query


_CLASSIFIERS = {
    "l5_decision_tree_named": lambda r: models.decision_tree(r, _E, "label", "classification"),
    "l6_random_forest_named": lambda r: models.random_forest(r, _E, "label", "classification"),
    "l7_gradient_boosting_named": lambda r: models.gradient_boosting(r, _E, "label", "classification", n_estimators=5),
    "l8_svm_named": lambda r: models.svm_classifier(r, _E, "label", kernel="linear"),
}
for _name, _fit in _CLASSIFIERS.items():
    _add(_name, _named_labels(_fit), "SELECT count(*) AS n, TRUE AS named, TRUE AS better FROM embeddings")

# --- metrics ---------------------------------------------------------------

_add(
    "l11_regression_metrics",
    lambda s, d: rounded(metrics.regression_metrics(
        table(s, d, "part").withColumn("prediction", F.col("p_size") * 10.0 + 1000), "p_retailprice"), 3),
    """SELECT round(avg(pow(p_retailprice - (p_size * 10.0 + 1000), 2)), 3) AS mse,
       round(1 - sum(pow(p_retailprice - (p_size * 10.0 + 1000), 2)) / (var_pop(p_retailprice) * count(*)), 3) AS r2 FROM part""",
)


def _guessed(spark, folder):
    return _quality(spark, folder).withColumn("prediction", (F.col("n_chars") > 1000).cast("int"))


_GUESSED = "(SELECT quality AS y, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))"
_add(
    "l12_accuracy", lambda s, d: rounded(metrics.accuracy(_guessed(s, d), "quality")),
    f"SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {_GUESSED}",
)
_add(
    "l13_classification_report", lambda s, d: rounded(metrics.classification_report(_guessed(s, d), "quality")),
    f"""WITH g AS {_GUESSED}, c AS (SELECT k, count(*) FILTER (y = k) AS support, count(*) FILTER (p = k) AS predicted,
          count(*) FILTER (y = k AND p = k) AS hit FROM g, (VALUES (0), (1)) AS v(k) GROUP BY k),
        r AS (SELECT CAST(k AS VARCHAR) AS class, coalesce(hit / nullif(predicted, 0), 0) AS "precision",
          coalesce(hit / nullif(support, 0), 0) AS recall, support, hit FROM c),
        f AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1 FROM r)
        SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
        UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
          CAST(sum(support) AS BIGINT) FROM f
        UNION ALL SELECT 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
        UNION ALL SELECT 'weighted avg', round(sum("precision" * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
          round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""",
)
_add("l14_feature_importances", lambda s, d: models.random_forest(
    _lines(s, d), _X, _Y).importances())


def _search(spark, folder):
    """The whole default grid: 81 settings on 5 folds."""
    return models.grid_search(_quality(spark, folder), ["n_chars", "words"], "quality", "classification", key="doc_id")[3]


_add("l15_grid_search", _search)
