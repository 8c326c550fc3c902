"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """(mse, r2) over the rows with label and prediction; r2 is NULL for a constant label."""
    p = F.col(prediction).cast("double")
    y = F.when(p.isNotNull(), F.col(label).cast("double"))
    gap = y - p
    return df.agg(
        F.avg(gap * gap).alias("mse"),
        (1 - F.try_divide(F.sum(gap * gap), F.var_pop(y) * F.count(y))).alias("r2"))


def accuracy(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Share of the rows with label and prediction where both agree: as numbers, or in the label's type."""
    kind = df.schema[label].dataType
    kind = T.DoubleType() if isinstance(kind, T.NumericType) else kind
    hit = F.col(label).cast(kind) == F.col(prediction).try_cast(kind)
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"))


def confusion(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n); predictions are compared in the label's type."""
    said = F.col(prediction).cast(df.schema[label].dataType)
    return df.groupBy(F.col(label).cast("string").alias("label"), said.cast("string").alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """(class, precision, recall, f1, support) per class, then the accuracy and
    the macro and weighted averages. Divisions by zero count as 0."""
    sides = F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    ))
    same = F.col("label") == F.col("prediction")
    counts = confusion(df, label, prediction)
    hits = F.when(same, F.col("n")).otherwise(0)
    per_class = counts.select(sides, hits.alias("hit")).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        (F.sum("hit") / 2).alias("hit"))  # each pair of the diagonal appears on both sides

    def share(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    rated = per_class.select(
        "class", "support", "hit", share(F.col("hit"), F.col("predicted")).alias("precision"),
        share(F.col("hit"), F.col("support")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    rated = rated.withColumn("f1", share(2 * p * r, p + r))
    measures = ("precision", "recall", "f1")
    total = F.sum("support")
    averages = rated.agg(
        total.alias("support"), (F.sum("hit") / total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in measures],
    ).select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"),
                 F.col("accuracy").alias("f1"), "support"),
        *[F.struct(F.lit(f"{k} avg").alias("class"), *[F.col(f"{k}_{m}").alias(m) for m in measures], "support")
          for k in ("macro", "weighted")],
    )))
    return rated.select("class", *measures, "support").unionByName(averages)
