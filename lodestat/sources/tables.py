"""Reading and writing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lodestat.operators.convert import INTEGER_TEXT, NUMBER_TEXT
from lodestat.plans.lineage import checkpoint_folder
from lodestat.sources.records import QUOTE, csv_records

# Text that stands for a missing value in CSV files.
NULL_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Spellings of booleans, and the delimiters looked for, in order.
BOOLEAN_TEXT = ("True", "TRUE", "true", "False", "FALSE", "false")
DELIMITERS = (",", "\t", ";", "|", " ")


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """A CSV file or folder with a header row.

    Without a schema one aggregate over the text decides each column: boolean,
    long, double or text. Dates stay text, and so do whole numbers that no long
    holds. With `multi_line` a quoted value may hold line breaks; left out, it is
    on if a line has an odd number of quotes. Files are split and read in
    parallel either way (see `records`).
    """
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    raw = spark.read.csv(path, header=True, sep=sep, quote=QUOTE, escape=QUOTE, multiLine=multi_line)
    if multi_line:
        names = raw.columns
        fields = ", ".join(f"c{i} string" for i in range(len(names)))
        records = csv_records(spark, path, sep).where(~F.col("header"))
        parsed = records.select(F.from_csv("text", fields, {"sep": sep, "quote": QUOTE, "escape": QUOTE}).alias("r"))
        raw = parsed.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)])
    clean = raw.select(*[F.when(~F.col(c).isin(*NULL_TEXT), F.col(c)).alias(c) for c in raw.columns])
    if schema is not None:
        kinds = {f.name: f.dataType for f in (T._parse_datatype_string(schema) if isinstance(schema, str) else schema)}
    else:
        kinds = _inferred(clean)
    return clean.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in clean.columns])


def _inferred(df: DataFrame) -> dict[str, T.DataType]:
    tests = {
        "boolean": lambda c: c.isin(*BOOLEAN_TEXT), "bigint": lambda c: c.rlike(INTEGER_TEXT) & c.try_cast("long").isNotNull(),
        "double": lambda c: c.rlike(NUMBER_TEXT) & ~(c.rlike(INTEGER_TEXT) & c.try_cast("long").isNull()),
    }
    row = df.agg(*[
        a for i, c in enumerate(df.columns) for a in (
            F.count(c).alias(f"n{i}"), *[F.count_if(t(F.col(c))).alias(f"{k}{i}") for k, t in tests.items()])
    ]).first()
    kinds = {}
    for i, c in enumerate(df.columns):
        fits = [k for k in tests if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]]
        if fits:
            kinds[c] = T._parse_datatype_string(fits[0])
    return kinds


def detect_delimiter(spark: SparkSession, path: str, sample_lines: int = 10) -> str:
    """The most frequent delimiter in the first lines, the earlier one on ties."""
    lines = spark.read.text(path).limit(sample_lines)
    text = F.col("value")
    row = lines.agg(*[
        F.sum(F.length(text) - F.length(F.replace(text, F.lit(d), F.lit("")))).alias(f"d{i}") for i, d in enumerate(DELIMITERS)
    ]).first()
    counts = [row[f"d{i}"] or 0 for i in range(len(DELIMITERS))]
    return DELIMITERS[counts.index(max(counts))]


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file whose delimiter is detected first."""
    return read_csv(spark, path, detect_delimiter(spark, path), schema)


# --- JSON documents --------------------------------------------------------


def json_orientation(document: Column) -> Column:
    """How a JSON document lays out a table: split, records, index, unknown, or
    'invalid JSON'."""
    keys = F.json_object_keys(document)
    parts = F.from_json(document, "array<string>")
    values = F.map_values(F.from_json(document, "map<string,string>"))
    split = F.forall(F.array(*[F.lit(k) for k in ("columns", "index", "data")]), lambda k: F.array_contains(keys, k))
    is_list = F.json_array_length(document).isNotNull()
    records = is_list & F.forall(parts, lambda p: F.ltrim(p).startswith("{"))
    index = keys.isNotNull() & F.forall(values, lambda v: F.ltrim(v).startswith("["))
    return (
        F.when(document.isNull() | F.try_parse_json(document).isNull(), "invalid JSON")
        .when(F.coalesce(split, F.lit(False)), "split").when(F.coalesce(records, F.lit(False)), "records")
        .when(F.coalesce(index, F.lit(False)), "index").otherwise("unknown")
    )


def json_rows(df: DataFrame, document: str, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of all documents of a column, whatever their orientation.

    `schema` lists the columns to read, as in "a long, b string". Documents that
    are invalid or of unknown layout give no rows; `json_rejects` lists them.
    """
    fields = T._parse_datatype_string(schema).fields
    text = F.col(document)
    tagged = df.withColumn("_kind", json_orientation(text))
    struct = T.StructType(fields)
    # each layout becomes an array of maps from column name to raw JSON text
    records = F.from_json(text, T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    table = F.from_json(text, "struct<columns: array<string>, data: array<array<string>>>")
    split = F.transform(table["data"], lambda r: F.map_from_arrays(table["columns"], r))
    lists = F.from_json(text, "map<string, array<string>>")
    longest = F.array_max(F.transform(F.map_values(lists), lambda v: F.size(v)))
    index = F.transform(
        F.sequence(F.lit(0), longest - 1),
        lambda i: F.map_from_entries(F.array(*[
            F.struct(F.lit(f.name), F.get(F.try_element_at(lists, F.lit(f.name)), i)) for f in fields])),
    )
    rows = (
        F.when(F.col("_kind") == "records", records).when(F.col("_kind") == "split", split)
        .when((F.col("_kind") == "index") & (longest > 0), index)
    )
    exploded = tagged.select(*keep, F.explode(rows).alias("_row"))
    return exploded.select(*keep, *[
        F.try_element_at("_row", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in struct.fields])


def json_rejects(df: DataFrame, document: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., orientation) of the documents that `json_rows` gives no rows for."""
    kind = json_orientation(F.col(document))
    return df.select(*keep, kind.alias("orientation")).where(F.col("orientation").isin("invalid JSON", "unknown"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files of any orientation. A file is one document, so it is
    read whole by one task; many files are read in parallel."""
    return json_rows(spark.read.text(path, wholetext=True), "value", schema)


def orientation_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, orientation) per JSON file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), json_orientation(F.col("value")).alias("orientation"))


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table as parquet, replacing what is there, and return it as read.

    The rows are written to the shared folder first and only a finished copy
    replaces the target, so a table may be saved over the one it was read from,
    and a job that fails leaves the target as it was. Should the replacement
    itself fail, the error names the copy.
    """
    spark = df.sparkSession
    copy = f"{checkpoint_folder(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(copy)
    spark.catalog.refreshByPath(path)
    try:
        spark.read.schema(df.schema).parquet(copy).write.mode("overwrite").parquet(path)
    except Exception as error:
        raise RuntimeError(f"The table could not be replaced; all its rows are in {copy}") from error
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)
