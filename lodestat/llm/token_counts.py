"""Exact token totals for every context limit, from a histogram of encoded lengths."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestat.llm.tables import store
from lodestat.llm.words import slices

_BLOCK = 256  # lengths of a block of the running totals


def default_vocabulary() -> str:
    """The rank file of the byte-level vocabulary of 50k entries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _lengths(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """How many texts of each length a batch holds."""
    encoding = _encoding(path)
    for batch in batches:
        for part in slices(batch):
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in part.column("text").to_pylist()]
            values, counts = np.unique(np.array(sizes, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["length", "docs"])


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(length, docs): documents by their number of tokens, whole texts encoded.

    `vocabulary` is the path of a rank file that every executor can read. Texts
    are counted where they are read; only counts are shuffled. NULL and empty
    texts have length 0.
    """
    made = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_lengths, path=vocabulary or default_vocabulary()), "length long, docs long")
    return made.groupBy("length").agg(F.sum("docs").alias("docs"))


def _suffix_sums(histogram: DataFrame, names: list[str]) -> DataFrame:
    """`<name>_from`: the sum over this and all greater lengths.

    Blocks of lengths are summed first; a block's own rows then need only its
    rows and one offset, so no task sees all lengths.
    """
    from pyspark.sql import Window

    rows = histogram.withColumn("block", F.floor(F.col("length") / _BLOCK))
    blocks = rows.groupBy("block").agg(*[F.sum(n).alias(n) for n in names]).withColumn("top", F.floor(F.col("block") / _BLOCK))
    tops = blocks.groupBy("top").agg(*[F.sum(n).alias(n) for n in names])

    def after(inner: DataFrame, key: str, over: list[str]) -> DataFrame:
        window = (Window.partitionBy(*over) if over else Window.partitionBy(F.lit(0))).orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, -1)
        return inner.select(key, *over, *[F.coalesce(F.sum(n).over(window), F.lit(0)).alias(f"{n}_after") for n in names])

    high = after(tops, "top", []).withColumnsRenamed({f"{n}_after": f"{n}_high" for n in names})
    mid = after(blocks, "block", ["top"]).join(high, "top").select(
        "block", *[(F.col(f"{n}_after") + F.col(f"{n}_high")).alias(f"{n}_after") for n in names])
    window = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(mid, "block").withColumns(
        {f"{n}_from": F.sum(n).over(window) + F.col(f"{n}_after") for n in names}).drop("block", *[f"{n}_after" for n in names])


def context_totals(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit, what the corpus holds under it.

    length, docs, tokens, docs_above, tokens_above, docs_total, tokens_total,
    truncated_total (tokens left when every text is cut there), share_below (of
    documents no longer than it; the first length with at least q is the
    q-quantile). Between two lengths the totals of the lower one hold, and
    `truncated_total` grows by docs_above per token.
    """
    rows = histogram.withColumn("tokens", F.col("length") * F.col("docs"))
    total = F.broadcast(rows.agg(F.sum("docs").alias("docs_total"), F.sum("tokens").alias("tokens_total")))  # one row
    found = _suffix_sums(rows, ["docs", "tokens"]).join(total)
    above = F.col("docs_from") - F.col("docs")
    heavier = F.col("tokens_from") - F.col("tokens")
    return found.select(
        "length", "docs", "tokens", above.alias("docs_above"), heavier.alias("tokens_above"), "docs_total", "tokens_total",
        (F.col("tokens_total") - heavier + above * F.col("length")).alias("truncated_total"),
        (1 - above / F.col("docs_total")).alias("share_below"))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """`context_totals` of the lengths of `docs`. An empty table has no rows. Other columns are ignored."""
    return context_totals(store(length_histogram(docs, vocabulary)))
