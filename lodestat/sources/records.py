"""Records of CSV files whose quoted values hold line breaks, read in parallel splits.

A split begins at any line, so whether that line is inside a quoted value is not
known there. A first pass finds, per split, whether its end is inside one for
either answer at its start; the answers then run through the splits of a file, a
row each, and a second pass puts the lines together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

QUOTE = '"'
_WHOLE, _OPENED, _INSIDE = 0, 1, 2  # a record, its start at the end of a split, and what follows in later ones


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line ends inside a quoted value, by where it starts."""
    at = 0
    while True:
        if inside:
            at = line.find(QUOTE, at)
            while at >= 0 and line.startswith(QUOTE, at + 1):  # a doubled quote
                at = line.find(QUOTE, at + 2)
            if at < 0:
                return True
            at += 1
        elif line.startswith(QUOTE, at):
            inside, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        inside, at = False, at + len(sep)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Neighbouring lines of one split."""
    blocks, files = np.asarray(batch.column("block")), batch.column("file").dictionary_encode()
    names, codes = files.dictionary.to_pylist(), np.asarray(files.indices)
    cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(blocks)]):
        if b > a:
            yield (names[codes[a]], int(blocks[a])), batch.slice(a, b - a)


def _quoted(lines: pa.Array) -> list[int]:
    return np.flatnonzero(np.asarray(pc.match_substring(lines, QUOTE))).tolist()


def _answers(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """Per split where it ends if it starts outside a quoted value, and if inside one."""
    last, ends = None, (False, True)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": last[0], "block": last[1], "outside": ends[0], "inside": ends[1]}])

    for batch in batches:
        for split, lines in _runs(batch):
            if split != last:
                if last:
                    yield row()
                last, ends = split, (False, True)
            values = lines.column("value")
            for i in _quoted(values):
                line = values[i].as_py()
                ends = tuple(ends_inside(line, e, sep) for e in ends)
    if last:
        yield row()


def _starts(answers: DataFrame) -> DataFrame:
    """(file, block, open): whether a split starts inside a quoted value.

    An answer that does not depend on the start settles what follows it; after
    that only reversals count. The windows hold a row per split of a file.
    """
    fixed = F.col("outside") == F.col("inside")
    file = Window.partitionBy("file").orderBy("block")
    since = Window.partitionBy("file", "_settled").orderBy("block")
    rows = answers.withColumn("_settled", F.sum(fixed.cast("int")).over(file))
    base = F.when(F.col("_settled") > 0, F.first("outside").over(since)).otherwise(F.lit(False))
    turned = F.sum((F.col("outside") & ~F.col("inside")).cast("int")).over(since) % 2 == 1
    after = rows.withColumn("_after", base != turned)
    return after.select("file", "block", F.coalesce(F.lag("_after").over(file), F.lit(False)).alias("open"))


def _pieces(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """Whole records, and the pieces of those that more than one split holds."""
    last, inside, held, began, seq, first = None, False, [], False, 0, False

    def rows(texts, kind: int, header: list[bool]) -> pa.RecordBatch:
        nonlocal seq
        many = len(texts)
        seq += many
        return pa.RecordBatch.from_arrays([
            pa.array([last[0]] * many), pa.array([last[1]] * many, pa.int64()), pa.array(range(seq - many, seq), pa.int64()),
            pa.array([kind] * many, pa.int32()), pa.array(header, pa.bool_()), texts], ["file", "block", "seq", "kind", "header", "text"])

    def take_first(many: int) -> list[bool]:
        nonlocal first
        out = [first] + [False] * (many - 1) if many else []
        first = first and not many
        return out

    def close(kind: int) -> pa.RecordBatch:
        texts = pa.array(["\n".join(held)])
        held.clear()
        return rows(texts, kind, take_first(1) if kind == _WHOLE else [False])

    for batch in batches:
        for split, lines in _runs(batch):
            if split != last:
                if held:
                    yield close(_OPENED if began else _INSIDE)
                last, seq, first = split, 0, split[1] == 0
                inside, began = lines.column("open")[0].as_py(), False
            values, at = lines.column("value"), 0
            for i in [*_quoted(values), len(values)]:
                # what has no quote stays where it is: records of their own, or all inside
                plain = values.slice(at, i - at)
                if len(plain):
                    if inside:
                        held.extend(plain.to_pylist())
                    else:
                        texts = pc.utf8_rtrim(plain, "\r")
                        texts = texts.filter(pc.greater(pc.binary_length(texts), 0))
                        if len(texts):
                            yield rows(texts, _WHOLE, take_first(len(texts)))
                if i == len(values):
                    break
                line = values[i].as_py()
                began = began or not inside
                inside = ends_inside(line, inside, sep)
                held.append(line if inside else line.rstrip("\r"))
                if not inside:
                    yield close(_WHOLE if began else _INSIDE)
                    began = False
                at = i + 1
    if held:
        yield close(_OPENED if began else _INSIDE)


def csv_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, header, text) of each record of the CSV files; the first record of a file is its header.

    Quotes open a value at its start only and are doubled inside, line breaks
    in quotes stay, empty lines go. Files are split like any text, so one large
    file is read by many tasks.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    answers = lines.mapInArrow(partial(_answers, sep=sep), "file string, block long, outside boolean, inside boolean")
    starts = _starts(answers)
    pieces = lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "value", "open").mapInArrow(
        partial(_pieces, sep=sep), "file string, block long, seq long, kind int, header boolean, text string")
    whole = pieces.where(F.col("kind") == _WHOLE).select("file", "header", "text")
    # at most two pieces of a split are left
    opened = F.sum((F.col("kind") == _OPENED).cast("int")).over(Window.partitionBy("file").orderBy("block", "seq"))
    parts = pieces.where(F.col("kind") != _WHOLE).withColumn("no", opened)
    joined = parts.groupBy("file", "no").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text", "header"))).alias("p")).select(
        "file", F.exists("p", lambda p: p["header"]).alias("header"), F.array_join(F.transform("p", lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(joined)
