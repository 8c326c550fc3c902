"""CSV records over line breaks, read in splits of any size, against Python's reader."""

import csv
import io
import random

import pytest

from lodestat.sources import tables
from lodestat.sources.records import csv_records, ends_inside


def drawn(rows, seed, newline="\n", sep=","):
    rng = random.Random(seed)
    pieces = ["a", "bb", " ", '"', "\n", newline, sep, "é", "\n\n", 'say "no"', f'5" pipe{sep}x', "x" * 30]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=newline, delimiter=sep)
    writer.writerow(["id", "first", f"second\nline"])
    for i in range(rows):
        writer.writerow([i, *["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(2)]])
    return out.getvalue()



@pytest.mark.parametrize("newline, sep, size", [("\n", ",", 64), ("\r\n", ";", 200), ("\n", ",", 1 << 20)])
def test_splits_give_the_rows_of_the_whole(spark, tmp_path, newline, sep, size):
    texts = [drawn(300, seed, newline, sep) for seed in range(3)]
    for i, text in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_bytes(text.encode())
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        records = csv_records(spark, str(tmp_path), sep)
        found = records.collect()
        if size == 64:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(r.header for r in found) == 3
    want = sorted(tuple(r) for t in texts for r in csv.reader(io.StringIO(t, newline=""), delimiter=sep) if r)
    assert sorted(tuple(next(csv.reader(io.StringIO(r.text, newline=""), delimiter=sep))) for r in found) == want


def test_table_equals_one_task(spark, tmp_path):
    rows = "id,text\n1,\"two\nlines\"\n2,plain\n\n3,\"a \"\"quoted\"\"\n\nword\"\n4,5\" pipe\n5,\"\"\n6,\"open to\nthe end"
    (tmp_path / "t.csv").write_text(rows)
    for size in (8, 20, 1 << 20):
        was = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        try:
            found = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "t.csv")).orderBy("id").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert found[:4] == [(1, "two\nlines"), (2, "plain"), (3, 'a "quoted"\n\nword'), (4, '5" pipe')]
        assert found[4] == (5, None) and len(found) == 6 and "the end" in found[5][1]


def test_ends_inside():
    cases = [("a,b", False, False), ('a,"b', False, True), ('a,"b"', False, False), ('a"b,c', False, False), ('x"",y', True, True), ('x"', True, False),
             ('x",y,"z', True, True), ('"', False, True), ('""', False, False), ('"""', False, True), ('"a"b,"c', False, True), ("", True, True)]
    for line, start, end in cases:
        assert ends_inside(line, start, ",") is end, line


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert csv_records(spark, str(tmp_path / "e.csv")).count() == 0
