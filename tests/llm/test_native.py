"""Quality rules, decontamination and the url filter."""

import hashlib
import re
from collections import Counter

import pytest
from compare import compare, connect

from lodestat.llm import decontamination as dec, quality_rules as rules, stages, url_filter
from lodestat.llm.registry import ENTRIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in ENTRIES.items() if sql])
def test_matches_sql(spark, name):
    query, sql = ENTRIES[name]
    assert compare(query(spark, FOLDER), connect(FOLDER), sql) is None


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered))


def test_ledger_edges(edge, nothing):
    rows = rules.ledger(edge).collect()
    assert Counter((r.doc_id, *[r[m] for m in rules.MEASURES]) for r in rows) == Counter(
        (r.doc_id, *brute_measures(r.text)) for r in edge.collect())
    assert rules.ledger(nothing).count() == 0


def test_overlapping_repeats(texts):
    own = ["a a a a a a a", "a b c d e x a b c d e", "a b c d e a b c d e f g", "l1 w\nl1 w\n\nl2\nl1 w", "😀 é # *"]
    found = {r.doc_id: tuple(r[m] for m in rules.MEASURES) for r in rules.ledger(texts(*own)).collect()}
    assert found == {i: brute_measures(t) for i, t in enumerate(own)}


def test_policies_and_ablations(texts):
    clean = "this is a plain sentence of more than ten words that nobody would reject."
    book = rules.ledger(texts(clean, "few words", "a### b### c### d### e### f### g### h### i### j### k###", "x### y"))
    kept = rules.apply_policies(book, [rules.BASE, rules.CURRENT]).orderBy("doc_id").collect()
    assert [(r.kept_base, r.kept_current) for r in kept] == [(True, True), (False, False), (True, False), (False, False)]
    table = {r.rule: (r.failing, r.by_it_alone, r.rejected_without_it) for r in rules.ablations(book).collect()}
    assert table["few_words"] == (2, 1, 2) and table["symbols"] == (2, 1, 2)
    with pytest.raises(ValueError):
        rules.Policy("v", ["no such rule"]).mask


def test_stage_drops_rejected(spark, edge):
    found = stages.passing_rules(spark, edge, "")
    assert found.columns == edge.columns and {r.doc_id for r in found.collect()} == {1}


def test_contamination_of_short_items(spark, texts):
    items = spark.createDataFrame([(1, "Alpha beta"), (2, "one-word"), (3, None), (None, "gamma"), (4, "--"), (10, "ALPHA beta")], "item_id long, text string")
    found = dec.contamination(texts("x alpha, BETA y alpha", "nothing", None, "one word one word"), items).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in found] == [(5, 2, 2), (1, 0, 0), (0, 0, 0), (4, 4, 1)]
    assert found[0].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert found[1].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_large_window_sets_are_shuffled(spark, monkeypatch, edge):
    items = spark.createDataFrame([(1, "two three"), (2, "short text"), (3, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    want = sorted(map(str, dec.contamination(edge, items).drop("spans", "items").collect()))
    monkeypatch.setattr(dec, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, dec.contamination(edge, items).drop("spans", "items").collect())) == want
    assert sum("contaminated=True" in r for r in want) == 4


def test_lower_case_is_ascii_only(spark, texts):
    items = spark.createDataFrame([(1, "École ÉTÉ")], "item_id long, text string")
    found = dec.contamination(texts("école été", "École ÉTÉ", "ÉCOLE ÉTÉ", "École ÉtÉ"), items).orderBy("doc_id").collect()
    assert [r.contaminated for r in found] == [False, True, True, True]
    assert dec.contamination(texts("éCole ÉTÉ"), items).first().contaminated is False


def test_contamination_edges(spark, edge, nothing):
    items = spark.createDataFrame([(9, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    found = dec.contamination(edge, items)
    assert found.count() == 9 and found.where("contaminated").count() == 2
    assert dec.contamination(edge, items.limit(0)).where("contaminated").count() == 0
    assert dec.contamination(nothing, items).count() == 0
    clean = dec.decontaminate(edge, items)
    assert clean.columns == edge.columns and clean.count() == 7  # both copies are mostly hit


def test_spans_are_cut(spark, texts):
    items = spark.createDataFrame([(9, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(20))
    docs = texts(f"{filler}, two three FOUR five six seven eight nine ten eleven! End.", "untouched -- text")
    found = {r.doc_id: r for r in dec.decontaminate(docs, items).collect()}
    assert found[0].text == f"{filler}, End." and found[0].n_chars == len(found[0].text)
    assert found[1].text == "untouched -- text"


def test_shuffled_windows_give_the_same(spark, texts, monkeypatch):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    docs = texts("z a b c d e f g h i j z", "a b c")
    want = dec.contamination(docs, items).orderBy("doc_id").collect()
    monkeypatch.setattr(dec, "BROADCAST_WINDOWS", 0)
    assert dec.contamination(docs, items).orderBy("doc_id").collect() == want


URLS = [
    ("http://A.Example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("https://b.www.example.com/en/", "b.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("ftp://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("x://site.net/es", "site.net", "/es", None, None), ("x://net/fr/a://b", "net", "/fr/a://b", "net/fr/", "block"),
    ("http://h.org?x=/en/", "h.org", "", None, None), ("http://com", "com", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None),
    ("http://a.com\n/x", "a.com\n", "/x", None, None),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u[0], 1) for i, u in enumerate(URLS)], "page_id long, url string, good int")
    labels = spark.createDataFrame([], "page_id long, good int")
    found = url_filter.judge(pages, labels).orderBy("page_id").collect()
    for r, (_, host, path, rule, verdict) in zip(found, URLS):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_reputation_is_shrunk(spark):
    hosts = {"bad.a.org": (0, 40), "new.a.org": (0, 1), "good.b.org": (40, 0), "lone.c.org": (1, 0)}
    rows = [(i, h, v) for i, (h, v) in enumerate((h, v) for h, (g, b) in hosts.items() for v in [1] * g + [0] * b)]
    frame = spark.createDataFrame(rows, "page_id long, host string, good int")
    mean = {r.host: (r.low, r.mean) for r in url_filter.reputation(frame).collect()}
    assert mean["bad.a.org"][1] < 0.1 < 0.9 < mean["good.b.org"][1]
    assert mean["new.a.org"][1] < mean["lone.c.org"][1] and all(low < m for low, m in mean.values())
    assert url_filter.reputation(frame.limit(0)).count() == 0
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, frame.select("page_id", "good")).count() == 0


def test_overlapping_spans_are_cut_once(spark, texts):
    """Any spans of words, many and overlapping, against a plain reconstruction."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(11)
    rows = []
    for i in range(60):
        n = rng.choice([1, 5, 40, 900])
        text = rng.choice(["", "-- "]) + "".join(f"w{k}{rng.choice([' ', ', ', '! '])}" for k in range(n))
        spans = sorted({(a, min(n, a + rng.randint(1, 12))) for a in (rng.randrange(n) for _ in range(rng.randint(1, n)))})
        rows.append((i, text, spans))
    frame = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,stop:int>>")
    for r, (_, text, spans) in zip(frame.withColumn("clean", dec.without_spans(F.col("text"), F.col("spans"))).orderBy("i").collect(), rows):
        hit = {w for a, b in spans for w in range(a, b)}
        pieces = re.findall(r"[A-Za-z0-9]+[^A-Za-z0-9]*", text)
        lead = re.match(r"[^A-Za-z0-9]*", text)[0]
        assert r.clean == lead + "".join(p for k, p in enumerate(pieces) if k not in hit)


def test_many_spans_take_linear_time(texts):
    from time import monotonic

    from pyspark.sql import functions as F

    row = texts("w " * 60_000).select(F.col("text"), F.expr("transform(sequence(0, 59999, 2), x -> named_struct('start', x, 'stop', x + 1))").alias("spans"))
    began = monotonic()
    assert row.select(F.length(dec.without_spans(F.col("text"), F.col("spans")))).first()[0] == 60_000
    assert monotonic() - began < 30
