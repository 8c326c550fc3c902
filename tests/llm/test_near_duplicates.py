import random
import re

import pytest

from lodestat.llm import near_duplicates as near, stages
from lodestat.llm.components import connected
from lodestat.llm.near_duplicates import near_duplicates


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute_force(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            common = len(sets[i] & sets[j])
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed=3):
    """Groups of copies edited ever more, a passage many share, short texts and upper-case copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    shared = [word() for _ in range(40)]
    for size in (1, 2, 3, 60):
        base = [word() for _ in range(120)]
        for k in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    out += [" ".join(shared + [word() for _ in range(60)]) for _ in range(50)]
    out += ["a b c", "A b  c", "a b c d e", "x", None, "", out[0].upper(), out[5]]
    return list(enumerate(out))


@pytest.mark.parametrize("limits", [{}, {"leaf_docs": 16, "leaf_shingles": 2_000, "depth": 3}])
def test_equals_brute_force(spark, limits):
    rows = corpus()
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_force(rows)


def test_edges(edge, nothing):
    found = near_duplicates(edge).collect()
    assert len(found) == 9
    by = {r.doc_id: r for r in found}
    assert (by[2].n_shingles, by[2].component_id, by[2].kept) == (0, 2, True)
    assert by[3].n_shingles == by[4].n_shingles == 0 and by[4].kept
    assert (by[7].component_id, by[7].kept) == (6, False)
    assert by[None].component_id is None and by[None].kept
    assert by[5].n_shingles == 2
    assert near_duplicates(nothing).count() == 0


def test_stage_keeps_one_of_each(spark, edge):
    found = stages.one_of_each(spark, edge, "")
    assert found.columns == edge.columns
    assert sorted((r.doc_id or 0) for r in found.collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_groups_to_confirm_are_packed_by_shingles(spark, monkeypatch):
    own = near._confirm

    def checked(table, *limits):
        assert sum(table.column("n").to_pylist()) <= 3200
        return own(table, *limits)

    monkeypatch.setattr(near, "_confirm", checked)
    rows = [(2 * i + j, " ".join(f"w{i}x{k}" for k in range(203 + j))) for i in range(60) for j in range(2)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf_shingles=400).collect()
    assert sum(r.kept for r in found) == 60


def test_stage_decides_for_each_text_of_a_doc_id(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one), (2, one), (2, two), (3, two), (4, one), (4, None), (4, three), (4, three), (5, one)]
    found = stages.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, one), (2, two), (4, None), (4, three)], key=str)


def test_components_of_chains_and_stars(spark):
    chain = [(i + 1, i) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    found = dict(connected(spark.createDataFrame(chain + star, "a long, b long")).collect())
    assert set(found.values()) == {0, 100} and found[40] == 0 and found[129] == 100
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def template_family(many, seed=5):
    """Documents of one template, alike but not linked, and a few linked pairs among them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(300)]
    rows = [(i, " ".join(shared + [word() for _ in range(34)])) for i in range(many)]
    return rows + [(many + i, rows[i][1] + " " + word()) for i in range(0, many, 60)]


def test_crowds_of_similar_documents_are_not_paired(spark):
    many = {}
    for docs in (300, 1200):
        rows = template_family(docs)
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        run = near._Join(frame, 5, 85, 10, 96, 50, 1_000_000, 1)
        leaves = run.nodes()[0]
        assert leaves.groupBy("leaf").count().agg({"count": "max"}).first()[0] <= 50
        many[docs] = leaves.count()
        found = {r.doc_id: r.component_id for r in near_duplicates(frame, leaf_docs=50, depth=1).collect()}
        assert found == {i: i - docs if i >= docs else i for i, _ in rows}
    assert many[1200] < 6 * many[300]  # pairs would be 16 times as many


def test_crowds_whose_common_shingles_suffice(spark):
    """Templates so long that some documents are linked by them alone, in a crowd with unlinked ones."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(300)]
    rows = [(i, " ".join(shared + [word() for _ in range(rng.choice([5, 18, 24, 30, 40, 60]))])) for i in range(150)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf_docs=20, depth=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_force(rows)


def test_common_by_search_and_by_products(monkeypatch):
    import numpy as np

    monkeypatch.setattr(near, "_MANY_PAIRS", 100)

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(60)]
    every = np.stack([*np.triu_indices(60, 1), np.zeros(1770, np.int64)])
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j, _ in every.T]
    assert near._common(sets, every).tolist() == want
    assert near._common(sets, every[:, :3]).tolist() == want[:3]
