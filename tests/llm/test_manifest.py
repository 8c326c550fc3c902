"""The Merkle manifest against a plain recomputation."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from lodestat.llm import manifest as man

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    said = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in said])


def climb(nodes, at, new):
    """The top of a tree, with one leaf replaced as well, and the siblings met."""
    met = ""
    while len(nodes) > 1:
        run = nodes[at // 8 * 8:at // 8 * 8 + 8]
        met += "".join(run[:at % 8] + run[at % 8 + 1:])
        new = h(*run[:at % 8], new, *run[at % 8 + 1:])
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        at //= 8
    return nodes[0], met, new


def brute(rows):
    trees = {}
    for r in rows:
        late = r.text
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and late is not None:
            late = "".join(c.lower() if "A" <= c <= "Z" else c for c in late)
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), leaf(r, late), r.doc_id))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])
    tops = [climb([x[2] for x in trees[lang]], 0, "")[0] for lang in langs]
    out = []
    for no, lang in enumerate(langs):
        nodes = [x[2] for x in trees[lang]]
        for at, (_, _, own, late, doc_id) in enumerate(trees[lang]):
            top, met, new = climb(nodes, at, late)
            root, more, new = climb(tops, no, new)
            out.append((doc_id, own, top, root, h(met + more), new, new == root))
    return Counter(out)


def documents(count, langs, seed=1):
    rng = random.Random(seed)
    for i in range(count):
        lang = rng.choices(langs, [9] + [1] * (len(langs) - 1))[0]
        yield (i, rng.choice(["Some TEXT", "lower", "", None, "ÉTÉ 😀"]) , lang, rng.choice(["a", None]), rng.choice([1, None]), 0, "")


@pytest.mark.parametrize("count, langs", [(1, ["en"]), (9, ["en", "é", None]), (600, ["en", None]), (700, [f"l{i}" for i in range(90)]), (5000, ["en", "de"])])
def test_equals_recomputation(spark, count, langs):
    docs = spark.createDataFrame(list(documents(count, langs)), SCHEMA)
    found = man.manifest(docs, man.lower_cased()).collect()
    assert Counter(map(tuple, found)) == brute(docs.collect())
    if count > 8:
        assert {r.verified for r in found} == {True, False}


def test_small_groups_and_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(man, "_LEVELS", 1)
    monkeypatch.setattr(man, "_SPAN", 8)
    docs = spark.createDataFrame(list(documents(600, ["en", "de", None])), SCHEMA)
    assert Counter(map(tuple, man.manifest(docs, man.lower_cased()).collect())) == brute(docs.collect())


def test_edges(spark, edge, nothing):
    assert Counter(map(tuple, man.manifest(edge, man.lower_cased()).collect())) == brute(edge.collect())
    assert man.manifest(nothing, man.lower_cased()).count() == 0
    assert all(r.verified for r in man.manifest(edge).collect())


def test_proofs_lead_to_the_root(spark, edge):
    docs = spark.createDataFrame(list(documents(900, ["en", "de", None])), SCHEMA)
    for frame in (docs, edge):
        found = man.manifest(frame, proofs=True)
        both = found.withColumn("folded", man.folded(found["leaf"], found["siblings"]))
        for r in both.collect():
            assert r.folded == r.root and r.proof_sha256 == h(*[s.before + s.after for s in r.siblings])
