"""Toxicity by the nearest labelled examples, searched exactly in a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestat.llm.words import hash_words, mix, slices

EXAMPLES = 20_000    # labelled rows to learn from, about; more are thinned by a hash of doc_id
TERMS = 4_096        # terms kept, those that tell toxic examples from others best
SUPPORT = 3          # toxic examples a term must occur in
LIFT = 3.0           # times as frequent in toxic examples as in others
STEMS = (3, 4, 5, 6)  # characters of a word's beginning that are terms besides the word
OFTEN = (1, 2, 3)    # a term also counts as found at least so often in a text
NEIGHBOURS = 15
_BLOCK = 64          # examples of an index block
_NEAR = 0.1          # added to distances before they divide a vote
THRESHOLD = 0.7
_U = np.uint64


def _coded(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased runs of letters, coded, and the text that each comes from."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL]+", " ")
    lists = pc.ascii_split_whitespace(clean)
    words, owner = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full).dictionary_encode(), owner[np.asarray(full)]


def _terms(words: pa.Array) -> np.ndarray:
    """One row per word: hashes of the word and of its stems (0 where it is no longer than the stem)."""
    sizes = np.asarray(pc.utf8_length(words))
    cols = [mix(hash_words(words) + _U(1))] if len(words) else [np.zeros(0, np.uint64)]
    for n in STEMS:
        stem = pc.utf8_slice_codeunits(words, 0, n)
        own = mix(hash_words(stem) + _U(n + 1)) if len(words) else np.zeros(0, np.uint64)
        cols.append(np.where(sizes > n, own, _U(0)))
    return np.stack(cols, axis=1)


def _occurrences(coded: pa.DictionaryArray, owner: np.ndarray, terms: np.ndarray, use: np.ndarray):
    """(text, term, how often): `terms` has a row of numbers per distinct word, of which `use` count."""
    word = np.asarray(coded.indices, dtype=np.int64)
    some = use.any(axis=1)[word] if len(word) else np.zeros(0, bool)
    doc, word = owner[some].astype(np.int64), word[some]
    mine = use[word]
    most = int(terms.max(initial=0)) + 1
    pairs, often = np.unique(np.repeat(doc, mine.sum(axis=1)) * most + terms[word][mine], return_counts=True)
    return pairs // most, pairs % most, often


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other examples of a batch each term occurs at least so often."""
    for batch in batches:
        for part in slices(batch):
            coded, owner = _coded(part.column("text"))
            hashes = _terms(coded.dictionary)
            keys, at = np.unique(hashes, return_inverse=True)
            doc, term, often = _occurrences(coded, owner, at.reshape(hashes.shape).astype(np.int64), hashes != 0)
            toxic = np.asarray(part.column("toxic"), dtype=np.int64)
            for least in OFTEN:
                use = often >= least
                ones = np.bincount(term[use], toxic[doc[use]], len(keys)).astype(np.int64)
                all_ = np.bincount(term[use], minlength=len(keys))
                some = all_ > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)[some]), pa.array(np.full(some.sum(), least), pa.int64()), pa.array(ones[some]),
                     pa.array((all_ - ones)[some])], ["term", "least", "ones", "others"])


def select_terms(examples: DataFrame, toxic: int, clean: int) -> list[tuple[int, int, int]]:
    """(term, how often at least, examples) of what tells best, by log-likelihood ratio; at most TERMS."""
    if not toxic or not clean:
        return []
    counts = examples.mapInArrow(_counted, "term long, least long, ones long, others long").groupBy("term", "least").agg(
        F.sum("ones").alias("ones"), F.sum("others").alias("others"))
    a, b = F.col("ones").cast("double"), F.col("others").cast("double")
    part = lambda seen, n: F.when(seen > 0, seen * F.ln(seen * (toxic + clean) / ((a + b) * n))).otherwise(0.0)
    rows = counts.where((a >= SUPPORT) & (a / toxic > LIFT * b / clean)).withColumn("ratio", part(a, toxic) + part(b, clean)).orderBy(
        F.desc("ratio"), "term", "least").limit(TERMS).collect()
    return [(r["term"] % (1 << 64), r["least"], r["ones"] + r["others"]) for r in rows]


class Vocabulary:
    """The selected terms: hashes, and for each number of times its place in a vector."""

    def __init__(self, chosen: list[tuple[int, int, int]], examples: int):
        self.size = len(chosen)
        self.keys = np.unique(np.array([t for t, _, _ in chosen], dtype=np.uint64))
        self.places = np.full((len(self.keys), len(OFTEN)), -1)
        self.idf = np.zeros(self.size)
        for i, (term, least, seen) in enumerate(chosen):
            self.places[np.searchsorted(self.keys, np.uint64(term)), OFTEN.index(least)] = i
            self.idf[i] = np.log((1 + examples) / (1 + seen)) + 1

    def vectors(self, texts: pa.Array):
        """(text, term, weight) of every text's unit TF-IDF vector, by text."""
        coded, owner = _coded(texts)
        hashes = _terms(coded.dictionary)
        at = np.searchsorted(self.keys, hashes)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == hashes if self.size else np.zeros(hashes.shape, bool)
        doc, key, often = _occurrences(coded, owner, np.where(known, at, 0).astype(np.int64), known)
        rows = []
        for j, least in enumerate(OFTEN):
            place = self.places[key, j] if self.size else key
            use = (often >= least) & (place >= 0)
            rows.append((doc[use], place[use], self.idf[place[use]]))
        doc, term, weight = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((term, doc))
        doc, term, weight = doc[order], term[order], weight[order]
        return doc, term, weight / np.sqrt(np.bincount(doc, weight ** 2, len(texts)))[doc]


class BlockMaxIndex:
    """Postings of the examples' vectors in blocks, with each term's greatest weight in a block."""

    def __init__(self, ids, labels, starts, terms, weights, size: int):
        lead = np.array([terms[a:b][np.argmax(weights[a:b])] for a, b in zip(starts[:-1], starts[1:])], dtype=np.int64)
        order = np.lexsort((ids, lead))  # examples of the same leading term share blocks
        self.ids, self.labels = ids[order], labels[order]
        blocks = max(1, -(-len(order) // _BLOCK))
        self.most = np.zeros((size, blocks))
        self.rows = []
        for b in range(blocks):
            own = order[b * _BLOCK:(b + 1) * _BLOCK]
            spans = [np.arange(starts[i], starts[i + 1]) for i in own]
            at = np.concatenate(spans) if spans else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(own)), [len(s) for s in spans])
            np.maximum.at(self.most[:, b], terms[at], weights[at])
            self.rows.append((row, terms[at], weights[at], len(own)))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, count: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the `count` nearest examples (equal ones by doc_id), never of `but`.

        Blocks are opened in order of the greatest cosine they could hold, until
        none can reach the last of those found.
        """
        bound = weights @ self.most[terms]
        query = np.zeros(len(self.most))
        query[terms] = weights
        place, cosine = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(cosine) == count and bound[b] < cosine[-1] - 1e-12):
                break
            row, term, weight, size = self.rows[b]
            own = np.bincount(row, weight * query[term], size)
            hit = np.flatnonzero(own > 0)
            place, cosine = np.concatenate([place, hit + b * _BLOCK]), np.concatenate([cosine, own[hit]])
            use = place != but
            place, cosine = place[use], np.round(cosine[use], 12)
            best = np.lexsort((self.ids[place], -cosine))[:count]
            place, cosine = place[best], cosine[best]
        return place, cosine

    def vote(self, place: np.ndarray, cosine: np.ndarray, prior: float) -> float:
        """Share of toxic neighbours, near ones counting more, with the prior as one at full distance."""
        weight = 1 / (1 - np.minimum(cosine, 1) + _NEAR)
        far = 1 / (1 + _NEAR)
        return float(((weight * self.labels[place]).sum() + far * prior) / (weight.sum() + far))


def calibration(votes: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (above 0) and offset of a logistic curve from votes to chances, lightly regularised."""
    if len(votes) == 0:
        return 6.0, -3.0
    beta = np.array([6.0, -3.0])
    centre, ridge = beta.copy(), np.diag([0.05, 0.05])
    x = np.stack([votes, np.ones(len(votes))], axis=1)
    for _ in range(rounds):
        mean = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (mean * (1 - mean))[:, None]).T @ x + ridge, x.T @ (labels - mean) - ridge @ (beta - centre))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.1), float(beta[1])


@dataclass
class Model:
    """What every task needs to score: bounded by EXAMPLES and TERMS."""

    vocabulary: Vocabulary
    index: BlockMaxIndex | None
    prior: float       # share of toxic examples
    blank: float       # share among examples without any term
    slope: float
    offset: float

    def chance(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.offset))))

    def score(self, terms, weights) -> tuple[float, list[int], list[float]]:
        if self.index is None or len(terms) == 0:
            return self.blank, [], []
        place, cosine = self.index.nearest(terms, weights, NEIGHBOURS)
        return self.chance(self.index.vote(place, cosine, self.prior)), self.index.ids[place].tolist(), cosine.tolist()


def _vector_rows(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            doc, term, weight = vocabulary.vectors(part.column("text"))
            cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v)) for v in (term, weight)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *lists], ["doc_id", "toxic", "terms", "weights"])


def sample_labels(labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic) of rows to learn from: labelled, and crc32 of doc_id mod 3 not 1; about `most`.

    Repeated labels of a document count as the highest.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("long").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    share = min(1.0, most / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30)) < int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Model:
    """Terms, index and calibration from labelled rows, of which at most about `most` are used."""
    sample = F.broadcast(sample_labels(labels, most))  # two numbers a row, bounded by `most`
    examples = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(sample, "doc_id")
    counts = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    chosen = select_terms(examples, toxic, clean)
    vocabulary = Vocabulary(chosen, toxic + clean)
    prior = toxic / (toxic + clean) if toxic + clean else 0.0
    if not chosen:
        return Model(vocabulary, None, prior, prior, *calibration(np.zeros(0), np.zeros(0)))
    made = examples.mapInArrow(partial(_vector_rows, vocabulary=vocabulary), "doc_id long, toxic long, terms array<long>, weights array<double>")
    some = made.where(F.size("terms") > 0).dropDuplicates().toArrow()  # bounded by `most`
    blank = made.where(F.size("terms") == 0).agg(F.sum("toxic"), F.count(F.lit(1))).first()
    share = (blank[0] or 0) / blank[1] if blank[1] else prior
    ids, own = some.column("doc_id").to_numpy(), some.column("toxic").to_numpy()
    terms, weights = some.column("terms").combine_chunks(), some.column("weights").combine_chunks()
    starts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(terms), dtype=np.int64))])
    term, weight = np.asarray(terms.flatten()), np.asarray(weights.flatten())
    index = BlockMaxIndex(ids, own, starts, term, weight, vocabulary.size)
    place_of = {i: p for p, i in enumerate(index.ids.tolist())}
    votes = np.array([
        index.vote(*index.nearest(term[a:b], weight[a:b], NEIGHBOURS, place_of[i]), prior)
        for i, a, b in zip(ids.tolist(), starts[:-1], starts[1:])])
    return Model(vocabulary, index, prior, share, *calibration(votes, own))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            doc, term, weight = model.vocabulary.vectors(part.column("text"))
            cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
            rows = [model.score(term[a:b], weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            scores, near, cosines = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())),
                pa.array(cosines, pa.list_(pa.float64()))], ["doc_id", "score", "evidence", "cosines"])


def toxicity(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, threshold: float = THRESHOLD) -> DataFrame:
    """Score of every document: doc_id, held_out, score, predicted, evidence, cosines.

    Terms are words and their beginnings; those are kept that tell toxic
    examples from others, so long texts compare by what matters. A document's
    score comes from the votes of the NEIGHBOURS examples of greatest cosine,
    found exactly, each by its nearness, set to a chance by a logistic curve
    fitted to the examples' leave-one-out votes. `evidence` lists the examples,
    `cosines` how near they are. A text without any of the terms, so also a NULL
    or empty one, scores the share of toxic examples among such texts.

    Labels of rows with crc32(doc_id as text) mod 3 = 1 are never read; those
    rows are `held_out`. Without labels all scores are 0. Neither labels nor
    lang, source or doc_id are inputs of a score. Repeated rows each get their
    score; other columns are ignored.
    """
    model = fit(docs, labels, most)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_scored, model=model), f"doc_id {kind}, score double, evidence array<long>, cosines array<double>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "cosines")
