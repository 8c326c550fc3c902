"""Quality by weak labels: heuristic labelers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestat.llm.tables import store
from lodestat.llm.words import hash_words, mix, slices, split_words

TRAINING = 10_000   # documents the scorer is trained on, about; chosen by a hash of the row
DIMENSIONS = 1 << 14
_U = np.uint64
_GOOD, _BAD, _NONE = 1, 0, 2

# Frequent words of four languages (fixed values).
_COMMON = frozenset(
    "the of and to in is that it was for on with as be at by this have from or an you are not "
    "der die und das von den mit ist des auf für im dem nicht ein eine auch sich es "
    "de la le et les des un une du que est pour dans qui au sur pas par plus elle ou "
    "el en los y se del las por con para su al lo como más pero sus una mi".split())
LABELERS = ("length", "symbols", "case", "variety", "sentences", "common_words", "tables", "lines", "prose")


def _votes(part: pa.RecordBatch) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """Each labeler's vote on each text; also the coded words and where each text's begin."""
    texts = pc.fill_null(part.column("text"), "")
    words, starts = split_words(texts)
    coded = words.dictionary_encode()
    at = np.asarray(coded.indices, dtype=np.int64)
    own = coded.dictionary
    counts = np.diff(starts)
    size = np.maximum(counts, 1)
    doc = np.repeat(np.arange(len(counts)), counts)

    def share(flags: pa.Array) -> np.ndarray:
        """Of a text's words, the share that has a property (or its sum per word)."""
        use = np.asarray(flags, dtype=float)
        return np.bincount(doc, use[at], len(counts)) / size if len(own) else np.zeros(len(counts))

    plain = pc.utf8_lower(pc.utf8_trim(own, characters=".,;:!?"))
    symbols = share(pc.count_substring_regex(own, r"[#*$%&|<>!~^=_{}\[\]]"))
    upper = share(pc.and_(pc.utf8_is_upper(own), pc.greater(pc.utf8_length(own), 1)))
    ends = share(pc.match_substring_regex(own, r"[.!?:;]$"))
    common = share(pc.is_in(plain, value_set=pa.array(sorted(_COMMON))))
    bars = share(pc.is_in(own, value_set=pa.array(["|", "||", "-", "*", "•"])))
    pairs = np.unique(doc * (len(own) + 1) + at)
    variety = np.bincount(pairs // (len(own) + 1), minlength=len(counts)) / size
    lines = pc.split_pattern(texts, "\n").to_pylist()
    repeated = np.array([1 - len(set(x)) / len(x) if (x := [y for y in own_ if y.strip()]) else 0.0 for own_ in lines])
    long_ = counts >= 50

    def vote(bad, good) -> np.ndarray:
        return np.where(bad, _BAD, np.where(good, _GOOD, _NONE))

    none = np.zeros(len(counts), bool)
    all_ = [
        vote(none, counts >= 50), vote(symbols > 0.15, none), vote(upper > 0.15, none), vote(long_ & (variety < 0.25), none),
        vote(long_ & (ends < 0.005), none), vote((counts >= 30) & (common < 0.02), long_ & (common > 0.15)),
        vote(bars > 0.3, none), vote(repeated > 0.3, none),
        vote(none, (counts > 0) & (symbols < 0.1) & (upper < 0.1) & (bars < 0.02) & (repeated < 0.1)
             & (~long_ | ((variety >= 0.25) & (ends >= 0.005))))]
    return np.stack(all_, axis=1) if len(counts) else np.zeros((0, len(LABELERS)), np.int64), coded, starts


def _shapes(words: pa.Array) -> pa.Array:
    """Letters and digits by class, runs shortened, other characters as they are."""
    for pattern, mark in ((r"[0-9]+", "9"), (r"\p{Ll}+", "a"), (r"\p{Lu}{2,}", "AA")):
        words = pc.replace_substring_regex(words, pattern, mark)
    return words


def _features(coded: pa.DictionaryArray, starts: np.ndarray):
    """(text, place, value): logarithmic counts of each text's hashed words and word shapes, unit length."""
    own = coded.dictionary
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at, counts = np.asarray(coded.indices, dtype=np.int64), np.diff(starts)
    place = np.stack([
        hash_words(pc.utf8_lower(own)) % _U(DIMENSIONS), mix(hash_words(_shapes(own))) % _U(DIMENSIONS)]).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs, many = np.unique(np.concatenate([doc * DIMENSIONS + p[at] for p in place]), return_counts=True)
    doc, col = pairs // DIMENSIONS, pairs % DIMENSIONS
    value = np.log1p(many)
    return doc, col, value / np.sqrt(np.bincount(doc, value ** 2, len(counts)))[doc]


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(len(LABELERS)))


def _unpack(patterns) -> np.ndarray:
    return (np.asarray(patterns, dtype=np.int64)[:, None] // 3 ** np.arange(len(LABELERS))) % 3


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a batch shows each pattern of votes."""
    for batch in batches:
        for part in slices(batch):
            values, counts = np.unique(_pattern(_votes(part)[0]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["pattern", "docs"])


@dataclass
class LabelModel:
    prior: float
    said: np.ndarray  # (class, labeler, vote): chance of each vote, abstaining included

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that a document is good."""
        gain = np.log(self.said[1]) - np.log(self.said[0])
        score = np.log(self.prior) - np.log1p(-self.prior) + sum(gain[j][votes[:, j]] for j in range(len(LABELERS)))
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))

    @property
    def accuracy(self) -> np.ndarray:
        """Of each labeler's votes, the share that is right."""
        share = np.array([1 - self.prior, self.prior])[:, None]
        right = share * np.stack([self.said[0][:, _BAD], self.said[1][:, _GOOD]])
        return right.sum(axis=0) / (share * self.said[:, :, :2].sum(axis=2)).sum(axis=0)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """How each labeler votes on good and on bad documents, from how votes go together.

    Most labelers know one bad sign and abstain without it, so abstaining is a
    vote too. The start takes a bad sign for more than a good one; on good
    documents no labeler votes bad more often than on bad ones. The votes of
    all documents count, as at most 3 ** labelers patterns.
    """
    votes, weight = _unpack(patterns), np.asarray(counts, float)
    good = 1 / (1 + np.exp(-(1.0 + (votes == _GOOD).sum(axis=1) - 4.0 * (votes == _BAD).sum(axis=1))))
    model = None
    for _ in range(rounds):
        said = np.zeros((2, len(LABELERS), 3))
        for t, share in ((0, weight * (1 - good)), (1, weight * good)):
            for v in (_BAD, _GOOD, _NONE):
                said[t, :, v] = (share[:, None] * (votes == v)).sum(axis=0) + 0.5
        said /= said.sum(axis=2, keepdims=True)
        said[1, :, _BAD] = np.minimum(said[1, :, _BAD], said[0, :, _BAD])
        said /= said.sum(axis=2, keepdims=True)
        model = LabelModel(float(np.clip((weight * good).sum() / max(weight.sum(), 1), 0.05, 0.95)), said)
        before, good = good, model.posterior(votes)
        if np.abs(good - before).max(initial=0) < 1e-8:
            break
    return model


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            votes, coded, starts = _votes(part)
            doc, col, value = _features(coded, starts)
            cuts = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (col, value)]
            yield pa.RecordBatch.from_arrays([pa.array(_pattern(votes), pa.int64()), *lists], ["pattern", "cols", "vals"])


def train(rows: pa.Table, model: LabelModel, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer of the posterior labels, by gradient steps scaled per weight."""
    target = model.posterior(_unpack(rows.column("pattern").to_numpy()))
    cols, vals = rows.column("cols").combine_chunks(), rows.column("vals").combine_chunks()
    row = np.repeat(np.arange(len(target)), np.asarray(pc.list_value_length(cols), dtype=np.int64))
    col, val = np.asarray(cols.flatten()), np.asarray(vals.flatten())
    weights, offset, n = np.zeros(DIMENSIONS), 0.0, max(1, len(target))
    seen, seen_offset = np.full(DIMENSIONS, 1e-12), 1e-12
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(np.bincount(row, val * weights[col], len(target)) + offset))) - target) / n
        slope = np.bincount(col, val * error[row], DIMENSIONS) + 1e-6 * weights
        seen, seen_offset = seen + slope ** 2, seen_offset + error.sum() ** 2
        weights, offset = weights - 0.5 * slope / np.sqrt(seen), offset - 0.5 * error.sum() / np.sqrt(seen_offset)
    return weights, float(offset)


def _scored(batches: Iterator[pa.RecordBatch], model: LabelModel, weights: np.ndarray, offset: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            votes, coded, starts = _votes(part)
            doc, col, value = _features(coded, starts)
            score = 1 / (1 + np.exp(-(np.bincount(doc, value * weights[col], part.num_rows) + offset)))
            score[np.diff(starts) == 0] = 0.0
            said = ["".join("01-"[v] for v in row) for row in votes.tolist()]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(said, pa.string()), pa.array(model.posterior(votes)), pa.array(score)],
                ["doc_id", "votes", "posterior", "score"])


def quality(docs: DataFrame, most: int = TRAINING, threshold: float = 0.5) -> DataFrame:
    """Quality of every document: doc_id, votes, posterior, score, kept.

    Overlapping heuristics vote good, bad or nothing on every text (`votes`, in
    the order of LABELERS). The counts of vote patterns over all documents give
    the labelers' accuracies by expectation-maximisation; the posteriors of
    about `most` documents, chosen by a hash of the row, train a linear scorer
    over hashed words and word shapes, which scores all. A text without words,
    NULL or empty, scores 0 and is not kept. Rows are neither joined nor
    shuffled; other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = store(rows.mapInArrow(_patterns, "pattern long, docs long").groupBy("pattern").agg(F.sum("docs").alias("docs")))
    seen = counts.orderBy("pattern").collect()  # bounded by 3 ** labelers
    total = sum(r["docs"] for r in seen)
    model = estimate(np.array([r["pattern"] for r in seen], np.int64), np.array([r["docs"] for r in seen]))
    share = min(1.0, most / max(1, total))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < int(share * (1 << 30)))
    weights, offset = train(sample.mapInArrow(_training_rows, "pattern long, cols array<long>, vals array<double>").toArrow(), model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(
        partial(_scored, model=model, weights=weights, offset=offset), f"doc_id {kind}, votes string, posterior double, score double")
    return found.withColumn("kept", F.col("score") >= threshold)
