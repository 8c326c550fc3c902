"""Words and shingles of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SLICE = 8 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text, whole texts each."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    piece = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words (runs of other than ASCII white space) and where each text's begin.

    A NULL text has no words. Only A-Z are lower-cased.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, starts = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    starts = starts - starts[0]
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    seen = np.concatenate([[0], np.cumsum(full)])
    return (words if full.all() else words.filter(pa.array(full))), seen[starts]


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return own[np.asarray(coded.indices)]


def shingles(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words and where each text's begin.

    A text of fewer words has its whole sequence as the only one; one of no
    words has none.
    """
    counts = np.diff(starts)
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(starts[:-1], many) + np.arange(ends[-1]) - np.repeat(ends[:-1], many)
    length = np.repeat(np.minimum(counts, width), many).astype(np.uint64)
    value = mix(length)
    for j in range(width):
        use = length > j
        word = hashes[np.where(use, first + j, first)]
        value = np.where(use, mix(value + word), value)
    return value, ends


def distinct_sets(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text and where each text's begin."""
    sets = [np.unique(values[a:b]) for a, b in zip(starts[:-1], starts[1:])]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
    return (np.concatenate(sets) if sets else values[:0]), ends
