"""License notices in texts: fingerprints of templates find candidates, an alignment confirms them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from importlib.resources import files
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodestat.llm.words import hash_words, shingles, slices, split_words

GRAM, WINDOW = 3, 2      # words of a fingerprint, grams of which the least is kept
BAND = 4                 # words by which an alignment may leave its diagonal at least
LEAST_COVERAGE = 0.7     # share of a template's words that must be aligned
TEMPLATE_BYTES = 1 << 20  # all templates together; they are sent to every task
_MARKS = ".,;:!?\"'()[]<>*#|/\\-_%=`~{}+“”‘’•–—"  # around words, of punctuation or comments

# Openings and notices of well-known licenses (fixed values).
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
           "General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


def whole_texts() -> dict[str, str]:
    """Whole licenses, NAME-text, of the files beside this module; lines that name an owner are left out of the short ones."""
    own = sorted((f for f in (files("lodestat.llm") / "licenses").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return {f"{f.name.removesuffix('.txt')}-text": f.read_text(encoding="utf-8") for f in own}


TEMPLATES = NOTICES | whole_texts()


def _bare(words: list[str]) -> pa.Array:
    """Words without the marks around them."""
    return pa.array([w.strip(_MARKS) for w in words], pa.string())


def _plain(text: str) -> list[str]:
    """Words without the marks around them, A-Z lower-cased; marks alone are no words."""
    words, _ = split_words(pa.array([text]), lower=True)
    return [w for w in _bare(words.to_pylist()).to_pylist() if w]


def winnow(grams: np.ndarray) -> list[tuple[int, int]]:
    """(gram, place) of the least gram of every WINDOW neighbours, the last of equal ones."""
    if len(grams) == 0:
        return []
    kept = set()
    for i in range(max(1, len(grams) - WINDOW + 1)):
        part = grams[i:i + WINDOW]
        kept.add(i + int(len(part) - 1 - np.argmin(part[::-1])))
    return [(int(grams[i]), i) for i in sorted(kept)]


class TemplateIndex:
    """Inverted index from fingerprints to (template, place), one for each number of words of a fingerprint."""

    def __init__(self, templates: dict[str, str]):
        if sum(len(t.encode()) for t in templates.values()) > TEMPLATE_BYTES:
            raise ValueError("templates are too long to send to every task")
        self.names, self.words, self.tallies, postings = list(templates), [], [], defaultdict(list)
        for t, text in enumerate(templates.values()):
            own = hash_words(pa.array(_plain(text), pa.string()))
            self.words.append(own)
            self.tallies.append(np.unique(own, return_counts=True))
            width = min(GRAM, max(1, len(own)))
            grams, _ = shingles(own, np.array([0, len(own)]), width)
            postings[width] += [(gram, t, place) for gram, place in winnow(grams)]
        self.postings = {}
        for width, rows in sorted(postings.items()):
            if rows:
                grams, template, place = zip(*sorted(rows))
                self.postings[width] = np.array(grams, np.uint64), np.array(template), np.array(place)

    def hits(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(text, template, where the template would begin), distinct and sorted, of all fingerprints found."""
        out = [np.zeros((0, 3), np.int64)]
        for width, (keys, template, place) in self.postings.items():
            grams, ends = shingles(hashes, starts, width)
            low = np.searchsorted(keys, grams)
            at = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == grams)
            low = low[at]
            many = np.searchsorted(keys, grams[at], side="right") - low
            post = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(at, many)
            text = np.searchsorted(ends, at, side="right") - 1
            out.append(np.stack([text, template[post], at - ends[text] - place[post]], axis=1))
        return np.unique(np.concatenate(out), axis=0)


def banded_alignment(template: np.ndarray, text: np.ndarray, band: int, least: float = 0) -> tuple[int, tuple[int, int]]:
    """(words matched, (first, last + 1) in the text) of the best alignment near the diagonal.

    Longest common subsequence within `band` words of the diagonal; `text` is
    the part of the document that the template would cover, `band` words wider
    at both ends. The way back is found from some rows that are kept and the
    rows after them, made again, so that long templates need little memory; it
    is left out where fewer than `least` words match.
    """
    width, size = 2 * band + 1, len(template)
    padded = np.zeros(size + width, dtype=np.uint64)
    padded[:min(len(text), len(padded))] = text[:len(padded)]

    def after(row: np.ndarray, i: int) -> np.ndarray:
        following = np.zeros(width + 1, dtype=np.int32)
        np.maximum(row[1:], np.where(padded[i:i + width] == template[i], row[:-1] + 1, 0), out=following[:-1])
        np.maximum.accumulate(following[:-1], out=following[:-1])
        return following

    step = max(1, int(size ** 0.5))
    kept, row = [], np.zeros(width + 1, dtype=np.int32)
    for i in range(size):
        if i % step == 0:
            kept.append(row)
        row = after(row, i)
    i, d = size, int(np.argmax(row[:width]))
    matched, used, rows, first = int(row[d]), [], [], size
    if matched < least:
        return matched, (0, 0)
    while i > 0:
        if i <= first:
            first = (i - 1) // step * step
            rows = [kept[first // step]]
            for k in range(first, i):
                rows.append(after(rows[-1], k))
        own, before = rows[i - first], rows[i - first - 1]
        if own[d] == 0:
            break
        j = i - 1 + d
        if j < len(text) and text[j] == template[i - 1] and own[d] == before[d] + 1:
            used.append(j)
            i -= 1
        elif own[d] == before[d + 1]:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return matched, (used[-1], used[0] + 1) if used else (0, 0)


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Words that two tallies (distinct words, how often) share: no alignment matches more."""
    (x, many), (y, others) = a, b
    if not len(x) or not len(y):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.where(y[at] == x, np.minimum(many, others[at]), 0).sum())


def _matches(words: np.ndarray, template: np.ndarray, begins: np.ndarray, index: TemplateIndex, least: float):
    """Confirmed notices of one text: (template, first word, last word + 1, words matched)."""
    found, tally = [], np.unique(words, return_counts=True)
    for t in np.unique(template).tolist():
        own, last = index.words[t], -1
        needed = least * len(own)
        if _common(index.tallies[t], tally) < needed:
            continue
        # as many words as may be missing can shift the rest; neighbouring diagonals are tried as one
        band, near = max(BAND, ceil(len(own) - needed)), len(own) // 16
        rest = begins[template == t].tolist()
        k = 0
        while k < len(rest):
            low = high = rest[k]
            k += 1
            if low < last:  # inside the notice found before
                continue
            while k < len(rest) and rest[k] - low <= near:
                high = rest[k]
                k += 1
            side = band + (high - low + 1) // 2
            first = (low + high) // 2 - side
            lead = max(0, -first)
            part = words[first + lead:first + 2 * side + len(own)]
            if _common(index.tallies[t], np.unique(part, return_counts=True)) < needed:
                continue
            part = np.concatenate([np.zeros(lead, np.uint64), part])
            matched, (x, y) = banded_alignment(own, part, side, needed)
            if matched >= needed:
                found.append((t, first + x, first + y, matched))
                last = found[-1][2]
    return found


def _best(found, index: TemplateIndex) -> list[bool]:
    """Whether no other template that covers much of the same words matches more of them, or as many of a shorter text."""
    rank = lambda m: (m[3], m[3] / len(index.words[m[0]]), -m[0])
    best = [True] * len(found)
    order = sorted(range(len(found)), key=lambda i: found[i][1])
    for n, i in enumerate(order):
        for j in order[n + 1:]:
            (t, a, b, _), (u, c, d, _) = found[i], found[j]
            if c >= b:
                break
            if t != u and 2 * (min(b, d) - c) > min(b - a, d - c):
                best[i if rank(found[i]) < rank(found[j]) else j] = False
    return best


_MATCH = pa.struct([("template", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64()), ("best", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch], index: TemplateIndex, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words, all_starts = split_words(part.column("text"), lower=True)
            coded = words.dictionary_encode()
            clean, codes = _bare(coded.dictionary.to_pylist()), np.asarray(coded.indices)
            full = np.asarray(pc.greater(pc.binary_length(clean), 0), dtype=bool)[codes]
            places = np.flatnonzero(full)  # of the words that are more than marks
            hashes = (hash_words(clean) if len(clean) else np.zeros(0, np.uint64))[codes[places]]
            starts = np.searchsorted(places, all_starts)
            hits = index.hits(hashes, starts)
            out = [[] for _ in range(part.num_rows)]
            cuts = np.searchsorted(hits[:, 0], np.arange(part.num_rows + 1))
            for d in np.flatnonzero(np.diff(cuts)).tolist():
                mine = hits[cuts[d]:cuts[d + 1]]
                found = _matches(hashes[starts[d]:starts[d + 1]], mine[:, 1], mine[:, 2], index, least)
                own = places[starts[d]:starts[d + 1]] - all_starts[d]
                for (t, a, b, n), best in zip(found, _best(found, index)):
                    out[d].append({"template": index.names[t], "start": int(own[a]), "stop": int(own[b - 1]) + 1, "matched": n,
                                   "coverage": n / len(index.words[t]), "best": best})
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(all_starts), pa.int64()), pa.array(out, pa.list_(_MATCH))], ["doc_id", "n_words", "matches"])


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """Notices and whole licenses in every text: doc_id, n_words, matches (template, start, stop, matched, coverage, best).

    The templates' word trigrams (of shorter ones all words) are winnowed and
    kept in an inverted index that goes to every task (at most TEMPLATE_BYTES of
    text). All trigrams of a text are looked up; each hit proposes where its
    template would lie, and a banded alignment of the whole template there
    reports how many of its words are found in order and from which word to
    which. The band is as wide as words may be missing, 1 - `least` of the
    template. Where the words, in any order, cannot suffice nothing is aligned.
    Words that are only marks, such as those of a comment block, are passed over,
    but `start` and `stop` count all words. Matches with less than `least` of the
    template are left out. Versions of a license match each other's texts; `best`
    is the one of which the same words match most. NULL and empty
    texts have none. Rows are neither joined nor shuffled; other columns are
    ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_scan, index=TemplateIndex(templates), least=least),
        f"doc_id {kind}, n_words long, matches array<struct<template:string,start:long,stop:long,matched:long,coverage:double,best:boolean>>")
