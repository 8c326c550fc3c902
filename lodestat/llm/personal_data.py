"""Personal data by weak supervision: labelers vote on candidate spans, a model decides."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestat.llm.tables import store

# Kinds in the order of the result; the first four have a base pattern.
KINDS = ("email", "ip", "card", "phone", "secret")
_MAILBOX = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_MAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match takes whole runs of digits, so it may only start where a run does
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Wider shapes that the base patterns do not take: national numbers and keys.
_LOCAL = re.compile(r"\([0-9]{2,4}\)[\x20-]?[0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
_DIGIT = re.compile(r"[0-9]")

# Fixed lists of the labelers.
_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu it nl ch at be pl ca us au jp cn in br mx".split())
_CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
_KEY_STARTS = ("ghp_", "gho_", "AKIA", "sk-", "xox", "eyJ", "AIza")
_CUES = {
    "email": "mail write contact kontakt correo courriel", "ip": "ip host server address from adresse",
    "card": "card visa pay karte carte tarjeta credit", "phone": "tel phone call fax mobile telefon telefono",
    "secret": "token secret key password passwd pwd api auth bearer clave schluessel",
}
_CUES = {k: re.compile(r"(?<![a-z])(" + "|".join(v.split()) + r")[^a-z0-9]{0,6}$") for k, v in _CUES.items()}
_COUNTER_CUE = re.compile(r"(?<![a-z])(isbn|version|page|order|id|sha|commit|checksum|md5|uuid)[^a-z0-9]{0,6}$")
_CONTEXT = 24
LABELERS = ("pattern", "gazetteer", "context", "shape")
_YES, _NO, _NONE = 1, 0, 2  # votes; the code of a pattern holds them in base 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of [mailbox]+@host, found from each @ so that long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_MAILBOX))
        host = _MAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        free = host.end() if host else at + 1
        at = text.find("@", free)


def _strict(kind: str, span: str) -> bool:
    """Whether a match of the kind's base pattern counts."""
    if kind == "ip":
        parts = [part.lstrip("0") for part in span.split(".")]
        return all(len(part) <= 3 and int(part or "0") <= 255 for part in parts)
    if kind == "card":
        digits = _digits(span)
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return span.startswith("+") and 9 <= len(_digits(span)) <= 15
    return kind == "email"


def _gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return _YES if span.rsplit(".", 1)[1].lower() in _DOMAINS else _NO
    if kind == "ip":
        return _NO if span.split(".")[0] in ("0", "127", "255") else _NONE
    if kind == "card":
        return _YES if _digits(span).startswith(_ISSUERS) else _NO
    if kind == "phone":
        return (_YES if span[1:].startswith(_CALLING) else _NO) if span.startswith("+") else _NONE
    return _YES if span.startswith(_KEY_STARTS) else _NONE


def _context(kind: str, before: str) -> int:
    before = before.lower()
    return _YES if _CUES[kind].search(before) else _NO if _COUNTER_CUE.search(before) else _NONE


def _shape(kind: str, span: str) -> int:
    """Whether the characters look drawn, not counted or spelled."""
    if kind == "secret":
        classes = sum(bool(re.search(p, span)) for p in ("[0-9]", "[a-z]", "[A-Z]"))
        return _YES if classes >= 2 and len(set(span)) >= 10 and any("0" <= c <= "9" for c in span) else _NO
    digits = _digits(span)
    if kind == "email":
        return _YES if len(span) <= 254 and ".." not in span else _NO
    return _YES if len(set(digits)) >= min(4, len(digits) // 2) else _NO


@dataclass(frozen=True)
class Span:
    kind: int
    start: int
    stop: int
    base: bool
    pattern: int


def _votes(kind: int, span: str, before: str) -> int:
    name, code = KINDS[kind], 0
    pattern = _YES if _strict(name, span) else _NO if name != "secret" else _NONE
    for vote in (pattern, _gazetteer(name, span), _context(name, before), _shape(name, span)):
        code = code * 3 + vote
    return code * len(KINDS) + kind


def _loose(kind: str, span: str) -> bool:
    """Whether a match that fails the base rule is still a candidate."""
    if kind == "card":
        return 13 <= len(_digits(span)) <= 19
    if kind == "phone":
        return 7 <= len(_digits(span)) <= 15
    return False


def spans_of(text: str) -> list[Span]:
    """Base spans and the method's candidates of a text; no candidate overlaps another span."""
    base: list[tuple[int, int, int]] = []
    more: list[tuple[int, int, int]] = []

    def scan(kind: int, pattern: re.Pattern) -> None:
        name = KINDS[kind]
        for m in pattern.finditer(text):
            if _strict(name, m[0]):
                base.append((kind, m.start(), m.end()))
            elif _loose(name, m[0]):
                more.append((kind, m.start(), m.end()))

    base += [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        scan(1, _IP)
        scan(2, _CARD)
        if "+" in text:
            scan(3, _PHONE)
        more += [(3, m.start(), m.end()) for m in _LOCAL.finditer(text)]
    more += [(4, m.start(), m.end()) for m in _SECRET.finditer(text)]
    if not base and not more:
        return []
    base.sort()
    taken = sorted((a, b) for _, a, b in base)
    chosen = []
    for kind, a, b in sorted(more, key=lambda s: (s[1] - s[2], s[1], s[0])):
        i = bisect_right(taken, (a, math.inf))
        if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b) or any(x < b and a < y for x, y in taken[max(0, i - 2):i + 2]):
            continue
        taken.insert(i, (a, b))
        chosen.append((kind, a, b))
    make = lambda s, own: Span(*s, own, _votes(s[0], text[s[1]:s[2]], text[max(0, s[1] - _CONTEXT):s[1]]))
    return [make(s, True) for s in base] + [make(s, False) for s in sorted(chosen)]


_FOUND = "found array<struct<kind:int,start:long,stop:long,base:boolean,pattern:int>>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("pattern", pa.int32())]))
    for batch in batches:
        found, counts, digests = [], [[] for _ in range(4)], []
        for text in batch.column("text"):
            own = spans_of(text.as_py() or "")
            found.append([vars(s) for s in own])
            for k in range(4):
                counts[k].append(sum(s.base and s.kind == k for s in own))
            said = ",".join(f"{KINDS[s.kind]}:{s.start}:{s.stop}" for s in own if s.base)
            digests.append(hashlib.sha256(said.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(found, kind)],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "found"])


def candidates(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, counts and digest of base spans, and `found`, all spans with their vote pattern."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _extract, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, {_FOUND}")


def _unpack(pattern: int) -> tuple[int, list[int]]:
    code, kind = divmod(pattern, len(KINDS))
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v)
    return kind, votes[::-1]


def estimate(counts: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of each vote pattern and each labeler's reliability, by expectation-maximisation.

    Per kind a candidate is personal data or not; a labeler votes right with an
    unknown reliability of its own and may abstain. `counts` has at most
    kinds * 3 ** labelers entries.
    """
    patterns = sorted(counts)
    kinds = np.array([_unpack(p)[0] for p in patterns])
    votes = np.array([_unpack(p)[1] for p in patterns]).reshape(len(patterns), len(LABELERS))
    weight = np.array([counts[p] for p in patterns], float)
    right = np.full((2, len(LABELERS)), 0.8)  # of votes on true and on false candidates
    prior = np.full(len(KINDS), 0.5)
    truth = np.zeros(len(patterns))
    for _ in range(rounds):
        yes, no = np.log(prior[kinds]), np.log1p(-prior[kinds])
        for j in range(len(LABELERS)):
            yes += np.where(votes[:, j] == _YES, np.log(right[1, j]), np.where(votes[:, j] == _NO, np.log1p(-right[1, j]), 0))
            no += np.where(votes[:, j] == _NO, np.log(right[0, j]), np.where(votes[:, j] == _YES, np.log1p(-right[0, j]), 0))
        before, truth = truth, 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        for j in range(len(LABELERS)):
            for t, share in ((1, truth), (0, 1 - truth)):
                said = weight * share * (votes[:, j] != _NONE)
                agree = (said * (votes[:, j] == (_YES if t else _NO))).sum()
                right[t, j] = np.clip((agree + 4) / (said.sum() + 5), 0.55, 0.995)  # better than chance by assumption
        for k in range(len(KINDS)):
            own = kinds == k
            prior[k] = np.clip(((weight * truth)[own].sum() + 1) / (weight[own].sum() + 2), 0.01, 0.99)
        if np.abs(truth - before).max(initial=0) < 1e-9:
            break
    return dict(zip(patterns, truth.tolist())), right


def classifier(counts: dict[int, int], posterior: dict[int, float], rounds: int = 50) -> dict[int, float]:
    """Probability of each vote pattern from a logistic model trained on the posteriors.

    The features are the kind and each labeler's vote, so the model shares
    strength between kinds that are seen seldom.
    """
    patterns = sorted(counts)
    rows = []
    for p in patterns:
        kind, votes = _unpack(p)
        rows.append([float(kind == k) for k in range(len(KINDS))] + [float(v == w) for v in votes for w in (_YES, _NO)])
    x = np.array(rows).reshape(len(patterns), len(KINDS) + 2 * len(LABELERS))
    y = np.array([posterior[p] for p in patterns])
    # every pattern speaks by the logarithm of its count, so that a frequent one does not drown the rest
    weight = np.log1p(np.array([counts[p] for p in patterns], float))
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton steps on the ridge-regularised likelihood
        mean = 1 / (1 + np.exp(-x @ beta))
        slope = x.T @ (weight * (y - mean)) - 0.1 * beta
        curve = (x * (weight * mean * (1 - mean))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(patterns, (1 / (1 + np.exp(-x @ beta))).tolist()))


def accepted_patterns(found: DataFrame, least: float = 0.5) -> list[int]:
    """Vote patterns that the trained classifier takes for personal data; counts are over all documents."""
    rows = found.select(F.explode("found").alias("s")).groupBy("s.pattern").count().collect()  # bounded by the votes
    counts = {r["pattern"]: r["count"] for r in rows}
    if not counts:
        return []
    scores = classifier(counts, estimate(counts)[0])
    return [p for p, score in sorted(scores.items()) if score >= least]


def personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Personal data of every text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Matches of the four base patterns always count. Wider candidates (numbers
    that fail a base rule, national phone numbers, keys) and the base matches
    get votes of a pattern, a gazetteer, a context and a shape labeler;
    reliabilities come from expectation-maximisation over the counts of vote
    patterns, and a logistic model trained on the posteriors decides on the
    candidates. `spans` lists kind:start:end by kind, then start, in code points.

    A NULL or empty text has no spans. Rows keep their doc_id, repeated or NULL,
    and are neither joined nor shuffled. Other columns are ignored.
    """
    found = store(candidates(docs))
    keep = accepted_patterns(found, least)
    names = F.array(*[F.lit(k) for k in KINDS])
    taken = F.filter("found", lambda s: s["base"] | s["pattern"].isin(keep)) if keep else F.filter("found", lambda s: s["base"])
    said: Column = F.transform(
        F.array_sort(F.transform(taken, lambda s: F.struct(s["kind"], s["start"], s["stop"]))),
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(said, ",").alias("spans"))


def redacted(text: str, keep: frozenset) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the first, then the longest."""
    out, at = [], 0
    for s in sorted((s for s in spans_of(text) if s.base or s.pattern in keep), key=lambda s: (s.start, -s.stop)):
        if s.start >= at:
            out += [text[at:s.start], f"<{KINDS[s.kind].upper()}>"]
        elif s.stop > at:
            out.append("")
        at = max(at, s.stop)
    return "".join([*out, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch], keep: frozenset) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.as_py() for t in batch.column("text")]
        clean = pa.array([None if t is None else redacted(t, keep) for t in texts], pa.string())
        cols = {name: clean if name == "text" else batch.column(name) for name in batch.schema.names}
        if "n_chars" in cols:
            was = batch.column("n_chars").to_pylist()
            cols["n_chars"] = pa.array(
                [n if new == old else len(new) for n, old, new in zip(was, texts, clean.to_pylist())], batch.schema.field("n_chars").type)
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """`docs` with personal data in `text` replaced; `n_chars` follows. All rows and columns stay."""
    keep = frozenset(accepted_patterns(candidates(docs), least))
    return docs.mapInArrow(partial(_redact, keep=keep), docs.schema)
