"""Quality rules kept as a bitmask ledger, built of SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
_WINDOW = 5

# name: condition over the measurements that fails; a rule's bit is its place in this table
RULES = {
    "few_words": lambda m: m["n_words"] < 10,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "symbols": lambda m: m["n_symbols"] > m["n_words"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 40 * m["n_words"],
    "duplicate_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Policy:
    """A version of what rejects a document: any of `rules` failing."""

    version: str
    rules: Sequence[str]

    @property
    def mask(self) -> int:
        unknown = set(self.rules) - set(RULES)
        if unknown:
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        return sum(1 << i for i, name in enumerate(RULES) if name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
CURRENT = Policy("current", tuple(RULES))


def bind(value: Column, use) -> Column:
    """`use(x)` with `value` computed once, inside a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spaced_words(text: Column) -> Column:
    """The runs of other than ASCII white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _covered(windows: Column) -> Column:
    """Words inside a window that is found twice or more, by sorting windows with their places."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(sorted_: Column) -> Column:
        twice = F.filter(sorted_, lambda x, j: (x["h"] == F.get(sorted_, j - 1)["h"]) | (x["h"] == F.get(sorted_, j + 1)["h"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda x, j: F.least(F.lit(_WINDOW), F.coalesce(F.get(at, j + 1) - x, F.lit(_WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return bind(bind(placed, places), total)


def _repeat_words(words: Column) -> Column:
    def of(hashes: Column) -> Column:
        windows = F.transform(
            F.slice(hashes, 1, F.greatest(F.size(hashes) - (_WINDOW - 1), F.lit(0))),
            lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, _WINDOW)]))
        return bind(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _covered(w)).otherwise(F.lit(0).cast("long")))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), of)


def measurements(text: Column) -> Column:
    """What the rules need to know of a text, as a struct; a NULL text has no words."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = bind(lines, lambda all_: F.struct(F.size(all_).alias("n"), F.size(F.array_distinct(all_)).alias("own")))
    words = bind(spaced_words(text), lambda w: F.struct(
        F.size(w).alias("n"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"),
        _repeat_words(w).alias("repeat")))

    def measured(found: Column) -> Column:
        w, line = found["w"], found["l"]
        values = (w["n"], w["chars"], found["s"], line["n"], line["n"] - line["own"], w["repeat"])
        return F.struct(*[v.cast("long").alias(name) for name, v in zip(MEASURES, values)])

    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return bind(F.struct(words.alias("w"), counts.alias("l"), symbols.alias("s")), measured)


def failures(measured: Column) -> Column:
    """The failure bits: each rule evaluated once."""
    bits = [F.when(rule(measured), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failure bits of every document: doc_id, the measures, failed.

    Bit i of `failed` is set when the i-th rule of `RULES` fails. A NULL or empty
    text has no words. Rows are neither joined nor shuffled, so repeated rows and
    rows without doc_id each get their own; other columns are ignored.
    """
    return docs.select("doc_id", measurements(F.col("text")).alias("m")).select("doc_id", "m.*", failures(F.col("m")).alias("failed"))


def passing(docs: DataFrame, policy: Policy) -> DataFrame:
    """The rows, all columns kept, whose text passes a policy."""
    failed = bind(measurements(F.col("text")), failures)
    return docs.where(failed.bitwiseAND(F.lit(policy.mask)) == 0)


def verdict(policy: Policy) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policies(ledger_: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """The ledger with one boolean column `kept_<version>` per policy."""
    return ledger_.withColumns({f"kept_{p.version}": verdict(p) for p in policies})


def ablations(ledger_: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """What each rule does: documents failing it, rejected by it alone, and rejected without it.

    The ledger is first counted by its bits, at most 2 ** rules rows whatever the
    corpus, and every figure comes from bitwise tests of those.
    """
    counts = ledger_.groupBy("failed").count()
    own = F.col("failed").bitwiseAND(F.lit(policy.mask))
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(1 << i).alias("bit")) for i, name in enumerate(RULES) if name in policy.rules]))
    per = counts.select(own.alias("own"), "count", rows.alias("r")).select("own", "count", "r.rule", "r.bit")
    hit = F.col("own").bitwiseAND(F.col("bit")) != 0
    return per.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("count")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("own") == F.col("bit"), F.col("count")).otherwise(0)).alias("by_it_alone"),
        F.sum(F.when(F.col("own").bitwiseAND(F.bitwise_not("bit")) != 0, F.col("count")).otherwise(0)).alias("rejected_without_it"))
