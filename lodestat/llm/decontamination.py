"""Benchmark passages found in training text, built of SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestat.llm.arrays import scan
from lodestat.llm.quality_rules import bind

WINDOW = 10          # words in a window of an item
DROP_SHARE = 0.5     # a document with this share of its words hit is dropped
# The windows' hashes are broadcast up to this many (16 bytes each); beyond, the join shuffles.
BROADCAST_WINDOWS = 2_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; `lower` does it where there is nothing else."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def plain_words(text: Column) -> Column:
    """Runs of digits, letters and all beyond ASCII, A-Z lower-cased."""
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), _BREAK), lambda w: w != "")


def _windows(hashes: Column, width: int) -> Column:
    """A hash of each `width` consecutive words."""
    return F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - (width - 1), F.lit(0))),
        lambda h, i: F.xxhash64(F.lit(width), h, *[F.get(hashes, i + k) for k in range(1, width)]))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, width, hash, words): an item's windows; a short item is one window."""
    items = benchmark.where("item_id is not null").select("item_id", plain_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(window))
    made = F.transform(F.sequence(F.lit(1), F.size("words") - width + 1), lambda i: F.slice("words", i, width))
    rows = items.select("item_id", width.alias("width"), F.explode(made).alias("words"))
    key = F.lit(None).cast("long")
    for size in range(1, window + 1):
        hashes = F.transform("words", lambda w: F.xxhash64(w))
        key = F.when(F.col("width") == size, F.get(_windows(hashes, size), F.lit(0))).otherwise(key)
    return rows.select("item_id", "width", key.alias("hash"), F.array_join("words", " ").alias("words")).distinct()


def _covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted."""
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("stop"))
    step = lambda a, s: F.struct(
        (a["words"] + F.greatest(s["stop"] - F.greatest(s["start"], a["stop"]), F.lit(0))).alias("words"),
        F.greatest(a["stop"], s["stop"]).alias("stop"))
    return F.aggregate(spans, start, step, lambda a: a["words"])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """What of which text is found: doc_id, text_hash, spans (start, stop in words), items.

    A row for each document with a hit. Every window of every text is looked up
    in a hash set of the items' windows and a match is verified word by word.
    Where the set is too large to broadcast, windows are shuffled as hashes with
    their places, and those found meet the words of their document again.
    """
    known = item_windows(benchmark, window)
    widths = sorted(r[0] for r in known.select("width").distinct().collect())  # at most `window` values
    keys = known.select("hash").distinct()
    few = keys.count() <= BROADCAST_WINDOWS
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id"), F.xxhash64(text).alias("text_hash"), plain_words(text).alias("words"))
    by_width = lambda hashes: F.array(*[F.struct(F.lit(w).alias("width"), _windows(hashes, w).alias("hashes")) for w in widths])
    made = bind(F.transform("words", lambda w: F.xxhash64(w)), by_width) if widths else F.expr("cast(array() as array<struct<width:int,hashes:array<bigint>>>)")
    own = ["doc_id", "text_hash", "words"] if few else ["doc_id", "text_hash"]
    each = rows.select(*own, F.inline(made)).select(*own, "width", F.posexplode("hashes").alias("start", "hash"))
    if few:
        each = each.join(F.broadcast(keys), "hash")
    else:
        places = each.join(keys, "hash").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("hash", "width", "start")).alias("places"))
        places = places.withColumnsRenamed({"doc_id": "found_doc", "text_hash": "found_text"})
        same = F.col("doc_id").eqNullSafe(F.col("found_doc")) & F.col("text_hash").eqNullSafe(F.col("found_text"))
        each = rows.join(places, same).select("doc_id", "text_hash", "words", F.inline("places"))
    found = each.select(
        "doc_id", "text_hash", "hash", "width", "start", F.array_join(F.slice("words", F.col("start") + 1, F.col("width")), " ").alias("words"))
    phrases = known.select("hash", "width", "words").distinct()
    verified = found.join(phrases, ["hash", "width", "words"]).select("doc_id", "text_hash", "hash", "start", (F.col("start") + F.col("width")).alias("stop"))
    per_doc = verified.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.collect_set("hash").alias("hashes"))
    items = per_doc.select("doc_id", "text_hash", "spans", F.explode("hashes").alias("hash")).join(known.select("hash", "item_id").distinct(), "hash")
    return items.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"), F.collect_set("item_id").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    A document word inside any occurrence of an item's window is hit. A NULL or
    empty text has no words, and so has no hits; an item without words has no
    window, an item without id is left out, repeated rows of either table each
    count like one. Other columns are ignored.
    """
    found = hits(docs, benchmark, window).withColumnsRenamed({"doc_id": "hit_doc", "text_hash": "hit_text"})
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.size(plain_words(text)).cast("long").alias("n_words"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_hash") == F.col("hit_text")), "left")
    names = F.array_sort(F.transform(F.coalesce("items", F.array()), lambda i: i.cast("string")))
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", "items")


def _disjoint(spans: Column) -> Column:
    """The sorted spans as ranges that neither meet nor overlap."""
    def ranges(x: Column) -> Column:
        own, reach, first = x["own"], x["reach"], x["first"]
        last = lambda t: F.coalesce(F.get(reach, F.get(first, t + 1) - 1), F.get(reach, F.size(own) - 1))
        return F.transform(first, lambda i, t: F.struct(F.get(own, i)["start"].alias("start"), last(t).alias("stop")))

    def opened(x: Column) -> Column:
        places = F.filter(F.transform(x["own"], lambda s, i: F.when((i == 0) | (s["start"] > F.get(x["reach"], i - 1)), i)), lambda i: i.isNotNull())
        return bind(F.struct(x["own"].alias("own"), x["reach"].alias("reach"), places.alias("first")), ranges)

    reach = scan(F.transform(spans, lambda s: s["stop"].cast("long")), F.greatest)
    return bind(F.struct(spans.alias("own"), reach.alias("reach")), opened)


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of `spans` and what follows each of them up to the next word.

    Overlapping spans are made one first and the text between is taken as
    slices, so the work grows with the text and not with its spans.
    """
    def rebuilt(parts: Column) -> Column:
        words, ranges = parts["words"], parts["ranges"]
        piece = lambda start, stop: F.array_join(F.slice(words, start + 1, F.greatest(stop - start, F.lit(0))), "")
        before = F.transform(ranges, lambda r, i: piece(F.coalesce(F.get(ranges, i - 1)["stop"], F.lit(0).cast("long")).cast("int"), r["start"].cast("int")))
        rest = piece(F.coalesce(F.get(ranges, F.size(ranges) - 1)["stop"], F.lit(0).cast("long")).cast("int"), F.size(words))
        return F.concat(F.get(parts["breaks"], F.lit(0)), F.array_join(before, ""), rest)

    def followed(x: Column) -> Column:
        words = F.transform(x["words"], lambda w, i: F.concat(w, F.get(x["breaks"], i + 1)))
        return bind(F.struct(words.alias("words"), x["breaks"].alias("breaks"), _disjoint(spans).alias("ranges")), rebuilt)

    words = F.filter(F.split(text, _BREAK), lambda w: w != "")
    return bind(F.struct(words.alias("words"), F.split(text, _WORD).alias("breaks")), followed)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, drop_share: float = DROP_SHARE) -> DataFrame:
    """Documents without benchmark passages, with the columns of `docs`.

    A document with at least `drop_share` of its words hit is dropped, another
    loses the hit words; `n_chars`, where there is such a column, follows. All
    other rows stay as they are.
    """
    found = hits(docs, benchmark, window).select(
        F.col("doc_id").alias("_hit_doc"), F.col("text_hash").alias("_hit_text"), F.col("spans").alias("_spans"))
    text = F.col("text").cast("string")
    rows = docs.join(
        found, docs["doc_id"].eqNullSafe(F.col("_hit_doc")) & (F.xxhash64(text) == F.col("_hit_text")), "left")
    share = _covered(F.col("_spans")) / F.size(plain_words(text))
    clean = rows.where(F.col("_spans").isNull() | (share < drop_share)).withColumn(
        "text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(without_spans(text, F.col("_spans"))))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return clean.select(docs.columns)
