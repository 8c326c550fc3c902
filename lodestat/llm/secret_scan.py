"""Secrets in texts: fixed shapes, and tokens that a battery of tests finds random; SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestat.llm.arrays import scan
from lodestat.llm.quality_rules import bind
from lodestat.llm.tables import store

# Kinds in the order of ties, with their pattern and what a match must have; the last is the method's.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run is taken whole, so none of 24 is left out by taking the pattern's first
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
_VALUE, _ACCESS = 6, 20

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Encodings, the first that fits is taken: characters in order, and the squared distance from uniform
# (k * sum p ** 2 - 1) from which a token counts as text. Words have about k * 0.065 - 1.
ENCODINGS = {
    "hex": (_DIGITS + "abcdef", 0.6),
    "HEX": (_DIGITS + "ABCDEF", 0.6),
    "base32": (_UPPER + "234567", 1.0),
    "lower": (_DIGITS + _LOWER, 1.0),
    "upper": (_DIGITS + _UPPER, 1.0),
    "letters and digits": (_DIGITS + _UPPER + _LOWER, 2.0),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", 2.0),
    "base64 of urls": (_UPPER + _LOWER + _DIGITS + "-_", 2.0),
}
RUNS = 0.5           # share by which a text's number of runs departs from the expected one
CORRELATION = 0.6    # a text's correlation of neighbouring characters
FALSE = 0.05         # share of texts among the tokens taken for random
_BINS = 3_000        # of a hundredth of a decade of p

# Coefficients of the exponent in a rational Chebyshev fit of erfc (relative error 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


_SPANS = "array<struct<start:bigint,stop:bigint,said:string>>"


def located(text: Column, pattern: str) -> Column:
    """All matches, leftmost first: (start, stop, said), in code points."""
    def placed(x: Column) -> Column:
        steps = F.transform(x["said"], lambda m, i: (F.length(F.get(x["between"], i)) + F.length(m)).cast("long"))
        return bind(scan(steps, lambda a, b: a + b), lambda stops: F.transform(x["said"], lambda m, i: F.struct(
            (F.get(stops, i) - F.length(m)).alias("start"), F.get(stops, i).alias("stop"), m.alias("said"))))

    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("said"), F.split(text, pattern, -1).alias("between"))
    return F.when(text.rlike(pattern), bind(found, placed).cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Spans of the fixed shapes, (start, kind, stop), by start, then kind."""
    def of(kind: int, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))

    return F.array_sort(F.concat(
        of(0, F.filter(located(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["said"], ASSIGN, 2)) >= _VALUE)),
        of(1, F.filter(located(text, ACCESS), lambda s: F.length(s["said"]) >= _ACCESS)),
        of(2, located(text, HEX))))


def _apart(tokens: Column, base: Column) -> Column:
    """Tokens that no base span touches.

    Both in one order: a token is apart when no span before it reaches past its
    start and the next one, if it is a base span, begins at its stop or later.
    """
    none = F.lit(None).cast("string")
    both = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["stop"].alias("stop"), none.alias("said"))),
        F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["stop"].alias("stop"), s["said"].alias("said")))))

    def chosen(x: Column) -> Column:
        all_, reach = x["all"], x["reach"]
        free = lambda s, i: (s["own"] == 1) & (F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long")) <= s["start"]) & (
            (F.coalesce(F.get(all_, i + 1)["own"], F.lit(1)) == 1) | (F.get(all_, i + 1)["start"] >= s["stop"]))
        return F.transform(F.filter(all_, free), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["said"].alias("said")))

    def reached(all_: Column) -> Column:
        stops = F.transform(all_, lambda s: F.when(s["own"] == 0, s["stop"]).otherwise(F.lit(0).cast("long")))
        return bind(F.struct(all_.alias("all"), scan(stops, F.greatest).alias("reach")), chosen)

    return F.when(F.size(base) == 0, tokens).otherwise(bind(both, reached))


def _normal_log10(z: Column) -> Column:
    """log10 of the lower normal tail at z < 0."""
    x = -z / F.lit(2 ** 0.5)
    t = 1 / (1 + x / 2)
    poly = F.lit(_ERFC[-1])
    for c in _ERFC[-2::-1]:
        poly = F.lit(c) + t * poly
    return (F.log(t / 2) - x * x + poly) / F.log(F.lit(10.0))


def _uniformity(n: Column, k: Column, far: Column, squares: Column) -> Column:
    """Normal score of Pearson's statistic among texts, whose statistic is noncentral with n * far (Sankaran's approximation)."""
    x, dof, lam = k / n * squares - n, k - 1, n * far
    h = 1 - 2 * (dof + lam) * (dof + 3 * lam) / (3 * (dof + 2 * lam) * (dof + 2 * lam))
    p = (dof + 2 * lam) / ((dof + lam) * (dof + lam))
    m = (h - 1) * (1 - 3 * h)
    centre = 1 + h * p * (h - 1 - (2 - h) * m * p / 2)
    return (F.pow(F.greatest(x, F.lit(0.0)) / (dof + lam), h) - centre) / (h * F.sqrt(2 * p) * (1 + m * p / 2))


def _runs(n: Column, bits: Column) -> Column:
    """Normal score of how near the number of runs of low and high characters is to the expected one."""
    ones = F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
    turns = (2 * n - F.length(F.replace(bits, F.lit("01"), F.lit(""))) - F.length(F.replace(bits, F.lit("10"), F.lit("")))) / 2
    mean = 2 * ones * (n - ones) / n + 1
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.0)))
    return F.when(spread > 0, (F.abs(turns + 1 - mean) - RUNS * mean) / spread).otherwise(F.lit(0.0))


def _correlation(n: Column, places: Column) -> Column:
    """Normal score of how small the correlation of neighbouring characters is, by Fisher's transformation."""
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    x = F.transform(places, lambda v: v.cast("double"))

    def of(s: Column) -> Column:
        mean = s["sum"] / n
        inside = s["product"] - mean * (2 * s["sum"] - s["first"] - s["last"]) + (n - 1) * mean * mean
        around = s["square"] - n * mean * mean
        r = F.least(F.abs(inside / around), F.lit(0.999999))
        return F.when(around > 0, (F.atanh(r) - F.atanh(F.lit(CORRELATION))) * F.sqrt(n - 3)).otherwise(F.lit(0.0))

    return bind(bind(x, lambda v: F.struct(
        total(v).alias("sum"), total(F.transform(v, lambda a: a * a)).alias("square"),
        total(F.transform(v, lambda a, i: a * F.coalesce(F.get(v, i + 1), F.lit(0.0)))).alias("product"),
        F.get(v, F.lit(0)).alias("first"), F.get(v, F.size(v) - 1).alias("last"))), of)


def _battery(body: Column) -> Column:
    """(band, bin) of a token, or NULL where no encoding fits.

    Each test asks whether the token departs from random as text does, so the
    largest p of the three is that of their union; `bin` is its logarithm in
    hundredths of a decade, rounded towards 1, `band` the length in half octaves.
    """
    def tested(token: Column, alphabet: str, far: float) -> Column:
        k = len(alphabet)

        def scored(x: Column) -> Column:
            n = F.length(x["t"]).cast("double")
            squares = F.aggregate(x["own"], F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(x["t"], c, F.lit(""))), F.lit(2.0)))
            bits = F.translate(x["t"], alphabet, "0" * (k // 2) + "1" * (k - k // 2))
            places = F.transform(x["chars"], lambda c: F.instr(F.lit(alphabet), c))
            z = F.greatest(_uniformity(n, F.lit(float(k)), F.lit(far), squares), _runs(n, bits), _correlation(n, places))
            bin_ = bind(z, lambda v: F.when(v < 0, F.least(F.floor(_normal_log10(v) * -100), F.lit(_BINS))).otherwise(F.lit(0)))
            return F.struct(F.floor(F.log2(n) * 2).cast("int").alias("band"), bin_.cast("int").alias("bin"))

        chars = F.filter(F.split(token, ""), lambda c: c != "")
        return bind(bind(chars, lambda c: F.struct(token.alias("t"), c.alias("chars"), F.array_distinct(c).alias("own"))), scored)

    found = F.when(body.rlike("^[0-9]+$"), F.lit(None))  # a number is random without being secret
    for alphabet, far in ENCODINGS.values():
        found = found.when(body.rlike(f"^[{alphabet.replace('-', '')}{'-' * ('-' in alphabet)}]+$"), tested(body, alphabet, far))
    return found


def candidates(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, `base` spans, and `tokens` (start, stop, band, bin) apart from them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    tokens = _apart(located(F.col("text"), TOKEN), F.col("base"))
    scored = F.filter(
        F.transform(tokens, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), _battery(F.regexp_replace(s["said"], "=+$", "")).alias("t"))),
        lambda s: s["t"].isNotNull())
    return rows.select("doc_id", "base", F.transform(scored, lambda s: F.struct(
        s["start"].alias("start"), s["stop"].alias("stop"), s["t"]["band"].alias("band"), s["t"]["bin"].alias("bin"))).alias("tokens"))


def least_bins(found: DataFrame, false: float = FALSE) -> dict[int, int]:
    """Per band of length the least bin taken: Benjamini and Hochberg's rule among the tokens of the band.

    Short tokens cannot reach a small p and long ones are few, so each band is
    judged by its own. Counts are over all documents; at most some 60 bands of
    3,001 bins are left to look at, in windows, and one row per band is collected.
    """
    counts = found.select(F.explode("tokens").alias("t")).groupBy("t.band", "t.bin").count()
    band = Window.partitionBy("band")
    above = F.sum("count").over(band.orderBy(F.col("bin").desc()))
    allowed = F.pow(F.lit(10.0), F.col("bin") / -100) * F.col("all") <= false * F.col("above")
    rows = counts.withColumns({"above": above, "all": F.sum("count").over(band)}).where(allowed).groupBy("band").agg(F.min("bin").alias("least"))
    return {r["band"]: r["least"] for r in rows.collect()}


def secrets(docs: DataFrame, false: float = FALSE) -> DataFrame:
    """Secrets of every text: doc_id, n_assign, n_access, n_hex, base (start, kind, stop), found (start, kind, stop).

    Matches of the three fixed shapes always count. Other tokens of 16 or more
    characters that touch none of them are read in the narrowest encoding that
    holds them and take three tests of randomness over its alphabet: Pearson's
    chi-squared statistic, runs of low and high characters, and the correlation
    of neighbours. Each is turned into the p of text, that is of a departure at
    least as large as `ENCODINGS`, `RUNS` or `CORRELATION` say, and the largest
    of the three counts, so that a token must look random to all. Per band of
    length the tokens found random hold about `false` of texts at most. `kind` is a
    place in `KINDS`; places are in code points, `stop` exclusive.

    A NULL or empty text has no spans. Rows keep their doc_id, repeated or NULL,
    and are neither joined nor shuffled. Other columns are ignored.
    """
    found = store(candidates(docs))
    least = least_bins(found, false)
    random = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    if least:
        reached = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
        random = F.transform(
            F.filter("tokens", lambda t: t["bin"] >= F.coalesce(F.get(F.array(reached[t["band"]]), F.lit(0)), F.lit(_BINS + 1))),
            lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["stop"].alias("stop")))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, "base", F.array_sort(F.concat("base", random)).alias("found"))


def said(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
