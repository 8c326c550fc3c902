"""Merkle manifest of a dataset: a tree of SHA-256 states per language, one root, a proof per row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestat.llm.decontamination import lower_ascii
from lodestat.llm.tables import store

FAN = 8                 # children of a node
_LEVELS = 3             # levels that one task folds
_SPAN = FAN ** _LEVELS  # and so the nodes of a group at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before:string,after:string>>"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(**other: Column) -> Column:
    """The digest of a row: every field by its length and value; `other` replaces columns."""
    return F.sha2(F.concat(*[_field(other.get(name, F.col(name))) for name in FIELDS]), 256)


def folded(digest: Column, siblings: Column) -> Column:
    """The root that a digest and its siblings, level by level, lead to."""
    return F.aggregate(siblings, digest, lambda at, s: F.sha2(F.concat(s["before"], at, s["after"]), 256))


class _Parent:
    """A node with the hash state before each of its child slots."""

    def __init__(self, children: list[bytes]):
        self.children, self.states = children, []
        state = sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def resumed(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in a slot: from the state before it on."""
        state = self.states[slot].copy()
        state.update(b"".join((child, *self.children[slot + 1:])))
        return state.hexdigest().encode()

    def sides(self, slot: int) -> tuple[bytes, bytes]:
        return b"".join(self.children[:slot]), b"".join(self.children[slot + 1:])


class _Step:
    """A level above a group: the state after the left siblings, and the right ones."""

    def __init__(self, before: bytes, after: bytes):
        self.state, self.after = sha256(before), after

    def resumed(self, child: bytes) -> bytes:
        state = self.state.copy()
        state.update(child + self.after)
        return state.hexdigest().encode()


def _parents(nodes: list[bytes], total: int) -> list[list[_Parent]]:
    """Up to three levels of parents over the nodes of a group, of a level of `total` nodes."""
    levels = []
    while total > 1 and len(levels) < _LEVELS:
        levels.append([_Parent(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes, total = [p.digest for p in levels[-1]], -(-total // FAN)
    return levels


def _sorted(rows: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    rows = rows.sort_by("at")
    return rows, [d.encode() for d in rows.column("digest").to_pylist()], rows.column("n")[0].as_py()


def _top(rows: pa.Table) -> pa.Table:
    """The node that stands for a group on the next round."""
    rows, nodes, total = _sorted(rows)
    levels = _parents(nodes, total)
    digest = levels[-1][0].digest if levels else nodes[0]
    return pa.table({
        "tree": rows.column("tree")[:1], "at": pa.array([rows.column("at")[0].as_py() // _SPAN], pa.int64()),
        "n": pa.array([-(-total // _SPAN)], pa.int64()), "digest": pa.array([digest.decode()], pa.string())})


def _local(levels: list[list[_Parent]], place: int) -> Iterator[tuple[_Parent, int]]:
    for parents in levels:
        place, slot = divmod(place, FAN)
        yield parents[place], slot


def _paths(rows: pa.Table, above: pa.Table) -> pa.Table:
    """Of each node its siblings up to the root."""
    rows, nodes, total = _sorted(rows)
    levels, upper = _parents(nodes, total), above.column("siblings")[0].as_py()
    out = []
    for place in range(len(nodes)):
        own = [parent.sides(slot) for parent, slot in _local(levels, place)]
        out.append([{"before": a.decode(), "after": b.decode()} for a, b in own] + upper)
    kind = above.schema.field("siblings").type
    return pa.table({"tree": rows.column("tree"), "at": rows.column("at"), "siblings": pa.array(out, kind)})


def _proofs(rows: pa.Table, above: pa.Table, listed: bool) -> pa.Table:
    """Per leaf the digest of its proof and the root that the leaf as found folds to."""
    rows, nodes, total = _sorted(rows)
    levels, upper = _parents(nodes, total), above.column("siblings")[0].as_py()
    steps = [_Step(s["before"].encode(), s["after"].encode()) for s in upper]
    tail = "".join(s["before"] + s["after"] for s in upper).encode()
    digests, roots, lists = [], [], []
    for place, (node, found) in enumerate(zip(nodes, rows.column("found").to_pylist())):
        proof, own = sha256(), []
        at = node if found is None else found.encode()
        for parent, slot in _local(levels, place):
            before, after = parent.sides(slot)
            proof.update(before + after)
            at = parent.resumed(slot, at)
            if listed:
                own.append({"before": before.decode(), "after": after.decode()})
        for step in steps:
            at = step.resumed(at)
        proof.update(tail)
        digests.append(proof.hexdigest())
        roots.append(at.decode())
        lists.append(own + upper)
    out = {
        "doc_id": rows.column("doc_id"), "leaf": rows.column("digest"), "subroot": pa.array([above.column("subroot")[0].as_py()] * len(nodes), pa.string()),
        "proof_sha256": pa.array(digests, pa.string()), "folded_root": pa.array(roots, pa.string())}
    if listed:
        out["siblings"] = pa.array(lists, above.schema.field("siblings").type)
    return pa.table(out)


def _placed(nodes: DataFrame, *order: str) -> DataFrame:
    """`nodes` (tree, ...) with `at`, the place in its tree, and `n`, the tree's size.

    The table is sorted in ranges and written once; the sizes of the ranges give
    the places. Ties are cut apart by their place in the input, so equal rows
    crowd no range.
    """
    keys = ["tree", *order, "_tie"]
    tied = nodes.withColumn("_tie", F.monotonically_increasing_id())
    rows = store(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftrightunsigned("_row", 33))
    held = rows.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_held"), F.min("_row").alias("_first"))
    tree = Window.partitionBy("tree")  # a row per range
    before = F.coalesce(F.sum("_held").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = store(held.select("tree", "_range", (F.col("_first") - before).alias("_shift"), F.sum("_held").over(tree).alias("n")))
    return rows.join(shifts, ["tree", "_range"]).withColumn("at", F.col("_row") - F.col("_shift")).drop("_row", "_range", "_shift")


def _group(rows: DataFrame) -> DataFrame:
    return rows.withColumn("span", F.floor(F.col("at") / _SPAN))


def _rounds(rows: DataFrame) -> list[DataFrame]:
    """The nodes of every third level, leaves first, down to one per tree."""
    rounds, most = [rows], rows.agg(F.max("n")).first()[0] or 1
    while most > 1:
        own = _group(rounds[-1].select("tree", "at", "n", "digest"))
        rounds.append(store(own.groupBy("tree", "span").applyInArrow(_top, "tree string, at long, n long, digest string")))
        most = -(-most // _SPAN)
    return rounds


def _below(rows: DataFrame, above: DataFrame, work, schema: str) -> DataFrame:
    """`work` on each group of nodes with the siblings of the node that stands for it."""
    return _group(rows).groupBy("tree", "span").cogroup(
        above.withColumnRenamed("at", "span").groupBy("tree", "span")).applyInArrow(work, schema)


def manifest(docs: DataFrame, changed: Column | None = None, proofs: bool = False) -> DataFrame:
    """Per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A row's leaf is the SHA-256 of its fields, each by length and value. The
    leaves of a language ascend by doc_id (NULL first, ties by leaf); every eight
    nodes in a row become the digest of their hex texts until one, the subroot,
    is left, and the subroots in order of language become the root in the same
    way. A parent keeps a copied hash state before each child slot: folding
    another leaf in resumes that state with the new digest and the siblings to
    the right. `changed` is the text as found later, the text itself by default;
    `folded_root` is the root with the row's leaf replaced by that of its text as
    found, and `verified` says that it is the root. `proof_sha256` is the digest
    of the row's siblings in order; with `proofs` they are returned as `siblings`.

    A task folds three levels of at most 512 nodes of one language, so a language
    may hold any share of the rows and no tree is held as a whole. Every column
    may be NULL, in a language of its own for `lang`; repeated rows are leaves of
    their own; an empty table has no rows. Other columns are ignored.
    """
    found = F.lit(None).cast("string")
    if changed is not None:
        found = F.when(~changed.eqNullSafe(F.col("text")), leaf(text=changed))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = _placed(store(docs.select("doc_id", tree.alias("tree"), leaf().alias("digest"), found.alias("found"))), "doc_id", "digest")
    rounds = _rounds(rows)
    tops = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest")
    subroots = store(_placed(store(tops), "own"))
    upper = _rounds(subroots)
    top = upper[-1].select("digest").first()
    root = F.lit(top["digest"] if top else None).cast("string")
    above = upper[-1].select("tree", "at", F.expr(f"cast(array() as {_STEPS})").alias("siblings"))
    for level in reversed(upper[:-1] or upper):
        above = store(_below(level.select("tree", "at", "n", "digest"), above, _paths, f"tree string, at long, siblings {_STEPS}"))
    above = subroots.select("at", F.col("own").alias("tree"), F.col("digest").alias("subroot")).join(above.drop("tree"), "at").select(
        "tree", F.lit(0).cast("long").alias("at"), "siblings", "subroot")
    own = store(above)
    for level in reversed(rounds[1:-1]):
        path = store(_below(level, above, _paths, f"tree string, at long, siblings {_STEPS}"))
        above = path.join(own.select("tree", "subroot"), "tree")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string" + f", siblings {_STEPS}" * proofs
    done = _below(rows, above, partial(_proofs, listed=proofs), schema)
    return done.withColumns({"root": root, "verified": F.col("folded_root") == root}).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *["siblings"] * proofs)


def lower_cased(every: int = 3) -> Column:
    """A change to find: where `every` divides the crc32 of the doc_id as text, A-Z is lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    return F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))
