"""Near-duplicate documents by a chosen-path set similarity join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lodestat.llm.components import connected
from lodestat.llm.tables import bins, store
from lodestat.llm.words import distinct_sets, hash_words, mix, shingles, slices, split_words

WIDTH = 5            # words in a shingle
PERCENT = 85         # 100 * intersection >= PERCENT * union links two documents
TREES = 10           # independent trees
TOKENS = 96          # minwise tokens of a document
BRANCHES = 2         # tokens each node below a root selects
LEAF_DOCS = 2_000    # a node of at most so many documents
LEAF_SHINGLES = 1_000_000  # and shingles is compared exhaustively
DEPTH = 6            # levels before a crowd that does not split is joined by the shingles few of it hold
_BIN_ROWS = 1_000
_U = np.uint64
_LINK = "a long, b long"


def _parameters(tokens: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_001)
    draw = partial(rng.integers, 0, 1 << 63, tokens, dtype=np.uint64)
    return draw() * _U(2) + _U(1), draw() * _U(2)


def _sets(texts: pa.Array, width: int):
    words, starts = split_words(texts, lower=True)
    return distinct_sets(*shingles(hash_words(words), starts, width))


def _keys(values: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """128 bits that stand for a whole set."""
    import xxhash

    return [xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None for a, b in zip(starts[:-1], starts[1:])]


def _sketch(batches: Iterator[pa.RecordBatch], width: int, tokens: int) -> Iterator[pa.RecordBatch]:
    """doc_id, set size, set key and the minwise tokens, 32 bits each."""
    factors, terms = _parameters(tokens)
    for batch in batches:
        for part in slices(batch):
            values, starts = _sets(part.column("text"), width)
            sizes = np.diff(starts)
            full = sizes > 0
            drawn = np.zeros((len(sizes), tokens), dtype=np.uint32)
            if len(values):
                at = starts[:-1][full]
                for k in range(tokens):
                    least = np.minimum.reduceat(values * factors[k] + terms[k], at)
                    drawn[full, k] = (mix(least) >> _U(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(_keys(values, starts), pa.binary()),
                pa.array([row.tobytes() for row in drawn], pa.binary())], ["doc_id", "n", "key", "tokens"])


def _keyed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            keys = [k and k.hex() for k in _keys(*_sets(part.column("text"), width))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(keys, pa.string())], ["doc_id", "text", "set_key"])


def set_keys(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, set_key) of every row, the key that `near_duplicates` gives it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_keyed, width=width), f"doc_id {kind}, text string, set_key string")


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values, starts = _sets(part.column("text"), width)
            own = [values[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(_keys(values, starts), pa.binary()), pa.array(own, pa.binary())], ["id", "key", "members"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for members, id_, n in zip(batch.column("members"), batch.column("id").to_pylist(), batch.column("n").to_pylist()):
            own = np.frombuffer(members.as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(np.full(len(own), id_)), pa.array(np.full(len(own), n))], ["shingle", "id", "n"])


def _matrix(column, tokens: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, tokens)


def _node_rows(nodes: np.ndarray, ids, sizes) -> pa.RecordBatch:
    """One row per document and node; `nodes` has a row per document."""
    many = nodes.shape[1]
    return pa.RecordBatch.from_arrays([
        pa.array(nodes.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(ids), many)), pa.array(np.repeat(np.asarray(sizes), many))],
        ["node", "id", "n"])


def _roots(batches: Iterator[pa.RecordBatch], trees: int, tokens: int) -> Iterator[pa.RecordBatch]:
    """The first node of each tree: the value of the token that its root selects."""
    chosen = np.arange(trees) * tokens // trees
    for batch in batches:
        if batch.num_rows:
            own = _matrix(batch.column("tokens"), tokens)[:, chosen].astype(np.uint64)
            yield _node_rows(mix(own + mix(np.arange(1, trees + 1, dtype=np.uint64))), batch.column("id"), batch.column("n"))


def _children(batches: Iterator[pa.RecordBatch], branches: int, tokens: int) -> Iterator[pa.RecordBatch]:
    """The nodes below a node, by the tokens that a hash of the node selects."""
    for batch in batches:
        if batch.num_rows:
            own = _matrix(batch.column("tokens"), tokens)
            node = np.asarray(batch.column("node")).view(np.uint64)
            made = []
            for j in range(branches):
                pick = mix(node + _U(j + 1))
                value = own[np.arange(len(own)), (pick % _U(tokens)).astype(np.int64)].astype(np.uint64)
                made.append(mix(pick ^ mix(value + _U(1))))
            yield _node_rows(np.stack(made, axis=1), batch.column("id"), batch.column("n"))


class _Forest:
    """Which of a leaf's documents are already joined."""

    def __init__(self, size: int):
        self.top = np.arange(size)

    def join(self, i: int, others) -> None:
        tops = np.unique(np.append(self.top[others], self.top[i]))
        if len(tops) > 1:
            self.top[np.isin(self.top, tops)] = tops[0]


def _likely(own: np.ndarray, sizes: np.ndarray, least: int, percent: int):
    """For each document the later ones whose tokens and sizes allow a link, and the tokens shared."""
    for a in range(0, len(own), 32):
        rows, rest = own[a:a + 32], own[a:]
        same = np.count_nonzero(rows[:, None, :] == rest[None, :, :], axis=2)
        mine, theirs = sizes[a:a + 32, None], sizes[None, a:]
        good = (same >= least) & (100 * np.minimum(mine, theirs) >= percent * np.maximum(mine, theirs))
        for i in range(len(rows)):
            after = np.flatnonzero(good[i, i + 1:]) + i + 1
            if len(after):
                yield a + i, a + after, same[i, after]


def _leaves(table: pa.Table, column: str):
    """Row numbers of each leaf in a group of several."""
    keys = table.column(column).to_numpy()
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return np.split(order, cuts) if len(order) else []


def _estimate(table: pa.Table, tokens: int, least: int, percent: int) -> pa.Table:
    """Compare the documents of each leaf by tokens; those likely linked share a `head`."""
    own, ids, sizes = _matrix(table.column("tokens"), tokens), table.column("id").to_numpy(), table.column("n").to_numpy()
    leaf, out = table.column("leaf").to_numpy(), []
    for rows in _leaves(table, "leaf"):
        rows = rows[np.argsort(ids[rows])]
        forest = _Forest(len(rows))
        for i, others, _ in _likely(own[rows], sizes[rows], least, percent):
            forest.join(i, others)
        tops = forest.top
        many = np.bincount(tops, minlength=len(rows))[tops] > 1
        out.append(np.stack([leaf[rows][many], ids[rows][tops[many]], ids[rows][many], sizes[rows][many]]))
    cols = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["leaf", "head", "id", "n"])


def _common(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, by search or, of very many pairs, by products of incidence matrices."""
    if pairs.shape[1] >= _MANY_PAIRS:
        every = np.concatenate(sets)
        values, counts = np.unique(every, return_counts=True)
        values = values[counts > 1]
        if len(sets) ** 2 * len(values) < 500_000 * pairs.shape[1]:  # a search takes about as long as so many products
            total = np.zeros((len(sets), len(sets)), np.float32)
            for low in range(0, len(values), 512):
                part = values[low:low + 512]
                block = np.zeros((len(sets), len(part)), np.float32)
                for i, own in enumerate(sets):
                    mine = own[slice(*np.searchsorted(own, (part[0], part[-1])) + np.array([0, 1]))]
                    at = np.minimum(np.searchsorted(part, mine), len(part) - 1)
                    block[i, at[part[at] == mine]] = 1
                total += block @ block.T
            return total[pairs[0], pairs[1]].astype(np.int64)
    out = np.zeros(pairs.shape[1], np.int64)
    for k, (i, j) in enumerate(zip(pairs[0].tolist(), pairs[1].tolist())):
        small, big = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
        at = np.searchsorted(big, small)
        out[k] = (big[np.minimum(at, len(big) - 1)] == small).sum()
    return out


_MANY_PAIRS = 20_000
_TRIED = 16  # pairs a document that are checked before it is asked what is joined already


def _confirm(table: pa.Table, tokens: int, least: int, percent: int) -> pa.Table:
    """Links of each group confirmed on full sets, enough of them to join what is linked.

    Likely pairs are tried from the most similar on, many at a time; a pair that
    confirmed links already join is not tried. With a `pivot`, only pairs with it are tried.
    """
    own, ids, sizes = _matrix(table.column("tokens"), tokens), table.column("id").to_numpy(), table.column("n").to_numpy()
    pivots, members = table.column("pivot").to_pylist(), table.column("members")
    found = []
    for rows in _leaves(table, "gid"):
        rows = rows[np.argsort(ids[rows])]
        sets = [np.frombuffer(members[int(r)].as_buffer(), dtype=np.uint64) for r in rows]
        forest = _Forest(len(rows))
        pivot = pivots[int(rows[0])]
        if pivot is None:
            pairs = [np.stack([np.full(len(j), i), j, same]) for i, j, same in _likely(own[rows], sizes[rows], least, percent)]
        else:
            at = int(np.searchsorted(ids[rows], pivot))
            same = np.count_nonzero(own[rows] == own[rows[at]], axis=1)
            mine = sizes[rows[at]]
            good = (same >= least) & (100 * np.minimum(mine, sizes[rows]) >= percent * np.maximum(mine, sizes[rows]))
            good[at] = False
            others = np.flatnonzero(good)
            pairs = [np.stack([np.full(len(others), at), others, same[others]])]
        tried = np.concatenate(pairs, axis=1) if pairs else np.zeros((3, 0), np.int64)
        tried = tried[:, np.argsort(-tried[2], kind="stable")]
        step = _TRIED * len(rows)
        for k in range(0, tried.shape[1], step):
            some = tried[:, k:k + step]
            some = some[:, forest.top[some[0]] != forest.top[some[1]]]
            if not some.shape[1]:
                continue
            common = _common(sets, some)
            n = sizes[rows]
            linked = 100 * common >= percent * (n[some[0]] + n[some[1]] - common)
            for i, j in some[:2, linked].T.tolist():
                if forest.top[i] != forest.top[j]:
                    forest.join(i, [j])
                    found.append((ids[rows[i]], ids[rows[j]]))
    a, b = zip(*found) if found else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class _Join:
    """One run of the join: its tables and limits."""

    def __init__(self, docs, width, percent, trees, tokens, leaf_docs, leaf_shingles, depth):
        self.docs, self.width, self.percent, self.tokens = docs, width, percent, tokens
        self.trees, self.leaf_docs, self.leaf_shingles = trees, leaf_docs, leaf_shingles
        self.depth = depth
        share = percent / 100
        # four standard deviations of the estimate below the threshold
        self.least = int(tokens * share - 4.1 * (tokens * share * (1 - share)) ** 0.5)
        self.sketches = store(docs.mapInArrow(
            partial(_sketch, width=width, tokens=tokens), "doc_id long, n long, key binary, tokens binary"))
        first = self.sketches.where("n > 0 and doc_id is not null").groupBy("key").agg(
            F.min(F.struct("doc_id", "n", "tokens")).alias("first"))
        self.classes = store(first.select(F.col("first.doc_id").alias("id"), "first.n", "first.tokens", "key"))

    def full_sets(self, ids: DataFrame) -> DataFrame:
        """(id, n, tokens, members) of some documents, whose texts are read again; only these are shuffled."""
        needed = ids.select("id").distinct()
        own = self.classes.join(needed, "id", "left_semi")
        texts = self.docs.join(needed.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        sets = texts.mapInArrow(partial(_full_sets, width=self.width), "id long, key binary, members binary").dropDuplicates(["id", "key"])
        return own.join(sets, ["id", "key"]).drop("key")

    def dealt(self, rows: DataFrame, group: str, wide: DataFrame) -> DataFrame:
        """`rows` (group, id, ...) joined with `wide` (id, n, ...) and with a `bin`: a large group alone, small ones together up to the limits."""
        size = rows.join(self.classes.select("id", F.col("n").alias("_n")), "id").groupBy(group).agg(F.count("_n").alias("_docs"), F.sum("_n").alias("_shingles"))
        size = store(size.withColumn("_small", (F.col("_docs") * 4 <= _BIN_ROWS) & (F.col("_shingles") * 4 <= self.leaf_shingles)))
        total = size.where("_small").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("_docs", "_shingles")]).first()
        many = 2 * max(bins(total[0], _BIN_ROWS), bins(total[1], self.leaf_shingles))
        own = F.when(F.col("_small"), F.pmod(F.xxhash64(group), F.lit(many))).otherwise(F.xxhash64(group))
        return rows.join(size.select(group, own.alias("bin")), group).join(wide, "id")

    def confirmed(self, groups: DataFrame) -> DataFrame:
        """Links within `groups` (gid, id, pivot), each group of bounded size."""
        groups = store(groups)
        return store(self.dealt(groups, "gid", self.full_sets(groups)).groupBy("bin").applyInArrow(self._grouped(_confirm), _LINK))

    def _grouped(self, work):
        tokens, least, percent = self.tokens, self.least, self.percent

        def run(table: pa.Table) -> pa.Table:
            return work(table, tokens, least, percent)

        return run

    def nodes(self) -> tuple[DataFrame, list[DataFrame]]:
        """Small nodes of all trees, (leaf, id, n), and the links found on the way down."""
        rows = self.classes.mapInArrow(partial(_roots, trees=self.trees, tokens=self.tokens), "node long, id long, n long")
        leaves, links = [], []
        for level in range(1, self.depth + 1):
            sizes = rows.groupBy("node").agg(
                F.count("id").alias("docs"), F.sum("n").alias("shingles"), F.min("id").alias("pivot")).where("docs > 1")
            live = store(rows.join(sizes, "node"))
            fits = (F.col("docs") <= self.leaf_docs) & (F.col("shingles") <= self.leaf_shingles)
            leaves.append(live.where(fits).select(F.col("node").alias("leaf"), "id", "n"))
            large = live.where(~fits)
            if large.isEmpty():
                break
            links.append(self.confirmed(self._stars(large)))
            large = store(self._undecided(large, links))
            if level == self.depth:
                leaves += self._crowds(large, links)
                break
            rows = large.select("node", "id", "n").join(self.classes.select("id", "tokens"), "id").mapInArrow(
                partial(_children, branches=BRANCHES, tokens=self.tokens), "node long, id long, n long").distinct()
        return reduce(DataFrame.unionByName, leaves), links

    def _stars(self, large: DataFrame) -> DataFrame:
        """Each document of a large node with the node's first one, in groups of bounded size."""
        pairs = large.select("pivot", "id", "n", "docs", "shingles").where("id <> pivot").groupBy("pivot", "id", "n").agg(
            F.max("docs").alias("docs"), F.max("shingles").alias("shingles"))
        parts = F.greatest(F.ceil(F.col("docs") * 4 / self.leaf_docs), F.ceil(F.col("shingles") * 4 / self.leaf_shingles), F.lit(1))
        dealt = pairs.withColumn("gid", F.xxhash64("pivot", F.pmod(F.xxhash64("id"), parts)))
        heads = dealt.select("gid", F.col("pivot").alias("id"), "pivot").distinct()
        return dealt.select("gid", "id", "pivot").unionByName(heads)

    def _undecided(self, large: DataFrame, links: list[DataFrame]) -> DataFrame:
        """Large nodes whose documents the confirmed links do not yet all join."""
        labels = connected(reduce(DataFrame.union, links))
        rows = large.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = rows.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        return rows.join(mixed.select("node"), "node", "left_semi").drop("component")

    def _rarest(self, rows: DataFrame, held: DataFrame, labels: DataFrame) -> DataFrame:
        """Leaves of the documents that share a rare shingle among the first of each, in order of rarity.

        Linked documents share all but (100 - percent) % of either's shingles, so
        in one order for all they share one of so many and one more. A leaf whose
        documents are joined already goes.
        """
        order = Window.partitionBy("id").orderBy(F.coalesce(~F.col("rare"), F.lit(False)), F.coalesce("docs", F.lit(1)), "shingle")
        first = rows.join(held, "shingle", "left").withColumn("place", F.row_number().over(order)).where(
            F.col("place") <= F.col("n") - F.ceil(F.col("n") * (self.percent / 100) - 1e-6) + 1)
        rare = first.where("rare").select(F.xxhash64("shingle", F.lit(1)).alias("leaf"), "id", "n")
        rare = store(rare.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
        mixed = rare.groupBy("leaf").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        return rare.join(mixed.select("leaf"), "leaf").select("leaf", "id", "n")

    def _crowds(self, large: DataFrame, links: list[DataFrame]) -> list[DataFrame]:
        """Leaves for documents of nodes that do not split, each pair that may be linked in one at least.

        Shingles that many of them hold, as templates do, are common, the others
        rare. Two documents of a and b shingles, f and g of them common, are
        linked only if they share percent / (100 + percent) * (a + b), and so
        share a rare one unless the lesser of f and g reaches that. So documents
        meet at their rarest shingles, in leaves within the limits, and only those
        with more common shingles than any partner in the crowd lets them have
        are compared in blocks, every crowd once.
        """
        own, labels = store(large.select("id", "n").distinct()), connected(reduce(DataFrame.union, links))
        rows = store(self.full_sets(own).select("members", "id", "n").mapInArrow(_each_shingle, "shingle long, id long, n long"))
        held = rows.groupBy("shingle").agg(F.count("id").alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
        few = (F.col("docs") <= self.leaf_docs) & (F.col("shingles") <= self.leaf_shingles)
        held = store(held.withColumn("rare", few))
        rare = self._rarest(rows, held, labels)
        common = rows.join(held.where("not rare").select("shingle"), "shingle").groupBy("id", "n").agg(F.count("shingle").alias("common"))
        share, least = self.percent / (100 + self.percent), own.agg(F.min("n")).first()[0]
        partner = F.greatest(F.col("n") * (self.percent / 100), F.lit(least))
        heavy = store(common.where(F.col("common") >= share * (F.col("n") + partner) - 1e-6).select("id"))
        if heavy.isEmpty():
            return [rare]
        crowd = connected(large.select(F.col("pivot").alias("a"), F.col("id").alias("b"))).withColumnRenamed("component", "node")
        members = own.join(heavy, "id").join(crowd, "id")
        sizes = members.groupBy("node").agg(F.count("id").alias("docs"), F.sum("n").alias("shingles"))
        return [rare, self._blocks(members.join(sizes, "node"))]

    def _blocks(self, large: DataFrame) -> DataFrame:
        """Every two blocks of a node's documents as a leaf, so that all of it is compared."""
        many = F.greatest(F.ceil(F.col("docs") * 4 / self.leaf_docs), F.ceil(F.col("shingles") * 4 / self.leaf_shingles)).cast("int")
        own = F.pmod(F.hash("id"), F.col("many"))
        others = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda x: F.struct(F.least(x, "own").alias("low"), F.greatest(x, "own").alias("high")))
        return (large.withColumn("many", many).withColumn("own", own).withColumn("pair", F.explode(others))
                .select(F.xxhash64("node", "pair").alias("leaf"), "id", "n"))

    def links(self) -> DataFrame:
        """Confirmed links (a, b) between classes of equal sets, enough to join all that is linked."""
        rows, links = self.nodes()
        found = links + [self.confirmed(self._candidates(rows))]
        return reduce(DataFrame.union, found)

    def _candidates(self, rows: DataFrame) -> DataFrame:
        """Groups of documents likely linked, by comparing the tokens of each leaf."""
        sized = F.array_sort(F.collect_list(F.struct("n", "id")))
        lists = rows.groupBy("leaf").agg(sized.alias("own")).select("own", F.size("own").alias("many")).withColumn("own", F.expr(
            f"filter(own, (x, i) -> (i > 0 and get(own, i - 1).n * 100 >= x.n * {self.percent})"
            f" or (i < many - 1 and x.n * 100 >= get(own, i + 1).n * {self.percent}))"))
        alike = lists.where(F.size("own") > 1).select(F.xxhash64("own").alias("leaf"), "own").dropDuplicates(["leaf"])
        live = store(alike.select("leaf", F.inline("own")).drop("n"))
        likely = store(
            self.dealt(live, "leaf", self.classes.select("id", "n", "tokens"))
            .groupBy("bin").applyInArrow(self._grouped(_estimate), "leaf long, head long, id long, n long"))
        cluster = connected(likely.select(F.col("head").alias("a"), F.col("id").alias("b")))
        ids = likely.select("id", "n").distinct().join(cluster, "id")
        sizes = ids.groupBy("component").agg(F.count("id").alias("docs"), F.sum("n").alias("shingles"))
        fits = (F.col("docs") <= self.leaf_docs) & (F.col("shingles") <= self.leaf_shingles)
        ids = store(ids.join(sizes, "component").withColumn("fits", fits))
        whole = ids.where("fits").select(F.col("component").alias("gid"), "id")
        # a cluster beyond the limits is confirmed leaf by leaf
        parts = likely.join(ids.where("not fits").select("id"), "id", "left_semi").select(F.xxhash64("leaf", "head").alias("gid"), "id")
        return whole.union(parts).withColumn("pivot", F.lit(None).cast("long"))


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, trees: int = TREES, tokens: int = TOKENS,
    leaf_docs: int = LEAF_DOCS, leaf_shingles: int = LEAF_SHINGLES, depth: int = DEPTH,
) -> DataFrame:
    """Groups of near-duplicate documents: doc_id, n_shingles, component_id, kept, set_key.

    A document's set holds its distinct shingles of `width` words; two documents
    are linked when 100 times the intersection is at least `percent` times the
    union. Equal sets are collapsed to a class first, so copies cost one row.

    Every class draws minwise tokens of its set. In each of `trees` independent
    trees a root selects one token and sends every class to the node of its
    value; a node larger than `leaf_docs` or `leaf_shingles` selects two more
    and branches again. On the way, all classes of a large node are compared
    with its first one, and a node that confirmed links already join is closed,
    so a crowd of near copies ends early. Small nodes are compared exhaustively
    by tokens, what is likely linked exactly on the full sets. A crowd that has
    not split after `depth` levels, such as the pages of one template, is joined
    by its rare shingles, see `_crowds`. Links of similarity s at the threshold or
    above share a root in all but (1 - s) ** trees of the cases (6e-9 at 0.85).

    `component_id` is the smallest doc_id reachable by links, `kept` says that
    it is the document's own. A NULL, empty or blank text has no shingles and is
    linked with nothing. A row without doc_id stays as it is, kept, with no
    component. Repeated rows each get their result. Other columns are ignored.
    """
    run = _Join(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), width, percent, trees, tokens, leaf_docs, leaf_shingles, depth)
    labels = connected(run.links())
    heads = store(run.classes.select("id", "key").join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("head")))
    own = run.sketches.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    found = own.join(heads, "key", "left").withColumn("component_id", F.coalesce("head", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        F.lower(F.hex("key")).alias("set_key"))
