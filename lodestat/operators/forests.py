"""Decision trees and forests grown to any depth, as tables of nodes.

A node of more rows than a task takes is split in passes over the table that
sum histograms; the rows below meet in one task per part, which grows the rest
with every threshold. A table small by measure goes to the tasks whole, some
trees to each. Where many rows share their features, each tree's draws are summed
per distinct features and it grows on the sums. The nodes stay a table in the
shared folder; only the tops of large trees, a node per part at most, are on the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestat.plans.lineage import checkpoint_folder, shuffles_dropped

PART_CELLS = 24_000_000       # rows times columns that one task grows on, twice as many of floats whose ranks take their place
PART_ROWS = 1_000_000         # and rows
WAVE_TREES = 4                # trees for each core whose rows are dealt to parts at once
BROADCAST_BYTES = 32 << 20    # a table of so many bytes is sent to the tasks whole
MODEL_BYTES = 64 << 20        # and so is a model when scoring
HISTOGRAM_BYTES = 64 << 20    # sums that a task holds in a pass
ROUTED_ROWS = 100_000         # rows of a part that one task scores
SHARED_ROWS = 8               # rows per distinct features from which draws are summed per features
DISTINCT = 100_000            # and the most distinct features for that
CELLS = 50_000                # values of a table that stands for a model when scoring
CHUNK_ROWS = 100_000          # rows that a task draws for or counts at once
BLOCK_ROWS = 32_768           # rows whose nodes are grown apart from the others, as they stay in a core's cache
BINS = 256
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Upper limits of a uniform draw for 0, 1, 2, ... of a Poisson variable of mean 1.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(13)])



def _least(limit: float) -> int:
    """The smallest whole number that is at least `limit` when divided by 2 ** 64 as a double."""
    low, high = 0, 2 ** 64
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if float(middle) / 2.0 ** 64 >= limit else (middle + 1, high)
    return low


# as signed numbers, which compare faster
_LIMITS = [np.int64(limit - 2 ** 63) for limit in map(_least, _POISSON) if limit < 2 ** 64]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@dataclass(frozen=True)
class Settings:
    """How trees are grown. `classes` is 0 for a regression, `subset` the features tried per node."""

    classes: int = 0
    trees: int = 1
    bagged: bool = False
    subset: int | None = None
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    seed: int = 42
    shift: float = 0.0  # what a regression's labels are less by while a tree grows

    @property
    def width(self) -> int:
        """Sums that describe a node besides its weight."""
        return max(1, self.classes)

    def seeds(self, trees: np.ndarray) -> np.ndarray:
        return _mix(trees.astype(np.uint64) + np.uint64(self.seed) * np.uint64(1_000_003))

    def weights(self, tree: int, numbers: np.ndarray) -> np.ndarray:
        """How often a tree draws each row, from the row's number alone."""
        if not self.bagged:
            return np.ones(len(numbers))
        drawn = _mix(numbers.astype(np.uint64) * np.uint64(2_654_435_761) + self.seeds(np.array([tree]))[0])
        drawn = (drawn ^ np.uint64(1 << 63)).view(np.int64)
        out = np.zeros(len(numbers), np.int8)
        for limit in _LIMITS:
            out += drawn >= limit
        return out.astype(float)

    def tried(self, seeds: np.ndarray, dims: int) -> np.ndarray:
        """(nodes, dims): the features each node may split on first."""
        if not self.some(dims):
            return np.ones((len(seeds), dims), bool)
        out = np.zeros((len(seeds), dims), bool)
        np.put_along_axis(out, self.tried_first(seeds, dims), True, axis=1)
        return out

    def some(self, dims: int) -> bool:
        """Whether nodes try some of the features only."""
        return self.subset is not None and self.subset < dims

    def tried_first(self, seeds: np.ndarray, dims: int) -> np.ndarray:
        """(nodes, subset): the same as places, ascending."""
        drawn = _mix(seeds[:, None] + np.arange(1, dims + 1, dtype=np.uint64))
        return np.sort(np.argpartition(drawn, self.subset - 1, axis=1)[:, :self.subset], axis=1)


def _below(seeds: np.ndarray, right: bool) -> np.ndarray:
    return _mix(seeds * np.uint64(2) + np.uint64(1 + right))


@dataclass
class Nodes:
    """Nodes of a tree or of a part of one; the right child follows the left one, leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    rows: np.ndarray
    gain: np.ndarray
    value: np.ndarray
    which: np.ndarray | None = None  # of a slim tree: places of the nodes' values among those that differ

    def values(self, nodes: np.ndarray | slice = slice(None)) -> np.ndarray:
        return self.value[nodes] if self.which is None else self.value[self.which[nodes]]

    def slim(self, inner: bool) -> Nodes:
        """The same with every value held once, of the leaves only unless a pruning may end at `inner` nodes."""
        value = np.ascontiguousarray(self.values() if inner else np.where((self.feature < 0)[:, None], self.values(), 0.0), float)
        _, first, which = np.unique(value.view(np.dtype((np.void, value.itemsize * value.shape[1]))).ravel(), return_index=True, return_inverse=True)
        return replace(self, gain=np.zeros(0), value=value[first], which=which)

    @classmethod
    def leaves(cls, nodes: int, width: int) -> Nodes:
        return cls(np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes, int), np.zeros(nodes), np.zeros(nodes), np.zeros((nodes, width)))

    def packed(self) -> dict[str, bytes]:
        kinds = _KINDS if self.which is None else _SLIM_KINDS
        return {name: np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in kinds.items()}

    @classmethod
    def unpacked(cls, row, width: int) -> Nodes:
        own = {name: np.frombuffer(row[name], dtype=kind) for name, kind in (_SLIM_KINDS if "which" in row else _KINDS).items()}
        own["value"] = own["value"].reshape(-1, width)
        return cls(**own)


_KINDS = {"feature": "i4", "threshold": "f8", "left": "i4", "rows": "i8", "gain": "f8", "value": "f8"}
_SLIM_KINDS = _KINDS | {"which": "i4"}
_PARTS, _SLIM = ("tree int, part int, depth int, " + ", ".join(f"{name} binary" for name in kinds) for kinds in (_KINDS, _SLIM_KINDS))


_BITS = 21
_PACKED = (1 << _BITS) - 1


@dataclass
class Held:
    """What a tree grows on: rows, or sums of rows that share their features (and their class)."""

    x: np.ndarray                     # (items, dims)
    count: np.ndarray                 # rows drawn
    weight: np.ndarray                # how often
    label: np.ndarray                 # weighted sum of labels, or the class, which `packed` tells if given
    low: np.ndarray | None = None     # smallest and largest label of all rows, drawn or not, of a regression
    high: np.ndarray | None = None
    ranks: np.ndarray | None = None   # (items, dims): places of the values among a column's
    packed: np.ndarray | None = None  # of two classes: rows, weight and weight of the second in one number, so that one sum is all three

    def of(self, rows: np.ndarray) -> Held:
        """Some of the items of a classification."""
        ranks = self.ranks[rows]
        x = replace(self.x, ranks=ranks) if isinstance(self.x, _Ranked) else self.x[rows]
        return Held(x, self.count[rows], self.weight[rows], self.label[rows], ranks=ranks, packed=None if self.packed is None else self.packed[rows])

    def in_one(self) -> np.ndarray | None:
        """`packed`, if the numbers are whole and their sums small enough."""
        w = self.weight
        if max(w.sum(), self.count.sum()) > _PACKED or (w != np.floor(w)).any() or (self.count != np.floor(self.count)).any():
            return None
        whole = w.astype(np.int64)
        return (self.count.astype(np.int64) << 2 * _BITS) | (whole << _BITS) | whole * self.label

    @classmethod
    def rows(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, ranks: np.ndarray | None = None) -> Held:
        if classes:
            return cls(x, (w > 0).astype(float), w, y.astype(_small(classes)), ranks=ranks)
        return cls(x, (w > 0).astype(float), w, w * y, y, y, ranks)


def _small(classes: int) -> type:
    return np.int8 if classes < 128 else np.int16


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.stack([np.unique(x[:, f], return_inverse=True)[1].astype(np.int32) for f in range(x.shape[1])], axis=1)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, s: Settings, seed: np.uint64, depth: int = 0) -> Nodes:
    """A tree over the rows of positive weight, level by level, every threshold tried."""
    return grow_on(Held.rows(x, y, w, s.classes), s, seed, depth)


def grow_on(held: Held, s: Settings, seed: np.uint64, depth: int = 0) -> Nodes:
    """A tree over the items of positive weight, level by level, every threshold tried.

    All nodes of a level are split at once. Where nodes try all features, the
    items are kept in the order of each feature within each node; where they try
    some, only those are sorted. A split is a running sum and its items are dealt
    to the children in place.
    """
    x, w, dims = held.x, held.weight, held.x.shape[1]
    inside = np.flatnonzero(held.count > 0)
    shift = 0.0 if s.classes else float(held.label[inside].sum() / w[inside].sum())
    if not s.classes:
        held = replace(held, label=held.label - shift * w)
    elif s.classes == 2 and held.packed is None:
        held = replace(held, packed=held.in_one())
    if s.some(dims):
        held = held if held.ranks is not None else replace(held, ranks=_ranks(x))
        orders = inside[None, :]
    else:
        orders = np.stack([inside[np.argsort(x[inside, f], kind="stable")] for f in range(dims)])
    return _grow_levels(held, s, orders, np.array([0]), np.array([seed], np.uint64), depth, shift + s.shift)


def _grow_levels(held: Held, s: Settings, orders: np.ndarray, starts: np.ndarray, seeds: np.ndarray, depth: int, shift: float) -> Nodes:
    """Trees whose roots have the items from each start on; the roots come first.

    Of a classification whose nodes try some features, nodes of few rows are
    grown apart from a large level, some together, as whole trees below it.
    """
    x, w, label = held.x, held.weight, held.label
    some = s.some(x.shape[1])
    made: dict[str, list[np.ndarray]] = {name: [] for name in _KINDS}
    total = len(starts)
    blocks: list[tuple[np.ndarray, Nodes]] = []
    while len(starts):
        rows = orders[0]
        sizes = np.diff(np.append(starts, len(rows)))
        first = total - len(starts)
        apart = sizes <= BLOCK_ROWS if s.classes and some and len(rows) > BLOCK_ROWS else np.zeros(len(starts), bool)
        if apart.any():
            for nodes in _packed(sizes, np.flatnonzero(apart)):
                own = rows[np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in nodes])]
                begins = np.concatenate([[0], np.cumsum(sizes[nodes])[:-1]])
                blocks.append((first + nodes, _grow_levels(held.of(own), s, np.arange(len(own))[None, :], begins, seeds[nodes], depth, shift)))
            orders = orders[:, np.repeat(~apart, sizes)]
            rows, own = orders[0], np.flatnonzero(~apart)
            sizes, seeds = sizes[own], seeds[own]
            starts = np.cumsum(sizes) - sizes
        else:
            own = np.arange(len(starts))
        here = Nodes.leaves(len(apart), s.width)
        split = np.zeros(0, bool)
        if len(own):
            if held.packed is not None:
                many, weight, one = _unpacked(np.add.reduceat(held.packed[rows], starts))
                sums = np.stack([weight - one, one], axis=1)
                mixed = sums.max(axis=1) < weight
            else:
                many = np.add.reduceat(held.count[rows], starts)
                weight = np.add.reduceat(w[rows], starts)
            if held.packed is not None:
                pass
            elif s.classes:
                node = np.repeat(np.arange(len(starts)), sizes)
                sums = np.bincount(node * s.classes + label[rows], w[rows], len(starts) * s.classes).reshape(-1, s.classes)
                mixed = sums.max(axis=1) < weight
            else:
                sums = np.add.reduceat(label[rows], starts)[:, None]
                mixed = np.minimum.reduceat(held.low[rows], starts) < np.maximum.reduceat(held.high[rows], starts)
            purity = (sums ** 2).sum(axis=1) / weight
            open_ = mixed & (many >= max(2, s.min_samples_split, 2 * s.min_samples_leaf))
            if s.max_depth is not None and depth >= s.max_depth:
                open_[:] = False
            here.rows[own], here.value[own] = many, sums / weight[:, None] + shift
            feature, threshold, best = np.full(len(own), -1), np.zeros(len(own)), np.full(len(own), -np.inf)
            edge, lefts, dealt = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), None
            if open_.any():
                orders, to = orders[:, np.repeat(open_, sizes)], np.flatnonzero(open_)
                level = _Level(x, held.count, w, label, s, sizes[to], many[to], weight[to], sums[to], held.packed)
                if some:
                    found, dealt = _tried_splits(level, held.ranks, orders[0], seeds[to])
                    feature[to], threshold[to], best[to], edge[to], lefts[to] = found
                else:
                    feature[to], threshold[to], best[to] = _all_splits(level, orders)
            split = feature >= 0
            here.feature[own], here.threshold[own], here.gain[own] = feature, threshold, np.where(split, best - purity, 0.0)
            here.left[own[split]] = total + 2 * np.arange(split.sum())
        for name in _KINDS:
            made[name].append(getattr(here, name))
        total += 2 * int(split.sum())
        if not split.any():
            break
        inside = np.repeat(split[open_], sizes[open_])
        seeds = np.stack([_below(seeds[split], False), _below(seeds[split], True)], axis=1).ravel()
        depth += 1
        if dealt is not None:  # sorted by the feature of the split already
            parts = np.stack([lefts[split], sizes[split] - lefts[split]], axis=1).ravel()
            orders, starts = dealt[inside][None, :], np.cumsum(parts) - parts
            continue
        orders, feature, threshold = orders[:, inside], feature[split], threshold[split]
        node = np.repeat(np.arange(len(feature)), sizes[split])
        if some:
            goes = held.ranks.reshape(-1)[orders[0] * x.shape[1] + feature[node]] <= edge[split][node]
        else:
            goes = np.zeros(len(x), bool)
            goes[orders[0]] = x[orders[0], feature[node]] <= threshold[node]
        orders, starts = _dealt(goes, orders, sizes[split], node, apart=some)
    whole = Nodes(**{name: np.concatenate(parts) for name, parts in made.items()})
    if not blocks:
        return whole
    pieces, at = [whole], len(whole.feature)
    for roots, nodes in blocks:
        many = len(roots)
        nodes.left[nodes.left > 0] += at - many
        for name in _KINDS:
            getattr(whole, name)[roots] = getattr(nodes, name)[:many]
        pieces.append(Nodes(**{name: getattr(nodes, name)[many:] for name in _KINDS}))
        at += len(nodes.feature) - many
    return Nodes(**{name: np.concatenate([getattr(p, name) for p in pieces]) for name in _KINDS})


def _packed(sizes: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
    """The nodes in runs of at most BLOCK_ROWS rows together."""
    out, held = [[]], 0
    for i, size in zip(nodes.tolist(), sizes[nodes].tolist()):
        if held + size > BLOCK_ROWS and out[-1]:
            out.append([])
            held = 0
        out[-1].append(i)
        held += size
    return [np.array(run) for run in out]


@dataclass
class _Level:
    """The items and the nodes of a level that may be split."""

    x: np.ndarray
    count: np.ndarray
    w: np.ndarray
    label: np.ndarray
    s: Settings
    sizes: np.ndarray    # items
    many: np.ndarray     # rows
    weight: np.ndarray
    sums: np.ndarray     # (nodes, width)
    packed: np.ndarray | None = None

    def __post_init__(self):
        self.ends, self.node = np.cumsum(self.sizes) - 1, np.repeat(np.arange(len(self.sizes)), self.sizes)

    def of(self, nodes: np.ndarray) -> _Level:
        return replace(self, sizes=self.sizes[nodes], many=self.many[nodes], weight=self.weight[nodes], sums=self.sums[nodes])

    def cuts(self, rows: np.ndarray, changes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes with a cut, the place of each one's best cut and its sum of purities.

        `rows` are sorted by a feature within each node; `changes` are the places
        (but the last) after which its value changes or a node ends.
        """
        ends, node = self.ends, self.node
        if self.packed is not None:
            return self._packed_cuts(rows, changes)
        w = self.w[rows]

        def run(values):
            total = np.cumsum(values)
            before = np.zeros(len(ends))
            before[1:] = total[ends[:-1]]
            return total - np.repeat(before, self.sizes)

        inside = changes.copy()
        inside[ends[:-1]] = False
        if self.s.min_samples_leaf > 1:
            run_n = run(self.count[rows])
            inside &= ((run_n >= self.s.min_samples_leaf) & (self.many[node] - run_n >= self.s.min_samples_leaf))[:-1]
        cut = np.flatnonzero(inside)
        own = node[cut]
        if not len(cut):
            return own, cut, np.zeros(0)
        left_w = run(w)[cut]
        right_w = self.weight[own] - left_w
        label = self.label[rows]
        if self.s.classes == 2:
            one = run(w * label)[cut]
            zero = left_w - one
            left, right = one ** 2 + zero ** 2, (self.sums[own, 1] - one) ** 2 + (self.sums[own, 0] - zero) ** 2
        elif self.s.classes:
            # sums of squares over classes grow with each row by what its own class had before it
            order = np.argsort(label, kind="stable")  # small numbers: no comparisons
            many = np.bincount(label.astype(np.int64) * len(ends) + node, minlength=len(ends) * self.s.classes)
            held, own_w = self.sums.T.ravel(), w[order]
            grown, cross = np.empty(len(rows)), np.empty(len(rows))
            grown[order] = own_w * (2 * (np.cumsum(own_w) - np.repeat(np.cumsum(held) - held, many)) - own_w)
            cross[order] = own_w * np.repeat(held, many)
            left = run(grown)[cut]
            right = (self.sums ** 2).sum(axis=1)[own] - 2 * run(cross)[cut] + left
        else:
            left = run(label)[cut]
            left, right = left ** 2, (self.sums[own, 0] - left) ** 2
        return _highest(own, cut, left / left_w + right / right_w)

    def _packed_cuts(self, rows: np.ndarray, changes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        changes[self.ends[:-1]] = False
        cut = np.flatnonzero(changes)
        own, total = self.node[cut], np.cumsum(self.packed[rows])
        before = np.zeros(len(self.ends), np.int64)
        before[1:] = total[self.ends[:-1]]
        many, left_w, one = _unpacked(total[cut] - before[own])  # right even where the running total overflows
        least = self.s.min_samples_leaf
        if least > 1:
            fit = np.flatnonzero((many >= least) & (self.many[own] - many >= least))
            cut, own, left_w, one = cut[fit], own[fit], left_w[fit], one[fit]
        if not len(cut):
            return own, cut, np.zeros(0)
        right_w, zero = self.weight[own] - left_w, left_w - one
        left, right = one ** 2 + zero ** 2, (self.sums[own, 1] - one) ** 2 + (self.sums[own, 0] - zero) ** 2
        return _highest(own, cut, left / left_w + right / right_w)


def _unpacked(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, weight and weight of the second class."""
    return (sums >> 2 * _BITS).astype(float), (sums >> _BITS & _PACKED).astype(float), (sums & _PACKED).astype(float)


def _highest(own: np.ndarray, cut: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, the place of each one's first cut of the highest score, and that."""
    if len(own):
        first = _firsts(own)
        top = np.maximum.reduceat(score, first)
        hit = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(own)))))
        hit = hit[_firsts(own[hit])]
        own, cut, score = own[hit], cut[hit], score[hit]
    return own, cut, score


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])


def _middle(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    low, high = low.astype(float), high.astype(float)
    middle = low + (high - low) / 2
    return np.where(middle < high, middle, low)


def _all_splits(level: _Level, orders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, threshold and sum of purities of each node's best split; feature -1 where there is none."""
    nodes = len(level.sizes)
    feature, threshold, best = np.full(nodes, -1), np.zeros(nodes), np.full(nodes, -np.inf)
    for f, rows in enumerate(orders):
        at = level.x[rows, f]
        found, cut, score = level.cuts(rows, at[:-1] < at[1:])
        better = score > best[found]
        found, cut = found[better], cut[better]
        feature[found], threshold[found], best[found] = f, _middle(at[cut], at[cut + 1]), score[better]
    return feature, threshold, best


def _tried_splits(level: _Level, ranks: np.ndarray, rows: np.ndarray, seeds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray | None]:
    """The same over the features each node tries, over its others where those have no split.

    To feature, threshold and sum of purities come the rank up to which rows go
    left and how many do. Where each node has met one feature, the rows are
    returned in the order of that within each node.
    """
    dims = level.x.shape[1]
    first = level.s.tried_first(seeds, dims)
    found, dealt = _sorted_splits(level, ranks, rows, first)
    lacking = np.flatnonzero(found[0] < 0)
    if len(lacking):
        rest = np.ones((len(lacking), dims), bool)
        np.put_along_axis(rest, first[lacking], False, axis=1)
        rest = np.nonzero(rest)[1].reshape(len(lacking), -1)
        of = np.repeat(found[0] < 0, level.sizes)
        more, again = _sorted_splits(level.of(lacking), ranks, rows[of], rest)
        for out, own in zip(found, more):
            out[lacking] = own
        if dealt is not None and again is not None:
            dealt[of] = again
        else:
            dealt = None
    return found, dealt


def _sorted_splits(level: _Level, ranks: np.ndarray, rows: np.ndarray, features: np.ndarray) -> tuple[list[np.ndarray], np.ndarray | None]:
    nodes = len(level.sizes)
    feature, threshold, best = np.full(nodes, -1), np.zeros(nodes), np.full(nodes, -np.inf)
    edge, lefts, sorted_ = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64), rows
    node = level.node
    bits = max(len(rows), int(ranks.max()) + 1).bit_length()
    ahead = (node << 2 * bits) | np.arange(len(rows)) if 3 * bits < 64 else None
    flat, at = ranks.reshape(-1), rows * ranks.shape[1]
    for column in features.T:
        rank = flat[at + column[node]]
        if 3 * bits < 64:  # node, rank and place fit one number
            key = rank.astype(np.int64)
            key <<= bits
            key |= ahead
            key.sort()
            key &= (1 << bits) - 1
            order = key
        else:
            order = np.lexsort((rank, node))
        sorted_, rank = rows[order], rank[order]
        found, cut, score = level.cuts(sorted_, rank[:-1] != rank[1:])
        better = score > best[found]
        found, cut = found[better], cut[better]
        f = column[found]
        feature[found], best[found], edge[found] = f, score[better], rank[cut]
        lefts[found] = cut + 1 - (level.ends[found] + 1 - level.sizes[found])
        threshold[found] = _middle(level.x[sorted_[cut], f], level.x[sorted_[cut + 1], f])
    return [feature, threshold, best, edge, lefts], sorted_ if features.shape[1] == 1 else None


def _dealt(goes: np.ndarray, orders: np.ndarray, sizes: np.ndarray, node: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """The orders with each node's rows moved to its children, and where those begin; `goes` left by row, or by place if there is one order."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    to_left = np.add.reduceat(goes if apart else goes[orders[0]], starts, dtype=int)
    out = np.empty_like(orders)
    for f, rows in enumerate(orders):
        left = goes if apart else goes[rows]
        run = np.cumsum(left)
        rank = run - np.where(starts > 0, run[starts - 1], 0)[node]  # left rows of the node so far
        place = np.arange(len(rows)) - starts[node]
        to = starts[node] + np.where(left, rank - 1, to_left[node] + place - rank)
        out[f, to] = rows
    return out, np.stack([starts, starts + to_left], axis=1).ravel()


@dataclass(frozen=True)
class Pruning:
    """A tree cut at a depth and at nodes of few rows, as if grown so."""

    max_depth: int | None = None
    min_samples_split: int = 2


WHOLE = (Pruning(),)


def stops(nodes: Nodes, x: np.ndarray, prunings: Sequence[Pruning], depth: int = 0, start: np.ndarray | None = None) -> np.ndarray:
    """(prunings, rows): the node at which each row ends."""
    at = np.zeros(len(x), np.int64) if start is None else start.copy()
    out = np.full((len(prunings), len(x)), -1, np.int64)
    live = np.arange(len(x))
    while len(live):
        here = at[live]
        leaf = nodes.feature[here] < 0
        for i, p in enumerate(prunings):
            ends = leaf | (nodes.rows[here] < p.min_samples_split)
            if p.max_depth is not None and depth >= p.max_depth:
                ends = np.ones(len(live), bool)
            new = ends & (out[i, live] < 0)
            out[i, live[new]] = here[new]
        live, here = live[~leaf], here[~leaf]
        at[live] = nodes.left[here] + (x[live, nodes.feature[here]] > nodes.threshold[here])
        depth += 1
    return out


def _points(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, dims)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _grow_trees(batches: Iterator[pa.RecordBatch], held, s: Settings) -> Iterator[pa.RecordBatch]:
    """A tree per row of the input, over the whole table that each task has."""
    trees = [tree for batch in batches for tree in batch.column("tree").to_pylist()]
    yield from _grow_whole(*held.value, trees, s)


@dataclass
class _Ranked:
    """A matrix as the places of its cells among the distinct values of their columns."""

    ranks: np.ndarray   # (rows, dims)
    values: np.ndarray  # of all columns, one after another
    first: np.ndarray   # where a column's begin

    @property
    def shape(self) -> tuple[int, int]:
        return self.ranks.shape

    def __len__(self) -> int:
        return len(self.ranks)

    def __getitem__(self, at: tuple) -> np.ndarray:
        return self.values[self.first[at[1]] + self.ranks[at]].astype(float)

    def rows(self, at: np.ndarray) -> _Ranked:
        return replace(self, ranks=self.ranks[at])

    @classmethod
    def of(cls, x: np.ndarray, order: np.ndarray) -> tuple[_Ranked, np.ndarray | None]:
        """The rows of `x` in an order, and numbers that equal rows share if there are two of a kind on average.

        A matrix of floats is used up: its ranks take its place in memory.
        """
        n, dims = x.shape
        ranks = x.view(np.int32) if x.dtype == np.float32 else np.empty(x.shape, np.int32)
        values, first = np.empty(n * dims, x.dtype), np.zeros(dims, np.int64)  # memory is taken as it is written
        end, code, many = 0, np.zeros(n, np.int64), 1
        for f in range(dims):
            own, rank = np.unique(x[order, f], return_inverse=True)
            ranks[:, f], first[f] = rank, end
            values[end:end + len(own)] = own
            end += len(own)
            if 2 * many <= n:
                found, code = np.unique(code * len(own) + rank, return_inverse=True)
                many = len(found)
        return cls(ranks, values, first), code if 2 * many <= n else None


def _grow_whole(x: np.ndarray, y: np.ndarray, numbers: np.ndarray, trees: Sequence[int], s: Settings) -> Iterator[pa.RecordBatch]:
    """The trees over a table in the order of its rows' values."""
    new = np.ones(len(x), bool)
    both = s.classes == 2 and s.some(x.shape[1]) and len(x) <= _PACKED // 2  # rows of either class that share features are one item
    new[1:] = (x[1:] != x[:-1]).any(axis=1) | (bool(s.classes) & (not both) & (y[1:] != y[:-1]))
    starts = np.flatnonzero(new)
    shared = (1 if both else 2) * len(starts) <= len(x)
    at = x[starts] if shared else x
    ranks = _ranks(at) if trees and s.some(x.shape[1]) else None
    yield from _grow_each(at, y, numbers, starts if shared else None, ranks, trees, s, both)


def _grow_ranked(x: np.ndarray, y: np.ndarray, numbers: np.ndarray, trees: Sequence[int], s: Settings) -> Iterator[pa.RecordBatch]:
    """The same over a large table, which is used up, where nodes try some features."""
    order = np.argsort(numbers)
    y, numbers = y[order], numbers[order]
    at, code = _Ranked.of(x, order)
    starts = None
    if code is not None:
        if s.classes:
            code = np.unique(code * s.classes + y.astype(np.int64), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        at, y, numbers = at.rows(order[starts]), y[order], numbers[order]
    yield from _grow_each(at, y, numbers, starts, at.ranks, trees, s)


def _grow_each(at, y: np.ndarray, numbers: np.ndarray, starts: np.ndarray | None, ranks, trees: Sequence[int], s: Settings, both: bool = False) -> Iterator[pa.RecordBatch]:
    """The trees over rows, or if `starts` are given over what begins there: rows that share features (and a class, unless of `both`)."""
    ends = None if starts is None else _ends(y, starts)
    for tree in trees:
        w = s.weights(tree, numbers)
        if not (w > 0).any():
            continue
        if starts is not None and both:
            held = _both_classes(at, y, w, starts, ranks)
        elif starts is not None:
            held = _held(at, y[starts], ranks, _drawn_sums(y, w, starts, s), ends, s)
        else:
            held = Held.rows(at, y, w, s.classes, ranks)
        yield _part(tree, 0, 0, grow_on(held, s, s.seeds(np.array([tree]))[0]))


def _both_classes(x, y: np.ndarray, w: np.ndarray, starts: np.ndarray, ranks) -> Held:
    packed = np.add.reduceat(Held.rows(x, y, w, 2).in_one(), starts)
    many, weight, _ = _unpacked(packed)
    return Held(x, many, weight, np.zeros(len(starts), np.int8), ranks=ranks, packed=packed)


def _drawn_sums(y: np.ndarray, w: np.ndarray, starts: np.ndarray, s: Settings) -> np.ndarray:
    """(kinds, groups): rows drawn, how often, and of a regression the labels' sum."""
    out = [np.add.reduceat((w > 0).astype(float), starts), np.add.reduceat(w, starts)]
    return np.stack(out if s.classes else [*out, np.add.reduceat(w * y, starts)])


def _ends(y: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)])


def _held(x, classes, ranks, sums: np.ndarray, ends: np.ndarray, s: Settings) -> Held:
    if s.classes:
        return Held(x, sums[0], sums[1], classes.astype(_small(s.classes)), ranks=ranks)
    return Held(x, *sums, *ends, ranks)


# --- tables of few distinct features, or that one task takes but the driver does not ---


@dataclass
class Codes:
    """Numbers of the distinct rows of a matrix, found column by column."""

    values: list[np.ndarray]
    pairs: list[np.ndarray]

    @classmethod
    def of(cls, rows: np.ndarray) -> Codes:
        made, code = cls([], []), np.zeros(len(rows), np.int64)
        for column in rows.T:
            values = np.unique(column)
            pair = code * len(values) + np.searchsorted(values, column)
            made.values.append(values)
            made.pairs.append(np.unique(pair))
            code = np.searchsorted(made.pairs[-1], pair)
        return made

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        code = np.zeros(len(rows), np.int64)
        for column, values, pairs in zip(rows.T, self.values, self.pairs):
            code = np.searchsorted(pairs, code * len(values) + np.searchsorted(values, column))
        return code


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches in tables of about CHUNK_ROWS rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _draw_groups(batches, held, dims: int, s: Settings, trees: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Per tree the sums of the rows it draws, for every distinct features; as tree -1 their smallest and largest labels."""
    codes, groups = held.value
    total = np.zeros((len(trees), 2 if s.classes else 3, groups))
    ends = np.stack([np.full(groups, np.inf), np.full(groups, -np.inf)])
    for rows in _chunks(batches):
        x, y, numbers = _points(_one(rows.column("x")), dims), rows.column("y").to_numpy(), rows.column("no").to_numpy()
        code = codes(np.column_stack([x, y]) if s.classes else x)
        order = np.argsort(code.astype(np.uint16) if groups <= 1 << 16 else code, kind="stable")
        code, y, numbers = code[order], y[order], numbers[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        found = code[starts]
        low, high = _ends(y, starts)
        ends[:, found] = np.minimum(ends[0, found], low), np.maximum(ends[1, found], high)
        for i, tree in enumerate(trees):
            total[i][:, found] += _drawn_sums(y, s.weights(tree, numbers), starts, s)
    for i, tree in [(-1, -1), *enumerate(trees)]:
        sums = (ends if tree < 0 else total[i]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([sums], pa.binary())], ["tree", "sums"])


def _add_groups(rows: pa.Table, groups: int) -> pa.Table:
    """One row of the sums that the tasks found for a tree."""
    tree = rows.column("tree")[0].as_py()
    parts = [np.frombuffer(packed.as_buffer()).reshape(-1, groups) for packed in rows.column("sums")]
    if tree < 0:
        total = np.stack([np.min([p[0] for p in parts], axis=0), np.max([p[1] for p in parts], axis=0)])
    else:
        total = sum(parts[1:], parts[0])
    return pa.table({"tree": pa.array([tree], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _grow_groups(batches, held, s: Settings) -> Iterator[pa.RecordBatch]:
    """A tree over each row's sums."""
    x, classes, ranks, ends = held.value
    for batch in batches:
        for tree, packed in zip(batch.column("tree").to_pylist(), batch.column("sums")):
            sums = np.frombuffer(packed.as_buffer()).reshape(-1, len(x))
            if sums[0].any():
                yield _part(tree, 0, 0, grow_on(_held(x, classes, ranks, sums, ends, s), s, s.seeds(np.array([tree]))[0]))


def _fit_groups(table: DataFrame, dims: int, s: Settings) -> DataFrame:
    """Parts of trees over a table of few distinct features: draws are summed where the rows are, each tree grows on the sums."""
    spark = table.sparkSession
    keys = table.select("x", *(["y"] if s.classes else [])).distinct().toArrow()  # at most about DISTINCT rows
    distinct = np.column_stack([_points(_one(keys.column("x")), dims), *([keys.column("y").to_numpy()] if s.classes else [])])
    distinct = np.unique(distinct + 0.0, axis=0)
    codes = Codes.of(distinct)
    x, classes = np.ascontiguousarray(distinct[:, :dims]), distinct[:, dims] if s.classes else None
    place = np.empty(len(distinct), np.int64)
    place[codes(distinct)] = np.arange(len(distinct))
    x, classes = x[place], None if classes is None else classes[place]
    ranks = _ranks(x) if s.some(dims) else None
    finder = spark.sparkContext.broadcast((codes, len(x)))
    at_once = max(1, HISTOGRAM_BYTES // (8 * (2 if s.classes else 3) * len(x)))
    found = None
    for i in range(0, s.trees, at_once):
        draw = partial(_draw_groups, held=finder, dims=dims, s=s, trees=range(i, min(s.trees, i + at_once)))
        work = partial(_add_groups, groups=len(x))
        own = _store(table.mapInArrow(draw, "tree int, sums binary").groupBy("tree").applyInArrow(lambda t: work(t), "tree int, sums binary"))  # noqa: B023
        found = own if found is None else found.unionByName(own)
    ends = np.frombuffer(found.where("tree < 0").first()["sums"]).reshape(2, -1)  # of any pass, each reads all rows
    groups = spark.sparkContext.broadcast((x, classes, ranks, ends))
    grown = found.where("tree >= 0").repartition(min(s.trees, 4 * spark.sparkContext.defaultParallelism))
    return _store(grown.mapInArrow(partial(_grow_groups, held=groups, s=s), _PARTS))


def _deal(batches, bundles: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bundle in range(bundles):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, bundle, np.int32)), *batch.columns], ["bundle", *batch.schema.names])


def _grow_bundle(batches: Iterator[pa.RecordBatch], dims: int, rows: int, s: Settings, bundles: int, kind: type) -> Iterator[pa.RecordBatch]:
    bundle, at = 0, 0
    x, y, numbers = np.empty((rows, dims), kind), np.empty(rows), np.empty(rows, np.int64)
    for batch in batches:
        to = slice(at, at + batch.num_rows)
        bundle, at = batch.column("bundle")[0].as_py(), to.stop
        x[to], y[to], numbers[to] = batch.column("x").flatten().to_numpy().reshape(-1, dims), batch.column("y").to_numpy(), batch.column("no").to_numpy()
    trees = range(bundle, s.trees, bundles)
    if s.some(dims):
        yield from _grow_ranked(x, y, numbers, trees, s)
    else:
        order = np.lexsort((numbers, y, *x.T))
        yield from _grow_whole(x[order], y[order], numbers[order], trees, s)


def _fit_bundles(table: DataFrame, dims: int, rows: int, s: Settings, single: bool) -> DataFrame:
    """Parts of trees over a table that one task takes: each of some tasks gets all rows once and grows its share of the trees."""
    bundles = min(s.trees, table.sparkSession.sparkContext.defaultParallelism)
    kind = "float" if single else "double"
    dealt = table.select(F.col("x").cast(f"array<{kind}>").alias("x"), "y", "no").mapInArrow(
        partial(_deal, bundles=bundles), f"bundle int, x array<{kind}>, y double, no long")
    work = partial(_grow_bundle, dims=dims, rows=rows, s=s, bundles=bundles, kind=np.float32 if single else np.float64)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)

    return _store(dealt.groupBy("bundle").applyInArrow(grown, _PARTS))


def _part(tree: int, part: int, depth: int, nodes: Nodes) -> pa.RecordBatch:
    own = nodes.packed()
    return pa.RecordBatch.from_arrays(
        [pa.array([tree], pa.int32()), pa.array([part], pa.int32()), pa.array([depth], pa.int32()), *[pa.array([v], pa.binary()) for v in own.values()]],
        ["tree", "part", "depth", *own])


def _slimmed(batches: Iterator[pa.RecordBatch], width: int, inner: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            yield _part(r["tree"], r["part"], r["depth"], Nodes.unpacked(r, width).slim(inner))


_NO_NODES = Nodes(*[np.zeros(0) for _ in range(5)], np.zeros((0, 1)))


# --- tops of trees over tables that no task takes whole ---------------------


@dataclass
class Top:
    """The first splits of a tree. A node is split, a leaf, or the root of a part of its own."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    depth: list[int]
    rows: list[int]
    seed: list[int]
    value: list[list[float]]
    gain: list[float]
    part: list[bool]

    @classmethod
    def root(cls, seed: int, part: bool) -> Top:
        return cls([-1], [0.0], [0], [0], [0], [seed], [[]], [0.0], [part])

    def add(self, depth: int, rows: int, seed: int, value: list[float], part: bool) -> int:
        for name, v in (("feature", -1), ("threshold", 0.0), ("left", 0), ("depth", depth), ("rows", rows), ("seed", seed), ("value", value), ("gain", 0.0), ("part", part)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def nodes(self) -> Nodes:
        width = max(map(len, self.value))
        value = np.array([v or [0.0] * width for v in self.value]).reshape(len(self.value), width)
        return Nodes(*[np.array(v) for v in (self.feature, self.threshold, self.left, self.rows, self.gain)], value)

    def route(self, x: np.ndarray) -> np.ndarray:
        return stops(self.nodes(), x, WHOLE)[0]


def _histograms(batches, dims: int, s: Settings, tops: list[Top], slots: dict[tuple[int, int], int], cuts: list[np.ndarray]):
    """Counts, weights and label sums by slot, feature and bin. The slots of a tree follow each other."""
    kinds = 2 + s.width + (not s.classes)
    total = np.zeros((kinds, len(slots), dims, BINS))
    own = {}
    for tree in dict.fromkeys(t for t, _ in slots):
        at = [k for (t, _), k in slots.items() if t == tree]
        own[tree] = min(at), len(at), np.array([slots.get((tree, i), -1) for i in range(len(tops[tree].feature))])
    for rows in _chunks(batches):
        x, y, numbers = _points(_one(rows.column("x")), dims), rows.column("y").to_numpy(), rows.column("no").to_numpy()
        codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        for tree, (first, many, slot_of) in own.items():
            w = s.weights(tree, numbers)
            slot = slot_of[tops[tree].route(x)]
            in_ = np.flatnonzero((slot >= 0) & (w > 0))
            slot, own_w, own_y = slot[in_] - first, w[in_], y[in_]
            part = total[:, first:first + many]
            for f in range(dims):
                at = slot * BINS + codes[f, in_]
                add = lambda k, term: np.add(part[k, :, f], np.bincount(at, term, many * BINS).reshape(many, BINS), out=part[k, :, f])  # noqa: B023, E731
                add(0, None)
                if s.classes:
                    by = np.bincount(at * s.classes + own_y.astype(int), own_w, many * BINS * s.classes).reshape(many, BINS, s.classes)
                    part[1, :, f] += by.sum(axis=2)
                    part[2:, :, f] += by.transpose(2, 0, 1)
                else:
                    add(1, own_w)
                    add(2, own_w * own_y)
                    add(3, own_w * own_y ** 2)
    slot, feature, place = np.nonzero(total[0])
    yield pa.RecordBatch.from_arrays(
        [pa.array(v.astype(np.int32)) for v in (slot, feature, place)] + [pa.array(t[slot, feature, place]) for t in total],
        ["slot", "feature", "bin", *[f"s{k}" for k in range(kinds)]])


def _best(rows: pa.Table, dims: int, s: Settings, cuts: list[np.ndarray], seeds: np.ndarray) -> pa.Table:
    """The best split of a slot's node and what its children hold."""
    slot = rows.column("slot")[0].as_py()
    kinds = 2 + s.width + (not s.classes)
    sums = np.zeros((kinds, dims, BINS))
    at = (rows.column("feature").to_numpy(), rows.column("bin").to_numpy())
    for k in range(kinds):
        sums[k][at] = rows.column(f"s{k}").to_numpy()
    run = sums.cumsum(axis=2)
    whole = run[:, 0, -1]
    rest = whole[:, None, None] - run
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (run[2:2 + s.width] ** 2).sum(axis=0) / run[1] + (rest[2:2 + s.width] ** 2).sum(axis=0) / rest[1]
    least = max(1, s.min_samples_leaf)
    score = np.where((run[0] >= least) & (rest[0] >= least), score, -np.inf)
    purity = (whole[2:2 + s.width] ** 2).sum() / whole[1]
    impurity = (whole[1] if s.classes else whole[-1]) - purity
    if impurity <= 1e-12 * (impurity + purity):
        score[:] = -np.inf
    first = np.where(s.tried(seeds[slot:slot + 1], dims)[0][:, None], score, -np.inf)
    use = first if np.isfinite(first.max()) else score
    f, b = np.unravel_index(int(use.argmax()), use.shape)
    found = bool(np.isfinite(use[f, b]))
    value = lambda v: (v[2:2 + s.width] / v[1] + s.shift).tolist()
    out = {
        "slot": [slot], "feature": [int(f) if found else -1], "threshold": [float(cuts[f][b]) if found else 0.0],
        "gain": [float(use[f, b] - purity) if found else 0.0], "rows": [int(whole[0])], "value": [value(whole)],
        "left_rows": [int(run[0, f, b]) if found else 0], "left_value": [value(run[:, f, b]) if found else []],
        "right_value": [value(rest[:, f, b]) if found else []]}
    return pa.table(out, schema=pa.schema([
        ("slot", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()), ("gain", pa.float64()), ("rows", pa.int64()),
        ("value", pa.list_(pa.float64())), ("left_rows", pa.int64()), ("left_value", pa.list_(pa.float64())), ("right_value", pa.list_(pa.float64()))]))


_BEST = "slot int, feature int, threshold double, gain double, rows long, value array<double>, left_rows long, left_value array<double>, right_value array<double>"


def _grow_tops(table: DataFrame, dims: int, rows: int, s: Settings) -> list[Top]:
    """Split nodes of more rows than a part may have, by histograms of quantile bins, until none is left."""
    most = max(1, min(PART_ROWS, PART_CELLS // (dims + 1)))
    seeds = s.seeds(np.arange(s.trees))
    tops = [Top.root(int(seed), rows <= most) for seed in seeds]
    if rows <= most:
        return tops
    probes = [i / BINS for i in range(1, BINS)]
    quantiles = table.agg(*[F.percentile_approx(F.col("x")[f], probes, 10_000).alias(f"q{f}") for f in range(dims)]).first()
    cuts = [np.unique(np.array(q, float)) for q in quantiles]
    wide = [np.concatenate([c, np.full(BINS - len(c), np.inf)]) for c in cuts]
    kinds = 2 + s.width + (not s.classes)
    at_once = max(1, HISTOGRAM_BYTES // (8 * kinds * dims * BINS))
    active = [(tree, 0) for tree in range(s.trees)]
    while active:
        following = []
        active.sort()
        for i in range(0, len(active), at_once):
            group = active[i:i + at_once]
            slots = {node: k for k, node in enumerate(group)}
            own = np.array([tops[t].seed[n] for t, n in group], np.uint64)
            schema = "slot int, feature int, bin int, " + ", ".join(f"s{k} double" for k in range(kinds))
            parts = table.mapInArrow(partial(_histograms, dims=dims, s=s, tops=tops, slots=slots, cuts=cuts), schema)
            summed = parts.groupBy("slot", "feature", "bin").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(kinds)])
            best = partial(_best, dims=dims, s=s, cuts=wide, seeds=own)
            for r in summed.groupBy("slot").applyInArrow(lambda t: best(t), _BEST).collect():  # noqa: B023  a row per node
                tree, node = group[r["slot"]]
                following += _grown(tops[tree], node, r, s, most, tree)
        active = following
    return tops


def _grown(top: Top, node: int, r, s: Settings, most: int, tree: int) -> list[tuple[int, int]]:
    """Split a node as found; its children that are still too large."""
    top.rows[node], top.value[node] = r["rows"], r["value"]
    depth = top.depth[node]
    stopped = r["feature"] < 0 or r["rows"] < s.min_samples_split or (s.max_depth is not None and depth >= s.max_depth)
    if stopped:
        return []
    top.feature[node], top.threshold[node], top.gain[node] = r["feature"], r["threshold"], r["gain"]
    sides = [(r["left_rows"], r["left_value"], False), (r["rows"] - r["left_rows"], r["right_value"], True)]
    seed = np.array([top.seed[node]], np.uint64)
    made = [top.add(depth + 1, n, int(_below(seed, right)[0]), value, n <= most) for n, value, right in sides]
    top.left[node] = made[0]
    return [(tree, i) for i in made if not top.part[i]]


def _to_parts(batches, dims: int, s: Settings, tops: list[Top], trees: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Each row under every tree that draws it, at the part it belongs to."""
    for batch in batches:
        x = _points(batch.column("x"), dims)
        for tree in trees:
            w = s.weights(tree, np.asarray(batch.column("no")))
            part = tops[tree].route(x)
            in_ = np.flatnonzero((w > 0) & np.array(tops[tree].part)[part])
            if len(in_):
                at = pa.array(in_)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(in_), tree, np.int32)), pa.array(part[in_].astype(np.int32)),
                    batch.column("x").take(at), batch.column("y").take(at), pa.array(w[in_])], ["tree", "part", "x", "y", "w"])


def _fit_parts(table: DataFrame, dims: int, s: Settings, tops: list[Top], single: bool) -> DataFrame:
    """The parts below the tops. Their rows are a copy of the table for most trees, so they are dealt for some trees at a time."""
    spark = table.sparkSession
    kind = "float" if single else "double"
    table = table.withColumn("x", F.col("x").cast(f"array<{kind}>"))
    work = partial(_grow_part, dims=dims, s=s, tops=tops)
    at_once = max(1, int(WAVE_TREES * spark.sparkContext.defaultParallelism))
    found = None
    for i in range(0, s.trees, at_once):
        route = partial(_to_parts, dims=dims, s=s, tops=tops, trees=range(i, min(s.trees, i + at_once)))
        routed = table.mapInArrow(route, f"tree int, part int, x array<{kind}>, y double, w double")
        with shuffles_dropped(spark):
            own = _store(routed.groupBy("tree", "part").applyInArrow(lambda t: work(t), _PARTS))  # noqa: B023
        found = own if found is None else found.unionByName(own)
    return found


def _grow_part(rows: pa.Table, dims: int, s: Settings, tops: list[Top]) -> pa.Table:
    tree, part = rows.column("tree")[0].as_py(), rows.column("part")[0].as_py()
    x = _points(rows.column("x").combine_chunks(), dims)
    depth, seed = tops[tree].depth[part], np.uint64(tops[tree].seed[part])
    nodes = grow(x, rows.column("y").to_numpy(), rows.column("w").to_numpy(), s, seed, depth)
    return pa.Table.from_batches([_part(tree, part, depth, nodes)])


def _store(df: DataFrame) -> DataFrame:
    path = f"{checkpoint_folder(df.sparkSession)}/forest-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fits_floats() -> F.Column:
    """Whether all features are the same as floats of half the size."""
    return F.bool_and(F.forall("x", lambda v: v == v.cast("float").cast("double")))


def fit_trees(points: DataFrame, dims: int, s: Settings) -> Forest:
    """Trees over `points` (x array<double> of `dims`, y double): see `Forest`."""
    spark = points.sparkSession
    table = points.select("x", "y")
    key = F.xxhash64("x", *(["y"] if s.classes else []))
    rows, mean, distinct, single = table.agg(
        F.count(F.lit(1)), F.avg("y"), F.approx_count_distinct(key),
        _fits_floats()).first()
    if not rows:
        raise ValueError("There are no rows to fit a tree on.")
    tops = None
    cells = rows * (dims + 1)
    whole = rows <= PART_ROWS and cells <= PART_CELLS * (2 if single and s.some(dims) else 1)
    if whole and 8 * rows * (dims + 2) <= BROADCAST_BYTES:
        local = table.toArrow()
        x = _points(local.column("x").combine_chunks(), dims)
        # numbers in the order of the rows' values, so that the draws do not depend on how the table is split
        y = local.column("y").to_numpy()
        order = np.lexsort((y, *x.T))
        held = spark.sparkContext.broadcast((x[order], y[order], np.arange(rows)))
        try:
            trees = spark.range(0, s.trees, 1, min(s.trees, max(8, 4 * spark.sparkContext.defaultParallelism))).select(F.col("id").cast("int").alias("tree"))
            parts = _store(trees.mapInArrow(partial(_grow_trees, held=held, s=s), _PARTS))
        finally:
            held.unpersist()
    else:
        if not s.classes:
            s = replace(s, shift=mean)
            table = table.withColumn("y", F.col("y") - mean)
        few = distinct <= DISTINCT and distinct * (dims + 1) <= PART_CELLS and rows >= SHARED_ROWS * distinct
        # a tree's draws are made in one pass there; elsewhere several passes must see the same numbers
        table = (table if few else _store(table)).withColumn("no", F.monotonically_increasing_id())
        if few:
            parts = _fit_groups(table, dims, s)
        elif whole:
            parts = _fit_bundles(table, dims, rows, s, single)
        else:
            tops = _grow_tops(table, dims, rows, s)
            parts = _fit_parts(table, dims, s, tops, single)
    return Forest(parts, tops, dims, s)


def _joined(parts: list, top: Top | None, width: int) -> Nodes:
    """One tree of a top and its parts."""
    own = {r["part"]: Nodes.unpacked(r, width) for r in parts}
    if top is None:
        return own[0]
    base = top.nodes()
    pieces, at = [], len(base.feature)
    feature, threshold, left, rows, gain, value = (np.array(getattr(base, n)) for n in ("feature", "threshold", "left", "rows", "gain", "value"))
    if value.shape[1] != width:
        value = np.zeros((len(feature), width))
    for part, nodes in own.items():
        # the part's root takes the place of the top's node, its other nodes follow
        move = lambda v, at=at: np.where(v > 0, v + at - 1, 0)
        nodes = replace(nodes, value=nodes.values(), gain=nodes.gain if len(nodes.gain) else np.zeros(len(nodes.feature)))
        feature[part], threshold[part], rows[part], gain[part], value[part] = (
            nodes.feature[0], nodes.threshold[0], nodes.rows[0], nodes.gain[0], nodes.value[0])
        left[part] = move(nodes.left[:1])[0]
        pieces.append(Nodes(nodes.feature[1:], nodes.threshold[1:], move(nodes.left[1:]), nodes.rows[1:], nodes.gain[1:], nodes.value[1:]))
        at += len(nodes.feature) - 1
    cat = lambda first, name: np.concatenate([first, *[getattr(p, name) for p in pieces]])
    return Nodes(cat(feature, "feature"), cat(threshold, "threshold"), cat(left, "left"), cat(rows, "rows"), cat(gain, "gain"), cat(value, "value"))


def _pruned(nodes: Nodes, prunings: Sequence[Pruning]) -> np.ndarray:
    """(nodes, prunings): where a row ends that reaches a node of the whole tree."""
    split = np.array([p.min_samples_split for p in prunings])
    deepest = np.array([np.inf if p.max_depth is None else p.max_depth for p in prunings])
    ends = np.repeat(np.arange(len(nodes.feature), dtype=np.int32)[:, None], len(prunings), axis=1)
    here, closed, depth = np.array([0]), np.zeros((1, len(prunings)), bool), 0
    while len(here):
        inner = nodes.feature[here] >= 0
        here, closed = here[inner], closed[inner]
        closed = closed | (nodes.rows[here][:, None] < split) | (depth >= deepest)
        own = ends[here]
        for below in (nodes.left[here], nodes.left[here] + 1):
            ends[below] = np.where(closed, own, below[:, None])
        here, closed, depth = np.concatenate([nodes.left[here], nodes.left[here] + 1]), np.concatenate([closed, closed]), depth + 1
    return ends


def _total(trees: dict[int, Nodes], x: np.ndarray, prunings: Sequence[Pruning], prefixes: Sequence[int], pruned: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """(rows, prefixes * prunings * width): sums of the values of the first trees, for each number of them.

    A row goes down a tree once; `pruned` has the trees' nodes under the prunings, if known.
    """
    width = next(iter(trees.values())).value.shape[1]
    out = np.zeros((len(x), len(prefixes), len(prunings), width))
    run, met = np.zeros((len(x), len(prunings), width)), set()
    for tree in sorted(trees):
        for i, many in enumerate(prefixes):
            if many <= tree and i not in met:
                met.add(i)
                out[:, i] = run
        nodes = trees[tree]
        leaf = stops(nodes, x, WHOLE)[0]
        run += nodes.values((pruned[tree] if pruned else _pruned(nodes, prunings))[leaf])
    for i in range(len(prefixes)):
        if i not in met:
            out[:, i] = run
    return out.reshape(len(x), -1)


def _route_rows(batches, dims: int, trees: int, tops: list[Top] | None, prunings) -> Iterator[pa.RecordBatch]:
    """Each row under every tree: its part, or the values of a top that ends before one."""
    for batch in batches:
        x = _points(batch.column("x"), dims)
        for tree in range(trees):
            part = tops[tree].route(x) if tops else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(np.full(len(x), tree, np.int32)), pa.array(part.astype(np.int32)), batch.column("x")],
                ["id", "tree", "part", "x"])


def _score_part(rows: pa.Table, parts: pa.Table, dims: int, s: Settings, tops: list[Top] | None, prunings, prefixes) -> pa.Table:
    """Values of rows that meet their part."""
    tree, part = rows.column("tree")[0].as_py(), rows.column("part")[0].as_py()
    x = _points(rows.column("x").combine_chunks(), dims)
    top = tops[tree].nodes() if tops else None
    if parts.num_rows:
        nodes = Nodes.unpacked(parts.slice(0, 1).to_pylist()[0], s.width)
        ends = stops(nodes, x, prunings, tops[tree].depth[part] if tops else 0)
        values = nodes.value[ends]
    else:
        values = np.broadcast_to(top.value[part], (len(prunings), len(x), s.width)).copy()
    if tops:  # a pruning may end above the part
        for i, p in enumerate(prunings):
            ends = stops(top, x, [p])[0]
            above = ends != part
            values[i, above] = top.value[ends[above]]
    use = np.array([tree < many for many in prefixes], float)
    out = (use[:, None, None, None] * values[None]).transpose(2, 0, 1, 3).reshape(len(x), -1)
    return pa.table({"id": rows.column("id"), "values": _lists(out)})


def _score_bundle(rows: pa.Table, parts: pa.Table, dims: int, s: Settings, tops: list[Top] | None, bundle_of, prunings, prefixes) -> pa.Table:
    """Sums over some trees of the values of rows."""
    if not rows.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "values": pa.array([], pa.list_(pa.float64()))})
    bundle, by = rows.column("bundle")[0].as_py(), {}
    for r in parts.to_pylist():
        by.setdefault(r["tree"], []).append(r)
    trees = {t: _joined(by.pop(t, []), tops[t] if tops else None, s.width) for t, b in enumerate(bundle_of) if b == bundle and (tops or t in by)}
    if tops:
        trees = {t: nodes.slim(True) for t, nodes in trees.items()}
    out, pruned = [], {t: _pruned(nodes, prunings) for t, nodes in trees.items()}
    for some in _chunks(rows.to_batches()):
        x = _points(_one(some.column("x")), dims)
        found = _total(trees, x, prunings, prefixes, pruned) if trees else np.zeros((len(x), len(prefixes) * len(prunings) * s.width))
        out.append(pa.table({"id": some.column("id"), "values": _lists(found)}))
    return pa.concat_tables(out)


def _added(points: DataFrame, scored: DataFrame, width: int) -> DataFrame:
    """`points` with the sums of their `values` in `scored`."""
    total = scored.groupBy("id").agg(*[F.sum(F.col("values")[k]).alias(f"v{k}") for k in range(width)])
    return points.join(total.select("id", F.array(*[f"v{k}" for k in range(width)]).alias("values")), "id")


@dataclass
class _Cells:
    """A model as a table: between neighbouring thresholds of every feature its values are the same."""

    cuts: list[np.ndarray]
    values: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for column, cuts in zip(x.T, self.cuts):
            at = at * (len(cuts) + 1) + np.where(np.isnan(column), 0, np.searchsorted(cuts, column))
        return self.values[at]


def _cell_values(trees: dict[int, Nodes], dims: int, prunings: Sequence[Pruning], prefixes: Sequence[int]) -> _Cells | None:
    """The table of a model, if it has at most CELLS values."""
    cuts = [np.unique(np.concatenate([n.threshold[n.feature == f] for n in trees.values()])) for f in range(dims)]
    cells = float(np.prod([len(c) + 1.0 for c in cuts]))
    if cells * len(prunings) * len(prefixes) * next(iter(trees.values())).value.shape[1] > CELLS:
        return None
    grid = np.meshgrid(*[np.append(c, np.inf) for c in cuts], indexing="ij")
    return _Cells(cuts, _total(trees, np.stack([g.ravel() for g in grid], axis=1), prunings, prefixes))


class Forest:
    """Grown trees: `parts`, a table with a row of packed nodes per tree and part, and the tops of large trees."""

    def __init__(self, parts: DataFrame, tops: list[Top] | None, dims: int, settings: Settings):
        self.parts, self.tops, self.dims, self.settings = parts, tops, dims, settings
        self._held = None
        self.bytes = parts.agg(F.coalesce(F.sum(self._size()), F.lit(0))).first()[0]

    @staticmethod
    def _size(names: Sequence[str] = tuple(_KINDS)) -> F.Column:
        size = F.lit(0)
        for name in names:
            size = size + F.octet_length(name)
        return size.cast("long")

    def trees(self) -> dict[int, Nodes]:
        """All nodes; for models below `MODEL_BYTES`."""
        if self._held is None:
            by: dict[int, list] = {}
            for r in self.parts.collect():
                by.setdefault(r["tree"], []).append(r)
            all_ = range(self.settings.trees) if self.tops else sorted(by)
            self._held = {t: _joined(by.get(t, []), self.tops[t] if self.tops else None, self.settings.width) for t in all_}
        return self._held

    def values(self, points: DataFrame, prunings: Sequence[Pruning] = WHOLE, prefixes: Sequence[int] | None = None) -> DataFrame:
        """`points` (id, x, ...) with `values`: per prefix and pruning the sum of the trees' values.

        A model small by measure is sent to the tasks, as a table of its values
        where its thresholds leave few cells. Of a larger one, tasks hold some
        whole trees each and get all rows once, in pieces; if not even a tree is
        small, rows meet the parts they end in, those of a part with many rows in
        several tasks.
        """
        prefixes = list(prefixes or [self.settings.trees])
        if self.bytes <= MODEL_BYTES:
            trees, dims = self.trees(), self.dims
            table = _cell_values(trees, dims, prunings, prefixes)
            held = points.sparkSession.sparkContext.broadcast(trees if table is None else table)
            pruned = {}  # of a task

            @F.arrow_udf("array<double>")
            def score(x: pa.Array) -> pa.Array:
                if table is None:
                    if not pruned:
                        pruned.update({t: _pruned(nodes, prunings) for t, nodes in held.value.items()})
                    return _lists(_total(held.value, _points(x, dims), prunings, prefixes, pruned))
                return _lists(held.value(_points(x, dims)))

            return points.withColumn("values", score("x"))
        sizes = dict(self.parts.groupBy("tree").agg(F.sum(self._size())).collect())
        if max(sizes.values()) <= MODEL_BYTES:
            return self._bundled(points, prunings, prefixes)
        return self._met(points, prunings, prefixes)

    def _bundled(self, points: DataFrame, prunings, prefixes) -> DataFrame:
        points, s, spark = _store(points), self.settings, points.sparkSession
        inner = any(p != Pruning() for p in prunings)
        slim = _store(self.parts.mapInArrow(partial(_slimmed, width=s.width, inner=inner or bool(self.tops)), _SLIM))
        sizes = dict(slim.groupBy("tree").agg(F.sum(self._size(_SLIM_KINDS))).collect())
        limit = min(MODEL_BYTES, sum(sizes.values()) / spark.sparkContext.defaultParallelism)
        bundle_of, bundle, held = [], 0, 0
        for tree in range(s.trees):
            if held and held + sizes.get(tree, 0) > limit:
                bundle, held = bundle + 1, 0
            bundle_of.append(bundle)
            held += sizes.get(tree, 0)
        many, single = points.agg(F.count(F.lit(1)), F.coalesce(_fits_floats(), F.lit(True))).first()
        kind = "float" if single else "double"
        pieces = -(-many // max(1, min(PART_ROWS, PART_CELLS * (2 if single else 1) // (self.dims + 1))))
        keys = ["bundle", "piece"]
        piece = F.pmod(F.xxhash64("id"), F.lit(max(1, pieces))).cast("int").alias("piece")
        rows = points.select("id", F.col("x").cast(f"array<{kind}>").alias("x"), piece).mapInArrow(
            partial(_deal, bundles=bundle + 1), f"bundle int, id long, x array<{kind}>, piece int")
        own = spark.createDataFrame(list(enumerate(bundle_of)), "tree int, bundle int")
        parts = slim.join(F.broadcast(own), "tree").withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(max(1, pieces) - 1))))
        work = partial(_score_bundle, dims=self.dims, s=s, tops=self.tops, bundle_of=bundle_of, prunings=prunings, prefixes=prefixes)
        scored = rows.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(lambda a, b: work(a, b), "id long, values array<double>")
        return _added(points, scored, len(prefixes) * len(prunings) * s.width)

    def _met(self, points: DataFrame, prunings, prefixes) -> DataFrame:
        points, s = _store(points), self.settings
        routed = _store(points.select("id", "x").mapInArrow(
            partial(_route_rows, dims=self.dims, trees=s.trees, tops=self.tops, prunings=prunings), "id long, tree int, part int, x array<double>"))
        counts = _store(routed.groupBy("tree", "part").agg(F.ceil(F.count(F.lit(1)) / ROUTED_ROWS).cast("int").alias("pieces")))
        rows = routed.join(counts, ["tree", "part"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
        copies = counts.select(F.col("tree").alias("tree"), F.col("part").alias("part"), F.sequence(F.lit(0), F.col("pieces") - 1).alias("copies"))
        parts = self.parts.join(copies, ["tree", "part"]).withColumn("piece", F.explode("copies")).drop("copies")
        keys = ["tree", "part", "piece"]
        work = partial(_score_part, dims=self.dims, s=s, tops=self.tops, prunings=prunings, prefixes=prefixes)
        scored = rows.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(
            lambda a, b: work(a, b) if a.num_rows else pa.table({"id": pa.array([], pa.int64()), "values": pa.array([], pa.list_(pa.float64()))}),
            "id long, values array<double>")
        return _added(points, scored, len(prefixes) * len(prunings) * s.width)

    def importances(self) -> np.ndarray:
        """Each feature's share of the gains, averaged over trees; sums to 1 where a tree splits."""
        def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    feature, gain = np.frombuffer(r["feature"], "i4"), np.frombuffer(r["gain"], "f8")
                    total = np.bincount(feature[feature >= 0], gain[feature >= 0], minlength=dims)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(dims, r["tree"], np.int32)), pa.array(np.arange(dims, dtype=np.int32)), pa.array(total.astype(float))], ["tree", "place", "gain"])

        dims = self.dims
        rows = self.parts.select("tree", "feature", "gain").mapInArrow(gains, "tree int, place int, gain double")
        table = np.zeros((self.settings.trees, dims))
        for r in rows.groupBy("tree", "place").agg(F.sum("gain").alias("gain")).collect():
            table[r["tree"], r["place"]] = r["gain"]
        for tree, top in enumerate(self.tops or []):
            for f, g in zip(top.feature, top.gain):
                table[tree, f] += g if f >= 0 else 0.0
        sums = table.sum(axis=1, keepdims=True)
        share = np.divide(table, sums, out=np.zeros_like(table), where=sums > 0).mean(axis=0)
        return share / share.sum() if share.sum() else share


# --- stages of a pipeline ---------------------------------------------------


def _row(features: Sequence[str] | None) -> F.Column:
    """The features as an array of doubles; from the columns themselves, if named, which is much cheaper than from a vector."""
    if not features:
        return vector_to_array("_features")
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


class ForestEstimator(Estimator):
    """Fits trees on `_features`, or the columns it was made of, and a numeric label."""

    def __init__(self, settings: Settings, label: str, prediction: str = "prediction", features: Sequence[str] | None = None):
        super().__init__()
        self.settings, self.label, self.prediction, self.features = settings, label, prediction, features

    def _fit(self, dataset: DataFrame) -> ForestModel:
        points = dataset.select(_row(self.features).alias("x"), F.col(self.label).cast("double").alias("y"))
        dims = len(points.first()["x"]) if not points.isEmpty() else 0
        return ForestModel(fit_trees(points, dims, self.settings), self.prediction, self.features)


class ForestModel(Transformer, MLWritable, MLReadable):
    """Adds the mean of the trees' values, or the class of the largest mean share."""

    def __init__(self, forest: Forest | None = None, prediction: str = "prediction", features: Sequence[str] | None = None):
        super().__init__()
        self.forest, self.prediction, self.features = forest, prediction, features

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  the name of the library's own models
        return DenseVector(self.forest.importances())

    def answer(self, values: str = "values") -> F.Column:
        s = self.forest.settings
        if not s.classes:
            return F.col(values)[0] / s.trees
        return (F.array_position(values, F.array_max(values)) - 1).cast("double")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = dataset.withColumn("x", _row(self.features)) if "x" not in dataset.columns else None
        if own is not None and "values" not in dataset.columns and self.forest.bytes <= MODEL_BYTES:
            return self.forest.values(own).withColumn(self.prediction, self.answer()).drop("x", "values")
        row = F.struct(*dataset.columns)
        packed = dataset.select(F.monotonically_increasing_id().alias("id"), row.alias("row"), _row(self.features).alias("x"))
        return self.forest.values(packed).select("row.*", self.answer().alias(self.prediction))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        forest = self.model.forest
        state = {"settings": asdict(forest.settings), "dims": forest.dims, "prediction": self.model.prediction, "features": self.model.features,
                 "tops": [asdict(t) for t in forest.tops] if forest.tops else None}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"forest": json.dumps(state)})
        forest.parts.write.parquet(f"{path}/parts")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark = SparkSession.active()
        state = json.loads(DefaultParamsReader.loadMetadata(path, spark)["forest"])
        tops = [Top(**t) for t in state["tops"]] if state["tops"] else None
        forest = Forest(spark.read.schema(_PARTS).parquet(f"{path}/parts"), tops, state["dims"], Settings(**state["settings"]))
        return ForestModel(forest, state["prediction"], state.get("features"))
