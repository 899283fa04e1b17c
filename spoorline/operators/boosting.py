"""Boosted trees that grow leaf by leaf, from histograms of gradients that Spark sums.

Features become at most ``bins`` quantile bins, 0 for missing. A pass over the rows sums gradients and curvatures (and rows,
where their least number says more than the least weight) per model, node, feature and bin; the smaller child of a split is
summed and the larger one is its parent less that. A node's best split depends on its own rows only, so all nodes of a depth
are summed in one pass, and which of the splits a tree of ``leaves`` leaves takes, best gain first, is chosen afterwards: the
tree is the one that leaf-wise growth makes. All models over the same rows, such as the folds of several actions, share every
pass. Rows lie in blocks by column, persisted with each model's scores; a tree adds itself to the scores once.
"""

from __future__ import annotations

import gc
import heapq
import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import Stages

#: Trees after which scores are written; least and most rows of a task; most rows, and scores, of a block; partial sums, and
#: numbers in them, that the driver takes at a time; numbers in one sum.
WRITE_EVERY, TASK_ROWS, TASK_MOST, BLOCK_ROWS, BLOCK_SCORES, PARTIALS, GATHERED, CELLS = 8, 75_000, 1_000_000, 100_000, 1 << 20, 64, 1 << 25, 1 << 24


@dataclass(frozen=True)
class Settings:
    """Sizes and penalties, by default those of the surveyed program."""

    trees: int = 250
    leaves: int = 31
    depth: int = 6
    rate: float = 0.08
    least_weight: float = 10.0
    least_rows: int = 20
    l1: float = 0.1
    l2: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 64
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number; a node with feature -1 is a leaf. Left takes bins up to ``bin``, and missing values if ``missing``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, missing: bool) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.bin[node], self.missing[node], self.left[node], self.right[node] = feature, at, missing, n, n + 1
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.missing, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [empty, empty]
        return n, n + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        return self.leaves(x.T)

    def leaves(self, columns: np.ndarray) -> np.ndarray:
        """The leaf of each row, from bins by column: each node reads its own column of its own rows, and no other."""
        out = np.zeros(columns.shape[1], np.int64)
        for node, rows in self.parted(columns):
            out[slice(None) if rows is None else rows] = node
        return out

    def parted(self, columns: np.ndarray, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray | None]]:
        """Each leaf with those of the rows (None: all) that come to it."""
        waiting = [(0, rows)]
        while waiting:
            node, rows = waiting.pop()
            if self.feature[node] < 0:
                yield node, rows
                continue
            b = columns[self.feature[node]] if rows is None else columns[self.feature[node]].take(rows)
            # A missing value's 0 less 1 is the largest bin.
            left = b <= self.bin[node] if self.missing[node] else b - np.uint8(1) < self.bin[node]
            for child, on in ((self.left[node], left), (self.right[node], ~left)):
                waiting.append((child, np.flatnonzero(on) if rows is None else rows[on]))


@dataclass
class Ensemble:
    """One model: features with their cuts, the score to start from, and trees whose leaves hold what they add."""

    features: list[str]
    cuts: list[list[float]]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, columns = np.full(len(x), self.start), np.ascontiguousarray(x.T)
        for tree in self.trees:
            out += np.array(tree.value)[tree.leaves(columns)]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Ensemble:
        own = json.loads(spark.read.parquet(path).first().model)
        return cls(own["features"], own["cuts"], own["start"], [Tree(**t) for t in own["trees"]])


def binned(values: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bins from 1, a value on a cut in the lower one; 0 where missing."""
    out = np.zeros(values.shape, np.uint8)
    for f, own in enumerate(cuts):
        known = ~np.isnan(values[:, f])
        out[known, f] = 1 + np.searchsorted(own, values[known, f])
    return out


def quantile_cuts(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Sketched quantiles of each feature, in one aggregation; at most ``bins`` - 2 cuts, none at the largest value."""
    if not features:
        return []
    shares = F.array(*[F.lit(i / (bins - 1)) for i in range(1, bins - 1)])
    columns = [F.struct(F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, F.lit(10_000)).alias("q"), F.max(F.col(f"`{f}`").cast("double")).alias("hi")).alias(f"_c{i}") for i, f in enumerate(features)]
    row = df.select(*[F.col(f"`{f}`") for f in features]).agg(*columns).first()
    return [sorted({float(v) for v in (c.q or []) if v < c.hi}) for c in row]


def _matrix(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]) if features else np.zeros((batch.num_rows, 0))


def _packed(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if width == 0 or not len(column):
        return np.zeros((len(column), width), kind)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width)


def _binary(matrix: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(matrix)
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def in_bag(row: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Whether a tree takes a row, by the row's number alone."""
    h = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree) % (1 << 63))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53) < share


@dataclass
class _Block:
    """Rows of a task by column: bins (features, rows), labels (labels, rows), scores (models, rows)."""

    row: np.ndarray
    fold: np.ndarray
    x: np.ndarray
    y: np.ndarray
    score: np.ndarray


def _blocks(batches: Iterator[tuple], width: int, labels: int, models: list[tuple[int, int]]) -> Iterator[_Block]:
    """Blocks of packed rows."""
    for packed in batches:
        row, fold = np.frombuffer(packed[0], np.int64), np.frombuffer(packed[1], np.int32)
        x, y = np.frombuffer(packed[2], np.uint8).reshape(-1, width) if width else np.zeros((len(row), 0), np.uint8), np.frombuffer(packed[3]).reshape(-1, labels)
        yield _Block(row, fold, np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), np.zeros((len(models), len(row))))


def _in_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One row of binaries for ``most`` packed rows, or some fewer."""
    waiting, n = [], 0

    def joined() -> pa.RecordBatch:
        values = [b"".join(bytes(v) for v in parts) for parts in zip(*waiting, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["row", "fold", "x", "y"])

    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            if n and n + part.num_rows > most:
                yield joined()
                waiting, n = [], 0
            ids = [part.column(c).to_numpy(zero_copy_only=False).astype(kind).tobytes() for c, kind in (("row", np.int64), ("fold", np.int32))]
            waiting.append([*ids, *[_packed(part.column(c), np.uint8, len(part.column(c)[0].as_py())).tobytes() for c in ("x", "y")]])
            n += part.num_rows
    if n:
        yield joined()


def _settled() -> None:
    """What a Python worker imported leaves its garbage collector, which would walk all of it after each of a fit's short tasks."""
    if not gc.get_freeze_count():
        gc.collect()
        gc.freeze()


@dataclass
class _Added:
    """Trees, one a model, that are added to the scores of blocks."""

    trees: list[Tree]

    def to(self, blocks: Iterator[_Block]) -> Iterator[_Block]:
        _settled()
        for block in blocks:
            score = block.score.copy()
            for m, tree in enumerate(self.trees):
                for node, rows in tree.parted(block.x):
                    score[m, slice(None) if rows is None else rows] += tree.value[node]
            yield _Block(block.row, block.fold, block.x, block.y, score)


@dataclass
class _Pass:
    """What a task needs: models as (label place, left-out fold), the growing trees, and which slot of the sums each of their
    nodes has."""

    models: list[tuple[int, int]]
    growing: list[Tree]
    slots: list[dict[int, int]]
    columns: np.ndarray
    tree: int
    settings: Settings

    def shapes(self) -> list[tuple[int, ...]]:
        return [(len(own), len(self.columns), self.settings.bins) for own in self.slots]

    def sums(self, blocks: Iterator[_Block]) -> Iterator[np.ndarray]:
        """Of all blocks: gradients and curvatures as complex numbers, then rows where they count; model after model."""
        _settled()
        s, sizes = self.settings, [int(np.prod(shape)) for shape in self.shapes()]
        total, counts = np.zeros(sum(sizes), complex), np.zeros(sum(sizes) if _counted(s) else 0)
        for block in blocks:
            bag = in_bag(block.row, self.tree, s.rows, s.seed)
            at = 0
            for m, (label, left_out) in enumerate(self.models):
                if self.slots[m]:
                    self._add(block, m, np.flatnonzero((block.fold != left_out) & ~np.isnan(block.y[label]) & bag), total[at : at + sizes[m]], counts[at : at + sizes[m]])
                at += sizes[m]
        yield np.concatenate([total.view(float), counts])

    def _add(self, block: _Block, m: int, on: np.ndarray, total: np.ndarray, counts: np.ndarray) -> None:
        slots, bins = self.slots[m], self.settings.bins
        found = [(slots[node], rows) for node, rows in self.growing[m].parted(block.x, on) if node in slots]
        rows = np.concatenate([own for _, own in found])
        first = np.repeat([slot * len(self.columns) * bins for slot, _ in found], [len(own) for _, own in found])
        p = 1 / (1 + np.exp(-block.score[m].take(rows)))
        weights = np.empty(len(rows), complex)
        weights.real, weights.imag = p - block.y[self.models[m][0]].take(rows), p * (1 - p)
        for c, f in enumerate(self.columns):
            code = block.x[f].take(rows) + first
            np.add.at(total[c * bins :], code, weights)
            if len(counts):
                np.add.at(counts[c * bins :], code, 1.0)


def _counted(s: Settings) -> bool:
    """Whether rows must be counted: a row's curvature is at most 1/4, so a least weight can say as much."""
    return s.least_weight < s.least_rows / 4


def _gathered(blocks: RDD, one: _Pass) -> list[np.ndarray]:
    """The sums of all tasks: (gradients and curvatures, or these and rows; slots, columns, bins) per model."""
    shapes, partial = one.shapes(), blocks.mapPartitions(one.sums)
    n, parts = sum(int(np.prod(shape)) for shape in shapes), blocks.getNumPartitions()
    if parts > PARTIALS or parts * 3 * n > GATHERED:
        total = partial.treeReduce(np.add)
    else:
        total, *rest = partial.collect()
        for own in rest:
            total += own
    planes, out, at = [total[0 : 2 * n : 2], total[1 : 2 * n : 2], *([total[2 * n :]] if _counted(one.settings) else [])], [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(np.stack([own[at : at + size] for own in planes]).reshape(len(planes), *shape))
        at += size
    return out


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def best_splits(hist: np.ndarray, s: Settings) -> list[tuple[float, int, int, bool] | None]:
    """(gain, column, bin, missing goes left) of nodes' sums (kinds, nodes, columns, bins); None without a gain.

    Of gains that differ by rounding only, the first counts: by column, missing values to the right first, then bin."""
    if not hist.shape[1] or not hist.shape[2]:
        return [None] * hist.shape[1]
    whole = hist[:, :, :1].sum(axis=3)[..., None, None]
    known = np.cumsum(hist[..., 1:], axis=3)[..., None, :-1]
    left = np.concatenate([known, known + hist[..., None, :1]], axis=3)
    right = whole - left
    ok = (left[1] >= s.least_weight) & (right[1] >= s.least_weight)
    if len(hist) > 2:
        ok &= (left[2] >= s.least_rows) & (right[2] >= s.least_rows)

    def gain_of(sums: np.ndarray) -> np.ndarray:
        g = _shrunk(sums[0], s.l1)
        return g * g / (sums[1] + s.l2)

    with np.errstate(invalid="ignore", divide="ignore"):
        gain = np.where(ok, gain_of(left) + gain_of(right) - gain_of(whole), -np.inf).reshape(hist.shape[1], -1)
    out, shape = [], (hist.shape[2], 2, hist.shape[3] - 2)
    for own in gain:
        top = float(own.max(initial=-np.inf))
        if not top > 1e-10:
            out.append(None)
            continue
        c, missing, b = np.unravel_index(int(np.argmax(own >= top - 1e-9 * max(1.0, top))), shape)
        out.append((top, int(c), int(b) + 1, bool(missing)))
    return out


def _leafwise(tree: Tree, found: dict[int, tuple], sums: dict[int, np.ndarray], s: Settings) -> Tree:
    """The tree of the splits of most gain that ``leaves`` allows, with its leaves' values."""
    out, names = Tree(), {0: 0}
    heap = [(-found[0][0], 0)] if 0 in found else []
    leaves = 1
    while heap and leaves < s.leaves:
        _, node = heapq.heappop(heap)
        children = out.split(names[node], tree.feature[node], tree.bin[node], tree.missing[node])
        leaves += 1
        for old, new in zip((tree.left[node], tree.right[node]), children, strict=True):
            names[old] = new
            if old in found:
                heapq.heappush(heap, (-found[old][0], old))
    for old, new in names.items():
        g, h = sums[old][:2]
        out.value[new] = float(-_shrunk(g, s.l1) / (h + s.l2) * s.rate) if h + s.l2 > 0 else 0.0
    return out


def grown(sums_of: Callable, s: Settings, columns: np.ndarray, models: int) -> list[Tree]:
    """One tree for each model; ``sums_of`` (trees, slots) gives the sums of the nodes that have slots."""
    trees, found, sums = [Tree() for _ in range(models)], [{} for _ in range(models)], [{} for _ in range(models)]
    hist = [{0: h[:, 0]} for h in sums_of(trees, [{0: 0} for _ in range(models)])]
    with ThreadPoolExecutor(8) as pool:
        for depth in range(s.depth):
            waiting = [[] for _ in range(models)]
            every = pool.map(lambda own: best_splits(np.stack(list(own.values()), axis=1), s) if own else [], hist)
            for m, best in enumerate(every):
                for (node, own), split in zip(hist[m].items(), best, strict=True):
                    sums[m][node] = own[:, 0].sum(axis=1)
                    if split is None:
                        continue
                    _, c, b, missing = split
                    left, right = trees[m].split(node, int(columns[c]), b, missing)
                    part = own[:, c, 1 : b + 1].sum(axis=1) + own[:, c, 0] * missing
                    sums[m][left], sums[m][right] = part, sums[m][node] - part
                    found[m][node] = split
                    small, large = (left, right) if part[-1] <= sums[m][right][-1] else (right, left)
                    # Children too light for two more have no split and need no sums.
                    if max(sums[m][small][1], sums[m][large][1]) >= 2 * s.least_weight - 1e-6:
                        waiting[m].append((node, small, large))
            if depth == s.depth - 1 or not any(waiting):
                break
            built = sums_of(trees, [{small: i for i, (_, small, _) in enumerate(own)} for own in waiting])
            hist = [{small: built[m][:, i] for i, (_, small, _) in enumerate(own)} | {large: hist[m][node] - built[m][:, i] for i, (node, _, large) in enumerate(own)} for m, own in enumerate(waiting)]
    return [_leafwise(tree, f, own, s) for tree, f, own in zip(trees, found, sums, strict=True)]


def fit(df: DataFrame, features: list[str], labels: list[str], fold: str | None = None, folds: int = 0, **settings) -> dict[tuple[str, int], Ensemble]:
    """(label, left-out fold) -> model; without ``fold`` one model a label over all rows, under fold -1.

    Labels are 0, 1 or NULL (no part). What reaches the driver is a pass's sums: numbers by models, nodes, features and
    bins, whatever the rows. Models over more than ``CELLS`` numbers are fitted group by group.
    """
    s, spark = Settings(**settings), df.sparkSession
    cuts = quantile_cuts(df, features, s.bins)
    every = [(label, k) for label in labels for k in (range(folds) if fold else [-1])]
    together = max(1, CELLS // max(1, len(features) * s.bins * 3 * 2 ** max(0, s.depth - 2)))
    if len(every) > together:
        out: dict = {}
        for i in range(0, len(labels), max(1, together // max(1, folds))):
            out |= _fitted(df, features, labels[i : i + max(1, together // max(1, folds))], fold, folds, s, cuts, spark)
        return out
    return _fitted(df, features, labels, fold, folds, s, cuts, spark)


def _fitted(df: DataFrame, features: list[str], labels: list[str], fold: str | None, folds: int, s: Settings, cuts: list[list[float]], spark: SparkSession) -> dict[tuple[str, int], Ensemble]:
    every = [(label, k) for label in labels for k in (range(folds) if fold else [-1])]
    stages, given = Stages(spark), F.col(fold).cast("int") if fold else F.lit(-2)
    names = [f"_f{i}" for i in range(len(features))]
    rows = df.select(F.monotonically_increasing_id().alias("row"), given.alias("fold"), F.array(*[F.col(f"`{c}`").cast("double") for c in labels]).alias("y"), *[F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(features, names, strict=True)])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.array([[np.nan if v is None else v for v in own] for own in batch.column("y").to_pylist()], float).reshape(batch.num_rows, len(labels))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("fold"), _binary(binned(_matrix(batch, names), cuts)), _binary(y)], names=["row", "fold", "x", "y"])

    table = stages.write(rows.mapInArrow(packed, "row long, fold int, x binary, y binary"))
    n, cores = table.count(), spark.sparkContext.defaultParallelism
    parts = max(1, min(-(-n // TASK_ROWS), max(cores, -(-n // TASK_MOST))))
    most = max(1, min(BLOCK_ROWS, BLOCK_SCORES // len(every)))
    # All tasks get as many rows; by a hash, since like values side by side are slower to sum.
    dealt = table.repartition(parts).sortWithinPartitions(F.xxhash64("row", F.lit(1)), "row").mapInArrow(lambda batches: _in_blocks(batches, most), "row binary, fold binary, x binary, y binary")
    places, width, n_labels = [(labels.index(label), k) for label, k in every], len(features), len(labels)
    state = stages.keep(dealt.rdd.mapPartitions(lambda own: _blocks(own, width, n_labels, places)))
    shares = []
    for known, ones in zip(*_counts(state, places), strict=True):
        shares.append(min(max(ones / known, 1e-15), 1 - 1e-15) if known else 0.5)
    models = [Ensemble(list(features), cuts, float(np.log(p / (1 - p)))) for p in shares]
    rng, trees = np.random.default_rng(s.seed), [Tree(value=[m.start]) for m in models]
    for t in range(s.trees if features else 0):
        columns = np.sort(rng.choice(len(features), max(1, round(s.columns * len(features))), replace=False))
        before, state = state, stages.keep(state.mapPartitions(_Added(trees).to), write=t % WRITE_EVERY == WRITE_EVERY - 1)

        def sums_of(trees: list[Tree], slots: list[dict[int, int]], now=state, columns=columns, t=t) -> list[np.ndarray]:
            return _gathered(now, _Pass(places, trees, slots, columns, t, s))

        trees = grown(sums_of, s, columns, len(every))
        stages.let_go(before)
        for model, tree in zip(models, trees, strict=True):
            model.trees.append(tree)
    stages.let_go(state)
    stages.close()
    return dict(zip(every, models, strict=True))


def _counts(blocks: RDD, models: list[tuple[int, int]]) -> np.ndarray:
    """(known rows, ones) of each model."""

    def counted(own: Iterator[_Block]) -> Iterator[np.ndarray]:
        total = np.zeros((2, len(models)))
        for block in own:
            for m, (label, left_out) in enumerate(models):
                y = block.y[label][(block.fold != left_out) & ~np.isnan(block.y[label])]
                total[:, m] += len(y), y.sum()
        yield total

    return sum(blocks.mapPartitions(counted).collect())


def scores(df: DataFrame, models: dict[str, list[Ensemble]], fold: str | None = None) -> DataFrame:
    """``df`` with a column for each name: the mean probability of its models, or with ``fold`` that of the row's fold's one.

    All models are sent once and scored in one pass over the rows.
    """
    used = sorted({f for own in models.values() for m in own for f in m.features})
    sent = df.sparkSession.sparkContext.broadcast(models)
    inner = {f: f"_b{i}" for i, f in enumerate(used)}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = dict(zip(used, _matrix(batch, list(inner.values())).T, strict=True))
            own_fold = batch.column(fold).to_numpy(zero_copy_only=False) if fold else None
            bins: dict = {}
            made = []
            for own in sent.value.values():
                total = np.zeros(batch.num_rows) if fold is None else np.full(batch.num_rows, np.nan)
                for k, m in enumerate(own):
                    key = json.dumps([m.features, m.cuts])
                    if key not in bins:
                        bins[key] = binned(np.column_stack([values[f] for f in m.features]) if m.features else np.zeros((batch.num_rows, 0)), m.cuts)
                    if fold is None:
                        total += 1 / (1 + np.exp(-m.raw(bins[key]))) / len(own)
                    else:
                        on = np.flatnonzero(own_fold == k)
                        total[on] = 1 / (1 + np.exp(-m.raw(bins[key][on])))
                made.append(pa.array(total, from_pandas=True))
            keep = [c for c in batch.schema.names if c not in set(inner.values())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, *sent.value])

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in models]])
    return df.withColumns({n: F.col(f"`{f}`").cast("double") for f, n in inner.items()}).mapInArrow(scored, schema)
