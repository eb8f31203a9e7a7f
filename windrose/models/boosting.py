"""Histogram boosting on Spark: second-order logistic trees and quantile trees, any number of fits in step.

Cases are packed once: inputs become bins between quantile cut points (missing has a bin of its own), a block of cases one row of
byte arrays, written to shared storage.  A level of all trees is one job: tasks route their blocks through the trees so far and emit
sums of gradients, curvatures and cases per (fit, node, input, bin), which one map-side combined aggregation adds up.  Split points are
chosen from these histograms; their size follows from parameters (fits, nodes, inputs, bins), never from the data.  Sums are
integers, so order, retries and cluster size do not change a tree.  Of two children only the smaller is summed: the other is the rest of
their parent.  Rows that no fit uses are not packed; labels and uses that fits share are packed once.

Fits in step share every job: the folds of a cross-fit, seeds, feature groups and quantile levels cost no more jobs than one fit.

* logistic: leaf values are Newton steps; a fit may start from a margin per case (``offset``) and adds log-odds to it.
* quantile: trees follow the sign of the residual; a leaf's value is the exact quantile of its residuals (32-bit floats), found by two
  counting passes over their leading and trailing 16 bits.  The counts are ranked on Spark; the driver gets one row a leaf.
* a missing input takes the side, chosen per split, that lowers the loss more.
* a fit stops ``patience`` rounds after its best loss on the stopping rows and keeps the rounds up to the best one, possibly none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from windrose.session import scratch_path, ship_code

FIXED = float(1 << 24)       # gradients and losses are summed as multiples of 1 / FIXED
MISSING = 255                # bin of a missing input; the others are 0 .. bins - 1
SNAPSHOT = 4                 # rounds after which the blocks are written with their margins: every level walks the trees since then
TASK_CASES = 50_000          # cases of a task
BLOCK_CASES = 1 << 14        # at most, of a block: two sums of a block then fit the 53 bits of one double
PARAMS = {"rounds": 2000, "rate": 0.03, "depth": 3, "min_curvature": 200.0, "min_cases": 1, "subsample": 0.8, "columns": 0.5, "shrink": 10.0,
          "patience": 100, "bins": 64, "seed": 20260928}


@dataclass(frozen=True)
class Fit:
    """One model.  ``fit_rows`` and ``stop_rows`` are SQL conditions; ``level`` None is logistic, else a quantile level."""

    features: tuple[str, ...]
    label: str
    fit_rows: str = "split = 'train'"
    stop_rows: str = "split = 'validation'"
    level: float | None = None
    offset: str | None = None
    seed: int = PARAMS["seed"]


@dataclass
class Trees:
    """A fitted ensemble.  Node 1 is a tree's root, the children of node i are 2 i and 2 i + 1."""

    features: list[str]
    cuts: list[np.ndarray]            # of each feature
    feature: np.ndarray               # (trees, nodes) tested input, -1 in a leaf
    cut: np.ndarray                   # the left side is bin <= cut
    missing_left: np.ndarray
    value: np.ndarray                 # of a leaf
    cover: np.ndarray                 # fitted cases in a node
    gain: np.ndarray
    start: float = 0.0
    offset: str | None = None
    losses: list[float] = field(default_factory=list)     # on the stopping rows, by number of trees; empty without such rows

    @property
    def rounds(self) -> int:
        return len(self.feature)

    def bins(self, x: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([binned(np.asarray(v, float), c) for v, c in zip(x, self.cuts)]) if len(self.features) else np.zeros((0, 0), np.uint8)

    def margin(self, bins: np.ndarray, offset: np.ndarray | None = None, trees: int | None = None) -> np.ndarray:
        out = np.full(bins.shape[1], self.start) if offset is None else offset.astype(float)
        for t in range(self.rounds if trees is None else trees):
            out = out + self.value[t][leaf_of(bins, self.feature[t], self.cut[t], self.missing_left[t])]
        return out

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the margin (log-odds or quantile) of each row in one Arrow pass; the ensemble is broadcast."""
        ship_code(df.sparkSession)
        held, names, offset = df.sparkSession.sparkContext.broadcast(self), self.features, self.offset

        @pandas_udf("double")
        def margins(batch):
            m = held.value
            return _series(m.margin(m.bins([batch[f"x{i}"] for i in range(len(names))]), None if offset is None else batch["offset"].to_numpy(float)))

        cols = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(names)]
        cols.append(F.col(offset).cast("double").alias("offset") if offset else F.lit(0.0).alias("offset"))
        return df.withColumn(out, margins(F.struct(*cols)))

    def importance(self) -> dict[str, float]:
        """Share of the total gain of each input that any tree tests, largest first."""
        total = {f: float(self.gain[self.feature == i].sum()) for i, f in enumerate(self.features)}
        whole = sum(total.values()) or 1.0
        return {f: g / whole for f, g in sorted(total.items(), key=lambda x: (-x[1], x[0])) if g > 0}

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per node (tree, node, feature, cut, missing_left, value, cover, gain); tree -1 carries start and losses."""
        rows = [(-1, i, -1, 0, False, float(x), 0.0, 0.0) for i, x in enumerate([self.start, *self.losses])]
        for t in range(self.rounds):
            rows += [(t, i, int(self.feature[t, i]), int(self.cut[t, i]), bool(self.missing_left[t, i]), float(self.value[t, i]),
                      float(self.cover[t, i]), float(self.gain[t, i])) for i in range(1, self.feature.shape[1])]
        return spark.createDataFrame(rows, "tree int, node int, feature int, cut int, missing_left boolean, value double, cover double, gain double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(i, f, self.cuts[i].tolist(), self.offset) for i, f in enumerate(self.features)],
                              "at int, feature string, cuts array<double>, offset string").write.mode("overwrite").parquet(f"{path}/inputs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Trees":
        inputs = spark.read.parquet(f"{path}/inputs").orderBy("at").collect()            # one row per input
        rows = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()    # the ensemble itself
        head, rows = rows[rows.tree < 0], rows[rows.tree >= 0]
        trees = int(rows.tree.max()) + 1 if len(rows) else 0
        width = int(rows.node.max()) + 1 if trees else 2
        grids = []
        for c in ("feature", "cut", "missing_left", "value", "cover", "gain"):
            g = np.full((trees, width), -1 if c == "feature" else 0, rows[c].dtype if trees else float)
            g[rows.tree.to_numpy(), rows.node.to_numpy()] = rows[c].to_numpy()
            grids.append(g)
        return cls([r.feature for r in inputs], [np.array(r.cuts) for r in inputs], *grids, float(head.value.iloc[0]), inputs[0].offset, head.value.iloc[1:].tolist())


def _series(x: np.ndarray):
    import pandas as pd

    return pd.Series(x)


def binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin b holds cuts[b - 1] < x <= cuts[b]."""
    b = np.searchsorted(cuts, x, "left").astype(np.uint8)
    b[np.isnan(x)] = MISSING
    return b


def leaf_of(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, missing_left: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The node in which every case (those at ``at``) ends."""
    n = bins.shape[1]
    rows = np.arange(n) if at is None else at
    inner = np.flatnonzero(feature >= 0)
    if not len(inner):
        return np.ones(len(rows), np.int64)
    follow = np.repeat(np.arange(len(feature)), 256).reshape(-1, 256)        # the node after a node, by bin
    code = np.arange(256)
    follow[inner] = 2 * inner[:, None] + np.where(code == MISSING, ~missing_left[inner, None].astype(bool), code > cut[inner, None])
    first, flat, follow = np.maximum(feature, 0) * n, bins.ravel(), follow.ravel()
    node = follow[256:512].take(bins[feature[1]] if at is None else bins[feature[1]].take(at))
    for _ in range(int(inner[-1]).bit_length() - 1):
        node = follow.take((node << 8) + flat.take(first.take(node) + rows))
    return node


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def uniform(key: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) of each key, the same on every machine."""
    x = key.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


# --- packing -------------------------------------------------------------------------------------------------------------

BLOCK = "n int, bins binary, key binary, y binary, use binary, f binary"


def _pack(n_features: int, cuts: list[np.ndarray], n_labels: int, uses: list[tuple[int, int]], starts: list[float]):
    """Blocks of cases; ``uses``: label and first fit of each distinct use."""
    def run(batches):
        for b in (whole.slice(k, BLOCK_CASES) for whole in batches for k in range(0, whole.num_rows, BLOCK_CASES)):
            col = lambda name: np.asarray(b.column(name).cast(pa.float64()).fill_null(np.nan))      # noqa: E731
            bins = np.stack([binned(col(f"x{i}"), cuts[i]) for i in range(n_features)])
            y, use = np.stack([col(f"y{i}") for i in range(n_labels)]), np.stack([np.asarray(b.column(f"u{i}")) for i in range(len(uses))])
            f = np.stack([col(f"o{i}") if np.isnan(s) else np.full(b.num_rows, s) for i, s in enumerate(starts)])
            use = np.stack([np.where(np.isnan(y[label]) | np.isnan(f[m]), 0, u) for (label, m), u in zip(uses, use)]).astype(np.uint8)
            data = [bins.tobytes(), np.asarray(b.column("key")).tobytes(), y.tobytes(), use.tobytes(), np.nan_to_num(f).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *(pa.array([d], pa.binary()) for d in data)], ["n", "bins", "key", "y", "use", "f"])
    return run


@dataclass
class _State:
    """What a task needs of one fit: trees since the blocks were written and the tree that is grown."""

    level: float | None
    inputs: np.ndarray           # all of the fit's inputs, as rows of the block
    used: np.ndarray             # those offered to this tree
    seed: int
    turn: int
    subsample: float
    y: int                       # rows of the block with its label and its use
    use: int
    done: list                   # (feature, cut, missing_left, value) by tree
    tree: tuple | None = None    # (feature, cut, missing_left) as far as it is grown
    counted: np.ndarray | None = None        # whether a node is summed: one of two children is the rest of their parent


def _blocks(batches):
    for b in batches:
        for r in range(b.num_rows):
            n = b.column("n")[r].as_py()
            raw = lambda c, kind: np.frombuffer(b.column(c)[r].as_buffer(), kind).reshape(-1, n)      # noqa: E731
            yield raw("bins", np.uint8), raw("key", np.int64)[0], raw("y", float), raw("use", np.uint8), raw("f", float)


def _leaves(s: _State, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, at: np.ndarray | None) -> np.ndarray:
    return leaf_of(bins, np.where(feature < 0, -1, s.inputs[feature]) if len(s.inputs) else feature, cut, left, at)


def _margin(s: _State, bins: np.ndarray, f: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    f = f if at is None else f[at]
    for feature, cut, left, value in s.done:
        f = f + value.take(_leaves(s, bins, feature, cut, left, at))
    return f


def _draw(drawn: dict, s: _State, key: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The fitting cases that the tree is grown on; fits with the same draw share it."""
    pick = (s.use, s.seed, s.turn)
    if pick not in drawn:
        at = np.flatnonzero(use[s.use] == 1)
        drawn[pick] = at[uniform(key[at], s.seed, s.turn) < s.subsample]
    return drawn[pick]


def _slopes(level: float | None, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if level is None:
        p = sigmoid(f)
        return p - y, p * (1 - p)
    return np.where(y > f, -level, 1 - level), np.ones(len(y))


def _loss(level: float | None, y: np.ndarray, f: np.ndarray) -> np.ndarray:
    if level is None:
        return np.logaddexp(0, np.clip(f, -40, 40)) - y * np.clip(f, -40, 40)
    return np.maximum(level * (y - f), (level - 1) * (y - f))


SUMS = "fit int, cell long, g long, h long, c long"


def _emit(fit: int, cell: np.ndarray, g: np.ndarray, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), fit), pa.int32()), *(pa.array(np.asarray(x, np.int64)) for x in (cell, g, h, c))],
                                      ["fit", "cell", "g", "h", "c"])


def _histograms(held, level: int):
    """Sums per (node of the level, input, bin); at level 0 also the loss of the stopping rows (cell -1)."""
    def run(batches):
        states, sums, losses = held.value, {}, {}
        for bins, key, y, use, f0 in _blocks(batches):
            drawn = {}
            for m, s in states.items():
                if not level:
                    at = np.flatnonzero(use[s.use] == 2)
                    got = losses.setdefault(m, [0, 0])
                    got[0] += int(np.rint(_loss(s.level, y[s.y][at], _margin(s, bins, f0[m], at)) * FIXED).astype(np.int64).sum())
                    got[1] += len(at)
                at = _draw(drawn, s, key, use)
                node = _leaves(s, bins, *s.tree, at) if level else np.ones(len(at), np.int64)
                if level:
                    live = np.flatnonzero(s.counted.take(node))
                    at, node = at.take(live), node.take(live)
                f, y_at = _margin(s, bins, f0[m], at), y[s.y].take(at)
                width = (1 << level) * 256
                out = sums.setdefault(m, np.zeros((3, 1 << level, len(s.inputs), 256), np.int64))
                first = (node - (1 << level)) << 8
                if s.level is None:
                    g, h = (np.rint(x * FIXED) for x in _slopes(None, y_at, f))
                    h += 2.0**37                             # a case; the curvatures of a block stay below
                    for i in s.used.tolist():
                        cell = first + bins[s.inputs[i]].take(at)
                        both = np.bincount(cell, h, width).astype(np.int64)
                        for k, v in enumerate((np.bincount(cell, g, width).astype(np.int64), both & (1 << 37) - 1, both >> 37)):
                            out[k, :, i] += v.reshape(-1, 256)
                else:
                    above, below = (int(np.rint(x * FIXED)) for x in (-s.level, 1 - s.level))
                    w = np.where(y_at > f, 2.0**20 + 1, 1.0)             # a case, and above the margin or not
                    for i in s.used.tolist():
                        both = np.bincount(first + bins[s.inputs[i]].take(at), w, width).astype(np.int64).reshape(-1, 256)
                        c, up = both & (1 << 20) - 1, both >> 20
                        out[0, :, i] += up * above + (c - up) * below
                        out[1, :, i] += c * int(FIXED)
                        out[2, :, i] += c
        for m, (loss, n) in losses.items():
            if n:
                yield _emit(m, np.array([-1]), [loss], [0], [n])
        for m, out in sums.items():
            g, h, c = out.reshape(3, -1)
            cell = np.flatnonzero(c)
            yield _emit(m, cell, g[cell], h[cell], c[cell])
    return run


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """32-bit floats as integers of the same order."""
    u = (x.astype(np.float32) + np.float32(0)).view(np.uint32).astype(np.int64)
    return np.where(u >> 31, 0xFFFFFFFF - u, u + 0x80000000)


def from_bits(u: int) -> float:
    return float(np.array([u - 0x80000000 if u >= 0x80000000 else 0xFFFFFFFF - u], np.uint32).view(np.float32)[0])


def _residual_counts(held, chosen):
    """Cases per (leaf, leading 16 bits of the residual), or per trailing 16 bits below the chosen leading ones."""
    def run(batches):
        states, sums = held.value, {}
        for bins, key, y, use, f0 in _blocks(batches):
            drawn = {}
            for m, s in states.items():
                at = _draw(drawn, s, key, use)
                u = ordered_bits(y[s.y].take(at) - _margin(s, bins, f0[m], at))
                node = _leaves(s, bins, *s.tree, at)
                if chosen is None:
                    cell = node << 16 | u >> 16
                else:
                    hit = np.flatnonzero(chosen[m].take(node) == u >> 16)
                    cell = node.take(hit) << 16 | u.take(hit) & 0xFFFF
                # a count for every cell: their number follows from the depth
                np.add.at(sums.setdefault(m, np.zeros(len(s.tree[0]) << 16, np.int64)), cell, 1)
        for m, n in sorted(sums.items()):
            cell = np.flatnonzero(n)
            zero = np.zeros(len(cell), np.int64)
            yield _emit(m, cell, zero, zero, n[cell])
    return run


def _advance(held):
    def run(batches):
        states = held.value
        for b in batches:
            for r in range(b.num_rows):
                bins, _, _, _, f = next(_blocks([b.slice(r, 1)]))
                f = f.copy()
                for m, s in states.items():
                    f[m] = _margin(s, bins, f[m])
                yield pa.RecordBatch.from_arrays([*(b.slice(r, 1).column(c) for c in ("n", "bins", "key", "y", "use")), pa.array([f.tobytes()], pa.binary())],
                                                 ["n", "bins", "key", "y", "use", "f"])
    return run


def best_split(g: np.ndarray, h: np.ndarray, c: np.ndarray, shrink: float, min_curvature: float, min_cases: int):
    """(gain, input, cut, missing left) of the best split of a node from its (inputs, 256) histograms, or None."""
    total = [x.sum(1, keepdims=True) for x in (g, h, c)]
    miss = [x[:, MISSING:] for x in (g, h, c)]
    left = [np.cumsum(x[:, :MISSING], 1) for x in (g, h, c)]
    parent = np.divide(total[0] ** 2, total[1] + shrink, out=np.zeros_like(total[0]), where=total[1] + shrink > 0)
    best = None
    for side in (False, True):
        gl, hl, cl = ((x + m) if side else x for x, m in zip(left, miss))
        gr, hr, cr = total[0] - gl, total[1] - hl, total[2] - cl
        ok = (hl >= min_curvature) & (hr >= min_curvature) & (cl >= min_cases) & (cr >= min_cases) & (cl > 0) & (cr > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(ok, gl**2 / (hl + shrink) + gr**2 / (hr + shrink) - parent, -np.inf)
        at = int(np.argmax(gain))
        if gain.flat[at] > 1e-9 and (best is None or gain.flat[at] > best[0] + 1e-12):
            i, b = divmod(at, MISSING)
            best = (float(gain.flat[at]), i, b, side)
    return best


def fit(df: DataFrame, fits: Sequence[Fit], key: str = "case_id", **params) -> list[Trees]:
    """All ``fits`` grown in step over the rows of ``df`` (see ``PARAMS`` for the parameters they share).

    Rows without a label or offset take no part; a fit without fitting rows has no tree and starts from 0.
    """
    spark = ship_code(df.sparkSession)
    p = {**PARAMS, **params}
    names = list(dict.fromkeys(f for x in fits for f in x.features))
    row_of = {f: i for i, f in enumerate(names)}
    labels = list(dict.fromkeys(x.label for x in fits))
    kinds = list(dict.fromkeys((x.label, x.fit_rows, x.stop_rows, x.offset) for x in fits))
    y_of, use_of = [labels.index(x.label) for x in fits], [kinds.index((x.label, x.fit_rows, x.stop_rows, x.offset)) for x in fits]
    use = [F.when(F.col(label).isNull(), 0).when(F.expr(to_fit), 1).when(F.expr(to_stop), 2).otherwise(0).cast("int") for label, to_fit, to_stop, _ in kinds]
    rows = df.select(F.xxhash64(key).alias("key"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(names)),
                     *(F.col(x).cast("double").alias(f"y{i}") for i, x in enumerate(labels)), *(u.alias(f"u{i}") for i, u in enumerate(use)),
                     *(F.col(x.offset).cast("double").alias(f"o{i}") for i, x in enumerate(fits) if x.offset))
    some = lambda test: F.greatest(*(test(F.col(f"u{i}")) for i in range(len(kinds)))) if len(kinds) > 1 else test(F.col("u0"))      # noqa: E731
    rows, fitted = rows.where(some(lambda u: u > 0)), some(lambda u: u == 1)
    probs = [i / p["bins"] for i in range(1, p["bins"])]
    own = [F.when(F.col(f"u{u}") == 1, F.col(f"y{y}")) for y, u in zip(y_of, use_of)]
    # cut points of each input and the start of each fit: (bins - 1) numbers an input
    shape = rows.agg(*(F.percentile_approx(F.when(fitted & ~F.isnan(f"x{i}"), F.col(f"x{i}")), probs, 10_000).alias(f"c{i}") for i in range(len(names))),
                     *((F.avg(o) if x.level is None else F.percentile_approx(o, x.level, 10_000)).alias(f"s{i}") for i, (o, x) in enumerate(zip(own, fits))), F.count(F.lit(1)).alias("n")).first()
    cuts = [np.unique(np.array(shape[f"c{i}"] or [], float)) for i in range(len(names))]
    starts = []
    for i, x in enumerate(fits):
        s = shape[f"s{i}"]
        if x.level is None and s is not None:
            s = float(np.log(max(s, 1e-6) / max(1 - s, 1e-6)))
        starts.append(float("nan") if x.offset else 0.0 if s is None else float(s))
    uses = [(y_of[use_of.index(k)], use_of.index(k)) for k in range(len(kinds))]
    path = scratch_path(spark, "boosting")
    # a task a level for every TASK_CASES cases: fewer would leave most of a small job to the start of tasks
    tasks = -(-shape["n"] // TASK_CASES) or 1
    rows.coalesce(tasks).mapInArrow(_pack(len(names), cuts, len(labels), uses, starts), BLOCK).write.parquet(f"{path}/0")

    def opened(i: int) -> DataFrame:
        return spark.read.schema(BLOCK).parquet(f"{path}/{i}").coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)

    def summed(fn, *args) -> dict[int, np.ndarray]:
        sums = blocks.mapInArrow(fn(*args), SUMS).groupBy("fit", "cell").agg(*(F.sum(c).alias(c) for c in "ghc")).toPandas()
        return {m: x.sort_values("cell").to_numpy() for m, x in sums.groupby("fit")}

    def reached(held, chosen, wanted: Column) -> list:
        """(fit, node, low, rest) per leaf: the 16 bits at which its running count reaches ``wanted`` of (fit, node, total), and how
        many of the cases with these bits that takes."""
        counts = blocks.mapInArrow(_residual_counts(held, chosen), SUMS).select(
            "fit", F.shiftright("cell", 16).cast("int").alias("node"), F.col("cell").bitwiseAND(F.lit(0xFFFF)).alias("low"), "c")
        leaf = W.partitionBy("fit", "node")
        ranked = counts.repartition("fit", "node").groupBy("fit", "node", "low").agg(F.sum("c").alias("c")).select(
            "*", F.sum("c").over(leaf).alias("total"), F.sum("c").over(leaf.orderBy("low").rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
        rest = wanted - F.col("upto") + F.col("c")
        return ranked.where((rest > 0) & (rest <= F.col("c"))).select("fit", "node", "low", rest.alias("rest")).collect()

    nodes = 2 << p["depth"]
    grown: list[list[tuple]] = [[] for _ in fits]
    losses: list[list[float]] = [[] for _ in fits]
    states = {m: _State(x.level, np.array([row_of[f] for f in x.features], int), np.zeros(0, int), x.seed, 0, p["subsample"], y_of[m], use_of[m], [])
              for m, x in enumerate(fits)}
    live, saved, blocks = set(states), 0, opened(0)
    for turn in range(p["rounds"] + 1):
        for m in live:
            s = states[m]
            s.turn, n = turn, len(s.inputs)
            s.used = np.sort(np.random.default_rng([s.seed, turn]).choice(n, max(1, int(np.ceil(p["columns"] * n))), replace=False)) if n else np.zeros(0, int)
            s.tree = (np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes, bool))
        trees = {m: [*states[m].tree, np.zeros(nodes), np.zeros(nodes), np.zeros(nodes)] for m in live}      # + value, cover, gain
        above: dict[int, np.ndarray] = {}                # sums of the level above
        for level in range(p["depth"]):
            held = SimpleNamespace(value={m: states[m] for m in live})        # a few small arrays: they travel with the task
            got = summed(_histograms, held, level)
            more = False
            for m in sorted(live):
                x, s = got.get(m, np.zeros((0, 5))), states[m]
                if not level:
                    if len(x) and x[0, 1] == -1:
                        losses[m].append(x[0, 2] / FIXED / x[0, 4])
                        best = int(np.argmin(losses[m]))
                        if len(losses[m]) - 1 - best >= p["patience"]:
                            live.discard(m)
                            continue
                    x = x[x[:, 1] >= 0]
                size = len(s.inputs) * 256
                whole = np.zeros((3, (1 << level) * size), np.int64)
                whole[:, x[:, 1].astype(int)] = x[:, 2:].T
                if level:
                    kids, parents = whole.reshape(3, -1, 2, size), above[m].reshape(3, -1, size)
                    for k in range(1 << level - 1):
                        node = (1 << level) + 2 * k
                        if s.counted[node] or s.counted[node + 1]:
                            other = int(s.counted[node])
                            kids[:, k, other] = parents[:, k] - kids[:, k, 1 - other]
                above[m] = whole
                hist = whole.astype(float)
                hist[:2] /= FIXED
                if not level and not hist[2].any():          # no fitting rows
                    live.discard(m)
                    continue
                feature, cut, left, value, cover, gain = trees[m]
                s.counted = np.zeros(nodes, bool)
                for k in range(1 << level):
                    g, h, c = hist[:, k * size:(k + 1) * size].reshape(3, -1, 256)
                    node = (1 << level) + k
                    if not c.any():
                        continue
                    own = s.used[0]
                    if node == 1:
                        cover[1] = c[own].sum()
                        value[1] = -g[own].sum() / (h[own].sum() + p["shrink"])
                    split = best_split(g[s.used], h[s.used], c[s.used], p["shrink"], p["min_curvature"], p["min_cases"])
                    if split is None:
                        continue
                    more = True
                    i = int(s.used[split[1]])
                    feature[node], cut[node], left[node], gain[node], value[node] = i, split[2], split[3], split[0], 0.0
                    inside = np.zeros(256, bool)
                    inside[:split[2] + 1], inside[MISSING] = True, split[3]
                    for kid, part in ((2 * node, inside), (2 * node + 1, ~inside)):
                        cover[kid] = c[i][part].sum()
                        value[kid] = -g[i][part].sum() / (h[i][part].sum() + p["shrink"])
                    s.counted[2 * node + int(cover[2 * node + 1] < cover[2 * node])] = True
                s.tree = (feature, cut, left)
            if not more:
                break
        if turn == p["rounds"]:
            break
        # a tree without a split changes nothing and never will, unless other rows or inputs are drawn
        for m in [m for m in live if trees[m][0][1] < 0 and p["subsample"] >= 1 and p["columns"] >= 1]:
            live.discard(m)
        if not live:
            break
        quantile = {m: states[m] for m in live if states[m].level is not None}
        if quantile:
            held = SimpleNamespace(value=quantile)
            level_of = F.create_map(*(F.lit(x) for m, q in quantile.items() for x in (m, float(q.level))))
            lead, below = {m: np.full(nodes, -1) for m in quantile}, {}
            for m, node, low, rest in reached(held, None, F.greatest(F.ceil(level_of[F.col("fit")] * F.col("total")), F.lit(1))):
                lead[m][node], below[m * nodes + node] = low, rest
            if below:
                rest_of = F.create_map(*(F.lit(int(x)) for pair in below.items() for x in pair))
                for m, node, low, _ in reached(held, lead, rest_of[F.col("fit") * nodes + F.col("node")]):
                    trees[m][3][node] = from_bits(int(lead[m][node]) << 16 | int(low))
        for m in live:
            trees[m][3] *= p["rate"]
            trees[m][3][trees[m][0] >= 0] = 0.0
            grown[m].append(tuple(trees[m]))
            states[m].done.append(tuple(trees[m][:4]))
        if (turn + 1) % SNAPSHOT == 0:
            held = SimpleNamespace(value=states)
            saved += 1
            blocks.mapInArrow(_advance(held), BLOCK).write.parquet(f"{path}/{saved}")
            blocks.unpersist()
            blocks = opened(saved)
            for s in states.values():
                s.done = []
    blocks.unpersist()
    out = []
    for m, x in enumerate(fits):
        keep = grown[m][:int(np.argmin(losses[m]))] if losses[m] else grown[m]
        grids = [np.stack(c) for c in zip(*keep)] if keep else [np.full((0, nodes), -1), *(np.zeros((0, nodes)) for _ in range(5))]
        out.append(Trees(list(x.features), [cuts[row_of[f]] for f in x.features], *grids, 0.0 if x.offset else starts[m], x.offset, losses[m]))
    return out


# --- attributions ------------------------------------------------------------------------------------------------------------

def attribution_weights(known: int, absent: int) -> float:
    """Shapley weight of a set of ``known`` players next to one player of ``known + absent + 1``: known! absent! / total!."""
    out = 1.0 / (known + absent + 1)
    for i in range(1, known + 1):
        out *= i / (absent + i)
    return out


def attributions(m: Trees, bins: np.ndarray) -> np.ndarray:
    """(inputs + 1, cases): what each input adds to the margin, and the mean of the ensemble last.  Columns sum to the margin without offset.

    Shapley values of the game in which an unknown input sends a case to both sides in proportion to their fitted cases.  A leaf
    pays only if each input of its path is known and agrees, or is unknown and then costs a factor; so a leaf's game depends on
    the few inputs of its path, and its values follow from sums over the subsets of these.
    """
    n = bins.shape[1]
    out = np.zeros((len(m.features) + 1, n))
    out[-1] = m.start
    for t in range(m.rounds):
        feature, cut, left, value, cover = m.feature[t], m.cut[t], m.missing_left[t], m.value[t], m.cover[t]
        paths = [(1, {})]
        while paths:
            node, path = paths.pop()
            f = int(feature[node])
            if f < 0:
                _leaf(out, path, value[node], n)
                continue
            b = bins[f]
            right = np.where(b == MISSING, not left[node], b > cut[node])
            for kid, agrees in ((2 * node, ~right), (2 * node + 1, right)):
                share, held = path.get(f, (1.0, np.ones(n, bool)))
                paths.append((kid, {**path, f: (share * cover[kid] / cover[node], held & agrees)}))
    return out


def _leaf(out: np.ndarray, path: dict, value: float, n: int) -> None:
    """Adds the values of the game of one leaf."""
    inputs = list(path)
    out[-1] += value * np.prod([path[f][0] for f in inputs])
    for f in inputs:
        others = [g for g in inputs if g != f]
        # poly[k]: sum over the subsets of k known others of the product of their agreements and the shares of the unknown ones
        poly = [np.ones(n)]
        for g in others:
            share, agrees = path[g]
            grown = [p * share for p in poly] + [np.zeros(n)]
            for k, p in enumerate(poly):
                grown[k + 1] = grown[k + 1] + p * agrees
            poly = grown
        share, agrees = path[f]
        pay = sum(attribution_weights(k, len(others) - k) * p for k, p in enumerate(poly))
        out[f] += value * pay * (agrees - share)


def explain(m: Trees, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, margin, offset (margin of the case before the trees, or 0), mean, and parts: a map of input to its share of the margin.

    ``margin = offset + mean + sum of parts`` up to rounding, in one Arrow pass over the rows.
    """
    ship_code(df.sparkSession)
    held, names, offset = df.sparkSession.sparkContext.broadcast(m), list(m.features), m.offset
    rows = df.select(*keys, *(F.col(f).cast("double").alias(f"in_{i}") for i, f in enumerate(names)),
                     (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("offset"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema)

    def run(batches):
        for b in batches:
            bins = held.value.bins([np.asarray(b.column(f"in_{i}").cast(pa.float64()).fill_null(np.nan)) for i in range(len(names))])
            base = np.asarray(b.column("offset"), float)
            parts = attributions(held.value, bins)
            offsets = np.arange(0, len(names) * b.num_rows + 1, len(names)).astype(np.int32)
            maps = pa.MapArray.from_arrays(pa.array(offsets), pa.array(names * b.num_rows), pa.array(parts[:-1].T.ravel()))
            margin = held.value.margin(bins, base if offset else None)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(margin), b.column("offset"), pa.array(parts[-1]), maps],
                                             [*keys, "margin", "offset", "mean", "parts"])

    return rows.mapInArrow(run, f"{fields}margin double, offset double, mean double, parts map<string,double>")


def group_sums(explained: DataFrame, groups: dict[str, Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """(keys, group_name, contribution_logodds): parts summed per group of inputs; inputs outside all groups are ``other``."""
    def total(wanted) -> Column:
        return F.aggregate(F.map_values(F.map_filter("parts", lambda k, v: wanted(k))), F.lit(0.0), lambda a, x: a + x)

    named = sorted({f for fs in groups.values() for f in fs})
    parts = [(g, total(lambda k, fs=tuple(fs): k.isin(*fs))) for g, fs in groups.items()] + [("other", total(lambda k: ~k.isin(*named)))]
    rows = F.array(*(F.struct(F.lit(g).alias("group_name"), c.alias("contribution_logodds")) for g, c in parts))
    return explained.select(*keys, F.inline(rows))
