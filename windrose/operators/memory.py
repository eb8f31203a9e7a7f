"""Analogue memory: exact causal k-nearest-neighbour join and the features derived from it.

For a query the candidates are cases of the same key (region and lead) verified no later than the query's init
time.  No candidate pair ever becomes a row, and most pairs of a large key are never compared:

* a key with more than a block of candidates is cut by time intervals and by the nearest of a few pivots (candidates of that
  key, drawn by hash); a cell that is still too large is salted.  Every block has a ball: its pivot and the largest distance to it;
* block pairs whose candidates all verify after the queries are never formed;
* a first wave compares every query block with its nearest wholly eligible candidate blocks, which gives each query a k-th
  distance; a second wave leaves out every block pair whose balls lie farther apart than the largest of these (and than the
  radius within which neighbours are counted), and inside a task every query farther from the candidates' ball than its own;
* one task sees one block pair and emits at most k rows and one count per query: a matrix product screens the pairs up to a bound on
  its rounding error, and the distances of the few that remain are computed exactly in NumPy;
* a window keeps the k best of the partial answers (ranked before the shuffle as well).

Cuts, pivots and balls only steer the work: the answer is exact for any choice.  Rows whose vector is null or holds a null or NaN
have no distance and take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.operators.ordered import grouped_quantiles, ordered_totals, slot_shapes, with_slots
from windrose.session import cut_lineage, stored_once

BLOCK_ROWS = 32_768     # a row travels to (blocks of its key that it may be near to): large blocks keep the replication small
PIVOTS = 32             # cells of one time interval at most; larger cells are salted
_TILE_CELLS = 1_000_000  # distances held at once inside a task
PAIR_TASKS = 4_096      # tasks of a wave at most
_SLACK = 1e-9           # relative and absolute room for the rounding of ball distances


@dataclass(frozen=True)
class NeighbourPass:
    """Partial answers of the visited block pairs, and all block pairs with the flag ``visited``."""

    rows: DataFrame
    pairs: DataFrame

    def report(self) -> DataFrame:
        """(n_pairs, n_visited, compared_share): block pairs, and the share of case pairs inside the visited ones."""
        cases = F.col("q_n") * F.col("c_n")
        return self.pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.count(F.when(F.col("visited"), 1)).alias("n_visited"),
                              (F.sum(F.when(F.col("visited"), cases).otherwise(0.0)) / F.sum(cases)).alias("compared_share"))


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, v: total + v))


def _clean(df: DataFrame) -> DataFrame:
    return df.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))


def _layout(c: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """(keys, _shape, _pivots) of the keys with more than a block of candidates: about as many time intervals as cells.

    Stored, so that queries and candidates are cut at the same points whatever is computed again."""
    n = F.col("_shape.n")
    intervals = F.ceil(F.sqrt(n)).cast("int")
    shapes = slot_shapes(c, keys, "t", block_rows)
    drawn = (c.join(shapes.select(*keys, F.ceil(n / intervals).alias("_cells")), list(keys))
             .withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("id", F.lit("pivot")), "id")))
             .where(F.col("_r") <= PIVOTS).where(F.col("_r") <= F.col("_cells")))
    pivots = drawn.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "vector")))["vector"].alias("_pivots"))
    cuts = shapes.withColumn("_shape", F.struct(F.col("_shape.cuts").alias("cuts"), intervals.alias("n")))
    return stored_once(cuts.join(pivots, list(keys)), "layout")


def _placed(df: DataFrame, layout: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Rows with their time interval, cell and distance to the cell's pivot; interval and cell 0 in keys of one block."""
    near = F.array_min(F.transform("_pivots", lambda p, i: F.struct(_distance(p, F.col("vector")).alias("d"), i.alias("cell"))))
    cells = df.join(layout.select(*keys, "_pivots"), list(keys), "left").withColumn("_near", near).drop("_pivots")
    rows = cells.withColumns({f"{side}_cell": F.coalesce("_near.cell", F.lit(0)), "_d": F.coalesce("_near.d", F.lit(0.0))}).drop("_near")
    return stored_once(with_slots(rows, layout.select(*keys, "_shape"), keys, "t", f"{side}_slot"), f"placed-{side}")


def _blocks(df: DataFrame, keys: Sequence[str], side: str, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their salt, and the table of blocks that exist, with their rows and the radius of their ball."""
    place = [*keys, f"{side}_slot", f"{side}_cell"]
    n = F.count(F.lit(1))
    sizes = df.groupBy(*place).agg(n.alias("_n"), F.max("_d").alias(f"{side}_r"), F.ceil(n / block_rows).cast("int").alias("_k"))
    rows = df.join(sizes.select(*place, "_k"), place).withColumn(f"{side}_salt", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int")).drop("_k", "_d")
    blocks = sizes.withColumns({f"{side}_salt": F.explode(F.sequence(F.lit(0), F.col("_k") - 1)), f"{side}_n": F.col("_n") / F.col("_k")})
    return rows, blocks.drop("_k", "_n")


def _tile_neighbours(q: pd.DataFrame, c: pd.DataFrame, k: int, radius: float | None) -> pd.DataFrame:
    """Partial answer of one block pair: up to k neighbours per query no farther than its ``bound``, and with a radius a row
    of counts (neighbour NULL)."""
    names = ["id", "neighbour", "distance", "bust", "norm_error", "n_within"]
    parts: list[pd.DataFrame] = []
    if len(q) and len(c):
        c = c.sort_values("id", kind="stable")
        cv, qv = np.stack(c["vector"].to_numpy()).astype(np.float64), np.stack(q["vector"].to_numpy()).astype(np.float64)
        finite = np.isfinite(cv).all(1), np.isfinite(qv).all(1)          # others are at no finite distance
        c, q, cv, qv = c[finite[0]], q[finite[1]], cv[finite[0]], qv[finite[1]]
    if len(q) and len(c):
        ct, qt, cid, qid, bound = c["t"].to_numpy(), q["t"].to_numpy(), c["id"].to_numpy(), q["id"].to_numpy(), q["bound"].to_numpy()
        centre = cv.mean(0)
        ball = np.sqrt(((cv - centre) ** 2).sum(1).max())
        reach = np.maximum(bound, -1.0 if radius is None else radius)
        open_ = np.sqrt(((qv - centre) ** 2).sum(1)) - ball <= reach * (1 + _SLACK) + _SLACK
        qv, qt, qid, bound = qv[open_], qt[open_], qid[open_], bound[open_]
        bust, error, dim = c["bust"].to_numpy(), c["norm_error"].to_numpy(), cv.shape[1]
        cc, cn = cv - centre, ((cv - centre) ** 2).sum(1)
        right = np.vstack([-2 * cc.T, cn[None, :], np.ones((1, len(cv)))])
        tile = max(1, _TILE_CELLS // len(cv))
        for start in range(0, len(qid), tile):
            qs = slice(start, start + tile)
            ids, qc = qid[qs], qv[qs] - centre
            qn = (qc ** 2).sum(1)
            d2 = np.hstack([qc, np.ones((len(qc), 1)), qn[:, None]]) @ right
            room = 8 * (dim + 8) * np.finfo(float).eps * (np.sqrt(qn) + ball) ** 2       # more than d2 can be off

            def exact(row: np.ndarray, col: np.ndarray, qs=slice(start, start + tile)) -> np.ndarray:
                total = np.zeros(len(row))
                for j in range(dim):                     # plain sums of squares: exact zeros for copies
                    diff = qv[qs, j][row] - cv[col, j]
                    total += diff * diff
                return np.sqrt(total)
            if ct.max() > qt[qs].min():
                d2[ct[None, :] > qt[qs][:, None]] = np.inf
            if radius is not None:
                r2 = float(radius) ** 2 * np.sign(radius)
                sure = d2 < (r2 * (1 - 1e-12) - room)[:, None]
                row, col = np.nonzero((d2 <= (r2 * (1 + 1e-12) + room)[:, None]) & ~sure & (d2 < np.inf))
                within = sure.sum(1) + np.bincount(row[exact(row, col) <= radius], minlength=len(ids))
                parts.append(pd.DataFrame({"id": ids[within > 0], "n_within": within[within > 0]}))
            limit = bound[qs] ** 2 * (1 + 1e-12) + room
            if len(cv) > k:                              # the k-th distance is within ``room`` of the k-th screened one, and so is every nearer one
                limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1] + 2 * room)
            row, col = np.nonzero((d2 <= limit[:, None]) & (d2 < np.inf))
            value = exact(row, col)
            near = value <= bound[qs][row]
            row, col, value = row[near], col[near], value[near]
            order = np.lexsort((col, value, row))        # candidates are sorted by id, so columns break ties
            row, col, value = row[order], col[order], value[order]
            first = np.searchsorted(row, np.arange(len(ids)))
            keep = np.arange(len(row)) - first[row] < k
            row, col, value = row[keep], col[keep], value[keep]
            parts.append(pd.DataFrame({"id": ids[row], "neighbour": cid[col], "distance": value, "bust": bust[col], "norm_error": error[col]}))
    out = (pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)).reindex(columns=names)
    return out.astype({"id": "int64", "neighbour": "Int64", "n_within": "Int64", "distance": float, "bust": float, "norm_error": float})


_PARTIAL = "id bigint, neighbour bigint, distance double, bust double, norm_error double, n_within bigint"


def _query_side(queries: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    return _clean(queries.select(*keys, F.col("case_id").alias("id"), F.col(vector).alias("vector"), F.unix_micros("init_time").alias("t")))


def _candidate_side(candidates: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    return _clean(candidates.select(*keys, F.col("case_id").alias("id"), F.col(vector).alias("vector"), F.unix_micros("valid_time").alias("t"),
                                    F.col("bust").cast("double").alias("bust"), F.col("norm_error").cast("double").alias("norm_error")))


def neighbour_pass(queries: DataFrame, candidates: DataFrame, keys: Sequence[str], vector: str, k: int, radius: float | None = None,
                   block_rows: int = BLOCK_ROWS) -> NeighbourPass:
    """Neighbours, and with a radius the counts within it, in one pass over the block pairs that may matter (see module text);
    ids must be unique."""
    keys = list(keys)
    c, q = _candidate_side(candidates, keys, vector), _query_side(queries, keys, vector)
    layout = _layout(c, keys, block_rows)
    c, cb = _blocks(_placed(c, layout, keys, "c"), keys, "c", block_rows)
    q, qb = _blocks(_placed(q, layout, keys, "q"), keys, "q", block_rows)
    q_keys, c_keys = [*keys, "q_slot", "q_cell", "q_salt"], [*keys, "c_slot", "c_cell", "c_salt"]
    centre = lambda side: F.element_at("_pivots", F.col(f"{side}_cell") + 1)                      # noqa: E731
    pairs = (qb.join(cb, keys).where(F.col("c_slot") <= F.col("q_slot"))                 # a later interval cannot be verified yet
             .join(layout.select(*keys, "_pivots"), keys, "left").withColumn("_apart", F.coalesce(_distance(centre("q"), centre("c")), F.lit(0.0)))
             .withColumns({"lower": F.col("_apart") - F.col("q_r") - F.col("c_r"), "upper": F.col("_apart") + F.col("q_r") + F.col("c_r")}))
    whole = F.col("c_slot") < F.col("q_slot")                                            # every candidate is eligible
    nearest = W.partitionBy(*q_keys).orderBy(F.desc(whole), "upper", "c_slot", "c_cell", "c_salt").rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.when(whole, F.col("c_n")).otherwise(0.0)).over(nearest), F.lit(0.0))
    pairs = stored_once(pairs.withColumn("first", seen < k).drop("_pivots", "_apart"), "pairs")

    def wave(chosen: DataFrame, rows: DataFrame) -> DataFrame:
        at = list(dict.fromkeys([*q_keys, *c_keys]))
        chosen = chosen.select(*at)
        # the work of a pair does not show in its bytes: a fixed number of tasks keeps small pairs from being put together
        tasks = min(max(2 * chosen.count(), 1), PAIR_TASKS)

        def named(df: DataFrame, side: str):
            place = [f"{side}_{x}" for x in at]
            return df.withColumnsRenamed(dict(zip(at, place))).repartition(tasks, *place).groupBy(*place)
        left, right = named(rows.join(chosen, q_keys), "of_query"), named(c.join(chosen, c_keys), "of_cand")

        def run(q_block: pd.DataFrame, c_block: pd.DataFrame) -> pd.DataFrame:
            return _tile_neighbours(q_block, c_block, k, radius)
        return left.cogroup(right).applyInPandas(run, _PARTIAL)

    first = stored_once(wave(pairs.where("first"), q.withColumn("bound", F.lit(float("inf")))), "nearest")
    kth = best_neighbours(first, k).where(F.col("rank") == k).select("id", F.col("distance").alias("bound"))
    bounded = q.join(kth, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    reach = F.greatest(F.col("_far"), F.lit(-1.0 if radius is None else float(radius))) * (1 + _SLACK) + _SLACK
    pairs = pairs.join(bounded.groupBy(*q_keys).agg(F.max("bound").alias("_far")), q_keys).withColumn("visited", F.col("first") | (F.col("lower") <= reach))
    return NeighbourPass(first.unionByName(wave(pairs.where("visited AND NOT first"), bounded)), pairs.drop("_far"))


def best_neighbours(partial_rows: DataFrame, k: int) -> DataFrame:
    """(id, rank, neighbour, distance, bust, norm_error); ties go to the smaller case id."""
    w = W.partitionBy("id").orderBy("distance", "neighbour")
    return (partial_rows.where(F.col("neighbour").isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("id", "rank", "neighbour", "distance", "bust", "norm_error"))


def knn_join(queries: DataFrame, candidates: DataFrame, keys: Sequence[str], vector: str, k: int = C.ANALOGUE_K,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest eligible candidates of every query."""
    return best_neighbours(neighbour_pass(queries, candidates, keys, vector, k, block_rows=block_rows).rows, k).withColumnRenamed("id", "case_id")


def eligible_counts(queries: DataFrame, candidates: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(id, an_n_eligible): candidates of the key verified by the query's init time, by one prefix sum over the times."""
    keys = list(keys)
    q, c = _query_side(queries, keys, vector), _candidate_side(candidates, keys, vector)
    times = c.select(*keys, "t", F.lit(1).alias("_one")).unionByName(q.select(*keys, "t", F.lit(0).alias("_one")))
    upto = ordered_totals(times, keys, "t", {"n": F.col("_one")}).select(*keys, "t", (F.col("below_n") + F.col("n")).cast("long").alias("an_n_eligible"))
    return q.select("id", *keys, "t").join(upto, [*keys, "t"]).select("id", "an_n_eligible")


def eligible(cases: DataFrame, mode: str) -> DataFrame:
    """Candidate side of a memory mode: 'causal_online' keeps learning, 'frozen' stops after validation."""
    if mode == "frozen":
        return cases.where(F.col("split").isin("train", "validation"))
    if mode != "causal_online":
        raise ValueError(mode)
    return cases


def fit_radius(cases: DataFrame, pool: DataFrame, keys: Sequence[str], vector: str, k: int, block_rows: int = BLOCK_ROWS) -> float:
    """Median distance of TRAIN rows to their k-th eligible neighbour in ``pool``, over keys with more than k TRAIN rows."""
    keys = list(keys)
    train = cases.where("split = 'train'")
    big = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k).select(*keys)
    best = best_neighbours(neighbour_pass(train.join(big, keys, "left_semi"), pool, keys, vector, k, block_rows=block_rows).rows, k)
    row = grouped_quantiles(best.where(F.col("rank") == k).select("distance"), [], "distance", {"radius": 0.5}).first()
    return float(row["radius"]) if row and row["radius"] is not None else float("inf")


def memory_features(cases: DataFrame, keys: Sequence[str], vector: str, k: int = C.ANALOGUE_K, kmin: int = C.ANALOGUE_MIN,
                    mode: str = "causal_online", block_rows: int = BLOCK_ROWS, radius: float | None = None) -> DataFrame:
    """Analogue features of every case: eligible and within-radius counts, distances, bust rate, median and Q90 error.

    One pass gives neighbours and counts; without a ``radius`` it is fitted on the TRAIN rows first."""
    pool = eligible(cases, mode)
    if radius is None:
        radius = fit_radius(cases, pool, keys, vector, k, block_rows)
    rows = cut_lineage(neighbour_pass(cases, pool, keys, vector, k, radius, block_rows).rows)
    best = best_neighbours(rows, k)
    counts = eligible_counts(cases, pool, keys, vector).join(
        rows.groupBy("id").agg(F.sum("n_within").alias("an_n_within")), "id", "left")
    n = F.count(F.lit(1))
    enough = lambda c: F.when(n >= kmin, c)                            # noqa: E731
    near = best.groupBy("id").agg(                # at most k rows per id
        n.alias("an_n_used"), F.min("distance").alias("an_dist1"), enough(F.avg("distance")).alias("an_dist_mean"),
        enough(F.avg("bust")).alias("an_bust_rate"), enough(F.percentile("norm_error", 0.5)).alias("an_err_med"),
        enough(F.percentile("norm_error", 0.9)).alias("an_err_q90"))
    zero = F.lit(0).cast("long")
    return (cases.select(F.col("case_id").alias("id")).join(counts, "id", "left").join(near, "id", "left").select(
        F.col("id").alias("case_id"), F.coalesce("an_n_eligible", zero).alias("an_n_eligible"), F.coalesce("an_n_within", zero).alias("an_n_within"),
        "an_dist1", "an_dist_mean", "an_bust_rate", "an_err_med", "an_err_q90"))


def expected_signature(neighbours: DataFrame, cases: DataFrame, min_busts: int = 3) -> DataFrame:
    """Class distribution of the analogue busts (all analogues when fewer than ``min_busts``); top class by share, ties in
    the fixed class order."""
    j = neighbours.join(cases.select(F.col("case_id").alias("neighbour"), "sig_class"), "neighbour")
    count = lambda c, cond: F.count(F.when((F.col("sig_class") == c) & cond, 1))      # noqa: E731
    bust = F.col("bust") == 1
    aggs = [F.count(F.when(bust, 1)).alias("_nb"), F.count(F.lit(1)).alias("_na")]
    for i, c in enumerate(C.SIGNATURE_CLASSES):
        aggs += [count(c, bust).alias(f"_b{i}"), count(c, F.lit(True)).alias(f"_a{i}")]
    g = j.groupBy("case_id").agg(*aggs)
    use = F.col("_nb") >= min_busts
    n = F.when(use, F.col("_nb")).otherwise(F.col("_na"))
    shares = [(F.when(use, F.col(f"_b{i}")).otherwise(F.col(f"_a{i}")) / n) for i in range(len(C.SIGNATURE_CLASSES))]
    top = F.lit(C.SIGNATURE_CLASSES[-1])
    for i in reversed(range(len(C.SIGNATURE_CLASSES) - 1)):
        best = shares[i] >= F.greatest(*shares[i + 1:]) if i + 1 < len(shares) - 1 else shares[i] >= shares[i + 1]
        top = F.when(best, C.SIGNATURE_CLASSES[i]).otherwise(top)
    return g.select("case_id", F.when(use, "analogue busts").otherwise("all analogues").alias("basis"), n.alias("n"),
                    *[s.alias(f"p_{c.lower()}") for s, c in zip(shares, C.SIGNATURE_CLASSES)], top.alias("expected_top"))


def nearest_listing(neighbours: DataFrame, cases: DataFrame, n: int = 8) -> DataFrame:
    """The n nearest analogues with their outcome; the signature is shown for busts only."""
    info = cases.select(F.col("case_id").alias("neighbour"), F.col("init_time").alias("nb_init"), "sig_class", F.col("split").alias("nb_split"))
    return neighbours.where(F.col("rank") <= n).join(info, "neighbour").select(
        "case_id", "rank", "neighbour", "nb_init", "distance", F.col("bust").cast("int").alias("bust"), "norm_error",
        F.when(F.col("bust") == 1, F.col("sig_class")).alias("signature"), "nb_split")


def fingerprints(cases: DataFrame, expected: DataFrame) -> DataFrame:
    """Verified busts with the expected class from their analogues and the probability given to the actual class."""
    j = cases.where("bust = 1").select("case_id", F.col("sig_class").alias("actual")).join(expected, "case_id", "left")
    p = None
    for c in C.SIGNATURE_CLASSES:
        hit = F.col("actual") == c
        p = F.when(hit, F.col(f"p_{c.lower()}")) if p is None else p.when(hit, F.col(f"p_{c.lower()}"))
    return j.select("case_id", "actual", "expected_top", "basis", p.alias("p_actual"))


def fingerprint_metrics(prints: DataFrame, train_busts: DataFrame) -> DataFrame:
    """Top-1 agreement and mean probability on the actual class, against always predicting the TRAIN class frequencies."""
    freq = train_busts.groupBy("sig_class").agg(F.count(F.lit(1)).alias("_n"))
    total = freq.agg(F.sum("_n")).scalar()
    top = freq.agg(F.max_by("sig_class", F.struct("_n", F.col("sig_class")))).scalar()
    j = (prints.join(freq.withColumnRenamed("sig_class", "actual"), "actual", "left").withColumns({"_t": total, "_top": top}))
    has = F.col("expected_top").isNotNull()
    rate = lambda c: F.avg(F.when(has, c.cast("double")))               # noqa: E731
    return j.agg(F.count(F.lit(1)).alias("n_busts"), F.count(F.when(has, 1)).alias("n_with_expectation"),
                 rate(F.col("expected_top") == F.col("actual")).alias("top1_agreement"), F.avg("p_actual").alias("mean_p_actual"),
                 rate(F.col("actual") == F.col("_top")).alias("reference_top1_agreement"),
                 rate(F.coalesce(F.col("_n") / F.col("_t"), F.lit(0.0))).alias("reference_mean_p"))
