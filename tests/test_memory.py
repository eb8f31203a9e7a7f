"""Blocked causal nearest neighbours against brute force, with a hot key cut into many blocks."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest

from windrose.operators import memory as M

T0 = dt.datetime(2024, 1, 1)


def fixture(n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        region = "hot" if i % 3 else f"r{i % 4}"
        init = T0 + dt.timedelta(hours=6 * i)
        lead = 2
        vec = np.round(rng.normal(size=3), 1)                     # coarse values: exact copies and ties
        rows.append((i, region, lead, init, init + dt.timedelta(days=lead), [float(x) for x in vec], int(rng.random() < 0.3),
                     float(rng.random()), ["train", "validation", "test"][min(2, i * 3 // n)], "RESIDUAL_MIXED"))
    return rows


SCHEMA = ("case_id bigint, region_id string, lead_day int, init_time timestamp, valid_time timestamp, z array<double>, bust int, "
          "norm_error double, split string, sig_class string")
KEYS = ["region_id", "lead_day"]


def brute(rows, k, frozen=False):
    out = {}
    for q in rows:
        c = [r for r in rows if r[1] == q[1] and r[4] <= q[3] and (not frozen or r[8] != "test")]
        d = sorted((float(np.sqrt(((np.array(r[5]) - np.array(q[5])) ** 2).sum())), r[0]) for r in c)
        out[q[0]] = (d[:k], len(c), d)
    return out


@pytest.mark.parametrize("block", [40, 10 ** 6])
def test_knn_is_exact_for_any_block_size(spark, block):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in M.knn_join(df, df, KEYS, "z", 5, block_rows=block).collect():
        got.setdefault(r["case_id"], []).append((r["rank"], r["distance"], r["neighbour"]))
    want = brute(rows, 5)
    for i, (best, _, _) in want.items():
        mine = [(d, j) for _, d, j in sorted(got.get(i, []))]
        assert [j for _, j in mine] == [j for _, j in best]
        assert [d for d, _ in mine] == pytest.approx([d for d, _ in best])


@pytest.mark.parametrize("mode", ["causal_online", "frozen"])
def test_features(spark, mode):
    rows = fixture(200, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    k, kmin, radius = 6, 4, 1.1
    got = {r["case_id"]: r for r in M.memory_features(df, KEYS, "z", k, kmin, mode, block_rows=50, radius=radius).collect()}
    by = {r[0]: r for r in rows}
    for i, (best, n, every) in brute(rows, k, mode == "frozen").items():
        r = got[i]
        assert r["an_n_eligible"] == n and r["an_n_within"] == sum(d <= radius for d, _ in every)
        if len(best) >= kmin:
            assert r["an_bust_rate"] == pytest.approx(np.mean([by[j][6] for _, j in best]))
            assert r["an_err_q90"] == pytest.approx(np.quantile([by[j][7] for _, j in best], 0.9))
        else:
            assert r["an_bust_rate"] is None
        assert (r["an_dist1"] is None) == (not best)


def test_future_cases_never_change_a_feature(spark):
    """Metamorphic: rewriting everything that verifies after T leaves the features of queries up to T unchanged."""
    rows = fixture(160, 4)
    cut = T0 + dt.timedelta(hours=6 * 100)
    changed = [r if r[4] <= cut else (*r[:5], [9.0, 9.0, 9.0], 1 - r[6], 99.0, *r[8:]) for r in rows]
    changed = [b if a[3] > cut or a[4] <= cut else (*b[:5], a[5], *b[6:]) for a, b in zip(rows, changed)]     # keep the queries' own state

    def features(data):
        df = spark.createDataFrame(data, SCHEMA)
        return {r["case_id"]: r for r in M.memory_features(df, KEYS, "z", 5, 2, block_rows=32, radius=1.0).collect()}
    a, b = features(rows), features(changed)
    for r in rows:
        if r[3] <= cut:
            assert a[r[0]] == b[r[0]]


def test_far_blocks_are_never_compared(spark):
    """Clustered states: most block pairs are left out, the answer and the counts stay exact."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        init = T0 + dt.timedelta(hours=6 * i)
        vec = np.array([100.0 * (i * 7 % 6), 50.0 * (i * 7 % 6), 0.0]) + rng.normal(size=3)
        rows.append((i, "hot", 2, init, init + dt.timedelta(days=2), [float(x) for x in vec], i % 2, float(i), "train", "RESIDUAL_MIXED"))
    df = spark.createDataFrame(rows, SCHEMA)
    done = M.neighbour_pass(df, df, KEYS, "z", 5, 1.5, block_rows=30)
    report = done.report().first()
    assert report["n_pairs"] > 50 and report["n_visited"] < 0.7 * report["n_pairs"] and report["compared_share"] < 0.7
    want = brute(rows, 5)
    got, within = {}, {}
    for r in M.best_neighbours(done.rows, 5).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for r in done.rows.where("n_within IS NOT NULL").collect():
        within[r["id"]] = within.get(r["id"], 0) + r["n_within"]
    for i, (best, _, every) in want.items():
        assert [j for _, j in sorted(got.get(i, []))] == [j for _, j in best]
        assert within.get(i, 0) == sum(d <= 1.5 for d, _ in every)


def test_rows_without_a_vector_take_no_part(spark):
    rows = fixture(60, 3)
    holes = [(*r[:5], None if r[0] % 7 == 0 else [float("nan"), 0.0, 0.0] if r[0] % 7 == 1 else r[5], *r[6:]) for r in rows]
    whole = [r for r in rows if r[0] % 7 > 1]
    df = spark.createDataFrame(holes, SCHEMA)
    got = {r["case_id"]: r for r in M.memory_features(df, KEYS, "z", 4, 2, block_rows=10, radius=1.0).collect()}
    want = brute(whole, 4)
    for i in range(60):
        assert got[i]["an_n_eligible"] == (want[i][1] if i in want else 0)
        assert got[i]["an_n_within"] == (sum(d <= 1.0 for d, _ in want[i][2]) if i in want else 0)
    empty = df.where("false")
    assert M.memory_features(empty, KEYS, "z", 4, 2, radius=1.0).count() == 0 and M.knn_join(df, empty, KEYS, "z", 3).count() == 0


def block(rng, n, dim, first=0):
    vectors = list(np.round(rng.normal(size=(n, dim)), 2))
    for i in range(0, n // 4, 2):
        vectors[i + 1] = vectors[i]                                   # copies
    return pd.DataFrame({"id": np.arange(first, first + n), "vector": vectors, "t": rng.integers(0, 1000, n), "bust": 1.0, "norm_error": 0.5})


def test_block_pairs_are_screened_without_loss_and_faster_than_all_distances():
    rng = np.random.default_rng(3)
    c, q = block(rng, 2500, 48), block(rng, 2000, 48, 500).assign(bound=np.inf)
    q["vector"] = [c["vector"][i % 2500] if i % 3 == 0 else v for i, v in enumerate(q["vector"])]
    c.at[7, "vector"], q.at[11, "vector"] = np.full(48, np.inf), np.full(48, -np.inf)       # no finite distance to anything
    cv, qv = np.stack(c["vector"]), np.stack(q["vector"])

    def plain():
        d2 = np.zeros((len(qv), len(cv)))
        for j in range(48):
            with np.errstate(invalid="ignore"):
                diff = qv[:, j][:, None] - cv[:, j][None, :]
            d2 += diff * diff
        return np.where((c["t"].to_numpy()[None, :] <= q["t"].to_numpy()[:, None]) & np.isfinite(d2), np.sqrt(d2), np.inf)
    radius = float(np.median(np.sort(plain(), axis=1)[:, 40]))
    t0 = time.process_time()
    dist = plain()
    t1 = time.process_time()
    got = M._tile_neighbours(q, c, 10, radius)
    t2 = time.process_time()
    counts = got.dropna(subset=["n_within"]).set_index("id")["n_within"].to_dict()
    near = got.dropna(subset=["neighbour"])
    mine = {i: list(zip(g["distance"], g["neighbour"])) for i, g in near.groupby("id")}
    for r, i in enumerate(q["id"]):
        order = [j for j in np.lexsort((c["id"], dist[r]))[:10] if np.isfinite(dist[r][j])]
        assert mine.get(i, []) == [(dist[r][j], j) for j in order]
        assert counts.get(i, 0) == int((dist[r] <= radius).sum())
    assert t2 - t1 < t1 - t0
