"""Learned-model queries.

A learner's numbers have no SQL form: these queries return them as they are.  Next to each stands a ``<name>_check`` query with SQL: on
an outcome with a planted effect, or by two ways to one number, it states the properties that the numbers must have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose import constants as C
from windrose.evaluation import ranking as R
from windrose.evaluation import scores as SC
from windrose.functions import probability as P
from windrose.functions import scalar as S
from windrose.models import boosting as BO
from windrose.models import calibration as CA
from windrose.models import exceedance as X
from windrose.models import patterns as PT
from windrose.models.selection import keep_improving_groups
from windrose.plans import bridge as B
from windrose.plans.joins import N
from windrose.plans.registry import query
from windrose.plans.windows import previous_init, recent
from windrose.session import scratch_path, stored_once
from windrose.sources import sinks

SPREAD = ["spread_m", "spread_thr_ratio", "lead_day", "region_code", "season_code", "init_hour"]
GROUPS = {"SPREAD": SPREAD, "REC": ["rec_err", "rec_bias", "rec_bust_rate", "rec_err_nbhd"], "ATM": ["p_b"]}

_fitted: dict = {}


def remember(spark: SparkSession, sf: str, name: str, make):
    key = (name, spark.sparkContext.applicationId, id(spark), sf)
    if key not in _fitted:
        _fitted[key] = make()
    return _fitted[key]


def table(spark: SparkSession, sf: str) -> DataFrame:
    """The stored case table with labels and features: written once, read by every learner (columnar, partitioned by split)."""
    def make():
        lab = B.labelled(spark, sf).withColumns({
            "region_code": S.region_code("row_n", "col_n"), "season_code": S.season_code("season", {"S0": 0, "S1": 1}), "init_hour": F.hour("ts")})
        rows = lab.join(recent(spark, sf), ["init_time", "region_id"], "left").where("split <> 'embargo'")
        return sinks.write_table(rows, scratch_path(spark, "table"))
    return spark.read.parquet(remember(spark, sf, "table", make))


#: The queries boost in larger steps and give up sooner than the defaults of ``boosting.PARAMS``.
FAST = {"rate": 0.2, "rounds": 200, "patience": 10, "min_curvature": 5.0}


def base_model(spark: SparkSession, sf: str) -> X.ExceedanceModel:
    return remember(spark, sf, "base", lambda: X.fit_exceedance(table(spark, sf), SPREAD, **FAST))


def within(c, lo: float = 0.0, hi: float = 1.0):
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((c >= lo) & (c <= hi), F.lit(False))


def test(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf).where("split = 'test'")


def planted(spark: SparkSession, sf: str) -> DataFrame:
    """The case table with an outcome that depends on lead_day and p_b in a known way, and an amount that depends on p_b."""
    t = table(spark, sf)
    u = lambda k: F.pmod(F.xxhash64("case_id", F.lit(k)), F.lit(10_000)) / 10_000.0      # noqa: E731
    chance = 0.05 + 0.25 * (F.col("lead_day") >= 4).cast("int") + 0.3 * (F.col("p_b") > 0.5).cast("int")
    return t.withColumns({"hit": (u(1) < chance).cast("int"), "amount": u(2) * (1 + 2 * F.col("p_b")), "period": F.floor(F.dayofmonth("init_time") / 6).cast("int")})


ONE = "SELECT true AS "


@query("gbt_exceedance")
def gbt_exceedance(spark: SparkSession, sf: str) -> DataFrame:
    return base_model(spark, sf).score(test(spark, sf)).select("case_id", "bust", "raw_probability", "bust_probability")


def planted_model(spark: SparkSession, sf: str) -> X.ExceedanceModel:
    return remember(spark, sf, "planted", lambda: X.fit_exceedance(planted(spark, sf), [*SPREAD, "p_b"], "hit", **FAST))


@query("gbt_exceedance_check", sql=ONE + "in_range, true AS calibrated_is_monotone, true AS auprc_beats_base_rate, true AS brier_beats_base_rate, true AS keeps_best_round")
def gbt_exceedance_check(spark: SparkSession, sf: str) -> DataFrame:
    """On the planted outcome: ranking and Brier score well above those of a constant, calibrated probabilities in order of the raw ones."""
    m = planted_model(spark, sf)
    p = stored_once(m.score(planted(spark, sf).where("split = 'test'")).select("hit", "raw_probability", "bust_probability"), "scored")
    falls = CA.falls(p, "raw_probability", "bust_probability")
    rate = p.agg(F.avg("hit").alias("rate"), SC.brier("hit", "bust_probability").alias("brier"), F.min(within("raw_probability") & within("bust_probability")).alias("ok"))
    rank = R.auprc(p, "hit", "raw_probability").select("auprc")
    losses = m.trees.losses
    return rate.select(
        F.col("ok").alias("in_range"), (falls.scalar() == 0).alias("calibrated_is_monotone"), (rank.scalar() > 1.5 * F.col("rate")).alias("auprc_beats_base_rate"),
        (F.col("brier") < 0.95 * F.col("rate") * (1 - F.col("rate"))).alias("brier_beats_base_rate"),
        F.lit(m.trees.rounds > 0 and min(losses) == losses[m.trees.rounds]).alias("keeps_best_round"))


@query("boosting_curve")
def boosting_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Validation loss by number of trees, the base model's and the planted one's."""
    models = {"base": base_model(spark, sf), "planted": planted_model(spark, sf)}
    parts = [m.loss_curve(spark).withColumn("model", F.lit(name)) for name, m in models.items()]
    return parts[0].unionByName(parts[1])


@query("crossfit_margin")
def crossfit_margin(spark: SparkSession, sf: str) -> DataFrame:
    return margins(spark, sf).select("case_id", "split", "margin")


def margins(spark: SparkSession, sf: str) -> DataFrame:
    def make():
        m = X.crossfit_margin(table(spark, sf), base_model(spark, sf), F.floor(F.dayofmonth("init_time") / 6).cast("int"))
        return sinks.write_table(m, scratch_path(spark, "margin"))
    return spark.read.parquet(remember(spark, sf, "margin", make))


def planted_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Margins of a model of lead_day alone."""
    def make():
        d = planted(spark, sf)
        base = X.fit_exceedance(d, ["lead_day"], "hit", calibrate=False, **FAST)
        m = X.crossfit_margin(base.margin(d, "full_margin"), base, F.col("period"), "hit")
        return sinks.write_table(m, scratch_path(spark, "planted-margin"))
    return spark.read.parquet(remember(spark, sf, "planted margin", make))


@query("crossfit_margin_check", ctes=B.LABELLED, sql="SELECT split, count(*) AS n, true AS as_expected FROM labelled WHERE split <> 'embargo' GROUP BY split")
def crossfit_margin_check(spark: SparkSession, sf: str) -> DataFrame:
    """TRAIN margins come from fits without the row's period, so most differ from the full model's; all other rows have the full model's."""
    same = (F.abs(F.col("margin") - F.col("full_margin")) < 1e-12).cast("double")
    return planted_margins(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.avg(same).alias("mean"), F.min(same).alias("least")).select(
        "split", "n", F.when(F.col("split") == "train", F.col("mean") < 0.5).otherwise(F.col("least") == 1).alias("as_expected"))


@query("residual_learner")
def residual_learner(spark: SparkSession, sf: str) -> DataFrame:
    """Log-odds added to the cross-fitted margin; early stopping decides how many trees, possibly none."""
    m = margins(spark, sf)
    model = remember(spark, sf, "residual", lambda: X.fit_residual(m, ["rec_err", "rec_bust_rate", "rec_bias", "p_b"], **FAST))
    scored = model.score(m.where("split = 'test'"))
    return scored.select("case_id", "margin", "raw_probability", "bust_probability", F.lit(model.trees.rounds).alias("n_trees"))


@query("residual_learner_check", sql=ONE + "gains_over_margin, true AS starts_at_margin, true AS loss_falls")
def residual_learner_check(spark: SparkSession, sf: str) -> DataFrame:
    """With lead_day in the margin, trees on p_b must add to the ranking; without trees the score is the margin's."""
    d = planted_margins(spark, sf)
    model = X.fit_residual(d, ["p_b"], "hit", calibrate=False, **FAST)
    none = X.ExceedanceModel(BO.Trees(model.trees.features, model.trees.cuts, *(g[:0] for g in (model.trees.feature, model.trees.cut, model.trees.missing_left,
                                      model.trees.value, model.trees.cover, model.trees.gain)), 0.0, "margin"))
    te = none.margin(model.raw(d.where("split = 'test'"), "p_full"), "start").withColumn("p_base", 1 / (1 + F.exp(-F.col("margin"))))
    full, base = (R.auprc(te, "hit", c).select(F.col("auprc").alias(c)) for c in ("p_full", "p_base"))
    start = te.agg(F.max(F.abs(F.col("start") - F.col("margin"))).alias("gap"))
    losses = model.trees.losses
    return start.select(
        (full.scalar() > 1.1 * base.scalar()).alias("gains_over_margin"), (F.col("gap") == 0).alias("starts_at_margin"), F.lit(min(losses) < losses[0]).alias("loss_falls"))


def forest(spark: SparkSession, sf: str) -> X.QuantileForest:
    return remember(spark, sf, "forest", lambda: X.fit_quantile_forest(table(spark, sf), SPREAD + ["rec_err"]))


QUANTILES = {"rate": 0.3, "rounds": 25, "patience": 4, "depth": 3}


def quantile_model(spark: SparkSession, sf: str) -> X.QuantileBoost:
    return remember(spark, sf, "quantiles", lambda: X.fit_quantile_boost(table(spark, sf), SPREAD + ["rec_err"], **QUANTILES))


def calibrated_quantiles(model, t: DataFrame) -> DataFrame:
    """TEST rows with q, the exceedance probability that the quantiles imply, and its calibration on VALIDATION."""
    rows = t.where("split IN ('validation', 'test')")
    q = model.quantiles(rows).join(rows.select("case_id", "split", "q_primary", "bust", "norm_error"), "case_id")
    q = q.withColumn("p_raw", P.exceedance_from_quantiles(F.col("q"), F.col("q_primary")))
    cal = CA.fit_isotonic(q.where("split = 'validation'"), "p_raw", "bust")
    return CA.calibrate(q.where("split = 'test'"), cal, "p_raw", "p_cal")


def quantile_columns():
    return [F.col("q")[i].alias(c) for i, c in enumerate(C.QUANTILE_COLUMNS)]


@query("quantile_forest")
def quantile_forest(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated_quantiles(forest(spark, sf), table(spark, sf)).select("case_id", *quantile_columns(), "p_raw", "p_cal")


@query("quantile_forest_check", ctes=B.LABELLED, sql="""
  SELECT case_id, true AS ordered, true AS raw_in_range, true AS calibrated_in_range FROM labelled WHERE split = 'test'""")
def quantile_forest_check(spark: SparkSession, sf: str) -> DataFrame:
    ordered = (F.size("q") == 6) & (F.col("q") == F.array_sort("q"))
    return calibrated_quantiles(forest(spark, sf), table(spark, sf)).select(
        "case_id", ordered.alias("ordered"), within("p_raw").alias("raw_in_range"), within("p_cal").alias("calibrated_in_range"))


@query("quantile_boost")
def quantile_boost(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated_quantiles(quantile_model(spark, sf), table(spark, sf)).select("case_id", *quantile_columns(), "crossed", "p_raw", "p_cal")


@query("quantile_boost_check", sql="SELECT unnest([10, 25, 50, 75, 90, 95]) AS level, true AS covers, true AS no_worse_than_forest")
def quantile_boost_check(spark: SparkSession, sf: str) -> DataFrame:
    """On an amount with a planted effect: TEST coverage near each level, and a mean pinball loss no worse than the forest's."""
    d = planted(spark, sf)
    te = d.where("split = 'test'")
    boost = X.fit_quantile_boost(d, ["p_b", "lead_day"], "amount", **QUANTILES)
    rest = X.fit_quantile_forest(d, ["p_b", "lead_day"], "amount")
    j = boost.quantiles(te).select("case_id", F.col("q").alias("qb")).join(rest.quantiles(te).select("case_id", F.col("q").alias("qf")), "case_id").join(te.select("case_id", "amount"), "case_id")
    y, levels = F.col("amount"), list(zip(C.QUANTILE_COLUMNS, C.QUANTILE_LEVELS))
    sums = j.agg(F.count("*").alias("n"), *(F.avg((y <= F.col("qb")[i]).cast("double")).alias(f"c{i}") for i in range(6)),
                 *(SC.pinball(y, F.col(q)[i], F.lit(v)).alias(f"{q}{i}") for q in ("qb", "qf") for i, (_, v) in enumerate(levels)))
    mean = lambda q: sum((F.col(f"{q}{i}") for i in range(1, 6)), F.col(f"{q}0"))      # noqa: E731
    # two points of coverage, and three standard errors where the test period is short
    near = lambda i, v: F.abs(F.col(f"c{i}") - v) <= 0.02 + 3 * F.sqrt(F.lit(v * (1 - v)) / F.col("n"))      # noqa: E731
    return sums.select(F.inline(F.array(*(F.struct(F.lit(round(100 * v)).alias("level"), near(i, v).alias("covers"), (mean("qb") <= 1.01 * mean("qf")).alias("no_worse_than_forest"))
                                          for i, (_, v) in enumerate(levels)))))


@query("q95_models")
def q95_models(spark: SparkSession, sf: str) -> DataFrame:
    m = remember(spark, sf, "q95", lambda: X.fit_exceedance(table(spark, sf), SPREAD, label="bust_q95", **FAST))
    return m.score(test(spark, sf)).select("case_id", "bust_q95", "raw_probability", "bust_probability")


@query("q95_models_check", sql="SELECT CAST(count(*) AS BIGINT) AS n, true AS q95_is_rarer FROM labelled WHERE split = 'test'", ctes=B.LABELLED)
def q95_models_check(spark: SparkSession, sf: str) -> DataFrame:
    """The mean probability of the rarer outcome is below that of the more frequent one."""
    a = q95_models(spark, sf).select("case_id", F.col("raw_probability").alias("p95")).join(gbt_exceedance(spark, sf).select("case_id", "raw_probability"), "case_id")
    return a.agg(F.count("*").alias("n"), (F.avg("p95") < F.avg("raw_probability")).alias("q95_is_rarer"))


def scored_by_loaded(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "model")
    base_model(spark, sf).save(path, spark)
    return X.ExceedanceModel.load(spark, path).score(test(spark, sf))


@query("score_batch")
def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Save, load and score."""
    return scored_by_loaded(spark, sf).select("case_id", "raw_probability", "bust_probability")


@query("score_batch_check", ctes=B.LABELLED, sql="SELECT case_id, true AS loaded_equals_fitted FROM labelled WHERE split = 'test'")
def score_batch_check(spark: SparkSession, sf: str) -> DataFrame:
    fitted = base_model(spark, sf).score(test(spark, sf)).select("case_id", F.col("bust_probability").alias("_p"))
    return scored_by_loaded(spark, sf).join(fitted, "case_id").select("case_id", (F.abs(F.col("bust_probability") - F.col("_p")) < 1e-12).alias("loaded_equals_fitted"))


def whole_model(spark: SparkSession, sf: str) -> X.ExceedanceModel:
    return remember(spark, sf, "all", lambda: X.fit_exceedance(table(spark, sf), sum(GROUPS.values(), []), **FAST))


@query("feature_importance")
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    return whole_model(spark, sf).importance(spark)


@query("feature_importance_check", sql=ONE + "sums_to_one, true AS unrelated_inputs_are_last")
def feature_importance_check(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs without a part in the planted effect have little of the gain (spread_m goes with p_b by construction)."""
    i = planted_model(spark, sf).importance(spark)
    rest = F.coalesce(F.sum(F.when(F.col("feature").isin("region_code", "season_code", "init_hour"), F.col("importance"))), F.lit(0.0))
    return i.agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"), (rest < 0.3).alias("unrelated_inputs_are_last"))


@query("group_attribution")
def group_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return X.group_attribution(test(spark, sf), whole_model(spark, sf), GROUPS)


@query("attributions")
def attributions(spark: SparkSession, sf: str) -> DataFrame:
    e = BO.explain(whole_model(spark, sf).trees, test(spark, sf), ["case_id"])
    return e.select("case_id", "margin", "offset", "mean", F.explode("parts").alias("feature", "part"))


@query("group_attribution_check", ctes=B.LABELLED, sql="SELECT case_id, true AS parts_sum_to_margin, true AS groups_follow FROM labelled WHERE split = 'test'")
def group_attribution_check(spark: SparkSession, sf: str) -> DataFrame:
    """Parts, mean and offset give the margin; the groups' sums give the same."""
    m = planted_model(spark, sf)
    e = stored_once(BO.explain(m.trees, planted(spark, sf).where("split = 'test'"), ["case_id"]), "explained")
    g = BO.group_sums(e, {"SPREAD": SPREAD, "ATM": ["p_b"]}, ["case_id"]).groupBy("case_id").agg(F.sum("contribution_logodds").alias("groups"))
    parts = F.aggregate(F.map_values("parts"), F.lit(0.0), lambda a, x: a + x)
    return e.join(g, "case_id").select("case_id", (F.abs(F.col("margin") - F.col("offset") - F.col("mean") - parts) < 1e-9).alias("parts_sum_to_margin"),
                                       (F.abs(F.col("groups") - parts) < 1e-9).alias("groups_follow"))


REPEATS = 3


def permuted(f, va: DataFrame, target: str = "norm_error") -> DataFrame:
    """Rise of the q90 pinball loss when one input is permuted; all permutations are scored in one pass."""
    perms = [name for name in f.features for _ in range(REPEATS)]
    donors = X.permutation_donors(va, len(perms), 100)
    given = va.select(F.col("case_id").alias("donor"), F.struct(*f.features).alias("given"))
    moved = donors.join(given, "donor").join(va, "case_id").withColumns({
        name: F.when(F.col("perm").isin([i for i, n in enumerate(perms) if n == name]), F.col("given")[name]).otherwise(F.col(name)) for name in f.features})
    rows = moved.select("perm", "case_id", target, *f.features).unionByName(va.select(F.lit(-1).alias("perm"), "case_id", target, *f.features))
    q90 = F.array_sort(F.array(*C.QUANTILE_COLUMNS))[4]
    loss = stored_once(f.raw_quantiles(rows).groupBy("perm").agg(SC.pinball(F.col(target), q90, F.lit(0.9)).alias("loss")), "loss")      # a row a permutation
    base = loss.where("perm < 0").select("loss").scalar()
    feature = F.element_at(F.array(*map(F.lit, perms)), F.col("perm") + 1)
    rise = loss.where("perm >= 0").withColumn("feature", feature).groupBy("feature").agg((F.avg("loss") - base).alias("importance"))
    return rise.select("feature", "importance")


@query("permutation_importance")
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    return permuted(quantile_model(spark, sf), table(spark, sf).where("split = 'validation'"))


@query("permutation_importance_check", sql="SELECT unnest(['p_b', 'init_hour']) AS feature, unnest([true, false]) AS matters")
def permutation_importance_check(spark: SparkSession, sf: str) -> DataFrame:
    """Of an input with a planted effect on the amount and one without, permuting the first alone raises the loss by a tenth."""
    d = planted(spark, sf)
    f = X.fit_quantile_boost(d, ["p_b", "init_hour"], "amount", **QUANTILES)
    va = d.where("split = 'validation'")
    floor = 0.1 * va.agg(F.avg("amount")).first()[0] * 0.1
    return permuted(f, va, "amount").select("feature", (F.col("importance") > floor).alias("matters"))


SEEDS = (20260928, 20260929, 20260930)


def selection(t: DataFrame, groups: dict, label: str, base=tuple(SPREAD)) -> DataFrame:
    """Every group added to ``base``, three seeds, judged on two periods; all fits are grown in step."""
    fits = X.fit_several(t, {name: [*base, *extra] for name, extra in groups.items()}, label, calibrate=False, seeds=SEEDS, **FAST)
    runs = None
    for (name, seed), m in fits.items():
        r = R.auprc(m.raw(t.where("split IN ('validation', 'test')")), label, "raw_probability", ["split"]).select(
            F.lit(name).alias("group_name"), F.col("split").alias("period"), F.lit(seed).alias("seed"), F.col("auprc").alias("metric"))
        runs = r if runs is None else runs.unionByName(r)
    return keep_improving_groups(runs, "BASE")


@query("group_selection")
def group_selection(spark: SparkSession, sf: str) -> DataFrame:
    return selection(table(spark, sf), {"BASE": [], "REC": GROUPS["REC"], "ATM": GROUPS["ATM"]}, "bust").select("group_name", "mean_gain", "worst_gain", "keep")


@query("group_selection_check", sql="SELECT 'ATM' AS group_name, true AS gains, 1 AS keep")
def group_selection_check(spark: SparkSession, sf: str) -> DataFrame:
    """The group with a planted effect gains in both periods and is kept."""
    g = selection(planted(spark, sf), {"BASE": [], "ATM": GROUPS["ATM"]}, "hit", ["lead_day", "region_code"])
    return g.select("group_name", (F.col("worst_gain") > 0.02).alias("gains"), "keep")


# --- pattern features ------------------------------------------------------------------------------------------------------

MAP_KEYS = ["init_time", "lead_day", "valid_time"]
TRAIN_MAPS = "init_time < '1998-01-01'"


def maps(spark: SparkSession, sf: str) -> DataFrame:
    g = B.grid(spark, sf).withColumn("anom", F.col("z") - F.col("clim_value"))
    return PT.maps_to_vectors(g, "anom", MAP_KEYS, N, N)


def pca(spark: SparkSession, sf: str):
    def make():
        train = maps(spark, sf).where(TRAIN_MAPS)
        m = PT.fit(train, 8)
        return m, PT.component_variances(m, train)
    return remember(spark, sf, "pca", make)


_MAPS = "maps AS (SELECT init_time, lead_day, valid_time FROM grid GROUP BY ALL)"


@query("pca_fit_check", ctes=B.GRID + "," + _MAPS, sql="""
  SELECT count(*) AS n_maps, CAST(c AS INTEGER) AS component, true AS ratio_in_range, true AS variance_is_that_of_the_scores
  FROM maps, range(1, 9) t(c) WHERE init_time < DATE '1998-01-01' GROUP BY c""")
def pca_fit_check(spark: SparkSession, sf: str) -> DataFrame:
    m, var = pca(spark, sf)
    frame = maps(spark, sf).where(TRAIN_MAPS).agg(F.count(F.lit(1)).alias("n_maps"))
    s = PT.scores(maps(spark, sf).where(TRAIN_MAPS), m, var)
    frame = frame.withColumn("found", s.agg(F.array(*[F.var_samp(F.col("pcs")[i]) for i in range(len(var))])).scalar())
    rows = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(0 <= r <= 1 and (i == 0 or r <= PT.explained(m)[i - 1] + 1e-12)).alias("ratio_in_range"),
                              (F.abs(F.col("found")[i] - F.lit(v)) <= 1e-6 * F.lit(v)).alias("variance_is_that_of_the_scores"))
                     for i, (r, v) in enumerate(zip(PT.explained(m), var))])
    return frame.select("n_maps", F.inline(rows))


@query("pca_fit")
def pca_fit(spark: SparkSession, sf: str) -> DataFrame:
    m, var = pca(spark, sf)
    frame = maps(spark, sf).where(TRAIN_MAPS).agg(F.count(F.lit(1)).alias("n_maps"))
    rows = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(float(r)).alias("explained"), F.lit(float(v)).alias("variance"))
                     for i, (r, v) in enumerate(zip(PT.explained(m), var))])
    return frame.select("n_maps", F.inline(rows))


@query("pca_scores")
def pca_scores(spark: SparkSession, sf: str) -> DataFrame:
    m, var = pca(spark, sf)
    return PT.scores(maps(spark, sf), m, var).select("init_time", "lead_day", *(F.col("pcs")[i].alias(f"pc{i + 1}") for i in range(len(var))), "pc_norm", "pc_resid")


@query("pca_scores_check", ctes=B.GRID + "," + _MAPS, sql="SELECT init_time, lead_day, true AS norm_is_a_norm, true AS resid_in_range FROM maps")
def pca_scores_check(spark: SparkSession, sf: str) -> DataFrame:
    m, var = pca(spark, sf)
    return PT.scores(maps(spark, sf), m, var).select(
        "init_time", "lead_day", within("pc_norm", 0.0, 1e9).alias("norm_is_a_norm"), within("pc_resid").alias("resid_in_range"))


@query("pattern_revision")
def pattern_revision(spark: SparkSession, sf: str) -> DataFrame:
    m, var = pca(spark, sf)
    return PT.pattern_revision(PT.scores(maps(spark, sf), m, var), previous_init(), var).select("init_time", "lead_day", "rev_pc")


@query("pattern_revision_check", ctes=B.GRID + "," + _MAPS, sql="""
  SELECT m.init_time, m.lead_day, p.init_time IS NOT NULL AS has_previous, CASE WHEN p.init_time IS NOT NULL THEN true END AS rev_is_a_norm
  FROM maps m LEFT JOIN maps p ON p.valid_time = m.valid_time AND p.init_time = m.init_time - INTERVAL 1 MONTH""")
def pattern_revision_check(spark: SparkSession, sf: str) -> DataFrame:
    m, var = pca(spark, sf)
    s = PT.scores(maps(spark, sf), m, var)
    return PT.pattern_revision(s, previous_init(), var).select(
        "init_time", "lead_day", F.col("rev_pc").isNotNull().alias("has_previous"), F.when(F.col("rev_pc").isNotNull(), F.col("rev_pc") >= 0).alias("rev_is_a_norm"))
