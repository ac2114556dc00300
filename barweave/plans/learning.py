"""Queries over training, scoring, evaluation and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave import panel
from barweave.operators import explain, models, targets
from barweave.operators import features as f
from barweave.operators import scoring as sc
from barweave.operators.calibration import Calibrator
from barweave.operators.signals import latest
from barweave.plans.features import _BOUNDS, _COMPLETE, _FOLDS, _PREP_SQL
from barweave.plans.registry import query
from barweave.plans.sqlparts import W, cols, ctes
from barweave.session import scratch_path

c = F.col

# --- training ------------------------------------------------------------------------
#
# The operators' defaults (trees, depth, folds) on all rows; the small model has its own features. Probabilities
# differ between engines, so a query returns its rows with what must hold for them in any engine, and
# the SQL twin says which rows these are. Equal training rows and settings are fitted once (models.Registry).
_FEATURES, _BASIC = f.MODEL_FEATURES, f.BASIC_FEATURES
_TRIALS = 50


def _labelled(t):
    rows = panel.windowed(t.features, [targets.add_direction()], ahead=1)
    return targets.drop_incomplete(rows, f.MODEL_FEATURES)


def _training(t):
    return t.store("training", lambda: _labelled(t).drop("prob_up"))


def _fitted(t, features):
    return models.Registry(t.spark).fit(_training(t), features)


def _oof(t):
    return t.store("oof_scored", lambda: models.out_of_fold(_training(t), _FEATURES, models.member_estimators))


def _valid(members=models.MEMBERS):
    """All members' probabilities are probabilities, and their mean is the ensemble's."""
    each = [c(f"prob_{m}") for m in members]
    inside = F.array(*each, c("prob_up"))
    return (F.forall(inside, lambda p: p.between(0.0, 1.0)) & (F.abs(sum(each[1:], each[0]) / len(each) - c("prob_up")) < 1e-9)).alias("valid")


_TEST = {
    **_PREP_SQL,
    "d": "SELECT date, row_number() OVER (ORDER BY date) AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM prep)",
    "b": _BOUNDS.format(src="(SELECT max(n) AS n FROM d)"),
    "folds": _FOLDS,
    "tests": "SELECT ticker, date, CAST(fold AS INTEGER) AS fold, target FROM folds JOIN d ON rank > test_start AND rank <= test_end JOIN prep USING (date)",
}


@query("ml_ensemble", ctes("bars", **_PREP_SQL) + "SELECT ticker, date, target, true AS valid FROM prep")
def ml_ensemble(t):
    scored = _fitted(t, targets.drop_constant(_training(t), f.MODEL_FEATURES)).transform(models.spread(_training(t)))
    return scored.select("ticker", "date", "target", _valid())


@query("ml_oof", ctes("bars", **_TEST) + "SELECT ticker, date, fold, target, true AS valid FROM tests")
def ml_oof(t):
    return _oof(t).select("ticker", "date", "fold", "target", _valid())


_MEMBERS = ", ".join(f"'{m}'" for m in models.MEMBERS)


@query(
    "ml_oof_member_scores",
    ctes("bars", **_TEST, up="SELECT fold, avg(target) AS share FROM tests GROUP BY 1")
    + f"SELECT unnest([{_MEMBERS}]) AS model, (SELECT count(*) FROM up) AS n_folds, true AS better_than_the_rarer_class",
)
def ml_oof_member_scores(t):
    scores = sc.member_scores(models.member_predictions(_oof(t)))
    rarer = _oof(t).groupBy("fold").agg(F.least(F.avg("target"), 1 - F.avg("target")).alias("r")).agg(F.avg("r")).scalar()
    return scores.select("model", "n_folds", (c("accuracy") >= rarer - 0.05).alias("better_than_the_rarer_class"))


def _draws_sql() -> str:
    rows = [(m, i, d["maxDepth"], d["maxIter"], d.get("maxLeaves", "NULL")) for m in _TUNED for i, d in enumerate(models.random_draws(_TRIALS, member=m))]
    values = ", ".join(f"('{m}', {', '.join(map(str, rest))})" for m, *rest in rows)
    kinds = "member, CAST(draw AS INTEGER) AS draw, CAST(depth AS DOUBLE) AS max_depth, CAST(trees AS DOUBLE) AS trees, CAST(leaves AS DOUBLE) AS max_leaves"
    return f"SELECT {kinds}, true AS valid FROM (VALUES {values}) v(member, draw, depth, trees, leaves), (SELECT count(*) AS n FROM bars) WHERE n > 0"


_TUNED = ("boosted_a", "boosted_b")


@query("ml_tune", ctes("bars") + _draws_sql())
def ml_tune(t):
    training = _training(t)
    parts = [models.tune(training, _FEATURES, models.random_draws(_TRIALS, member=m)).withColumn("member", F.lit(m)) for m in _TUNED]
    found = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return found.select("member", "draw", c("maxDepth").alias("max_depth"), c("maxIter").alias("trees"), c("maxLeaves").alias("max_leaves"), c("accuracy").between(0.0, 1.0).alias("valid"))


@query("ml_final_fit", ctes("bars", **_PREP_SQL) + "SELECT ticker, date, true AS same_when_loaded FROM prep")
def ml_final_fit(t):
    path = scratch_path(t.spark, "model")
    fitted = _fitted(t, _FEATURES)
    fitted.save(path, {"rows": _training(t).count()})
    now = fitted.transform(models.spread(_training(t))).withColumnRenamed("prob_up", "_now")
    both = models.Ensemble.load(path).transform(now.drop(*[f"prob_{m}" for m in models.MEMBERS]))
    return both.select("ticker", "date", (F.abs(c("prob_up") - c("_now")) < 1e-9).alias("same_when_loaded"))


def _basic(t):
    split = targets.split_temporal(_training(t))
    train = models.training_rows(split.where(c("role") == "train"), _BASIC)
    return models.basic_forest().fit(train), split.where(c("role") == "test")


@query("ml_basic")
def ml_basic(t):
    model, test = _basic(t)
    rows = models.training_rows(test, _BASIC)
    scored = model.transform(rows).withColumn("prediction", c("prediction").cast("int"))
    return sc.binary_metrics(scored)


@query("ml_importance")
def ml_importance(t):
    model, _ = _basic(t)
    return models.importances(model, _BASIC, 5)


_SCORED = {
    "complete": _COMPLETE,
    "newest": "SELECT ticker, max(date) AS date FROM bars WHERE date <= (SELECT max(date) FROM vix) GROUP BY 1",
}


@query("sc_batch", ctes("bars", "vix", **_SCORED) + "SELECT ticker, date, true AS valid FROM complete SEMI JOIN newest USING (ticker, date)")
def sc_batch(t):
    model = _fitted(t, _FEATURES)
    newest = latest(t.features.where(c("date") <= t.vix.agg(F.max("date")).scalar())).dropna(how="any", subset=_FEATURES)
    scored = Calibrator("isotonic").fit(_oof(t)).transform(model.transform(newest))
    return scored.select("ticker", "date", (c("prob_up").between(0.0, 1.0) & c("prob_cal").between(0.01, 0.99)).alias("valid"))


@query(
    "sc_panel",
    ctes("bars", **_SCORED, k="SELECT ticker, count(*) AS n FROM complete GROUP BY 1") + "SELECT ticker, date, true AS valid FROM complete JOIN k USING (ticker) WHERE n >= 60",
)
def sc_panel(t):
    return _fitted(t, _FEATURES).transform(models.spread(models.scorable(t.features, _FEATURES))).select("ticker", "date", _valid())


@query("xp_contributions")
def xp_contributions(t):
    coef, mean, base = models.surrogate(_training(t), _FEATURES)
    return explain.contributions(_training(t), coef, mean, base)


# --- evaluation ------------------------------------------------------------------------


def _predicted(t):
    return t.oof.withColumn("prediction", (c("prob_up") >= 0.5).cast("int"))


_PRED = {
    "pr": "SELECT *, CAST(prob_up >= 0.5::DOUBLE AS INTEGER) AS prediction FROM oof",
    "cf": """SELECT count(*) FILTER (WHERE prediction = 1 AND target = 1) AS tp, count(*) FILTER (WHERE prediction = 1 AND target = 0) AS fp,
    count(*) FILTER (WHERE prediction = 0 AND target = 1) AS fn, count(*) FILTER (WHERE prediction = 0 AND target = 0) AS tn, count(*) AS n FROM pr""",
    "cls": """SELECT 0 AS label, tn / (tn + fn)::DOUBLE AS precision, tn / (tn + fp)::DOUBLE AS recall, 2 * tn / (2 * tn + fn + fp)::DOUBLE AS f1, tn + fp AS support FROM cf
    UNION ALL SELECT 1, tp / (tp + fp)::DOUBLE, tp / (tp + fn)::DOUBLE, 2 * tp / (2 * tp + fn + fp)::DOUBLE, tp + fn FROM cf""",
}


@query(
    "ev_binary",
    ctes("oof", **_PRED, o="""SELECT n, (tp + tn) / n::DOUBLE AS accuracy, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall,
    2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, greatest(tp + fn, fp + tn) / n::DOUBLE AS baseline FROM cf""")
    + f"SELECT {cols('n', 'accuracy precision recall f1 baseline')} FROM o",
)
def ev_binary(t):
    return sc.binary_metrics(_predicted(t))


@query(
    "ev_weighted",
    ctes("oof", **_PRED, o="""SELECT (SELECT (tp + tn) / n::DOUBLE FROM cf) AS accuracy, sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall,
    sum(f1 * support) / sum(support) AS f1 FROM cls""") + f"SELECT {cols('', 'accuracy precision recall f1')} FROM o",
)
def ev_weighted(t):
    return sc.weighted_metrics(_predicted(t))


@query("ev_class_report", ctes("oof", **_PRED) + f"SELECT CAST(label AS INTEGER) AS label, {cols('support', 'precision recall f1')} FROM cls")
def ev_class_report(t):
    return sc.class_report(_predicted(t))


@query(
    "ev_simple_backtest",
    ctes("bars", r=f"SELECT *, (lead(close) OVER ({W}) / close - 1) * CAST(prob_up >= 0.5::DOUBLE AS INTEGER) AS r FROM bars",
         o="SELECT ticker, sum(r) AS total_return, avg(r) / stddev_samp(r) AS sharpe_ratio, avg(coalesce((r > 0)::INT, 0)) AS win_rate FROM r GROUP BY 1")
    + f"SELECT {cols('ticker', 'total_return sharpe_ratio win_rate')} FROM o",
)
def ev_simple_backtest(t):
    rows = panel.windowed(t.bars, [targets.add_next_return], ahead=1)
    return sc.simple_backtest(rows.withColumn("prediction", (c("prob_up") >= 0.5).cast("int")))


@query(
    "ml_member_scores",
    ctes("oof", m="""SELECT year(date) AS fold, target, 'even' AS model, CAST(prob_up >= 0.5::DOUBLE AS INTEGER) AS prediction FROM oof
    UNION ALL SELECT year(date), target, 'strict', CAST(prob_up >= 0.55::DOUBLE AS INTEGER) FROM oof""",
         k="SELECT model, fold, avg((prediction = target)::INT) AS accuracy FROM m GROUP BY 1, 2",
         o="SELECT model, avg(accuracy) AS accuracy, count(*) AS n_folds FROM k GROUP BY 1")
    + f"SELECT {cols('model n_folds', 'accuracy')} FROM o",
)
def ml_member_scores(t):
    fire = lambda name, p: F.struct(F.lit(name).alias("model"), (c("prob_up") >= p).cast("int").alias("prediction"))
    rows = t.oof.select(F.year("date").alias("fold"), "target", F.explode(F.array(fire("even", 0.5), fire("strict", 0.55))).alias("m"))
    return sc.member_scores(rows.select("fold", "target", "m.*"))


# --- decisions ---------------------------------------------------------------------------

_THR = 0.6
_DEC = {
    "dec": f"""SELECT *, CASE WHEN prob_up >= {_THR}::DOUBLE THEN 'buy' WHEN 1 - prob_up >= {_THR}::DOUBLE THEN 'sell' ELSE 'none' END AS decision,
    greatest(prob_up, 1 - prob_up) AS confidence FROM {{src}}""",
}
_PCT = "CAST(floor(confidence * 100 * 100 + 0.5) / 100 AS VARCHAR) || '%'"


def _decided(df):
    return sc.add_decision(df, F.lit(_THR))


@query("sc_decision", ctes("bars", dec=_DEC["dec"].format(src="bars")) + f"SELECT {cols('ticker date decision', 'confidence')} FROM dec")
def sc_decision(t):
    return _decided(t.bars).select("ticker", "date", "decision", "confidence")


@query(
    "sc_message",
    ctes("bars", dec=_DEC["dec"].format(src="bars"))
    + f"""SELECT ticker, date, CASE WHEN decision = 'none' THEN 'discarded: confidence ' || {_PCT} || ' below threshold 60.0%' WHEN confidence >= 0.75 THEN 'high confidence (' || {_PCT} || ')'
    WHEN confidence >= 0.6::DOUBLE THEN 'moderate confidence (' || {_PCT} || ')' ELSE 'low confidence (' || {_PCT} || '), use with care' END AS message FROM dec""",
)
def sc_message(t):
    return _decided(t.bars).select("ticker", "date", sc.message(F.lit(_THR)).alias("message"))


@query(
    "sc_recommend",
    ctes("bars") + "SELECT ticker, date, CASE WHEN prob_up > 0.6::DOUBLE THEN 'buy' WHEN 1 - prob_up > 0.6::DOUBLE THEN 'sell' ELSE 'hold' END AS recommendation FROM bars",
)
def sc_recommend(t):
    return t.bars.select("ticker", "date", sc.recommend(c("prob_up")).alias("recommendation"))


_STATE = {
    "lg": f"SELECT *, lag(close, 5) OVER ({W}) AS c5, lag(close, 20) OVER ({W}) AS c20 FROM rets",
    "vl": "SELECT ticker, stddev_samp(ret_1d) AS daily_vol, max(date) AS date FROM rets GROUP BY 1",
    "st": "SELECT g.*, daily_vol, close AS price, coalesce(close / c5 - 1, 0) AS mom_5, coalesce(close / c20 - 1, 0) AS mom_20 FROM lg g JOIN vl USING (ticker, date)",
    "dec": """SELECT *, CASE WHEN prob_up >= 0.5::DOUBLE THEN 'buy' WHEN 1 - prob_up >= 0.5::DOUBLE THEN 'sell' ELSE 'none' END AS decision, greatest(prob_up, 1 - prob_up) AS confidence FROM st""",
    "h1": "SELECT *, CASE WHEN decision = 'buy' THEN 1 ELSE -1 END AS s FROM dec",
    "h2": "SELECT *, s * daily_vol * confidence * 1.5 AS m1 FROM h1",
    "h3": "SELECT *, CASE WHEN mom_5 * s > 0 THEN s * abs(mom_5) * confidence * 1.2 ELSE m1 * 3 END AS m5 FROM h2",
    "h4": "SELECT *, CASE WHEN mom_20 * s > 0 THEN s * abs(mom_20) * confidence * 1.1 ELSE m5 * 2 END AS m20 FROM h3",
    "h5": """SELECT *, greatest(least(m1, 0.05::DOUBLE), -0.05::DOUBLE) AS move_1, greatest(least(m5, 0.12::DOUBLE), -0.12::DOUBLE) AS move_5, greatest(least(m20, 0.25::DOUBLE), -0.25::DOUBLE) AS move_20 FROM h4""",
    "hz": "SELECT *, price * (1 + move_1) AS target_1, price * (1 + move_5) AS target_5, price * (1 + move_20) AS target_20 FROM h5",
}


def _horizons(t):
    return sc.add_horizons(sc.add_decision(sc.price_state(t.bars), F.lit(0.5)))


@query("sc_horizons", ctes("rets", **_STATE) + f"SELECT {cols('ticker date decision', 'move_1 move_5 move_20 target_1 target_5 target_20')} FROM hz")
def sc_horizons(t):
    return _horizons(t).select("ticker", "date", "decision", *[f"{k}_{n}" for k in ("move", "target") for n in (1, 5, 20)])


_M = "floor(abs(move_{n}) * 100 * 100 + 0.5) / 100"


@query(
    "sc_holding",
    ctes("rets", **_STATE)
    + f"""SELECT ticker, CASE WHEN confidence >= 0.75 THEN CASE WHEN {_M.format(n=20)} >= 8 THEN '15-20 days (long swing)' WHEN {_M.format(n=5)} >= 4 THEN '5-10 days (swing)' ELSE '1-3 days (day trading)' END
    WHEN confidence >= 0.6::DOUBLE THEN CASE WHEN {_M.format(n=5)} >= 3 THEN '3-7 days (moderate swing)' ELSE '1-2 days (day trading)' END ELSE 'intraday or 1 day at most' END AS holding FROM hz""",
)
def sc_holding(t):
    return _horizons(t).select("ticker", sc.holding().alias("holding"))


@query(
    "sc_stop_take",
    ctes("atrs", **{**_STATE, "sa": """SELECT h.*, coalesce(a.atr, h.price * 0.02) AS a FROM hz h JOIN (SELECT ticker, date, atr FROM atrs) a USING (ticker, date)""",
         "o": "SELECT ticker, decision, price - s * 2 * a AS stop_loss, floor(target_5 * 100 + 0.5) / 100 AS take_profit, price FROM sa WHERE decision <> 'none'",
         "o2": "SELECT *, abs(take_profit - price) / nullif(abs(price - stop_loss), 0) AS reward_risk FROM o"})
    + f"SELECT {cols('ticker decision', 'stop_loss take_profit reward_risk')} FROM o2",
)
def sc_stop_take(t):
    atr = f.compute(t.bars, [f.atr]).select("ticker", "date", "atr")
    joined = _horizons(t).join(atr, ["ticker", "date"], "left")
    return sc.add_stop_take(joined).select("ticker", "decision", "stop_loss", "take_profit", "reward_risk")


@query(
    "sc_rank_summary",
    ctes("bars", dec=_DEC["dec"].format(src="bars"), o="SELECT decision, count(*) AS n, avg(confidence) AS mean_confidence FROM dec GROUP BY 1")
    + f"SELECT {cols('decision n', 'mean_confidence')} FROM o",
)
def sc_rank_summary(t):
    return sc.decision_counts(_decided(t.bars))


# --- calibration -----------------------------------------------------------------------------

# isotonic fit by the max-min formula over the distinct probabilities
_ISO = {
    "g": "SELECT prob_up, sum(target)::DOUBLE AS s, count(*)::DOUBLE AS k, row_number() OVER (ORDER BY prob_up) AS i FROM oof GROUP BY 1",
    "cum": "SELECT *, sum(s) OVER (ORDER BY i) AS cs, sum(k) OVER (ORDER BY i) AS ck FROM g",
    "avgs": """SELECT a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.ck - a.ck + a.k) AS m FROM cum a JOIN cum b ON b.i >= a.i""",
    "mins": "SELECT j, k AS i, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS lo FROM avgs",
    "iso": "SELECT i, max(lo) AS fit FROM mins GROUP BY 1",
    "knot": "SELECT g.prob_up, greatest(least(fit, 0.99::DOUBLE), 0.01::DOUBLE) AS prob_cal FROM g JOIN iso USING (i)",
    "cal": "SELECT o.*, prob_cal FROM oof o JOIN knot USING (prob_up)",
}


def _calibrated(t):
    return Calibrator("isotonic").fit(t.oof).transform(t.oof)


@query("cal_isotonic", ctes("oof", **_ISO) + f"SELECT DISTINCT {cols('', 'prob_up prob_cal')} FROM cal")
def cal_isotonic(t):
    return _calibrated(t).select("prob_up", "prob_cal").distinct()


@query("cal_transform", ctes("oof", **_ISO) + f"SELECT {cols('ticker date', 'prob_cal')} FROM cal")
def cal_transform(t):
    return _calibrated(t).select("ticker", "date", "prob_cal")


# logistic fit on the logit by Newton steps
_PLATT = {
    "z": """SELECT prob_up, ln(greatest(least(prob_up, 0.999999), 0.000001) / (1 - greatest(least(prob_up, 0.999999), 0.000001))) AS z,
    sum(target)::DOUBLE AS s, count(*)::DOUBLE AS k FROM oof GROUP BY 1""",
    "nw": """SELECT 0 AS it, 0::DOUBLE AS a, 0::DOUBLE AS b UNION ALL
    SELECT it + 1, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT it, a, b, sum(s - k * p) AS ga, sum((s - k * p) * z) AS gb, sum(k * p * (1 - p)) AS haa, sum(k * p * (1 - p) * z) AS hab, sum(k * p * (1 - p) * z * z) AS hbb
    FROM (SELECT nw.*, z.*, 1 / (1 + exp(-(a + b * z))) AS p FROM nw, z WHERE it < 12) GROUP BY 1, 2, 3)""",
    "pl": "SELECT o.ticker, o.date, o.prob_up, 1 / (1 + exp(-(a + b * z))) AS prob_cal FROM oof o JOIN z USING (prob_up), (SELECT a, b FROM nw WHERE it = 12)",
}


@query("cal_platt", ctes("oof", **_PLATT).replace("WITH ", "WITH RECURSIVE ", 1) + f"SELECT {cols('ticker date', 'prob_up prob_cal')} FROM pl")
def cal_platt(t):
    return Calibrator("platt").fit(t.oof).transform(t.oof).select("ticker", "date", "prob_up", "prob_cal")


@query(
    "cal_brier",
    ctes("oof", **_ISO, o="SELECT avg(pow(prob_up - target, 2)) AS brier_prob_up, avg(pow(prob_cal - target, 2)) AS brier_prob_cal FROM cal")
    + f"SELECT {cols('', 'brier_prob_up brier_prob_cal')} FROM o",
)
def cal_brier(t):
    return sc.brier(_calibrated(t), ["prob_up", "prob_cal"])


_TT = {
    "th": f"SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in sc.THRESHOLDS)}]) AS threshold",
    "tt": """SELECT threshold, count(*) AS n, count(*) FILTER (WHERE prob_up >= threshold) AS signals, avg(target) FILTER (WHERE prob_up >= threshold) AS precision,
    count(*) FILTER (WHERE prob_up >= threshold) / count(*)::DOUBLE AS signal_rate FROM oof, th GROUP BY 1""",
}


@query("cal_threshold_table", ctes("oof", **_TT) + f"SELECT {cols('n signals', 'threshold precision signal_rate')} FROM tt")
def cal_threshold_table(t):
    return sc.threshold_table(t.oof)


_PICK = """SELECT coalesce((SELECT threshold FROM tt WHERE signals >= 30 AND precision IS NOT NULL ORDER BY precision DESC, signals DESC, threshold LIMIT 1),
(SELECT threshold FROM tt WHERE precision IS NOT NULL ORDER BY precision DESC, signals DESC, threshold LIMIT 1), 0.5::DOUBLE) AS threshold"""


@query("cal_threshold_select", ctes("oof", **_TT) + _PICK)
def cal_threshold_select(t):
    return sc.select_threshold(sc.threshold_table(t.oof))


@query(
    "cal_threshold_default",
    ctes("oof", "users", **_TT, pick=_PICK)
    + "SELECT user_id, floor(coalesce(CASE WHEN tier = 'pro' THEN 0.7::DOUBLE END, CASE WHEN tier = 'free' THEN (SELECT threshold FROM pick) END, 0.6::DOUBLE) * 1e6 + 0.5) / 1e6 AS threshold FROM users",
)
def cal_threshold_default(t):
    picked = sc.select_threshold(sc.threshold_table(t.oof)).scalar()
    explicit = F.when(c("tier") == "pro", 0.7)
    return t.users.select("user_id", sc.default_threshold(explicit, F.when(c("tier") == "free", picked)).alias("threshold"))


# --- diagnostics --------------------------------------------------------------------------------

_BAND = """CASE WHEN prob_up <= 0.35::DOUBLE THEN '<=35%' WHEN prob_up <= 0.45::DOUBLE THEN '35-45%' WHEN prob_up <= 0.55::DOUBLE THEN '45-55%' WHEN prob_up <= 0.65::DOUBLE THEN '55-65%' ELSE '>=65%' END"""


@query(
    "diag_prob_bands",
    ctes("oof", o=f"""SELECT {_BAND} AS band, count(*) AS n, avg(CASE WHEN prob_up <= 0.45::DOUBLE THEN 1 - target ELSE target END) AS accuracy,
    count(*) / (SELECT count(*) FROM oof)::DOUBLE AS share FROM oof GROUP BY 1""") + f"SELECT {cols('band n', 'accuracy share')} FROM o",
)
def diag_prob_bands(t):
    return sc.prob_bands(t.oof)


_EDGES = [(0.5, 0.55), (0.55, 0.6), (0.6, 0.65), (0.65, 0.7), (0.7, 1.01)]


@query(
    "diag_confidence_matrix",
    ctes("oof", o=" UNION ALL ".join(
        f"SELECT '{lo:.2f}-{hi:.2f}' AS band, 'long' AS side, count(*) AS n, avg(target) AS accuracy FROM oof WHERE prob_up >= {lo}::DOUBLE AND prob_up < {hi}::DOUBLE "
        f"UNION ALL SELECT '{lo:.2f}-{hi:.2f}', 'short', count(*), avg(1 - target) FROM oof WHERE prob_up <= 1 - {lo}::DOUBLE AND prob_up > 1 - {hi}::DOUBLE" for lo, hi in _EDGES))
    + f"SELECT {cols('band side n', 'accuracy')} FROM o WHERE n > 0",
)
def diag_confidence_matrix(t):
    return sc.confidence_matrix(t.oof)


@query(
    "diag_oof_markers",
    ctes("oof") + """SELECT ticker, date, prob_up, CASE WHEN prob_up >= 0.5::DOUBLE THEN 'BUY' ELSE 'SELL' END AS signal, target AS actual_up, CAST((prob_up >= 0.5::DOUBLE) = (target = 1) AS INTEGER) AS correct FROM oof""",
)
def diag_oof_markers(t):
    return sc.oof_markers(t.oof)


@query(
    "diag_oof_range",
    ctes("oof", o="SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS n, avg(((prob_up >= 0.5::DOUBLE) = (target = 1))::INT) AS overall_accuracy FROM oof")
    + f"SELECT {cols('first_date last_date n', 'overall_accuracy')} FROM o",
)
def diag_oof_range(t):
    return sc.oof_range(t.oof)
