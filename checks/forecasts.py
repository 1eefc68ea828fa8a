"""Calendar samples, scaling, forecasts and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import archive as arch, evaluation as ev, forecasting as fc, samples as sm, scaling
from paneltide.operators.reports import sorted_rows
from paneltide.plans import comparison
from paneltide.session import cut_lineage, scratch_path
from paneltide.sources.csv_records import CsvRecords
from paneltide.timeline import row_index

from .registry import cols, query, r
from .sql_parts import ar_path, archive, predictions, samples, t_test_p

FIT = "cast(floor(n * 0.7::DOUBLE) AS bigint)"


def positioned(v, series=False):
    keys = ["series"] if series else []
    source = v.p_series5 if series else v.p_series
    return sm.calendar_position(row_index(source, "date", keys, "i", total="n"), v.axis)


def prepared(v, lags=5, lead=1, features=(), series=(), windows=False, **kw):
    source = v.p_series5 if series else v.p_series
    return sm.prepare_samples(source, v.axis, "sr", features, lead, lags, series=series, windows=windows, **kw)


def stand_in(v, lags=5, lead=1):
    """Archive of the test origins whose forecast is the mean of the last two observations."""
    test = prepared(v, lags, lead, windows=True).where("split = 'test'")
    base = (F.col("window")[lags - 1][0] + F.col("window")[lags - 2][0]) / 2
    return test.select("i", "origin_date", F.col("target_date").alias("date"), F.lit(lead).alias("lead"), F.lit("direct").alias("forecast_mode"),
                       F.col("target").alias("TRUE"), base.alias("Informer_pred"), "x")


def stored(rows):
    """As a file, the way an archive comes."""
    return cut_lineage(rows, "archive")


def wide(v, lags=5, lead=1):
    rows = fc.training_rows(v.p_series, "sr")
    return fc.ar1_forecast(stand_in(v, lags, lead).withColumn("Persistence_pred", F.col("x")), fc.fit_ar1(rows, "sr"), lead)


PREDS = ["Informer_pred", "Persistence_pred", "AR1_pred"]


def long(v, lags=5, lead=1):
    return ev.long_predictions(wide(v, lags, lead), "TRUE", PREDS, keep=["date"])


# Calendar and samples

@query("calendar_position", f"SELECT s.series, s.date, c.pos, {r('s.sr')} AS sr FROM p_series5 s JOIN p_calendar c ON c.date = s.date")
def _(v):
    return sm.calendar_position(v.p_series5, v.axis).select("series", "date", "pos", "sr")


@query("exact_lead_target", f"""WITH pos AS (SELECT s.*, c.pos FROM p_series5 s JOIN p_calendar c ON c.date = s.date)
  SELECT h.series, h.date, t.date AS target_date, {r('t.sr')} AS target FROM pos h JOIN pos t ON t.series = h.series AND t.pos = h.pos + 5""", stage=("p_series5",))
def _(v):
    rows = sm.calendar_position(v.p_series5, v.axis)
    return sm.exact_lead(rows, {"target_date": "date", "target": "sr"}, 5, ["series"]).select("series", "date", "target_date", "target")


@query("contiguous_history", f"WITH {samples(5, 1, 'p_series5', 'series')} SELECT series, date, pos, coalesce(ok, false) AS contiguous FROM hist", stage=("p_series5",))
def _(v):
    return sm.contiguous_history(positioned(v, True), 5, ["series"]).select("series", "date", "pos", "contiguous")


@query("lookback_windows", f"""WITH {samples(4, 1, 'p_series5', 'series')} SELECT h.series, h.pos, h.pos - p.pos AS back, {r('p.sr')} AS sr, {r('p.feature')} AS feature
  FROM hist h JOIN pos p ON p.series = h.series AND p.pos BETWEEN h.pos - 3 AND h.pos WHERE h.ok""", stage=("p_series5",))
def _(v):
    cut = sm.lookback_windows(positioned(v, True), ["sr", "feature"], 4, ["series"])
    return cut.select("series", "pos", F.posexplode("window").alias("k", "row")).select(
        "series", "pos", (3 - F.col("k")).alias("back"), F.col("row")[0].alias("sr"), F.col("row")[1].alias("feature"))


@query("sliding_samples", f"""WITH idx AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM p_series)
  SELECT s.i AS sample, 'x' AS part, x.i - s.i AS k, {r('x.sr')} AS sr FROM idx s JOIN idx x ON x.i BETWEEN s.i AND s.i + 5 WHERE s.i <= s.n - 6 - 2
  UNION ALL SELECT s.i, 'y', y.i - s.i - 3, {r('y.sr')} FROM idx s JOIN idx y ON y.i BETWEEN s.i + 3 AND s.i + 7 WHERE s.i <= s.n - 6 - 2""")
def _(v):
    made = sm.sliding_samples(row_index(v.p_series, "date"), "sr", seq_len=6, label_len=3, pred_len=2)
    part = lambda name: made.select("sample", F.lit(name).alias("part"), F.posexplode(name).alias("k", "sr"))
    return part("x").unionByName(part("y"))


@query("chrono_split", """WITH idx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM p_series),
  b AS (SELECT *, cast(floor(n * 0.7::DOUBLE) AS bigint) AS tr, cast(floor(n * 0.2::DOUBLE) AS bigint) AS te FROM idx)
  SELECT date, i, 'train' AS segment FROM b WHERE i < tr UNION ALL SELECT date, i, 'val' FROM b WHERE i >= tr - 5 AND i < n - te
  UNION ALL SELECT date, i, 'test' FROM b WHERE i >= n - te - 5""")
def _(v):
    return sm.chrono_split(row_index(v.p_series, "date", total="n"), 5).select("date", "i", "segment")


def _embargo(series, lags, lead):
    return f"""WITH {samples(lags, lead, 'p_series5' if series else 'p_series', 'series' if series else '')}"""


@query("embargo_split", f"{_embargo(True, 5, 1)} SELECT series, origin_date, target_date, i, target_i, fit_end, split, {r('target')} AS target FROM samples", stage=("p_series5",))
def _(v):
    return prepared(v, series=["series"]).select("series", "origin_date", "target_date", "i", "target_i", "fit_end", "split", "target")


@query("embargo_split_three_way", f"""WITH {samples(4, 5)}, b AS (SELECT *, n - cast(floor(n * 0.2::DOUBLE) AS bigint) AS ts FROM smp)
  SELECT origin_date, target_date, split FROM (SELECT *, CASE WHEN target_i < fit_end THEN 'train' WHEN target_i < ts THEN CASE WHEN i >= fit_end - 1 THEN 'val' END
    WHEN i >= ts - 1 THEN 'test' END AS split FROM b) WHERE split IS NOT NULL""", stage=("p_series",))
def _(v):
    return prepared(v, 4, 5, ways=3).select("origin_date", "target_date", "split")


@query("future_dates", """WITH idx AS (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS k FROM p_series5)
  SELECT series, date, false AS generated FROM idx WHERE k <= 5 UNION ALL
  SELECT series, cast(date + to_days(cast(j AS int)) AS date), true FROM idx, (SELECT unnest(range(1, 8)) AS j) WHERE k = 1""", stage=("p_series5",))
def _(v):
    return sm.future_stamps(v.p_series5, "d", 5, 7, ["series"])


@query("scaler_fit", f"""WITH idx AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM p_series5),
  s AS (SELECT series, min(sr) AS a, max(sr) - min(sr) AS b, min(feature) AS c, max(feature) - min(feature) AS d FROM idx WHERE i < floor(n * 0.7::DOUBLE) GROUP BY series)
  SELECT idx.series, date, {r('(sr - a) / CASE WHEN b = 0 THEN 1 ELSE b END')} AS sr_scaled, {r('(feature - c) / CASE WHEN d = 0 THEN 1 ELSE d END')} AS feature_scaled
  FROM idx JOIN s ON s.series = idx.series""", stage=("p_series5",))
def _(v):
    rows = row_index(v.p_series5, "date", ["series"], "i", total="n")
    stats = scaling.fit_scaler(rows.where(F.col("i") < sm.share(F.col("n"), 0.7)), ["sr", "feature"], "minmax", ["series"])
    return scaling.scale(rows, stats, ["sr", "feature"], ["series"]).select("series", "date", "sr_scaled", "feature_scaled")


@query("scaler_standard", f"""WITH idx AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM p_series),
  s AS (SELECT avg(sr) AS a, stddev_pop(sr) AS b FROM idx WHERE i < floor(n * 0.7::DOUBLE)) SELECT date, {r('(sr - a) / b')} AS sr_scaled FROM idx, s""", stage=("p_series",))
def _(v):
    rows = row_index(v.p_series, "date", total="n")
    stats = scaling.fit_scaler(rows.where(F.col("i") < sm.share(F.col("n"), 0.7)), ["sr"], "standard")
    return scaling.scale(rows, stats, ["sr"]).select("date", "sr_scaled")


@query("forecast_identity", f"""WITH idx AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM p_series)
  SELECT w.i AS window_id, first.date AS forecast_start, f.i - w.i AS horizon, f.date, {r('f.sr')} AS pred FROM idx w JOIN idx f ON f.i BETWEEN w.i + 1 AND w.i + 5
  JOIN idx first ON first.i = w.i + 1 WHERE w.i + 5 < w.n""", stage=("p_series",))
def _(v):
    return sm.forecast_identity(joint(v))


def joint(v):
    """Every row with the five rows after it, as a joint forecast would hold them."""
    from paneltide.timeline import in_blocks

    rows = row_index(v.p_series, "date")
    cells = in_blocks(rows, "i", [], {"forecast": lambda w: F.collect_list(F.struct("date", F.col("sr").alias("pred"))).over(w.rowsBetween(1, 5))}, after=5)
    return cells.where("size(forecast) = 5").select(F.col("date").alias("origin_date"), "forecast")


@query("recover_horizons", f"""WITH idx AS (SELECT date, sr, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM p_series)
  SELECT f.date, w.i AS window_id, f.i - w.i AS horizon, {r('f.sr + w.i')} AS pred FROM idx w JOIN idx f ON f.i BETWEEN w.i + 1 AND w.i + 5 WHERE w.i + 5 < w.n""", stage=("p_series",))
def _(v):
    """An archive that kept only dates, as sorted files: every row gets its own window back."""
    numbered = row_index(joint(v), "origin_date", index="w")
    flat = numbered.select("w", F.explode("forecast").alias("f")).select(F.col("f.date").alias("date"), "w", (F.col("f.pred") + F.col("w")).alias("pred"))
    path = scratch_path(v.spark, "legacy")
    flat.repartitionByRange(4, "date", "w").sortWithinPartitions("date", "w").drop("w").write.option("header", True).csv(path)
    rows = CsvRecords(v.spark, path).cells(numbered="place").select("place", F.col("date").cast("date"), F.col("pred").cast("double"))
    return sm.recover_horizons(rows, 5, place="place").drop("place")


# Forecasts

@query("ar1_fit", f"""WITH idx AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM p_series5),
  p AS (SELECT series, sr AS y, lag(sr) OVER (PARTITION BY series ORDER BY i) AS x FROM idx WHERE i < floor(n * 0.7::DOUBLE))
  SELECT series, {r('regr_intercept(y, x)')} AS intercept, {r('regr_slope(y, x)')} AS slope FROM p WHERE x IS NOT NULL GROUP BY series""", stage=("p_series5",))
def _(v):
    return fc.fit_ar1(fc.training_rows(v.p_series5, "sr", ["series"]), "sr", ["series"])


@query("forecast_persistence", f"{_embargo(True, 5, 1)} SELECT series, origin_date, target_date, {r('x')} AS Persistence_pred FROM samples WHERE split = 'test'", stage=("p_series5",))
def _(v):
    return fc.persistence(prepared(v, series=["series"]).where("split = 'test'")).select("series", "origin_date", "target_date", "Persistence_pred")


@query("forecast_ar1", f"""WITH {samples(5, 1, 'p_series5', 'series')}, ar AS (SELECT series, regr_intercept(y, x) AS c, regr_slope(y, x) AS phi FROM
    (SELECT series, sr AS y, lag(sr) OVER (PARTITION BY series ORDER BY i) AS x FROM idx WHERE i < floor(n * 0.7::DOUBLE)) WHERE x IS NOT NULL GROUP BY series)
  SELECT s.series, s.origin_date, s.target_date, {r(ar_path(1))} AS AR1_pred FROM samples s JOIN ar ON ar.series = s.series WHERE split = 'test'""", stage=("p_series5",))
def _(v):
    rows = fc.training_rows(v.p_series5, "sr", ["series"])
    made = fc.ar1_forecast(prepared(v, series=["series"]).where("split = 'test'"), fc.fit_ar1(rows, "sr", ["series"]), 1, ["series"])
    return made.select("series", "origin_date", "target_date", "AR1_pred")


def levels_sql(alpha: float, series: str = "") -> str:
    key, same = (f"{series}, ", f"d.{series} = l.{series} AND ") if series else ("", "")
    pick = f"l.{series}, " if series else ""
    return f"""levels AS (SELECT {key}i, sr AS level FROM idx WHERE i = 0 UNION ALL
   SELECT {pick}d.i, {alpha}::DOUBLE * d.sr + (1 - {alpha}::DOUBLE) * l.level FROM levels l JOIN idx d ON {same}d.i = l.i + 1)"""


@query("forecast_ets", f"""WITH RECURSIVE {samples(5, 1, 'p_series5', 'series')}, {levels_sql(0.3, 'series')}
  SELECT s.series, s.origin_date, s.target_date, {r('l.level')} AS ETS_pred FROM samples s JOIN levels l ON l.series = s.series AND l.i = s.i WHERE split = 'test'""", stage=("p_series5",))
def _(v):
    rows = fc.training_rows(v.p_series5, "sr", ["series"])
    made = fc.ets_forecast(prepared(v, series=["series"]).where("split = 'test'"), rows, "sr", ["series"], alpha=0.3)
    return made.select("series", "origin_date", "target_date", "ETS_pred")


TRIALS = [k / 20 for k in range(1, 20)]


@query("forecast_ets_fitted", f"""WITH RECURSIVE {samples(5, 1, 'p_series5', 'series')}, a AS (SELECT unnest({TRIALS!r})::DOUBLE AS alpha),
  walk AS (SELECT series, alpha, i, sr AS level, 0::DOUBLE AS e FROM idx, a WHERE i = 0 UNION ALL
    SELECT w.series, w.alpha, d.i, w.alpha * d.sr + (1 - w.alpha) * w.level, d.sr - w.level FROM walk w JOIN idx d ON d.series = w.series AND d.i = w.i + 1 WHERE d.i < floor(d.n * 0.7::DOUBLE)),
  tried AS (SELECT series, alpha, sum(e * e) AS sse FROM walk GROUP BY ALL), best AS (SELECT series, min(sse) AS sse FROM tried GROUP BY series)
  SELECT series, {r('any_value(b.sse)', 4)} AS grid_sse, TRUE AS no_trial_is_better, count(*) AS forecasts
  FROM samples s JOIN best b USING (series) WHERE split = 'test' GROUP BY series""", digits=4, stage=("p_series5",))
def _(v):
    """Fitted weights against fixed trials, and a forecast for every test origin."""
    rows = fc.training_rows(v.p_series5, "sr", ["series"])
    weights = cut_lineage(fc.fit_ets(rows, "sr", ["series"]), "weights")
    made = fc.ets_forecast(prepared(v, series=["series"]).where("split = 'test'"), rows, "sr", ["series"], alpha=weights)
    sse = fc.squared_errors(rows, "sr", weights.select("series", F.explode(F.array("alpha", *[F.lit(t) for t in TRIALS])).alias("alpha")), ["series"])
    own = F.col("alpha").isin(TRIALS)
    compared = sse.groupBy("series").agg(F.min(F.when(own, F.col("sse"))).alias("grid_sse"), F.min(F.when(~own, F.col("sse"))).alias("fitted_sse"))
    counted = made.groupBy("series").agg(F.count("ETS_pred").alias("forecasts"))
    return counted.join(compared, "series").select("series", "grid_sse", (F.col("fitted_sse") <= F.col("grid_sse") * (1 + 1e-9)).alias("no_trial_is_better"), "forecasts")


GBR = {"GBR": {"n_estimators": 12, "learning_rate": 0.3, "max_depth": 2}}
FEATURES = ["feature"]


@query("forecast_gbr", f"""WITH {samples(5, 1, 'p_series5', 'series')}
  SELECT series, split, count(*) AS forecasts, TRUE AS finite, TRUE AS beats_mean, TRUE AS beats_persistence_where_fitted FROM samples GROUP BY series, split""", stage=("p_series5",))
def _(v):
    """What SQL can say of the forecasts of all series: one for every origin, and bounds on the training rows that no constant
    and no copy of the last value can meet. The trees themselves: ``forecast_gbr_tree``."""
    ready = prepared(v, features=FEATURES, series=["series"], windows=True)
    rows = fc.training_rows(v.p_series5, "sr", ["series"]).select("series", "date", "i", "fit_end")
    stats = scaling.fit_scaler(v.p_series5.join(rows.where("i < fit_end"), ["series", "date"], "left_semi"), ["sr", *FEATURES], "minmax", ["series"])
    made = fc.gbr_forecast(ready, stats, ["sr", *FEATURES], "sr", rounds=12, rate=0.3, depth=2, series=["series"], every=True)
    error = lambda p: F.avg((F.col("target") - p) ** 2)
    scores = made.groupBy("series", "split").agg(
        F.count(F.lit(1)).alias("forecasts"), F.every(F.coalesce(F.abs("GBR_pred") < float("inf"), F.lit(False))).alias("finite"),
        error(F.col("GBR_pred")).alias("own"), error(F.col("x")).alias("last"), F.var_pop("target").alias("spread"))
    fitted = F.col("split") == "train"
    return scores.select("series", "split", "forecasts", "finite", (~fitted | (F.col("own") < F.col("spread"))).alias("beats_mean"),
                         (~fitted | (F.col("own") < F.col("last"))).alias("beats_persistence_where_fitted"))


@query("forecast_gbr_tree", f"""WITH {samples(5, 1, 'p_series5', 'series')},
  scale AS (SELECT series, min(sr) AS a, max(sr) - min(sr) AS b FROM idx WHERE i < floor(n * 0.7::DOUBLE) GROUP BY series),
  f AS (SELECT s.series, s.pos, s.split, (s.target - a) / b AS y, a, b, 4 - (s.pos - p.pos) AS ft, (p.sr - a) / b AS x, s.origin_date
    FROM samples s JOIN scale USING (series) JOIN pos p ON p.series = s.series AND p.pos BETWEEN s.pos - 4 AND s.pos),
  e AS (SELECT series, ft, min(x) AS low, max(x) AS high FROM f WHERE split = 'train' GROUP BY series, ft),
  c AS (SELECT f.*, least(15, greatest(0, cast(floor((x - low) / ((high - low) / 16)) AS bigint))) AS bin, cast(round(y * 1073741824) AS bigint) AS q FROM f JOIN e USING (series, ft)),
  base AS (SELECT series, cast(round(sum(q) / count(*)) AS bigint) AS m FROM c WHERE split = 'train' AND ft = 0 GROUP BY series),
  t AS (SELECT c.*, q - m AS r, m FROM c JOIN base USING (series)),
  k AS (SELECT series, ft, bin, sum(sum(r)) OVER w AS ls, sum(count(*)) OVER w AS ln, sum(sum(r)) OVER g AS s, sum(count(*)) OVER g AS n FROM t WHERE split = 'train' GROUP BY series, ft, bin
    WINDOW w AS (PARTITION BY series, ft ORDER BY bin), g AS (PARTITION BY series, ft)),
  v AS (SELECT *, ls::DOUBLE * ls / ln + (s - ls)::DOUBLE * (s - ls) / (n - ln) - s::DOUBLE * s / n AS gain FROM k WHERE ln < n),
  best AS (SELECT series, ft, bin AS cut, cast(round(0.5::DOUBLE * ls / ln) AS bigint) AS low, cast(round(0.5::DOUBLE * (s - ls) / (n - ln)) AS bigint) AS high
    FROM v WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY series ORDER BY gain DESC, ft, bin) = 1)
  SELECT t.series, origin_date, {r('((m + CASE WHEN t.bin > cut THEN best.high ELSE best.low END) / 1073741824::DOUBLE) * b + a')} AS GBR_pred
  FROM t JOIN best ON best.series = t.series AND best.ft = t.ft WHERE split = 'test'""", stage=("p_series5",))
def _(v):
    """The first tree of every series, one cut deep."""
    rows = fc.training_rows(v.p_series5, "sr", ["series"])
    stats = scaling.fit_scaler(rows.where("i < fit_end"), ["sr"], "minmax", ["series"])
    made = fc.gbr_forecast(prepared(v, series=["series"], windows=True), stats, ["sr"], "sr", rounds=1, rate=0.5, depth=1, series=["series"], bins=16)
    return made.select("series", "origin_date", "GBR_pred")


@query("prediction_frame", f"""WITH {samples(5, 5)}, s AS (SELECT min(sr) AS a, max(sr) - min(sr) AS b FROM idx WHERE i < floor(n * 0.7::DOUBLE))
  SELECT origin_date, target_date AS date, cast(5 AS bigint) AS lead, {r('((x - a) / b * 0.5) * b + a')} AS half_pred FROM samples, s WHERE split = 'test'""", stage=("p_series",))
def _(v):
    rows = fc.training_rows(v.p_series, "sr")
    stats = scaling.fit_scaler(rows.where("i < fit_end"), ["sr"])
    test = scaling.attach(prepared(v, 5, 5).where("split = 'test'"), stats)
    scored = test.withColumn("scaled", (F.col("x") - F.col("sr__centre")) / F.col("sr__scale") * 0.5)
    return fc.prediction_frame(scored, "scaled", "sr", 5, "half_pred")


@query("run_comparison", f"""WITH RECURSIVE {archive(5, 1)}, {levels_sql(0.3)}
  SELECT origin_date, date, date AS target_date, lead, cast(1 AS bigint) AS horizon, 'direct' AS forecast_mode, {r('actual')} AS "TRUE", {r('base')} AS Informer_pred,
    {r('x')} AS Persistence_pred, {r(ar_path(1))} AS AR1_pred, {r('level')} AS ETS_pred FROM archive JOIN levels ON levels.i = archive.i, ar""", stage=("p_series", "p_days",))
def _(v):
    raw = stored(stand_in(v).drop("i", "x"))
    return comparison.run_comparison(v.p_series, raw, v.axis, "sr", 1, 5, ["Persistence", "AR(1)", "ETS"], provenance="direct_terminal_target", ets_alpha=0.3)


@query("run_comparison_all_series", f"""WITH {samples(5, 1, 'p_series5', 'series')}, prev AS (SELECT series, i, lag(sr) OVER (PARTITION BY series ORDER BY i) AS before FROM idx),
  ar AS (SELECT series, regr_intercept(y, x) AS c, regr_slope(y, x) AS phi FROM (SELECT series, sr AS y, lag(sr) OVER (PARTITION BY series ORDER BY i) AS x
    FROM idx WHERE i < floor(n * 0.7::DOUBLE)) WHERE x IS NOT NULL GROUP BY series)
  SELECT s.series, origin_date, target_date AS date, {r('target')} AS "TRUE", {r('(x + before) / 2')} AS Informer_pred, {r('x')} AS Persistence_pred, {r(ar_path(1))} AS AR1_pred,
    TRUE AS ets_between, TRUE AS gbr_finite FROM samples s JOIN prev USING (series, i) JOIN ar USING (series) WHERE split = 'test'""", stage=("p_series5", "p_days",))
def _(v):
    """All series and all four models in one plan; smoothing with fitted weights stays within what the series has seen."""
    test = prepared(v, series=["series"], windows=True).where("split = 'test'")
    base = (F.col("window")[4][0] + F.col("window")[3][0]) / 2
    archive_rows = stored(test.select("series", "origin_date", F.col("target_date").alias("date"), F.lit(1).alias("lead"), F.lit("direct").alias("forecast_mode"),
                                      F.col("target").alias("TRUE"), base.alias("Informer_pred")))
    made = comparison.run_comparison(v.p_series5, archive_rows, v.axis, "sr", 1, 5, ["Persistence", "AR(1)", "ETS", "GBR"], FEATURES, provenance="direct_terminal_target",
                                     settings={"GBR": {"n_estimators": 3, "max_depth": 2}}, series=["series"])
    seen = v.p_series5.groupBy("series").agg(F.min("sr").alias("low"), F.max("sr").alias("high"))
    return made.join(seen, "series").select("series", "origin_date", "date", "TRUE", "Informer_pred", "Persistence_pred", "AR1_pred",
                                            F.coalesce(F.col("ETS_pred").between(F.col("low"), F.col("high")), F.lit(False)).alias("ets_between"),
                                            F.coalesce(F.abs("GBR_pred") < float("inf"), F.lit(False)).alias("gbr_finite"))


# Archives

def flawed(v):
    """The archive with one broken rule in every 50th row or so."""
    good = stand_in(v)
    i = F.col("i")
    return good.select(
        F.when(i % 53 == 0, F.date_sub("origin_date", 1)).otherwise(F.col("origin_date")).alias("origin_date"), "date",
        F.when(i % 59 == 0, 5).otherwise(1).alias("lead"), F.when(i % 61 == 0, "joint").otherwise("direct").alias("forecast_mode"),
        (F.col("TRUE") + F.when(i % 67 == 0, 1.0).otherwise(0.0)).alias("TRUE"), "Informer_pred")


@query("validate_series", f"""WITH {archive()}, bad AS (SELECT date, CASE WHEN i % 71 <> 0 THEN base END AS base FROM archive UNION ALL SELECT date, base FROM archive WHERE i % 73 = 0)
  SELECT 'duplicate_dates' AS rule, count(*) - count(DISTINCT date) AS violations FROM bad UNION ALL SELECT 'missing_dates', 0
  UNION ALL SELECT 'nonfinite_TRUE', 0 UNION ALL SELECT 'nonfinite_Informer_pred', count(*) - count(base) FROM bad""", stage=("p_series", "p_days",))
def _(v):
    good = stored(stand_in(v).select("i", "date", "TRUE", "Informer_pred"))
    bad = good.withColumn("Informer_pred", F.when(F.col("i") % 71 != 0, F.col("Informer_pred"))).unionByName(good.where("i % 73 = 0"))
    return arch.series_report(bad, "date", "TRUE", ["Informer_pred"])


@query("audit_archive", f"""WITH {archive()}, f AS (SELECT i, CASE WHEN i % 53 = 0 THEN cast(origin_date - INTERVAL 1 DAY AS date) ELSE origin_date END AS o, date FROM archive)
  SELECT 'forecast_mode' AS rule, count(*) FILTER (WHERE i % 61 = 0) AS violations FROM f UNION ALL SELECT 'lead_matches', count(*) FILTER (WHERE i % 59 = 0) FROM f
  UNION ALL SELECT 'date_alias_conflict', 0 UNION ALL SELECT 'origin_on_calendar', count(*) FILTER (WHERE i % 53 = 0) FROM f UNION ALL SELECT 'finite_values', 0
  UNION ALL SELECT 'target_on_calendar', 0 UNION ALL SELECT 'target_in_data', 0 UNION ALL SELECT 'origin_in_data', 0
  UNION ALL SELECT 'actual_matches_data', count(*) FILTER (WHERE i % 67 = 0) FROM f UNION ALL SELECT 'unique_origin', count(*) - count(DISTINCT o) FROM f
  UNION ALL SELECT 'unique_target', 0 UNION ALL SELECT 'not_empty', 0""", stage=("p_series", "p_days",))
def _(v):
    return arch.audit_rules(stored(flawed(v)), v.p_series, v.axis, 1, "sr")


@query("merge_one_to_one", f"WITH {archive()} SELECT origin_date, date, lead, {r('base')} AS Informer_pred, {r('x')} AS Persistence_pred FROM archive", stage=("p_series",))
def _(v):
    base = stand_in(v)
    addition = fc.persistence(prepared(v).where("split = 'test'")).select("origin_date", F.col("target_date").alias("date"), F.lit(1).alias("lead"), "Persistence_pred")
    return arch.merge_one_to_one(base.select("origin_date", "date", "lead", "Informer_pred"), addition, ["origin_date", "date", "lead"], "Persistence_pred", "Persistence")


@query("keys_contained", f"WITH {samples(5, 1)} SELECT origin_date, target_date AS date FROM samples WHERE split = 'train' AND i % 10 = 0", stage=("p_series",))
def _(v):
    all_samples = prepared(v).withColumnRenamed("target_date", "date")
    claimed = all_samples.where("split = 'test' or i % 10 = 0")
    return arch.keys_outside(claimed, all_samples.where("split = 'test'"), ["origin_date", "date"])


@query("actuals_within_tolerance", f"""WITH {archive()}, a AS (SELECT *, actual + CASE WHEN i % 67 = 0 THEN 1 ELSE 0 END AS t FROM archive)
  SELECT a.date, {r('a.t')} AS "TRUE", {r('s.sr')} AS data_value, abs(s.sr - t) <= 1e-8 + 1e-6 * abs(t) AS within FROM a JOIN p_series s ON s.date = a.date""", stage=("p_series",))
def _(v):
    return arch.actuals_within_tolerance(flawed(v), v.p_series, "sr").select("date", "TRUE", "data_value", "within")


@query("sort_by_keys", """SELECT l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber, count(*) AS lines, row_number() OVER (ORDER BY l_linenumber, l_orderkey) - 1 AS place
  FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def _(v):
    return sorted_rows(v.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("lines")), ["l_linenumber", "l_orderkey"])


# Evaluation

METRICS = f"""count(*) AS n, {r('avg((y - p) * (y - p))')} AS "MSE", {r('sqrt(avg((y - p) * (y - p)))')} AS "RMSE", {r('avg(abs(y - p))')} AS "MAE",
  {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS "R2" """


@query("error_metrics", f"WITH {predictions()} SELECT model, {METRICS} FROM long GROUP BY model", stage=("p_series",))
def _(v):
    return ev.error_metrics(long(v))


SAFE = "CASE WHEN y = 0 THEN 1e-9 ELSE y END"


@query("error_metrics_pct", f"""WITH {predictions()}, z AS (SELECT model, CASE WHEN day(date) = 31 THEN 'val' ELSE 'test' END AS split,
    CASE WHEN day(date) % 29 = 0 THEN 0 ELSE y END AS y, p FROM long)
  SELECT model, split, {r('avg((y - p) * (y - p))')} AS "MSE", {r('avg(abs(y - p))')} AS "MAE", {r('sqrt(avg((y - p) * (y - p)))')} AS "RMSE",
  {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS "R2", {r(f'log10(avg(abs((y - p) / {SAFE})) * 100)')} AS "MAPE",
  {r(f'log10(avg(((y - p) / {SAFE}) * ((y - p) / {SAFE})) * 100)')} AS "MSPE" FROM z GROUP BY model, split""", stage=("p_series",))
def _(v):
    z = long(v).select("model", F.when(F.dayofmonth("date") == 31, "val").otherwise("test").alias("split"),
                       F.when(F.dayofmonth("date") % 29 == 0, 0.0).otherwise(F.col("y")).alias("y"), "p")
    return ev.error_metrics_pct(z).withColumns({c: F.log10(c) for c in ("MAPE", "MSPE")})  # a zero actual makes both huge


@query("error_metrics_raw", f"""WITH {predictions()} SELECT model, {r('avg(abs(y - p))')} AS "MAE", {r('avg((y - p) * (y - p))')} AS "MSE",
  {r('sqrt(avg((y - p) * (y - p)))')} AS "RMSE", {r('avg(abs((y - p) / y))')} AS "MAPE", {r('avg(((y - p) / y) * ((y - p) / y))')} AS "MSPE" FROM long GROUP BY model""", stage=("p_series",))
def _(v):
    return ev.error_metrics_raw(long(v))


@query("rse_corr", f"""WITH {predictions()}, m AS (SELECT model, avg(y) AS my, avg(p) AS mp FROM long GROUP BY model)
  SELECT model, {r('sqrt(sum((y - p) * (y - p))) / sqrt(sum((y - my) * (y - my)))')} AS RSE,
  {r('sum((y - my) * (p - mp)) / sqrt(sum((y - my) * (y - my) * (p - mp) * (p - mp)))')} AS CORR FROM long JOIN m USING (model) GROUP BY model""", stage=("p_series",))
def _(v):
    return ev.rse_corr(long(v))


def dm_sql(lags=5, lead=1) -> str:
    return predictions(lags, lead) + """,
 d AS (SELECT c.criterion, k.model, CASE c.criterion WHEN 'MAD' THEN abs(b.y - b.p) - abs(k.y - k.p) ELSE (b.y - b.p) ** 2 - (k.y - k.p) ** 2 END AS d
   FROM long b JOIN long k ON k.date = b.date AND b.model = 'Informer' AND k.model <> 'Informer', (SELECT unnest(['MAD', 'MSE']) AS criterion) c),
 dm AS (SELECT criterion, model, count(*) AS n, avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1) / count(*)) AS statistic FROM d GROUP BY ALL)"""


@query("dm_statistic", f"WITH {dm_sql(10, 5)} SELECT criterion, model, n, {r('statistic')} AS statistic FROM dm", stage=("p_series",))
def _(v):
    return ev.dm_statistics(wide(v, 10, 5), "TRUE", "Informer_pred", PREDS[1:])


@query("dm_p_value", f"WITH {dm_sql(10, 5)} SELECT criterion, model, n, {r('statistic')} AS statistic, {r(t_test_p('statistic', 'n - 1'))} AS p_value FROM dm", stage=("p_series",))
def _(v):
    return ev.dm_tests(wide(v, 10, 5), "TRUE", "Informer_pred", PREDS[1:])


@query("dm_table", f"""WITH {dm_sql()}, t AS (SELECT *, {t_test_p('statistic', 'n - 1')} AS p FROM dm),
  c AS (SELECT criterion, model, printf('%.3f', statistic) || CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.10 THEN '*' ELSE '' END AS cell FROM t)
  SELECT criterion, max(cell) FILTER (WHERE model = 'Persistence') AS Persistence, max(cell) FILTER (WHERE model = 'AR1') AS "AR1" FROM c GROUP BY criterion""", stage=("p_series",))
def _(v):
    return ev.dm_table(ev.dm_tests(wide(v), "TRUE", "Informer_pred", PREDS[1:]), ["Persistence", "AR1"])
