"""Report tables and figure data."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.operators import evaluation as ev, reports as rp
from paneltide.operators.scaling import standardize

from .forecasts import PREDS, dm_sql, long, wide
from .registry import cols, query, r
from .sql_parts import predictions, t_test_p

AVG = """avg_m AS (SELECT bank, spec, avg(MSE) AS MSE, avg(MAE) AS MAE, avg(RMSE) AS RMSE, avg(R2) AS R2 FROM p_metrics WHERE split = 'test' GROUP BY ALL)"""


@query("descriptive_stats", f"""WITH l AS (SELECT 'sr' AS indicator, sr AS v FROM p_series_sent UNION ALL SELECT 'skew', skew FROM p_series_sent UNION ALL SELECT 'posts', posts FROM p_series_sent)
  SELECT indicator, {r('avg(v)')} AS mean, {r('stddev_samp(v)')} AS std, {r('min(v)')} AS min, {r('max(v)')} AS max FROM l GROUP BY indicator""")
def _(v):
    return rp.descriptive_stats(v.p_series_sent, ["sr", "skew", "posts"])


@query("lag_feature", f"SELECT date, {r('lag(skew) OVER (ORDER BY date)')} AS skew_lag1, {r('lag(posts) OVER (ORDER BY date)')} AS posts_lag1 FROM p_series_sent", stage=("p_series_sent",))
def _(v):
    return rp.lag_feature(v.p_series_sent, ["skew", "posts"], 1).select("date", "skew_lag1", "posts_lag1")


CORR = """lagged AS (SELECT *, lag(skew, 1) OVER (ORDER BY date) AS s1, lag(posts, 1) OVER (ORDER BY date) AS p1 FROM p_series_sent),
  pairs AS (SELECT 'sr' AS risk_variable, 'skew_lag1' AS lagged_variable, sr AS a, s1 AS b FROM lagged UNION ALL SELECT 'sr', 'posts_lag1', sr, p1 FROM lagged
    UNION ALL SELECT 'feature2', 'skew_lag1', feature2, s1 FROM lagged UNION ALL SELECT 'feature2', 'posts_lag1', feature2, p1 FROM lagged)"""


@query("lagged_correlation", f"""WITH {CORR} SELECT risk_variable, lagged_variable, count(*) AS n, {r('corr(a, b)')} AS correlation FROM pairs
  WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""", stage=("p_series_sent",))
def _(v):
    return rp.lagged_correlation(v.p_series_sent, ["sr", "feature2"], ["skew", "posts"], 1)


@query("correlation_p_value", f"""WITH {CORR}, c AS (SELECT risk_variable, lagged_variable, count(*) AS n, corr(a, b) AS c FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
  t AS (SELECT *, c * sqrt((n - 2) / (1 - c * c)) AS t FROM c)
  SELECT risk_variable, lagged_variable, n, {r('c')} AS correlation, {r(t_test_p('t', 'n - 2'))} AS p_value FROM t""", stage=("p_series_sent",))
def _(v):
    return rp.with_correlation_p(rp.lagged_correlation(v.p_series_sent, ["sr", "feature2"], ["skew", "posts"], 1))


@query("average_over_iterations", f"WITH {AVG} SELECT bank, spec, {cols('MSE', 'MAE', 'RMSE', 'R2')} FROM avg_m")
def _(v):
    return ev.average_over_iterations(v.p_metrics)


SAVED = """saved AS (SELECT bank, (max(MSE) FILTER (WHERE spec = 'without') - max(MSE) FILTER (WHERE spec = 'with')) / nullif(max(MSE) FILTER (WHERE spec = 'without'), 0) AS MSE,
  (max(MAE) FILTER (WHERE spec = 'without') - max(MAE) FILTER (WHERE spec = 'with')) / nullif(max(MAE) FILTER (WHERE spec = 'without'), 0) AS MAE FROM avg_m GROUP BY bank)"""


@query("error_reduction", f"""WITH {AVG}, {SAVED} SELECT bank, spec, {cols('MSE', 'MAE', 'RMSE', 'R2')} FROM avg_m
  UNION ALL SELECT bank, 'reduction', {r('MSE')}, {r('MAE')}, NULL, NULL FROM saved""")
def _(v):
    return rp.error_reduction(v.p_metrics)


@query("extreme_metrics", f"""WITH m AS (SELECT *, MAE * iteration AS MAPE, MSE / iteration AS MSPE FROM p_metrics)
  SELECT bank, spec, {", ".join(f"{r(f'CASE spec WHEN {chr(39)}without{chr(39)} THEN {a}({m}) ELSE {b}({m}) END')} AS {m}" for m, a, b in
  (('MSE', 'max', 'min'), ('MAE', 'max', 'min'), ('RMSE', 'max', 'min'), ('R2', 'min', 'max'), ('MAPE', 'max', 'min'), ('MSPE', 'max', 'min')))} FROM m WHERE split = 'test' GROUP BY bank, spec""")
def _(v):
    return rp.extreme_metrics(v.p_metrics.withColumns({"MAPE": F.col("MAE") * F.col("iteration"), "MSPE": F.col("MSE") / F.col("iteration")}))


BY_RUN = """runs AS (SELECT bank, spec, concat('run', cast(iteration AS string)) AS model, MSE, MAE FROM p_metrics),
  ml AS (SELECT bank, spec, model, 'MSE' AS metric, MSE AS v FROM runs UNION ALL SELECT bank, spec, model, 'MAE', MAE FROM runs)"""


def by_run(v):
    return v.p_metrics.select("bank", "spec", F.concat(F.lit("run"), F.col("iteration").cast("string")).alias("model"), "MSE", "MAE")


@query("best_comparator_improvement", f"""WITH {BY_RUN}, a AS (SELECT bank, spec, metric, max(v) FILTER (WHERE model = 'run1') AS baseline, min(v) FILTER (WHERE model <> 'run1') AS best,
    min_by(model, v) FILTER (WHERE model <> 'run1') AS best_model FROM ml GROUP BY ALL)
  SELECT bank, spec, metric, {r('baseline')} AS baseline, {r('best')} AS best, best_model, {r('(best - baseline) / best * 100')} AS improvement FROM a""")
def _(v):
    return rp.best_comparator_improvement(by_run(v), "run1", [f"run{k}" for k in range(2, 8)], ["bank", "spec"])


@query("quantile_cuts", f"SELECT p, {r('quantile_cont(sr, p)')} AS q FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS p), (SELECT sr FROM p_series) GROUP BY p"
       .replace("quantile_cont(sr, p)", "CASE p WHEN 0 THEN min(sr) WHEN 0.25 THEN quantile_cont(sr, 0.25) WHEN 0.5 THEN quantile_cont(sr, 0.5) WHEN 0.75 THEN quantile_cont(sr, 0.75) ELSE max(sr) END"))
def _(v):
    return rp.exact_quantiles(v.p_series, "sr")


@query("quantile_bin", f"""WITH e AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS c FROM lineitem)
  SELECT l_quantity, cast(CASE WHEN l_quantity <= a THEN 0 WHEN l_quantity <= b THEN 1 WHEN l_quantity <= c THEN 2 ELSE 3 END AS bigint) AS risk, count(*) AS n
  FROM lineitem, e GROUP BY ALL""")
def _(v):
    return rp.quantile_bin(v.lineitem.select("l_quantity"), "l_quantity").groupBy("l_quantity", "risk").agg(F.count(F.lit(1)).alias("n"))


Z = "z AS (SELECT date, (sr - avg(sr) OVER ()) / stddev_samp(sr) OVER () AS sr, (skew - avg(skew) OVER ()) / stddev_samp(skew) OVER () AS skew FROM p_series_sent)"


@query("standardize", f"WITH {Z} SELECT date, {cols('sr', 'skew')} FROM z", stage=("p_series_sent",))
def _(v):
    return standardize(v.p_series_sent.select("date", "sr", "skew"), ["sr", "skew"])


@query("monthly_resample", f"""WITH {Z}, q AS (SELECT * FROM z), m AS (SELECT last_day(date) AS month, avg(sr) AS sr, avg(skew) AS skew FROM q GROUP BY 1),
  span AS (SELECT last_day(cast(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS date)) AS month FROM q)
  SELECT span.month, {r('m.sr')} AS sr, {r('m.skew')} AS skew FROM span LEFT JOIN m ON m.month = span.month""", stage=("p_series_sent",))
def _(v):
    z = standardize(v.p_series_sent.select("date", "sr", "skew"), ["sr", "skew"])
    return rp.monthly_means(z, ["sr", "skew"])


@query("fixed_order_reindex", f"""SELECT s_suppkey AS ord, concat('B', lpad(cast(s_suppkey AS string), 2, '0')) AS bank, {r('m.MAE')} AS MAE FROM supplier
  LEFT JOIN (SELECT bank, avg(MAE) AS MAE FROM p_metrics GROUP BY bank) m ON m.bank = concat('B', lpad(cast(s_suppkey AS string), 2, '0'))""")
def _(v):
    order = v.supplier.select(F.concat(F.lit("B"), F.lpad(F.col("s_suppkey").cast("string"), 2, "0")).alias("bank"), F.col("s_suppkey").alias("ord"))
    return rp.fixed_order(v.p_metrics.groupBy("bank").agg(F.avg("MAE").alias("MAE")), "bank", order)


@query("first_seen_order", "SELECT event_type, min(event_id) AS first_row FROM events GROUP BY event_type")
def _(v):
    return rp.first_seen_order(v.events, "event_type", "event_id")


@query("best_model", f"WITH {BY_RUN} SELECT bank, spec, metric, min_by(model, v) AS model, {r('min(v)')} AS v FROM ml GROUP BY ALL")
def _(v):
    runs = by_run(v)
    cells = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("MSE", "MAE")]))
    return rp.best_model(runs.select("bank", "spec", "model", cells), ["bank", "spec", "metric"], "model", "v")


def _tests(lead: int) -> str:
    return f"""(WITH {dm_sql(5, lead)}, t AS (SELECT *, {t_test_p('statistic', 'n - 1')} AS p FROM dm),
      c AS (SELECT criterion, model, printf('%.3f', statistic) || CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.10 THEN '*' ELSE '' END AS cell FROM t)
      SELECT '{lead}' AS part, CASE criterion WHEN 'MAD' THEN 'MAE' ELSE criterion END AS line, '' AS Informer, max(cell) FILTER (WHERE model = 'Persistence') AS Persistence,
        max(cell) FILTER (WHERE model = 'AR1') AS "AR1", '' AS IMP FROM c GROUP BY criterion)"""


_CELL = "printf('{f}', max({m}) FILTER (WHERE model = '{k}'))"
_IMP = "printf('%.2f%%', (min({m}) FILTER (WHERE model <> 'Informer') - max({m}) FILTER (WHERE model = 'Informer')) / min({m}) FILTER (WHERE model <> 'Informer') * 100)"


@query("report_tables", f"""WITH errors AS (SELECT * FROM (WITH {predictions()}, m AS (SELECT model, avg((y - p) * (y - p)) AS MSE, avg(abs(y - p)) AS MAE FROM long GROUP BY model)
    {" UNION ALL ".join(f"SELECT 'errors' AS part, '{m}' AS line, " + ", ".join(f'{_CELL.format(f=f, m=m, k=k)} AS "{k}"' for k in ("Informer", "Persistence", "AR1")) + f", {_IMP.format(m=m)} AS IMP FROM m"
                        for m, f in (("MSE", "%.2e"), ("MAE", "%.3f")))}))
  SELECT * FROM errors UNION ALL SELECT * FROM {_tests(1)} UNION ALL SELECT * FROM {_tests(5)}""", stage=("p_series",))
def _(v):
    models = ["Persistence", "AR1"]
    errors = rp.published_comparison(ev.error_metrics(long(v)), ["Informer", *models], "Informer").select(F.lit("errors").alias("part"), "*")
    tests = rp.published_tests({str(h): ev.dm_tests(wide(v, 5, h), "TRUE", "Informer_pred", PREDS[1:], strict=True) for h in (1, 5)}, models)
    blank = F.lit("")
    return errors.unionByName(tests.select(F.col("horizon").alias("part"), "line", blank.alias("Informer"), *models, blank.alias("IMP")))


@query("side_by_side", f"""WITH {AVG}, o AS (SELECT bank, ord, (SELECT count(*) FROM p_map) AS n FROM p_map), p AS (SELECT a.*, o.ord, cast(ceil(n / 2) AS bigint) AS h FROM avg_m a JOIN o USING (bank)),
  l AS (SELECT ord AS block, spec, bank, MSE, MAE FROM p WHERE ord < h), q AS (SELECT ord - h AS block, spec, bank, MSE, MAE FROM p WHERE ord >= h)
  SELECT block, spec, l.bank AS "left", {r('l.MSE')} AS left_MSE, {r('l.MAE')} AS left_MAE, q.bank AS "right", {r('q.MSE')} AS right_MSE, {r('q.MAE')} AS right_MAE
  FROM l FULL JOIN q USING (block, spec)""")
def _(v):
    rows = ev.average_over_iterations(v.p_metrics)
    return rp.side_by_side(rows, v.p_map.select("bank", "ord"), "bank", ["MSE", "MAE"], "spec")


@query("figure_series", f"WITH {predictions()} SELECT date, CASE model WHEN 'Informer' THEN 'baseline' ELSE model END AS model, {r('y')} AS observed, {r('p')} AS forecast FROM long", stage=("p_series",))
def _(v):
    return rp.figure_series(wide(v), "TRUE", PREDS, baseline="Informer_pred")
