"""Panels, weighted aggregates, macro predictors and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.functions import signals
from paneltide.operators import panel, posts as posts_ops
from paneltide.plans.datasets import forecasting_datasets
from paneltide.schema import MACRO_FEATURES
from paneltide.sources.panels import inner_join_tables

from .registry import cols, query, r
from .sql_parts import FEATURES, MACRO, STATS, STATS_COLUMNS, WEIGHTED_AVERAGE, weighted

MACRO_NAMES = {
    signals.GOV_3M: "gov3m", signals.GOV_6M: "gov6m", signals.GOV_10Y: "gov10y", signals.CORP_AAA_10Y: "corp10y",
    signals.INTERBANK_3M: "ib3m", signals.VOLATILITY: "volatility", signals.LOG_RETURN: "log_return",
}
PREDICTORS = ["risk_receiving", "risk_spillover", "net_risk_value", "pe", "pb", "ps", "pc"]
WIDE = ", ".join(PREDICTORS)
NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in MACRO_FEATURES)


def macro_sources(v):
    return [v.p_macro, v.p_interbank, v.p_market]


def macro(v):
    return panel.macro_features(v.p_panel.select("date").distinct(), macro_sources(v), MACRO_NAMES)


@query("cap_weighted_average", f"WITH {weighted({'sr': 'covar', 'receiving': 'risk_receiving'})} SELECT date, {cols('sr', 'receiving')} FROM agg", stage=("p_panel",))
def _(v):
    return panel.cap_weighted_average(v.p_panel, v.p_panel, v.p_map, {"sr": "covar", "receiving": "risk_receiving"})


@query("lag_panel", f"""WITH axis AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM p_panel)),
  l AS (SELECT a.nxt AS date, p.bank, p.cap AS cap_lag FROM p_panel p JOIN axis a ON a.date = p.date WHERE a.nxt IS NOT NULL)
  SELECT date, bank, {r('p.cap', 2)} AS cap, {r('l.cap_lag', 2)} AS cap_lag FROM p_panel p FULL JOIN l USING (date, bank)""", digits=2, stage=("p_panel",))
def _(v):
    return panel.lag_panel(v.p_panel, "cap", "cap_lag")


@query("ffill_observed", f"WITH {MACRO} SELECT date, {cols('gov3m', 'gov6m', 'gov10y', 'corp10y', 'ib3m', 'volatility', 'log_return')} FROM mfill")
def _(v):
    return panel.carry_forward(v.p_panel.select("date").distinct(), macro_sources(v))


@query("assemble_bank_panel", f"""WITH {MACRO} SELECT p.date, p.bank, {r('-100.0 * covar')} AS target, {cols(*PREDICTORS)}, {cols(*MACRO_FEATURES)}
  FROM p_panel p LEFT JOIN macro m ON m.date = p.date WHERE {NOT_NULL}""", stage=("p_panel",))
def _(v):
    predictors = [v.p_panel.select("date", "bank", *PREDICTORS[:3]), v.p_panel.select("date", "bank", *PREDICTORS[3:])]
    return panel.assemble_entity_panel(v.p_panel, predictors, macro(v), "covar")


SYSTEM = weighted({"target": "covar", **{p: p for p in PREDICTORS}}, {"covar": -100.0})


@query("assemble_system_panel", f"""WITH {SYSTEM}, {MACRO} SELECT a.date, {r('target')} AS target, {cols(*PREDICTORS)}, {cols(*MACRO_FEATURES)}
  FROM agg a LEFT JOIN macro m ON m.date = a.date WHERE {NOT_NULL} AND target IS NOT NULL""", stage=("p_panel",))
def _(v):
    return panel.assemble_system_panel(v.p_panel, v.p_panel, v.p_map, "covar", {p: p for p in PREDICTORS}, macro(v), target_out="target")


SHIFTED = "SELECT s.*, cast(s.pub_day - INTERVAL 9000 DAY AS date) AS day FROM stats s"


def shifted_stats(v):
    """Posts are from 2024, panels end earlier: move the sentiment days into the range of the panel."""
    stats = posts_ops.daily_sentiment_stats(posts_ops.clean_posts(v.p_posts))
    return stats.withColumn("pub_day", F.date_sub("pub_day", 9000))


@query("merge_sentiment", f"""WITH {STATS}, sh AS ({SHIFTED}), named AS (SELECT m.bank, sh.* FROM sh JOIN p_map m USING (bank_code))
  SELECT p.date, p.bank, {r('p.covar')} AS covar, {FEATURES} FROM p_panel p JOIN named n ON n.bank = p.bank AND n.day = p.date""")
def _(v):
    return panel.merge_sentiment(v.p_panel.select("date", "bank", "covar"), posts_ops.entity_sentiment(shifted_stats(v), v.p_map), ["date", "bank"])


@query("common_entities", """WITH names AS (SELECT c_custkey AS bank_code, c_name AS bank, cast(c_nationkey AS bigint) AS ord FROM customer)
  SELECT bank_code, bank, ord FROM names WHERE bank IN (SELECT concat('Customer#', lpad(cast(o_custkey AS string), 9, '0')) FROM orders)
    AND bank IN (SELECT concat('Customer#', lpad(cast(l_suppkey AS string), 9, '0')) FROM lineitem)""")
def _(v):
    named = lambda t, key: t.select(F.concat(F.lit("Customer#"), F.lpad(F.col(key).cast("string"), 9, "0")).alias("bank"))
    mapping = v.customer.select(F.col("c_custkey").alias("bank_code"), F.col("c_name").alias("bank"), F.col("c_nationkey").cast("bigint").alias("ord"))
    return panel.common_entities(mapping, named(v.orders, "o_custkey"), named(v.lineitem, "l_suppkey"), strict=True)


@query("date_intersection", "SELECT DISTINCT date FROM p_panel WHERE date IN (SELECT date FROM p_macro)")
def _(v):
    return panel.common_dates(v.p_panel, v.p_macro)


@query("inner_join_three", f"""SELECT a.date, {r('a.gov10y')} AS Yield, {r('b.skew')} AS TurnoverRate, {r('c.sr')} AS delteCoVaR
  FROM p_macro a JOIN p_signal b ON b.date = a.date JOIN p_series c ON c.date = a.date""")
def _(v):
    return inner_join_tables([v.p_macro.select("date", "gov10y"), v.p_signal.select("date", "skew"), v.p_series.select("date", "sr")],
                             {"gov10y": "Yield", "skew": "TurnoverRate", "sr": "delteCoVaR"})


FEATURE_NAMES = ["Total_Count", "Emotional_Skew", "Weighted_Emotional_Skew_Read", "Weighted_Emotional_Skew_Comment"]
NULL_FEATURES = ", ".join(f"NULL AS {c}" for c in FEATURE_NAMES)


@query("build_all_datasets", f"""WITH {SYSTEM}, {MACRO}, {STATS}, sh AS ({SHIFTED}),
  named AS (SELECT m.bank, sh.day, {FEATURES} FROM sh JOIN p_map m USING (bank_code)),
  tot AS (SELECT day, {", ".join(f"sum({c}) AS {c}" for c in STATS_COLUMNS)} FROM sh GROUP BY day),
  overall AS (SELECT day, {FEATURES} FROM tot),
  ent AS (SELECT p.date, p.bank, -100.0 * covar AS target, {WIDE}, {", ".join(MACRO_FEATURES)} FROM p_panel p JOIN macro m ON m.date = p.date
    WHERE {NOT_NULL} AND p.bank IN (SELECT bank FROM p_map)),
  sys AS (SELECT a.date, 'ALL' AS bank, target, {WIDE}, {", ".join(MACRO_FEATURES)} FROM agg a JOIN macro m ON m.date = a.date WHERE {NOT_NULL} AND target IS NOT NULL),
  leg AS (SELECT date, 'ALL' AS bank, target, {", ".join(f"NULL AS {c}" for c in PREDICTORS + MACRO_FEATURES)} FROM agg WHERE target IS NOT NULL),
  pieces AS (SELECT 'without' AS variant, ent.*, {NULL_FEATURES} FROM ent
    UNION ALL SELECT 'with', ent.*, {", ".join("n." + c for c in FEATURE_NAMES)} FROM ent JOIN named n ON n.bank = ent.bank AND n.day = ent.date
    UNION ALL SELECT 'without', sys.*, {NULL_FEATURES} FROM sys
    UNION ALL SELECT 'with', sys.*, {", ".join("o." + c for c in FEATURE_NAMES)} FROM sys JOIN overall o ON o.day = sys.date
    UNION ALL SELECT 'legacy_without', leg.*, {NULL_FEATURES} FROM leg
    UNION ALL SELECT 'legacy_with', leg.*, {", ".join("o." + c for c in FEATURE_NAMES)} FROM leg JOIN overall o ON o.day = leg.date)
  SELECT variant, bank, date, {cols('target', *PREDICTORS, *MACRO_FEATURES, *FEATURE_NAMES)} FROM pieces""", stage=("p_panel",))
def _(v):
    target = v.p_panel.select("date", "bank", F.col("covar").alias("target"))
    return forecasting_datasets(target, [v.p_panel.select("date", "bank", *PREDICTORS)], v.p_panel.select("date", "bank", "cap"), v.p_map,
                                shifted_stats(v), macro_sources(v), macro_names=MACRO_NAMES)
