"""Sources and sinks: data Spark derives from the tables is written, then read back through the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide.functions.text import DEFAULT_INSTRUCTION
from paneltide.operators.archive import read_forecasting_data, resolve_aliases
from paneltide.operators.grid import collect_metrics, experiment_grid, read_run_metrics, setting_name
from paneltide.operators.sampling import stratified_split
from paneltide.operators.samples import prepare_samples
from paneltide.session import scratch_path
from paneltide.sources import panels, records, tables

from .configs import GRID_SQL, JOBS, jobs_for
from .registry import big, cols, query, r
from .sql_parts import samples

BANKS = [f"B{b:02d}" for b in range(14)]


@query("read_csv_auto", """SELECT cast(doc_id AS string) AS doc_id, text, CASE WHEN doc_id % 2 = 0 THEN source END AS source FROM documents""")
def _(v):
    folder = scratch_path(v.spark, "mixed")
    docs = v.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")
    tables.write_csv(docs.where("doc_id % 2 = 0"), f"{folder}/utf")
    v.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    docs.where("doc_id % 2 = 1").select("text", "doc_id").write.option("header", True).option("escape", '"').option("encoding", "GB18030").csv(f"{folder}/gb")
    return tables.read_csv_auto(v.spark, [f"{folder}/utf", f"{folder}/gb"]).select("doc_id", "text", "source")


@query("write_csv", "SELECT doc_id, text, lang FROM documents")
def _(v):
    path = tables.write_csv(v.documents.select("doc_id", "text", "lang"), scratch_path(v.spark, "sink"))
    return tables.read_csv_auto(v.spark, path, encoding="UTF-8").select(F.col("doc_id").cast("bigint"), "text", "lang")


@query("merge_prediction_files", """SELECT cast(doc_id AS string) AS doc_id, text, CASE WHEN lang = 'en' THEN NULL ELSE source END AS source FROM documents""")
def _(v):
    folder = scratch_path(v.spark, "parts")
    docs = v.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source", "lang")
    tables.write_csv(docs.where("lang = 'en'").select("doc_id", "text"), f"{folder}/a")
    tables.write_csv(docs.where("lang <> 'en' OR lang IS NULL").select("source", "doc_id", "text"), f"{folder}/b")
    return tables.merge_prediction_files(v.spark, f"{folder}/*/*.csv").select("doc_id", "text", "source")


@query("audit_inputs", """SELECT 'panel' AS name, TRUE AS "exists", TRUE AS sized, count(*) AS records FROM documents
  UNION ALL SELECT 'posts', TRUE, TRUE, count(*) FROM p_posts UNION ALL SELECT 'absent', FALSE, FALSE, NULL""")
def _(v):
    folder = scratch_path(v.spark, "audit")
    tables.write_csv(v.documents.select("doc_id", "text"), f"{folder}/panel")
    tables.write_csv(v.p_posts.select("post_id", "predict"), f"{folder}/posts")
    found = tables.audit_inputs(v.spark, {"panel": f"{folder}/panel/*.csv", "posts": f"{folder}/posts/*.csv", "absent": f"{folder}/none/*.csv"})
    return found.select("name", "exists", F.coalesce(F.col("size_bytes") > 0, F.lit(False)).alias("sized"), "records")


@query("panel_long", f"""
  SELECT d.date, b.bank, i.indicator, {r("CASE i.indicator WHEN 'cap' THEN p.cap ELSE p.pe END", 2)} AS value
  FROM (SELECT DISTINCT date FROM p_panel) d, (SELECT unnest({BANKS!r}) AS bank) b, (SELECT unnest(['cap', 'pe']) AS indicator) i
  LEFT JOIN p_panel p ON p.date = d.date AND p.bank = b.bank""", digits=2)
def _(v):
    folder = scratch_path(v.spark, "prices")
    wide = v.p_panel.groupBy("date").pivot("bank", BANKS).agg(F.first("cap").alias("cap"), F.first("pe").alias("pe"))
    cells = [(b, i) for b in BANKS for i in ("cap", "pe")]
    rows = wide.select(F.col("date").cast("string").alias("c0"), *[F.col(f"{b}_{i}").cast("string").alias(f"c{n}") for n, (b, i) in enumerate(cells, 1)])
    heads = [["date"] + ["板块, \"银行\"\n一"] * len(cells), ["date"] + [b for b, _ in cells], ["date"] + ["总市值(元)" if i == "cap" else "市盈率" for _, i in cells]]
    rows = rows.select("*", F.lit(len(heads)).alias("line"), F.month("c0").alias("month"))
    top = v.spark.createDataFrame([(*h, n, m) for m in range(1, 13) for n, h in enumerate(heads)], rows.schema)
    v.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    whole = top.unionByName(rows).repartition("month").sortWithinPartitions("month", "line", "c0").drop("line")
    whole.write.partitionBy("month").option("encoding", "GB18030").option("escape", '"').csv(folder)
    panel = panels.read_price_panel(v.spark, f"{folder}/*/*.csv")
    return panel.withColumn("indicator", F.when(F.col("indicator") == "总市值(元)", "cap").otherwise("pe"))


@query("unpivot_panel", f"""
  SELECT w.date, m.bank, {r("p.risk_spillover")} AS value FROM (SELECT date FROM p_panel_wide) w CROSS JOIN p_map m
  LEFT JOIN p_panel p ON p.date = w.date AND p.bank = m.bank""")
def _(v):
    return panels.unpivot_panel(v.p_panel_wide, "date", v.p_map)


@query("read_mapping", """SELECT c_custkey AS bank_code, concat('银行', cast(c_custkey AS string)) AS bank,
  row_number() OVER (ORDER BY c_custkey % 2, c_custkey) - 1 AS ord FROM customer""")
def _(v):
    folder = scratch_path(v.spark, "mapping")
    named = v.customer.select(F.col("c_custkey").alias("bank_code"), F.concat(F.lit("银行"), F.col("c_custkey").cast("string")).alias("bank"))
    v.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for half in (0, 1):
        part = named.where(F.col("bank_code") % 2 == half).repartitionByRange(4, "bank_code").sortWithinPartitions("bank_code")
        part.write.option("header", True).option("encoding", "GB18030").csv(f"{folder}/{half}")
    return panels.read_mapping(v.spark, f"{folder}/*/*.csv")


SPLIT_SQL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42-', cast(doc_id AS string))), doc_id) AS rk,
  count(*) OVER (PARTITION BY y) AS n FROM p_class),
 flagged AS (SELECT *, rk <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS is_val FROM ranked)"""


@query("instruction_sink", f"""WITH {SPLIT_SQL}, said AS (SELECT *, CASE WHEN is_val THEN 'val' ELSE 'train' END AS part FROM flagged)
  SELECT part, 'json' AS kind, '{DEFAULT_INSTRUCTION}' AS instruction, NULL::BIGINT AS doc_id, text AS input, CASE y WHEN -1 THEN '负面' WHEN 0 THEN '中性' ELSE '正面' END AS output FROM said
  UNION ALL SELECT part, 'csv', NULL, doc_id, text, cast(y AS string) FROM said""")
def _(v):
    """Both halves are read back: the instruction records and the CSV tables."""
    flagged = stratified_split(v.p_class.select("doc_id", "text", "y"), "y", "doc_id", 0.1)
    written = records.write_split(flagged, "text", "y", "is_val", scratch_path(v.spark, "split"))
    parts = []
    for p in ("train", "val"):
        json_rows = records.read_instructions(v.spark, written[f"{p}_json"])
        parts.append(json_rows.select(F.lit(p).alias("part"), F.lit("json").alias("kind"), "instruction", F.lit(None).cast("bigint").alias("doc_id"), "input", "output"))
        csv_rows = tables.read_csv_auto(v.spark, written[f"{p}_csv"])
        parts.append(csv_rows.select(F.lit(p).alias("part"), F.lit("csv").alias("kind"), F.lit(None).cast("string").alias("instruction"), F.col("doc_id").cast("bigint"),
                                     F.col("text").alias("input"), F.col("y").alias("output")))
    return tables.union_tables(parts)


@query("instruction_source", f"""
  SELECT '{DEFAULT_INSTRUCTION}' AS instruction, text AS input, CASE WHEN n_chars % 2 = 0 THEN '正面' ELSE '中性' END AS output FROM documents""")
def _(v):
    folder = scratch_path(v.spark, "records")
    docs = v.documents.withColumn("label", F.when(F.col("n_chars") % 2 == 0, 1).otherwise(0))
    for name, part in (("a", docs.where("lang = 'en'")), ("b", docs.where("lang <> 'en' or lang is null"))):
        records.instruction_records(part, "text", "label").write.json(f"{folder}/{name}")
    return records.read_instructions(v.spark, [f"{folder}/a", f"{folder}/b"])


@query("read_forecasting_data", f"SELECT date, {cols('sr', 'feature', 'feature2')} FROM p_series")
def _(v):
    raw = v.p_series.select(
        F.col("date").cast("string").alias("date"), "feature2", F.col("feature").cast("string").alias("feature"), "sr", F.lit("text").alias("note"))
    return read_forecasting_data(raw, "date", "sr", ["feature", "feature2", "note", "feature"])


@query("collect_metrics", f"""WITH grid AS ({GRID_SQL}), metrics AS (
    SELECT concat('informer_direct_ftMS_sl5_ll2_pl1_dm512_nh8_el2_dl1_df2048_atprob_fc5_ebtimeF_dtTrue_mxTrue_path', bank, '_', spec,
      '.csv_run_', bank, '_', spec, '_', cast(iteration AS string), '_1_lead1') AS setting, MSE, MAE, RMSE, R2, split FROM p_metrics)
  SELECT g.bank, g.spec, cast(g.iteration AS bigint) AS iteration, g.setting, m.split, {cols('MSE', 'MAE', 'RMSE', 'R2')}
  FROM grid g JOIN metrics m ON m.setting = g.setting""")
def _(v):
    grid = experiment_grid(jobs_for(v.spark, JOBS), v.p_map).withColumn("setting", setting_name())
    name = F.concat(F.lit("informer_direct_ftMS_sl5_ll2_pl1_dm512_nh8_el2_dl1_df2048_atprob_fc5_ebtimeF_dtTrue_mxTrue_path"), "bank",
                    F.lit("_"), "spec", F.lit(".csv_run_"), "bank", F.lit("_"), "spec", F.lit("_"), F.col("iteration").cast("string"), F.lit("_1_lead1"))
    folder = scratch_path(v.spark, "runs")
    made = v.p_metrics.withColumn("setting", name).select("setting", "MSE", "MAE", "RMSE", "R2", "split")
    made.write.partitionBy("setting").option("header", True).csv(folder)
    metrics = read_run_metrics(v.spark, folder, "MSE double, MAE double, RMSE double, R2 double, split string", file="*.csv")
    metrics = metrics.withColumn("setting", F.replace("setting", F.lit("setting="), F.lit("")))
    return collect_metrics(grid, metrics).select("bank", "spec", "iteration", "setting", "split", "MSE", "MAE", "RMSE", "R2")


@query("merge_evaluations", f"""
  SELECT split AS dataset, bank AS model_name, {r('avg(R2)')} AS accuracy, {r('avg(MSE)')} AS precision, {r('avg(MAE)')} AS recall,
    {r('avg(RMSE)')} AS f1 FROM p_metrics GROUP BY split, bank""")
def _(v):
    made = v.p_metrics.groupBy("split", "bank").agg(*[F.avg(m).alias(m) for m in ("MSE", "MAE", "RMSE", "R2")]).select(
        F.col("MSE").alias("precision"), F.col("R2").alias("accuracy"), F.col("split").alias("dataset"), F.col("bank").alias("model_name"),
        F.col("MAE").alias("recall"), F.col("RMSE").alias("f1"))
    extra = made.where("dataset = 'train'").withColumn("note", F.lit("x"))
    return tables.merge_evaluations([made.where("dataset = 'test'"), extra])


@query("resolve_aliases", f"""WITH {samples(5, 1)}
  SELECT origin_date, target_date AS date, cast(1 AS bigint) AS lead, {r('target')} AS "TRUE", {r('x')} AS Informer_pred FROM samples WHERE split = 'test'""", stage=("p_series",))
def _(v):
    test = prepare_samples(v.p_series, v.axis, "sr", (), 1, 5, windows=False).where("split = 'test'")
    raw = test.select(F.col("origin_date").alias("origin"), "target_date", F.lit(1).alias("horizon"), F.col("target").alias("true"), F.col("x").alias("pred"))
    return resolve_aliases(raw)
