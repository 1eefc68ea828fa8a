"""Experiment grids: runs, their identifiers and the metrics they left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The template of a run identifier, and the defaults of parameters a job leaves out.
SETTING = ("{model}_{data}_ft{features}_sl{seq_len}_ll{label_len}_pl{pred_len}_dm{d_model}_nh{n_heads}_el{e_layers}_dl{d_layers}_df{d_ff}"
           "_at{attn}_fc{factor}_eb{embed}_dt{distil}_mx{mix}_path{path}_{des}_{itr}")
DEFAULTS = {
    "model": "informer", "features": "MS", "seq_len": 5, "label_len": 2, "pred_len": 1, "d_model": 512, "n_heads": 8,
    "e_layers": 2, "d_layers": 1, "d_ff": 2048, "attn": "prob", "factor": 5, "embed": "timeF", "distil": True, "mix": True, "itr": 1,
}


def job_table(spark: SparkSession, config: Mapping) -> DataFrame:
    """One row per job and variant of a batch configuration; arguments are merged in the order common, job, variant."""
    rows = []
    for job in config["jobs"]:
        variants = job.get("variants") or [{**job, "name": job.get("name", "default"), "sentiment_label": job.get("sentiment_label", "带情绪")}]
        for variant in variants:
            args = {**config.get("common_args", {}), **job.get("args", {}), **variant.get("args", {})}
            rows.append({
                "job": job["name"], "scope": "banks" if job.get("target_scope") == "banks" else "aggregate",
                "variant": variant["name"], "spec": variant.get("sentiment_label", variant["name"]),
                "times": int(job.get("training_times", 1)), "data": variant["data"], "path": variant["data_path"],
                "predict_col": variant["predict_col"], "des": variant["description"],
                "args": {k: str(v) for k, v in args.items()},
            })
    schema = ("job string, scope string, variant string, spec string, times int, data string, path string, "
              "predict_col string, des string, args map<string,string>")
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.replace("map<string,string>", "m").split(", ")) for r in rows], schema)


def targets(mapping: DataFrame) -> DataFrame:
    """Grid targets by scope: every mapped bank, and the aggregate."""
    banks = mapping.select(F.lit("banks").alias("scope"), "bank")
    return banks.unionByName(mapping.sparkSession.range(1).select(F.lit("aggregate").alias("scope"), F.lit("ALL").alias("bank")))


def experiment_grid(jobs: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per job, variant, target and iteration; targets are joined on their scope."""
    runs = jobs.join(targets(mapping), "scope").withColumn("iteration", F.explode(F.sequence(F.lit(1), F.col("times"))))

    def filled(name):
        text = F.replace(F.col(name), F.lit("{bank}"), F.col("bank"))
        return F.replace(text, F.lit("{iteration}"), F.col("iteration").cast("string"))

    return runs.withColumns({c: filled(c) for c in ("path", "predict_col", "des")}).drop("times", "scope")


def argument(name: str, args: str = "args") -> Column:
    default = DEFAULTS.get(name)
    return F.coalesce(F.try_element_at(args, F.lit(name)), F.lit(None if default is None else str(default)))


def setting_name(columns: Sequence[str] = ("data", "path", "des")) -> Column:
    """Run identifier; scalar-direct runs also carry their lead."""
    parts: list[Column] = []
    for prefix, name, _, _ in Formatter().parse(SETTING):
        parts += [F.lit(prefix), F.col(name) if name in columns else argument(name)]
    base = reduce(lambda a, b: F.concat(a, b), parts)
    return F.when(F.col("data") == "direct", F.concat(base, F.lit("_lead"), argument("lead"))).otherwise(base)


def collect_metrics(grid: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics of the runs that finished, tagged with target, variant and iteration; unfinished runs drop out."""
    tags = grid.select("setting", "bank", "spec", "iteration")
    return tags.join(metrics, "setting")


def read_run_metrics(spark: SparkSession, folder: str, schema, file: str = "metrics.csv") -> DataFrame:
    """The metrics ``file`` (a name or pattern) of every run folder; the run identifier is the folder name."""
    raw = spark.read.schema(schema).option("header", True).csv(f"{folder}/*/{file}")
    run = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return raw.select("*", F.url_decode(run).alias("setting"))
