"""A batch configuration for the grid queries, and its SQL twin."""

from __future__ import annotations

from paneltide.operators.grid import job_table

# Arguments and run counts of the jobs, as a batch configuration states them.
_ARGS = {"features": "MS", "seq_len": 5, "label_len": 2, "pred_len": 1, "lead": 1}
JOBS = {
    "common_args": {"d_model": 512, "seq_len": 99},
    "jobs": [{
        "name": "banks_1d", "target_scope": "banks", "training_times": 10, "args": _ARGS,
        "variants": [
            {"name": n, "sentiment_label": n, "data": "direct", "data_path": "{bank}_%s.csv" % n, "predict_col": "{bank}_CoVaR",
             "description": "run_{bank}_%s_{iteration}" % n} for n in ("with", "without")],
    }, {
        "name": "aggregate_5d", "target_scope": "aggregate", "training_times": 15, "data": "direct", "data_path": "ALL.csv",
        "predict_col": "ALL_CoVaR", "description": "run_ALL_{iteration}", "args": {**_ARGS, "seq_len": 10, "label_len": 3, "lead": 5, "d_model": 1024},
    }],
}


def jobs_for(spark, config):
    return job_table(spark, config)


def _setting(sl, ll, dm, path, des, lead):
    return (f"concat('informer_direct_ftMS_sl{sl}_ll{ll}_pl1_dm{dm}_nh8_el2_dl1_df2048_atprob_fc5_ebtimeF_dtTrue_mxTrue_path', {path}, '_', {des}, "
            f"'_1_lead{lead}')")


GRID_SQL = f"""
  SELECT 'banks_1d' AS job, v.spec AS variant, v.spec, m.bank, it.iteration, concat(m.bank, '_CoVaR') AS predict_col,
    {_setting(5, 2, 512, "concat(m.bank, '_', v.spec, '.csv')", "concat('run_', m.bank, '_', v.spec, '_', it.iteration)", 1)} AS setting
  FROM p_map m, (SELECT unnest(['with', 'without']) AS spec) v, (SELECT unnest(range(1, 11)) AS iteration) it
  UNION ALL SELECT 'aggregate_5d', 'aggregate_5d', '带情绪', 'ALL', it.iteration, 'ALL_CoVaR',
    {_setting(10, 3, 1024, "'ALL.csv'", "concat('run_ALL_', it.iteration)", 5)}
  FROM (SELECT unnest(range(1, 16)) AS iteration) it"""
