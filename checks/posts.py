"""Posts, text columns and sentiment aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from paneltide import schema
from paneltide.functions import calendar, reporting, signals, text
from paneltide.operators import classify, evaluation, posts as posts_ops, sampling
from paneltide.operators.grid import experiment_grid, setting_name
from paneltide.operators.panel import select_entities
from paneltide.operators.reports import recode_by_table, recoded
from paneltide.plans.daily_sentiment import daily_sentiment
from paneltide.session import cut_lineage, scratch_path
from paneltide.sources import panels, records, tables

from .configs import GRID_SQL, JOBS, jobs_for
from .registry import big, cols, query, r
from .sources import SPLIT_SQL
from .sql_parts import CLEAN, COUNT, DAY, FEATURES, LABEL, STATS, STATS_COLUMNS, prf_classes

RAW = ", ".join(STATS_COLUMNS)


@query("normalize_label", f"SELECT post_id, cast({LABEL.format('predict')} AS bigint) AS label FROM p_posts")
def _(v):
    return v.p_posts.select("post_id", text.normalize_label("predict").alias("label"))


@query("parse_response", f"""SELECT doc_id, cast(CASE WHEN contains(response, '负面') THEN -1 WHEN contains(response, '正面') THEN 1
  WHEN contains(response, '中性') THEN 0 ELSE {LABEL.format('response')} END AS bigint) AS strict,
  cast(CASE WHEN contains(response, '负面') THEN -1 WHEN contains(response, '正面') THEN 1 ELSE 0 END AS bigint) AS lenient FROM p_responses""")
def _(v):
    return v.p_responses.select("doc_id", text.parse_response("response", on_bad="null").alias("strict"), text.parse_response("response", default=0).alias("lenient"))


@query("parse_count", f"SELECT post_id, {COUNT.format('read_num')} AS reads, {COUNT.format('comments_num')} AS comments FROM p_posts")
def _(v):
    return v.p_posts.select("post_id", text.parse_count("read_num").alias("reads"), text.parse_count("comments_num").alias("comments"))


@query("to_pub_day", "SELECT post_id, CASE WHEN post_id % 97 <> 0 THEN cast(ts AS date) END AS pub_day FROM p_posts")
def _(v):
    return v.p_posts.select("post_id", text.to_day("pub_date").alias("pub_day"))


@query("numeric_coerce", f"SELECT post_id, {r('TRY_CAST(read_num AS double)')} AS read_num, {r('TRY_CAST(comments_num AS double)')} AS comments_num FROM p_posts")
def _(v):
    return schema.numeric_columns(v.p_posts.select("post_id", "read_num", "comments_num"), ["read_num", "comments_num"])


@query("date_corrections", "SELECT post_id, CASE WHEN post_id % 97 = 0 THEN '2023-12-31' ELSE pub_date END AS pub_date FROM p_posts")
def _(v):
    fixes = v.events.where("event_id % 97 = 0").select(F.col("event_id").alias("post_id"), F.lit("2023-12-31").alias("pub_date"))
    return posts_ops.correct_dates(v.p_posts.select("post_id", "pub_date"), fixes, "post_id")


@query("scale_target", f"SELECT date, bank, {r('-100.0 * covar')} AS sr, {r('100.0 * risk_receiving')} AS receiving FROM p_panel")
def _(v):
    return v.p_panel.select("date", "bank", signals.scaled(F.col("covar")).alias("sr"), signals.scaled(F.col("risk_receiving"), 100).alias("receiving"))


@query("sentiment_features", f"WITH {STATS} SELECT bank_code, pub_day, {big(*STATS_COLUMNS)}, {FEATURES} FROM stats")
def _(v):
    return daily_sentiment(v.p_posts.select("bank_code", "pub_date", "predict", "read_num", "comments_num"))


@query("macro_spreads", f"""SELECT m.date, {r('b.ib3m - m.gov3m')} AS LS, {r('m.gov10y - m.gov6m')} AS YS, {r('m.corp10y - m.gov10y')} AS CS,
  {r('k.volatility')} AS VIX, {r('k.log_return')} AS Market_Return FROM p_macro m LEFT JOIN p_interbank b ON b.date = m.date
  JOIN p_market k ON k.date = m.date""")
def _(v):
    from .panels import MACRO_NAMES
    joined = v.p_macro.join(v.p_interbank, "date", "left").join(v.p_market, "date")
    return signals.macro_spreads(joined, MACRO_NAMES).select("date", *schema.MACRO_FEATURES)


CHAT = ("concat('<|start_header_id|>system<|end_header_id|>', nl, nl, 'You are a helpful assistant. 你是一个乐于助人的助手。<|eot_id|>"
        "<|start_header_id|>user<|end_header_id|>', nl, nl, {0}, '<|eot_id|><|start_header_id|>assistant<|end_header_id|>', nl, nl)")


@query("build_prompt", f"""SELECT doc_id, md5({CHAT.format("concat(i, CASE WHEN t <> '' THEN concat(nl, t) ELSE '' END)")}) AS source,
  concat(CASE WHEN y THEN '正面' ELSE '中性' END, '<|eot_id|>') AS target,
  md5(concat('Instruction: 下面语句的情绪是什么? 必须从括号内选项选择回答 {{正面/中性/负面}},只回答是正面、中性或是负面', nl, text)) AS title
  FROM (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS t, n_chars % 2 = 0 AS y, chr(10) AS nl,
    '{text.DEFAULT_INSTRUCTION}' AS i FROM documents)""")
def _(v):
    docs = v.documents.select("doc_id", "text", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("t"),
                              F.when(F.col("n_chars") % 2 == 0, 1).otherwise(0).alias("y"))
    pairs = records.chat_pairs(records.instruction_records(docs, "t", "y", keep=["doc_id", "text"]), ["doc_id", "text"])
    return pairs.select("doc_id", F.md5("source").alias("source"), "target", F.md5(text.title_prompt(F.col("text"))).alias("title"))


@query("extract_answer", """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN regexp_replace(split_part(output, concat('assistant', chr(10), chr(10)), 2), '^\\s+|\\s+$', '', 'g') END AS answer,
  CASE WHEN role = 'assistant' THEN 'end' ELSE regexp_replace(output, '^\\s+|\\s+$', '', 'g') END AS last FROM p_turns""")
def _(v):
    return v.p_turns.select("conv_id", "turn", text.extract_answer("output").alias("answer"), text.extract_answer("output", "last").alias("last"))


@query("map_values", f"""SELECT post_id, CASE {LABEL.format('predict')} WHEN -1 THEN '负面' WHEN 0 THEN '中性' ELSE '正面' END AS label,
  concat('n', m.bank) AS bank, CASE event_type WHEN 'view' THEN 'seen' ELSE event_type END AS kind
  FROM p_posts p LEFT JOIN p_map m USING (bank_code)""")
def _(v):
    named = v.p_map.select("bank_code", F.concat(F.lit("n"), "bank").alias("name"))
    posts = v.p_posts.select("post_id", text.lookup(text.normalize_label("predict"), text.LABEL_TEXT, "raise").alias("label"),
                             F.col("bank_code").alias("bank"), F.col("event_type").alias("kind"))
    return recoded(recode_by_table(posts, "bank", named, "bank_code", "name", strict=True), "kind", {"view": "seen"})


@query("time_features_int", """SELECT event_id, cast(month(ts) AS bigint) AS month, cast(day(ts) AS bigint) AS day, cast(isodow(ts) - 1 AS bigint) AS weekday,
  cast(hour(ts) AS bigint) AS hour, cast(minute(ts) // 15 AS bigint) AS minute FROM events""")
def _(v):
    return v.events.select("event_id", *calendar.calendar_parts(F.col("ts"), "t"))


@query("time_features_norm", f"""SELECT event_id, {r('second(ts) / 59.0 - 0.5')} AS second, {r('minute(ts) / 59.0 - 0.5')} AS minute,
  {r('hour(ts) / 23.0 - 0.5')} AS hour, {r('(isodow(ts) - 1) / 6.0 - 0.5')} AS day_of_week, {r('(day(ts) - 1) / 30.0 - 0.5')} AS day_of_month,
  {r('(dayofyear(ts) - 1) / 365.0 - 0.5')} AS day_of_year, {r('(month(ts) - 1) / 11.0 - 0.5')} AS month,
  {r('(weekofyear(ts) - 1) / 52.0 - 0.5')} AS week_of_year FROM events""")
def _(v):
    ts = F.col("ts")
    return v.events.select("event_id", *calendar.scaled_features(ts, "S"), *calendar.scaled_features(ts, "M"), calendar.scaled_features(ts, "W")[1])


@query("significance_stars", """SELECT l_orderkey, l_linenumber, l_discount AS p, CASE WHEN l_discount < 0.01::DOUBLE THEN '***' WHEN l_discount < 0.05::DOUBLE THEN '**'
  WHEN l_discount < 0.1::DOUBLE THEN '*' ELSE '' END AS stars FROM (SELECT l_orderkey, cast(l_linenumber AS bigint) AS l_linenumber, l_discount FROM lineitem)""")
def _(v):
    return v.lineitem.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("p"), reporting.stars(F.col("l_discount")).alias("stars"))


@query("format_report", """SELECT o_orderkey, format('{:.1f}', o_totalprice) AS one, format('{:.2f}', o_totalprice / 1e4::DOUBLE * 1e2::DOUBLE) AS scaled,
  format('{:.3f}%', (250000 - o_totalprice) / 1e5::DOUBLE) AS share, CASE WHEN o_orderstatus = 'F' THEN '' ELSE format('{:.2f}', o_totalprice / 7::DOUBLE) END AS gap,
  concat(format('{:.3f}', o_totalprice / 8::DOUBLE), '***') AS marked FROM orders""")
def _(v):
    price = F.col("o_totalprice")
    return v.orders.select(
        "o_orderkey", reporting.fixed(price, 1).alias("one"), reporting.fixed(price / 1e4, 2, 1e2).alias("scaled"),
        reporting.fixed((250000 - price) / 1e5, 3, suffix="%").alias("share"),
        reporting.fixed(F.when(F.col("o_orderstatus") != "F", price / 7), 2).alias("gap"),
        reporting.squeeze(F.concat(reporting.fixed(price / 8, 3), F.lit(" ***"))).alias("marked"))


@query("repair_mse", f"SELECT bank, spec, iteration, {r('RMSE * RMSE')} AS MSE FROM p_metrics")
def _(v):
    broken = F.when(F.col("iteration") == 3, 0.0).otherwise(F.col("MSE"))
    return v.p_metrics.select("bank", "spec", "iteration", reporting.repaired_mse(broken, F.col("RMSE")).alias("MSE"))


@query("drop_unnamed", f"SELECT bank, spec, iteration, {r('MAE')} AS MAE FROM p_metrics")
def _(v):
    return schema.drop_unnamed(v.p_metrics.select(F.lit(1).alias("_c0"), "bank", "spec", F.lit("x").alias("Unnamed: 0"), "iteration", "MAE"))


@query("setting_name", f"SELECT bank, spec, cast(iteration AS bigint) AS iteration, setting FROM ({GRID_SQL})")
def _(v):
    return experiment_grid(jobs_for(v.spark, JOBS), v.p_map).withColumn("setting", setting_name()).select("bank", "spec", "iteration", "setting")


@query("experiment_grid", f"SELECT job, variant, spec, bank, cast(iteration AS bigint) AS iteration, predict_col FROM ({GRID_SQL})")
def _(v):
    return experiment_grid(jobs_for(v.spark, JOBS), v.p_map).select("job", "variant", "spec", "bank", "iteration", "predict_col")


@query("dropna_any", f"SELECT date, {cols('gov3m', 'gov6m', 'gov10y', 'corp10y')} FROM p_macro WHERE gov3m IS NOT NULL AND gov6m IS NOT NULL AND gov10y IS NOT NULL AND corp10y IS NOT NULL")
def _(v):
    return schema.rows_complete(v.p_macro)


@query("dropna_all", f"SELECT date, {cols('gov3m', 'gov6m')} FROM p_macro WHERE gov3m IS NOT NULL OR gov6m IS NOT NULL")
def _(v):
    return schema.rows_observed(v.p_macro.select("date", "gov3m", "gov6m"), ["gov3m", "gov6m"])


@query("exclude_index_series", f"SELECT date, bank, {r('cap', 2)} AS cap FROM p_panel WHERE bank NOT IN ('B03', 'B11')", digits=2)
def _(v):
    named = F.when(F.col("bank").isin("B03", "B11"), F.concat("bank", F.lit("金融指数"))).otherwise(F.col("bank"))
    return panels.without_index_series(v.p_panel.select("date", named.alias("bank"), "cap"))


@query("select_entities", f"SELECT p.date, p.bank, m.ord, {r('p.covar')} AS covar FROM p_panel p JOIN p_map m USING (bank) WHERE bank IN ('B05', 'B02', 'B09')")
def _(v):
    chosen = select_entities(v.p_map, ["B09", "B02", "B05"])
    return v.p_panel.join(chosen.select("bank", "ord"), "bank").select("date", "bank", "ord", "covar")


@query("require_columns", """SELECT 'posts' AS input, count(*) AS rows, NULL AS problem FROM p_posts UNION ALL SELECT 'panel', count(*), NULL FROM p_panel
  UNION ALL SELECT 'macro', NULL, 'Missing columns in macro: [''bank_code'', ''comments_num'', ''predict'', ''pub_date'', ''read_num'']'
  UNION ALL SELECT 'series', NULL, 'Missing columns in series: [''covar'']'""")
def _(v):
    """Frames that keep the contract are counted; for the others, what the error says."""
    posts = ["pub_date", "bank_code", "predict", "read_num", "comments_num"]
    cases = {"posts": (v.p_posts, posts), "panel": (v.p_panel, ["date", "bank", "covar"]), "macro": (v.p_macro, posts), "series": (v.p_series, ["date", "covar", "sr"])}
    parts = []
    for name, (df, wanted) in cases.items():
        try:
            rows = schema.require_columns(df, wanted, name).agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("string").alias("problem"))
        except ValueError as error:
            rows = df.limit(1).agg(F.lit(None).cast("bigint").alias("rows"), F.lit(str(error)).alias("problem"))
        parts.append(rows.select(F.lit(name).alias("input"), "rows", "problem"))
    return tables.union_tables(parts)


@query("test_split_filter", f"SELECT bank, spec, iteration, {r('MAE')} AS MAE FROM p_metrics WHERE split = 'test'")
def _(v):
    return evaluation.test_rows(v.p_metrics).select("bank", "spec", "iteration", "MAE")


@query("daily_sentiment_stats", f"WITH {STATS} SELECT bank_code, pub_day, {big(*STATS_COLUMNS)} FROM stats")
def _(v):
    return posts_ops.daily_sentiment_stats(posts_ops.clean_posts(v.p_posts))


@query("outer_stats_merge", f"""WITH {CLEAN}, c AS (SELECT bank_code, pub_day, {", ".join(f"count(*) FILTER (WHERE predict = {k}) AS {g}_Count" for g, k in posts_ops.GROUPS)} FROM clean GROUP BY ALL),
  s AS (SELECT bank_code, pub_day, {", ".join(f"sum(CASE WHEN predict = {k} THEN {m} ELSE 0 END) AS {g}_{m}" for m in ('read_num', 'comments_num') for g, k in posts_ops.GROUPS)} FROM clean GROUP BY ALL),
  t AS (SELECT bank_code, pub_day, sum(read_num) AS read_num, sum(comments_num) AS comments_num FROM clean GROUP BY ALL)
  SELECT bank_code, pub_day, {big(*STATS_COLUMNS)} FROM c FULL JOIN s USING (bank_code, pub_day) FULL JOIN t USING (bank_code, pub_day)""")
def _(v):
    """Counts, sums by label and totals are taken apart; the label sums of neutral posts lack whole days."""
    posts, keys = posts_ops.clean_posts(v.p_posts), ["bank_code", "pub_day"]
    counts = posts.groupBy(*keys).agg(*[F.count_if(F.col("predict") == k).alias(f"{g}_Count") for g, k in posts_ops.GROUPS])
    sums = [posts.where(F.col("predict") == k).groupBy(*keys).agg(*[F.sum(m).alias(f"{g}_{m}") for m in ("read_num", "comments_num")]) for g, k in posts_ops.GROUPS]
    totals = posts.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in ("read_num", "comments_num")])
    return posts_ops.merge_stats([counts, *sums, totals], keys)


@query("system_day_sentiment", f"""WITH {STATS}, total AS (SELECT pub_day, {", ".join(f"cast(sum({c}) AS bigint) AS {c}" for c in STATS_COLUMNS)} FROM stats GROUP BY pub_day)
  SELECT pub_day, {RAW}, {FEATURES} FROM total""")
def _(v):
    return posts_ops.system_day_sentiment(posts_ops.daily_sentiment_stats(posts_ops.clean_posts(v.p_posts)))


@query("code_to_name", f"WITH {STATS} SELECT m.bank, s.pub_day AS date, {FEATURES} FROM stats s JOIN p_map m ON m.bank_code = s.bank_code")
def _(v):
    return posts_ops.entity_sentiment(posts_ops.daily_sentiment_stats(posts_ops.clean_posts(v.p_posts)), v.p_map)


@query("union_by_name", """SELECT post_id, predict, NULL AS k FROM (SELECT post_id, trim(predict) AS predict, bank_code FROM p_posts) WHERE bank_code < 7
  UNION ALL SELECT post_id, NULL, cast(k AS bigint) FROM p_posts WHERE bank_code >= 5""")
def _(v):
    a = v.p_posts.where("bank_code < 7").select("post_id", F.trim("predict").alias("predict"))
    return tables.union_tables([a, v.p_posts.where("bank_code >= 5").select("k", "post_id")])


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT doc_id, cast(y AS bigint) AS y, is_val FROM flagged")
def _(v):
    return sampling.stratified_split(v.p_class.select("doc_id", "y"), "y", "doc_id", 0.1)


RANDOM_SQL = """SELECT doc_id, row_number() OVER (ORDER BY md5(concat('7-', cast(doc_id AS string))), doc_id) <= round_even(count(*) OVER () * 0.25::DOUBLE, 0) AS is_val
  FROM documents"""


@query("random_split", RANDOM_SQL)
def _(v):
    return sampling.random_split(v.documents.select("doc_id"), "doc_id", 0.25, seed=7)


@query("split_anti", f"WITH f AS ({RANDOM_SQL}) SELECT d.doc_id, d.lang FROM documents d JOIN f ON f.doc_id = d.doc_id WHERE NOT f.is_val")
def _(v):
    docs = v.documents.select("doc_id", "lang")
    return sampling.rest_of(sampling.random_split(docs, "doc_id", 0.25, seed=7), "is_val")


@query("key_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(v):
    return sampling.key_difference(v.documents, v.labels, ["doc_id"])


@query("key_intersection", "SELECT date FROM p_macro INTERSECT SELECT date FROM p_panel")
def _(v):
    return sampling.key_intersection(v.p_macro, v.p_panel, ["date"])


@query("weighted_prf", f"""WITH {prf_classes('p_class')} SELECT {r('sum(hits) / sum(support)')} AS accuracy,
  {", ".join(f"{r(f'sum({m} * support) / sum(support)')} AS {m}" for m in ('precision', 'recall', 'f1'))} FROM cls""")
def _(v):
    return evaluation.weighted_prf(v.p_class, "y", "pred")


@query("macro_prf_by_step", f"""WITH src AS (SELECT cast(vec_id % 5 + 1 AS bigint) AS Day, label % len(embedding) AS y,
    list_position(embedding, list_max(embedding)) - 1 AS pred FROM embeddings), {prf_classes('src', 'Day')}
  SELECT Day, {r('sum(hits) / sum(support)')} AS Accuracy, {r('avg(precision)')} AS "Precision", {r('avg(recall)')} AS Recall, {r('avg(f1)')} AS F1_Score FROM cls GROUP BY Day""")
def _(v):
    scored = v.embeddings.select((F.col("vec_id") % 5).alias("step"), (F.col("label") % F.size("embedding")).alias("y"), F.col("embedding").alias("scores"))
    return evaluation.macro_prf_by_step(scored, "y", "scores", "step")


class WordRule:
    """Stand-in for a text model: answers by the number of commas and full stops."""

    def __call__(self, texts):
        balance = texts.str.count(",") - texts.str.count(r"\.")
        return balance.map(lambda b: "负面" if b < 0 else "正面" if b > 0 else "中性")


BALANCE = "(length({0}) - length(replace({0}, ',', ''))) - (length({0}) - length(replace({0}, '.', '')))"


@query("score_text", f"""SELECT doc_id, CASE WHEN b < 0 THEN '负面' WHEN b > 0 THEN '正面' ELSE '中性' END AS Output, cast(CASE WHEN b < 0 THEN -1 WHEN b > 0 THEN 1 ELSE 0 END AS bigint) AS predict
  FROM (SELECT doc_id, 1 + {BALANCE.format('text')} AS b FROM documents)""")
def _(v):
    return classify.predict_sentiment(v.documents.select("doc_id", "text"), "text", WordRule).select("doc_id", "Output", "predict")


@query("scores_to_rows", f"""SELECT conv_id, turn, role, CASE WHEN b < 0 THEN '负面' WHEN b > 0 THEN '正面' ELSE '中性' END AS Output
  FROM (SELECT conv_id, turn, role, {BALANCE.format('text')} AS b FROM conversations)""")
def _(v):
    """Half of the turns is scored first; the second run scores the texts that are new, and rows find their text's score."""
    rows = v.conversations.select("conv_id", "turn", "role", "text")
    path = scratch_path(v.spark, "ledger")
    classify.score_new_texts(rows.where("turn % 2 = 0"), "text", WordRule, path)
    return classify.scores_to_rows(rows, "text", classify.score_new_texts(rows, "text", WordRule, path)).drop("text")


@query("compare_text_classifiers", """WITH k AS (SELECT y, row_number() OVER (PARTITION BY y ORDER BY md5(concat('42-', cast(doc_id AS string))), doc_id) AS rk, count(*) OVER (PARTITION BY y) AS n FROM p_class),
  c AS (SELECT CASE WHEN rk <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'val' ELSE 'train' END AS dataset FROM k)
  SELECT dataset, model_name, count(*) AS rows, TRUE AS same_scores, TRUE AS beats_majority_where_fitted FROM c, (SELECT unnest(['LogisticRegression', 'NaiveBayes']) AS model_name) GROUP BY ALL""")
def _(v):
    """What SQL can say of fitted models: the rows they were scored on, that all four scores are those of the emitted predictions
    by their definitions, and that on the rows it was fitted to a model beats the most frequent class."""
    flagged = cut_lineage(sampling.stratified_split(v.p_class.withColumn("class", F.col("y") + 1), "class", "doc_id", 0.2), "flagged")
    made = cut_lineage(classify.text_predictions(flagged, "text", "class", "is_val"), "text-predictions")
    scores, keys = evaluation.weighted_prf(made, "class", "prediction", ["dataset", "model_name"]), ["dataset", "model_name"]
    made.createOrReplaceTempView("text_predictions")
    plain = v.spark.sql("""WITH k AS (SELECT DISTINCT dataset, model_name, class AS c FROM text_predictions UNION SELECT DISTINCT dataset, model_name, prediction FROM text_predictions),
      s AS (SELECT k.dataset, k.model_name, c, count_if(class = c) AS support, count_if(prediction = c) AS said, count_if(class = c AND prediction = c) AS hit
        FROM k JOIN text_predictions t ON t.dataset = k.dataset AND t.model_name = k.model_name GROUP BY ALL)
      SELECT dataset, model_name, sum(support) AS rows, sum(hit) / sum(support) AS a, sum(support * coalesce(try_divide(hit, said), 0)) / sum(support) AS p,
        sum(support * coalesce(try_divide(hit, support), 0)) / sum(support) AS r, sum(support * coalesce(try_divide(2 * hit, support + said), 0)) / sum(support) AS f,
        max(support) / sum(support) AS majority FROM s GROUP BY dataset, model_name""")
    same = [F.abs(F.col(x) - F.col(y)) < 1e-9 for x, y in zip("aprf", ("accuracy", "precision", "recall", "f1"))]
    return scores.join(plain, keys).select(*keys, "rows", (same[0] & same[1] & same[2] & same[3]).alias("same_scores"),
                                           ((F.col("dataset") == "val") | (F.col("a") > F.col("majority"))).alias("beats_majority_where_fitted"))
