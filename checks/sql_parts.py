"""Oracle building blocks, written independently of the library."""

from __future__ import annotations

LABEL = """CASE lower(trim({0})) WHEN '-1' THEN -1 WHEN '负面' THEN -1 WHEN 'negative' THEN -1 WHEN '0' THEN 0
 WHEN '中性' THEN 0 WHEN 'neutral' THEN 0 WHEN '1' THEN 1 WHEN '+1' THEN 1 WHEN '正面' THEN 1 WHEN 'positive' THEN 1
 ELSE cast(trunc(try_cast(trim({0}) AS double)) AS int) END"""

COUNT = """cast(trunc(coalesce(CASE WHEN lower(trim({0})) IN ('', 'nan', 'none', '--') THEN 0 ELSE
 try_cast(regexp_extract(replace(replace(replace(replace({0}, ',', ''), '亿', ''), '万', ''), '+', ''), '-?[0-9]+([.][0-9]+)?') AS double)
 * CASE WHEN contains({0}, '亿') THEN 1e8 WHEN contains({0}, '万') THEN 1e4 ELSE 1 END END, 0)) AS bigint)"""

DAY = "try_cast(replace({0}, '/', '-') AS date)"

CLEAN = f"""clean AS (SELECT post_id, bank_code, {DAY.format('pub_date')} AS pub_day, {LABEL.format('predict')} AS predict,
 {COUNT.format('read_num')} AS read_num, {COUNT.format('comments_num')} AS comments_num FROM p_posts
 WHERE {DAY.format('pub_date')} IS NOT NULL)"""

_NAMES = [("Negative", -1), ("Neutral", 0), ("Positive", 1)]
STATS_COLUMNS = ([f"{g}_Count" for g, _ in _NAMES] + [f"{g}_{m}" for m in ("read_num", "comments_num") for g, _ in _NAMES]
                 + ["read_num", "comments_num"])
STATS = CLEAN + ", stats AS (SELECT bank_code, pub_day, " + ", ".join(
    [f"count(*) FILTER (WHERE predict = {v}) AS {g}_Count" for g, v in _NAMES]
    + [f"cast(coalesce(sum({m}) FILTER (WHERE predict = {v}), 0) AS bigint) AS {g}_{m}" for m in ("read_num", "comments_num") for g, v in _NAMES]
    + ["cast(sum(read_num) AS bigint) AS read_num", "cast(sum(comments_num) AS bigint) AS comments_num"]) + " FROM clean GROUP BY ALL)"

FEATURES = """Positive_Count + Neutral_Count + Negative_Count AS Total_Count,
 round(ln((Negative_Count + 1) / (Positive_Count + 1)), 6) + 0.0 AS Emotional_Skew,
 round(ln((Negative_read_num + 1) / (Positive_read_num + 1)), 6) + 0.0 AS Weighted_Emotional_Skew_Read,
 round(ln((Negative_comments_num + 1) / (Positive_comments_num + 1)), 6) + 0.0 AS Weighted_Emotional_Skew_Comment"""


def samples(lags: int, lead: int, source: str = "p_series", series: str = "", extra: str = "") -> str:
    """CTEs ``idx, pos, hist, smp, samples`` for one source; ``series`` is an optional key column."""
    by = f"PARTITION BY {series}" if series else ""
    key = f"h.{series}, " if series else ""
    same = f" AND t.{series} = h.{series}" if series else ""
    return f"""idx AS (SELECT *, row_number() OVER ({by} ORDER BY date) - 1 AS i, count(*) OVER ({by}) AS n FROM {source}),
 pos AS (SELECT idx.*, c.pos FROM idx JOIN p_calendar c ON c.date = idx.date),
 hist AS (SELECT *, pos - lag(pos, {lags - 1}) OVER ({by} ORDER BY i) = {lags - 1} AS ok FROM pos),
 smp AS (SELECT {key}h.date AS origin_date, h.i, h.n, h.pos, h.sr AS x, t.date AS target_date, t.i AS target_i, t.sr AS target,
   cast(floor(h.n * 0.7::DOUBLE) AS bigint) AS fit_end{extra} FROM hist h JOIN pos t ON t.pos = h.pos + {lead}{same} WHERE h.ok),
 samples AS (SELECT * FROM (SELECT *, CASE WHEN target_i < fit_end THEN 'train' WHEN i >= fit_end - 1 THEN 'test' END AS split
   FROM smp) WHERE split IS NOT NULL)"""


def archive(lags: int = 5, lead: int = 1) -> str:
    """CTE ``archive``: stand-in forecasts of the test samples, and the AR(1) parameters ``ar``."""
    return samples(lags, lead) + f""",
 prev AS (SELECT i, lag(sr) OVER (ORDER BY i) AS before FROM idx),
 archive AS (SELECT s.i, s.origin_date, s.target_date AS date, cast({lead} AS bigint) AS lead, s.target AS actual, s.x,
   (s.x + p.before) / 2 AS base FROM samples s JOIN prev p ON p.i = s.i WHERE s.split = 'test'),
 ar AS (SELECT regr_intercept(y, x) AS c, regr_slope(y, x) AS phi FROM (SELECT sr AS y, lag(sr) OVER (ORDER BY i) AS x
   FROM idx WHERE i < floor(n * 0.7::DOUBLE)) WHERE x IS NOT NULL)"""


def ar_path(lead: int, x: str = "x") -> str:
    out = x
    for _ in range(lead):
        out = f"(ar.c + ar.phi * {out})"
    return out


def predictions(lags: int = 5, lead: int = 1) -> str:
    """CTE ``wide``: actual, baseline, persistence and AR(1) forecasts; ``long``: model, y, p."""
    return archive(lags, lead) + f""",
 wide AS (SELECT archive.*, x AS per, {ar_path(lead)} AS ar1 FROM archive, ar),
 long AS (SELECT date, 'Informer' AS model, actual AS y, base AS p FROM wide UNION ALL
   SELECT date, 'Persistence', actual, per FROM wide UNION ALL SELECT date, 'AR1', actual, ar1 FROM wide)"""


WEIGHTED_AVERAGE = """axis AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM p_panel)),
 w AS (SELECT a.nxt AS date, p.bank, p.cap FROM p_panel p JOIN axis a ON a.date = p.date
   WHERE a.nxt IS NOT NULL AND p.bank IN (SELECT bank FROM p_map)),
 dates AS (SELECT DISTINCT date FROM p_panel)"""


def weighted(columns: dict[str, str], scale: dict[str, float] | None = None) -> str:
    """CTE ``agg`` with capitalisation-weighted columns."""
    scale = scale or {}
    items = ", ".join(
        f"CASE WHEN sum(w.cap) <> 0 THEN coalesce(sum({scale.get(src, 1.0)} * v.{src} * w.cap), 0) / sum(w.cap) END AS {out}"
        for out, src in columns.items())
    return WEIGHTED_AVERAGE + f""",
 agg AS (SELECT d.date, {items} FROM dates d LEFT JOIN w ON w.date = d.date
   LEFT JOIN p_panel v ON v.date = w.date AND v.bank = w.bank GROUP BY d.date)"""


_FILL = {"gov3m": "m", "gov6m": "m", "gov10y": "m", "corp10y": "m", "ib3m": "b", "volatility": "k", "log_return": "k"}
MACRO = "mframe AS (SELECT f.date, " + ", ".join(f"{t}.{c}" for c, t in _FILL.items()) + """
   FROM (SELECT DISTINCT date FROM p_panel) f LEFT JOIN p_macro m ON m.date = f.date LEFT JOIN p_interbank b ON b.date = f.date
   LEFT JOIN p_market k ON k.date = f.date),
 mfill AS (SELECT date, """ + ", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY date) AS {c}" for c in _FILL) + """ FROM mframe),
 macro AS (SELECT date, ib3m - gov3m AS LS, gov10y - gov6m AS YS, corp10y - gov10y AS CS, volatility AS VIX, log_return AS Market_Return
   FROM mfill)"""


def prf_classes(source: str, by: str = "") -> str:
    """CTEs ``cls`` with per-class scores from ``source`` (columns y, pred and optional group columns)."""
    b = f"{by}, " if by else ""
    on = " AND ".join(["c.k = x.k", *[f"c.{g.strip()} = x.{g.strip()}" for g in by.split(",") if g.strip()]])
    return f"""seen AS (SELECT DISTINCT {b}k FROM (SELECT {b}y AS k FROM {source} UNION SELECT {b}pred FROM {source})),
 lab AS (SELECT {b}y AS k, count(*) AS support, count(*) FILTER (WHERE y = pred) AS hits FROM {source} GROUP BY ALL),
 prd AS (SELECT {b}pred AS k, count(*) AS predicted FROM {source} GROUP BY ALL),
 cls AS (SELECT {", ".join("c." + g.strip() for g in by.split(",")) + ", " if by else ""}c.k, coalesce(x.support, 0) AS support, coalesce(x.hits, 0) AS hits,
   coalesce(coalesce(x.hits, 0) / nullif(q.predicted, 0), 0) AS precision, coalesce(coalesce(x.hits, 0) / nullif(x.support, 0), 0) AS recall,
   coalesce(2.0::double * coalesce(x.hits, 0) / nullif(coalesce(x.support, 0) + coalesce(q.predicted, 0), 0), 0) AS f1
   FROM seen c LEFT JOIN lab x ON {on} LEFT JOIN prd q ON {on.replace("x.", "q.")})"""


def t_test_p(t: str, df: str) -> str:
    """Two-sided Student-t p-value by Simpson's rule on the density."""
    density = f"pow(1 + pow(abs({t}) * k / 2000.0::DOUBLE, 2) / ({df}), -(({df}) + 1) / 2.0::DOUBLE)"
    weight = "CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    factor = f"exp(lgamma((({df}) + 1) / 2.0::DOUBLE) - lgamma(({df}) / 2.0::DOUBLE)) / sqrt(({df}) * pi())"
    return f"1 - 2 * {factor} * abs({t}) / 6000.0::DOUBLE * list_sum(list_transform(range(0, 2001), lambda k: {weight} * {density}))"
