"""Domain-shaped views over the driver tables, in SQL that Spark and DuckDB both read.

Every view scans whole tables. ``{name}`` marks a table or another view.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.operators.panel import session_axis
from paneltide.session import cut_lineage

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

VIEWS = {
    "p_map": """
        SELECT bank_code, concat('B', lpad(cast(bank_code AS string), 2, '0')) AS bank, bank_code AS ord
        FROM (SELECT DISTINCT c_custkey % 14 AS bank_code FROM {customer}) t""",
    "p_events": """
        SELECT event_id, user_id, ts, event_type, regexp_extract(props, '([0-9]+)', 1) AS k FROM {events}""",
    "p_posts": """
        SELECT event_id AS post_id, user_id % 14 AS bank_code,
          CASE WHEN event_id % 97 = 0 THEN 'no date'
               WHEN event_id % 3 = 0 THEN cast(cast(ts AS date) AS string)
               WHEN event_id % 3 = 1 THEN replace(cast(cast(ts AS date) AS string), '-', '/')
               ELSE concat(cast(cast(ts AS date) AS string), ' 08:15:00') END AS pub_date,
          CASE event_type WHEN 'error' THEN '负面' WHEN 'purchase' THEN ' Positive ' WHEN 'signup' THEN '+1'
               WHEN 'click' THEN '0.5' ELSE '中性' END AS predict,
          CASE WHEN event_id % 50 = 0 THEN concat(k, '亿')
               WHEN event_id % 5 = 0 THEN k
               WHEN event_id % 5 = 1 THEN concat(k, '.53万')
               WHEN event_id % 5 = 2 THEN concat('1,', lpad(k, 3, '0'))
               WHEN event_id % 5 = 3 THEN concat(k, '+')
               ELSE '--' END AS read_num,
          cast(event_id % 7 AS string) AS comments_num,
          cast(k AS bigint) AS k, event_type, ts
        FROM {p_events}""",
    "p_days": """
        SELECT cast(l_shipdate AS date) AS date FROM {lineitem} UNION SELECT cast(o_orderdate AS date) AS date FROM {orders}""",
    "p_panel": """
        SELECT cast(l_shipdate AS date) AS date, concat('B', lpad(cast(l_suppkey % 14 AS string), 2, '0')) AS bank,
          -avg(l_discount) AS covar, sum(l_extendedprice) AS cap, avg(l_tax) AS risk_receiving,
          avg(l_quantity) AS risk_spillover, avg(l_quantity) - avg(l_tax) AS net_risk_value,
          min(l_quantity) AS pe, max(l_quantity) AS pb, avg(l_quantity) AS ps, avg(l_discount) AS pc
        FROM {lineitem} GROUP BY cast(l_shipdate AS date), l_suppkey % 14""",
    "p_panel_wide": "SELECT date, " + ", ".join(
        f"max(CASE WHEN bank = 'B{b:02d}' THEN risk_spillover END) AS B{b:02d}" for b in range(14)) + " FROM {p_panel} GROUP BY date",
    "p_macro": """
        SELECT cast(o_orderdate AS date) AS date,
          avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS gov3m,
          avg(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH') AS gov6m,
          avg(o_totalprice) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS gov10y,
          avg(o_totalprice) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') AS corp10y
        FROM {orders} GROUP BY cast(o_orderdate AS date)""",
    "p_interbank": """
        SELECT cast(o_orderdate AS date) AS date, avg(o_totalprice) AS ib3m FROM {orders}
        WHERE o_orderpriority = '5-LOW' GROUP BY cast(o_orderdate AS date)""",
    "p_market": """
        SELECT cast(o_orderdate AS date) AS date, max(o_totalprice) - min(o_totalprice) AS volatility,
          ln(max(o_totalprice) / min(o_totalprice)) AS log_return
        FROM {orders} GROUP BY cast(o_orderdate AS date)""",
    "p_series": """
        SELECT cast(o_orderdate AS date) AS date, sum(o_totalprice) / 987654.0 AS sr, cast(count(*) AS double) AS feature,
          avg(o_totalprice) / 98765.0 AS feature2
        FROM {orders} GROUP BY cast(o_orderdate AS date)""",
    "p_series5": """
        SELECT o_orderpriority AS series, cast(o_orderdate AS date) AS date, sum(o_totalprice) / 987654.0 AS sr,
          cast(count(*) AS double) AS feature
        FROM {orders} GROUP BY o_orderpriority, cast(o_orderdate AS date)""",
    "p_signal": """
        SELECT cast(l_shipdate AS date) AS date, avg(l_quantity) AS skew, cast(count(*) AS double) AS posts
        FROM {lineitem} GROUP BY cast(l_shipdate AS date)""",
    "p_series_sent": """
        SELECT s.date, s.sr, s.feature, s.feature2, g.skew, g.posts FROM {p_series} s JOIN {p_signal} g ON s.date = g.date""",
    "p_metrics": """
        SELECT concat('B', lpad(cast(l_suppkey % 14 AS string), 2, '0')) AS bank,
          CASE WHEN l_returnflag = 'A' OR l_returnflag = 'N' AND l_linestatus = 'F' THEN 'without' ELSE 'with' END AS spec, cast(l_linenumber AS bigint) AS iteration,
          var_pop(l_discount) AS MSE, avg(l_tax) AS MAE, sqrt(var_pop(l_discount)) AS RMSE,
          1 - avg(l_quantity) / 50 AS R2, CASE WHEN l_linenumber > 2 THEN 'test' ELSE 'train' END AS split
        FROM {lineitem}
        GROUP BY l_suppkey % 14, CASE WHEN l_returnflag = 'A' OR l_returnflag = 'N' AND l_linestatus = 'F' THEN 'without' ELSE 'with' END, l_linenumber""",
    "p_class": """
        SELECT d.doc_id, l.toxic - l.quality AS y, cast(d.n_chars % 3 - 1 AS int) AS pred, d.lang, d.source, d.text
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "p_responses": """
        SELECT doc_id, lang, concat(CASE WHEN doc_id % 5 = 0 THEN '回答：负面，不是正面。' WHEN doc_id % 5 = 1 THEN '正面 '
            WHEN doc_id % 5 = 2 THEN '中性 ' WHEN doc_id % 5 = 3 THEN 'negative ' ELSE '' END, text) AS response
        FROM {documents}""",
    "p_turns": """
        SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN concat('user\n\nq', 'assistant\n\n ', text, ' assistant\n\n', 'end ')
            ELSE text END AS output FROM {conversations}""",
}


def dependencies(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


def with_views(sql: str) -> str:
    """Prefix a statement with the definitions of the views it mentions."""
    order: list[str] = []

    def visit(name):
        if name in VIEWS and name not in order:
            for other in dependencies(VIEWS[name]):
                visit(other)
            order.append(name)

    for name in re.findall(r"\b(?:p_\w+)\b", sql):
        if name == "p_calendar":
            visit("p_days")
        visit(name)
    plain = {n: n for n in [*TABLES, *VIEWS]}
    parts = [f"{n} AS ({VIEWS[n].format(**plain)})" for n in order]
    if "p_calendar" in sql:
        parts.append("p_calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, "
                     "lead(date) OVER (ORDER BY date) AS next_date FROM p_days)")
    body = sql.strip()
    recursive = bool(re.match(r"WITH\s+RECURSIVE\b", body, re.I))
    rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I) if re.match(r"WITH\b", body, re.I) else None
    if not parts:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + (",\n" + rest if rest is not None else "\n" + body)


class Views:
    """Lazy DataFrames of the tables and views below one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            elif name in VIEWS:
                text = VIEWS[name]
                self._made[name] = self.spark.sql(text, **{d: getattr(self, d) for d in dict.fromkeys(dependencies(text))})
            else:
                raise AttributeError(name)
        return self._made[name]

    def stage(self, name: str) -> None:
        self._made[name] = cut_lineage(getattr(self, name), name)

    @cached_property
    def axis(self) -> DataFrame:
        return session_axis(self.p_days)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded doubles without negative zero, 64-bit integers."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits) + 0.0
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind.startswith("timestamp"):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(name))
    return df.select(*out)
