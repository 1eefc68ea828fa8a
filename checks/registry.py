"""Registration of queries with their oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Views, tidy, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, digits: int = 6, stage: tuple[str, ...] = ()):
    """Register a query. Views named in ``stage`` feed several branches of the plan: they are aggregated once and
    written to the shared folder, so the raw tables are not scanned again for every branch."""
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            views = Views(spark, sf_dir)
            for name in stage:
                views.stage(name)
            return tidy(build(views), digits)

        run.__name__ = key
        if key in QUERIES:
            raise KeyError(f"{key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return build

    return register


def r(expression: str, digits: int = 6) -> str:
    """Rounded double without negative zero, for oracle statements."""
    return f"round(cast({expression} AS double), {digits}) + 0.0"


def cols(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def big(*names: str) -> str:
    return ", ".join(f"cast({n} AS bigint) AS {n}" for n in names)
