"""Small registry: a query function and, where it exists, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvella.plans.views import Views
from corvella.plans.views import sql as with_views


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str] = {}

    def add(self, name: str, views: str = "", sql: str | None = None):
        """Decorator for ``f(views) -> DataFrame``; ``views`` are the SQL views that ``sql`` needs."""

        def keep(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
            self.QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if sql is not None:
                self.ORACLES[name] = with_views(views, sql) if views else sql
            return f

        return keep
