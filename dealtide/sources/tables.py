"""The base tables as one bundle, read from files or from a catalog."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from dealtide.sources.schemas import CRM_TABLES, TABLES, conform, crm_columns


class Tables:
    """The base tables by name. A table is opened on first use, so a report opens only its own."""

    def __init__(self, load: Callable[[str], DataFrame]):
        self._load = load

    @cached_property
    def opportunity(self) -> DataFrame:
        return self._load("opportunity")

    @cached_property
    def opportunity_field_history(self) -> DataFrame:
        return self._load("opportunity_field_history")

    @cached_property
    def wbs(self) -> DataFrame:
        return self._load("wbs")

    @cached_property
    def resource_request(self) -> DataFrame:
        return self._load("resource_request")

    @cached_property
    def resource_request_history(self) -> DataFrame:
        return self._load("resource_request_history")

    @cached_property
    def resource_actuals(self) -> DataFrame:
        return self._load("resource_actuals")

    @cached_property
    def utilization_calculation(self) -> DataFrame:
        return self._load("utilization_calculation")

    @cached_property
    def utilization_detail(self) -> DataFrame:
        return self._load("utilization_detail")

    @cached_property
    def utilization_summary(self) -> DataFrame:
        return self._load("utilization_summary")


def parquet_tables(spark: SparkSession, root: str) -> Tables:
    """Tables stored as ``<root>/<table>`` under the neutral names of the schemas."""
    return Tables(lambda name: conform(spark.read.parquet(f"{root}/{name}"), TABLES[name]))


def catalog_tables(
    spark: SparkSession,
    namespace: str,
    org: str,
    *,
    tables: Mapping[str, str] = CRM_TABLES,
    columns: Mapping[str, Mapping[str, str]] | None = None,
) -> Tables:
    """Tables of a catalog namespace (``db`` or ``catalog.db``) under their CRM names.

    ``org`` is the prefix of the house's own columns; see ``crm_columns``.
    """
    columns = crm_columns(org) if columns is None else columns
    return Tables(
        lambda name: conform(
            spark.table(f"{namespace}.{tables[name]}"), TABLES[name], columns.get(name)
        )
    )
