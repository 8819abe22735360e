"""Small hand-made tables under the library's schemas."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from dealtide.sources import schemas


def frame(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """Rows given by column name; columns left out are NULL, numbers become decimals as needed."""
    schema = schemas.TABLES[table]
    kinds = {f.name: f.dataType.typeName() for f in schema.fields}

    def value(row: dict, name: str):
        x = row.get(name)
        if x is not None and kinds[name] == "decimal":
            return Decimal(str(x))
        return x

    return spark.createDataFrame([tuple(value(r, f.name) for f in schema.fields) for r in rows], schema)


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def deal(id: str, created: str, close: str, **columns) -> dict:
    """A won data deal unless told otherwise."""
    return {
        "id": id,
        "created_date": at(created),
        "close_date": day(close),
        "stage_name": "Closed Won",
        "is_won": True,
        "is_closed": True,
        "practice": "Data",
    } | columns


def change(deal_id: str, when: str, field: str, old: str | None, new: str | None) -> dict:
    return {
        "opportunity_id": deal_id,
        "created_date": at(when),
        "field": field,
        "old_value": old,
        "new_value": new,
    }
