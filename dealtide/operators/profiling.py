"""A first look at tables: some rows, and the facts one notes about their columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealtide.functions.dates import as_of_date, days_between


def table_preview(
    table: DataFrame, *, n: int = 5, order_by: Sequence[str | Column] = ()
) -> DataFrame:
    """The first ``n`` rows in the given order, or any ``n`` rows without one."""
    return (table.orderBy(*order_by) if order_by else table).limit(n)


#: Fields of the unpivoted rows: a long that is the value itself, values that are digested, and digests of others.
_WHOLE, _REAL, _TEXT, _BYTES, _PAIR = "whole", "real", "words", "bytes", "pair"
_TYPES = {
    _WHOLE: "bigint", _REAL: "double", _TEXT: "string", _BYTES: "binary", _PAIR: "struct<a: bigint, b: bigint>",
}
_DAY = 86_400_000_000


def _unpivoted(value: Column, kind: T.DataType) -> tuple[str, Column]:
    """The field that holds a column's values, and them as its type."""
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return _WHOLE, value.cast("bigint")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return _WHOLE, (value * F.expr(f"{10**kind.scale}BD")).cast("bigint")
    if isinstance(kind, T.DateType):
        return _WHOLE, F.unix_date(value).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return _WHOLE, F.unix_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        minutes = (F.hour(value) * 60 + F.minute(value)).cast("bigint")
        micros = (F.extract(F.lit("SECOND"), value) * 1_000_000).cast("bigint")
        return _WHOLE, F.unix_date(F.to_date(value)) * F.lit(_DAY) + minutes * 60_000_000 + micros
    if isinstance(kind, T.FloatType | T.DoubleType):
        return _REAL, value.cast("double")
    if isinstance(kind, T.StringType):
        return _TEXT, value.cast("string")
    if isinstance(kind, T.BinaryType):
        return _BYTES, value
    # Wide decimals and nested values are digested as they are; maps, which can't be, by their entries.
    whole = value if not _holds_map(kind) else F.to_json(F.struct(value.alias("v")))
    return _PAIR, F.when(value.isNotNull(), F.struct(*_digest(whole)))


def _digest(*values: Column) -> tuple[Column, Column]:
    """128 bits of hash; null values are passed over."""
    return F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b")


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.AtomicType)


def _named(table: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return table["`" + name.replace("`", "``") + "`"]


def table_profile(
    table: DataFrame, *, as_of: dt.date | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Per column: rows, nulls, zeros (numbers only), distinct values, date of the newest value and its age.

    One scan whatever the number of columns: every row becomes (column number, value) pairs with a field for each kind of value, so values
    are digested after that, by one expression for all columns. Integers, decimals of up to 18 digits, booleans, dates
    and times are their own digest, others get 128 bits of hash. Pairs are folded on these three numbers, of fixed width, before they are
    shuffled, so a value that fills a third of a column moves as one row per task, and no text is shuffled. Values are told apart as their
    type does: two instants of a repeated hour are two; 0.0 and -0.0 are one, and so are all NaN. An empty table gives
    zeros, no columns an empty frame.
    """
    fields = [f for f in table.schema.fields if columns is None or f.name in columns]
    names = table.sparkSession.createDataFrame(
        [(i, f.name, isinstance(f.dataType, T.NumericType), f.dataType.typeName()) for i, f in enumerate(fields)],
        "at int, column string, number boolean, kind string",
    )
    if fields:
        facts = _facts(table, fields)
    else:
        facts = names.selectExpr(
            "at", "0L as rows", "0L as nulls", "0L as zeros", "0L as distinct_values", "0L as most"
        )
    none = F.lit(0).cast("bigint")
    newest = F.expr(
        f"""CASE kind WHEN 'date' THEN date_from_unix_date(cast(most AS int))
                WHEN 'timestamp' THEN to_date(timestamp_micros(most))
                WHEN 'timestamp_ntz' THEN date_from_unix_date(cast(floor(most / {_DAY}) AS int)) END"""
    )
    return (
        names.join(facts, "at", "left")
        .withColumn("max_date", newest)
        # A row per column of the table: one task sorts them without sampling for ranges.
        .coalesce(1)
        .sortWithinPartitions("at")
        .select(
            "column",
            F.coalesce("rows", none).alias("rows"),
            F.coalesce("nulls", none).alias("nulls"),
            F.when(F.col("number"), F.coalesce("zeros", none)).alias("zeros"),
            F.coalesce("distinct_values", none).alias("distinct_values"),
            "max_date",
            days_between(F.col("max_date"), as_of_date(as_of)).alias("days_since_max"),
        )
    )


def _facts(table: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """at, rows, nulls, zeros (of numbers), distinct_values, most: the greatest of values that are their own digest."""
    placed = [_unpivoted(_named(table, f.name), f.dataType) for f in fields]
    kinds = list(dict.fromkeys(kind for kind, _ in placed))
    # A column of each kind that is null throughout stands for the fields that a value doesn't fill.
    base = table.select(
        *[v.alias(f"v{at}") for at, (_, v) in enumerate(placed)],
        *[F.lit(None).cast(_TYPES[k]).alias(f"no_{k}") for k in kinds],
    )
    groups = (
        f"({', '.join(f'v{at}' if k == kind else f'no_{k}' for k in kinds)}) AS `{at}`"
        for at, (kind, _) in enumerate(placed)
    )
    listed = ", ".join(kinds)
    values = table.sparkSession.sql(
        f"SELECT cast(at AS int) AS at, {listed} FROM {{base}}"
        f" UNPIVOT INCLUDE NULLS (({listed}) FOR at IN ({', '.join(groups)}))",
        base=base,
    )
    first, second = [], []
    if _WHOLE in kinds:
        first.append(F.col(_WHOLE))
        second.append(F.when(F.col(_WHOLE).isNotNull(), F.lit(0).cast("bigint")))
    if _PAIR in kinds:
        first.append(F.col("pair.a"))
        second.append(F.col("pair.b"))
    if digested := [k for k in kinds if k not in (_WHOLE, _PAIR)]:
        # Only one of the fields has a value.
        some = reduce(Column.__or__, [F.col(k).isNotNull() for k in digested])
        first, second = (
            [*known, F.when(some, hashed)] for known, hashed in zip((first, second), _digest(*digested), strict=True)
        )
    folded = (
        values.select("at", F.coalesce(*first).alias("first"), F.coalesce(*second).alias("second"))
        .groupBy("at", "first", "second")
        .agg(F.count("*").alias("n"))
    )
    # What zero looks like, in each type that is hashed too.
    zeros = [(F.lit(0), F.lit(0)), _digest(F.lit(0.0))]
    wide = {f.dataType for f in fields if isinstance(f.dataType, T.DecimalType) and f.dataType.precision > 18}
    zeros += [_digest(F.lit(0).cast(kind)) for kind in wide]
    is_zero = reduce(Column.__or__, [(F.col("first") == a) & (F.col("second") == b) for a, b in zeros])
    return folded.groupBy("at").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("first").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(is_zero, F.col("n")).otherwise(0)).alias("zeros"),
        F.count("first").alias("distinct_values"),
        F.max("first").alias("most"),
    )


# ------------------------------------------------------------------ a whole catalog

#: Types whose counts, or whose least and greatest values, the readers have from file footers.
_COUNTED = (
    T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType, T.DateType, T.DecimalType, T.StringType,
    T.BinaryType, T.TimestampType, T.TimestampNTZType,
)
_BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)
_FOOTERS = {
    "spark.sql.sources.useV1SourceList": "",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.orc.aggregatePushdown": "true",
}


def tables_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of the tables in a folder by name: its subfolders and files, with any ending like .parquet left off."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    found = {}
    for status in listed:
        name = status.getPath().getName()
        if not name.startswith((".", "_")):
            found[name.partition(".")[0]] = status.getPath().toString()
    return dict(sorted(found.items()))


def catalog_profile(
    spark: SparkSession,
    tables: Mapping[str, str] | str,
    *,
    file_format: str = "parquet",
    as_of: dt.date | None = None,
    stale_days: int = 365,
) -> DataFrame:
    """A line per column of many tables: table, column, type, rows, nulls, zeros_only, newest, days_since, verdict.

    tables: paths by name, or a folder of tables. Rows, nulls, bounds and newest dates are read from file footers, which hold them
    exactly; only what footers lack is scanned, and of that only the columns in question: newest times, and whether
    decimals are zero throughout. A table whose files have no statistics is scanned. The verdict is the first of "empty" (the table has no
    rows), "all null", "zeros only", "stale" (the newest date of the whole table is over ``stale_days`` old), else "data". Nested
    columns have no null count here; `table_profile` has.

    The tables are looked at when this is called; the result, a row per column, is a local frame.
    """
    paths = tables_in(spark, tables) if isinstance(tables, str) else dict(tables)
    # Its readers take aggregates from footers.
    session = spark.newSession()
    for key, value in _FOOTERS.items():
        session.conf.set(key, value)
    rows: list[tuple] = []
    for name, path in paths.items():
        try:
            rows += _column_rows(name, session.read.format(file_format).load(path))
        except (PySparkException, Py4JJavaError):
            # No statistics in some footer: the same by a scan, which fails if anything else was wrong.
            rows += _column_rows(name, spark.read.format(file_format).load(path))
    known = spark.createDataFrame(rows, _CATALOG)
    verdict = (
        F.when(F.col("rows") == 0, "empty")
        .when(F.col("nulls") == F.col("rows"), "all null")
        .when(F.col("zeros_only"), "zeros only")
        .when(days_between(F.col("of_table"), as_of_date(as_of)) > stale_days, "stale")
        .otherwise("data")
    )
    age = days_between(F.col("newest"), as_of_date(as_of)).alias("days_since")
    return known.select(*known.columns[:-1], age, verdict.alias("verdict"))


_CATALOG = (
    "table string, column string, type string, rows bigint, nulls bigint, zeros_only boolean, newest date,"
    " of_table date"
)


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)


def footer_facts(table: DataFrame) -> DataFrame:
    """One row of what footers hold: rows, and by the column's number its count n, and least and most where they have bounds."""
    found = [F.count("*").alias("rows")]
    for i, field in enumerate(table.schema.fields):
        if isinstance(field.dataType, _COUNTED):
            found.append(F.count(_named(table, field.name)).alias(f"n{i}"))
        if isinstance(field.dataType, _BOUNDED):
            found += _bounds(table, i)
    return table.agg(*found)


def scanned_facts(table: DataFrame) -> DataFrame | None:
    """One row of the bounds of times and decimals, which footers lack; None if there are none."""
    found = []
    for i, field in enumerate(table.schema.fields):
        if isinstance(field.dataType, T.TimestampType | T.TimestampNTZType | T.DecimalType):
            found += _bounds(table, i)
    return table.agg(*found) if found else None


def _bounds(table: DataFrame, i: int) -> list[Column]:
    field = table.schema.fields[i]
    value = _named(table, field.name)
    least, most = F.min(value), F.max(value)
    if _is_time(field.dataType) and not isinstance(field.dataType, T.DateType):
        least, most = F.to_date(least), F.to_date(most)
    return [least.alias(f"least{i}"), most.alias(f"most{i}")]


def _column_rows(name: str, table: DataFrame) -> list[tuple]:
    """Rows of a table's columns: as _CATALOG."""
    facts = footer_facts(table).first().asDict()
    if (scanned := scanned_facts(table)) is not None:
        facts |= scanned.first().asDict()
    fields = table.schema.fields
    total = facts["rows"] or 0  # files without a row group have no count at all
    newest = {i: facts[f"most{i}"] for i, f in enumerate(fields) if _is_time(f.dataType)}
    of_table = max((day for day in newest.values() if day is not None), default=None)
    out = []
    for i, field in enumerate(fields):
        zeros_only = None
        if isinstance(field.dataType, T.NumericType):
            least, most = facts[f"least{i}"], facts[f"most{i}"]
            zeros_only = None if least is None else bool(least == 0 and most == 0)
        counted = isinstance(field.dataType, _COUNTED)
        nulls = total - (facts[f"n{i}"] or 0) if counted else None
        kind = field.dataType.simpleString()
        out.append((name, field.name, kind, total, nulls, zeros_only, newest.get(i), of_table))
    return out


def duplicate_ids(table: DataFrame, *, id: str = "id") -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    return (
        table.filter(F.col(id).isNotNull())
        .groupBy(F.col(id).alias("id"))
        .agg(F.count("*").alias("num_rows"))
        .filter(F.col("num_rows") > 1)
    )
