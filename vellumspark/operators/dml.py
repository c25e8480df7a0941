"""Changes of a table as new tables (D-1..D-15): each takes DataFrames and returns the changed DataFrame, for its caller to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """D-1: missing columns become null."""
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None, ignore: bool = False) -> DataFrame:
    """D-2, D-11, D-13: rows replace those of equal keys, or with ignore give way to them. order: the later of equal new keys wins."""
    rows = last_of(rows, keys, order) if order else rows.dropDuplicates(keys)
    if order and order not in table.columns:
        rows = rows.drop(order)
    if ignore:
        return insert(table, rows.join(table.select(*keys), keys, "left_anti"))
    return insert(table.join(rows.select(*keys), keys, "left_anti"), rows)


def update(table: DataFrame, where: Column, **values) -> DataFrame:
    """D-3, D-9, D-10, D-15: values are Columns or constants, read before the change."""
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, where: Column) -> DataFrame:
    """D-4: rows where the condition is unknown stay."""
    return table.where(~F.coalesce(where, F.lit(False)))


def replace_keys(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """D-5: all rows of the new rows' keys go, the new rows come."""
    return insert(table.join(rows.select(*keys).distinct(), keys, "left_anti"), rows)


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """D-6, D-8: the new rows whose keys aren't there, once each."""
    return insert(table, rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def update_existing(table: DataFrame, other: DataFrame, keys: list[str], **values) -> DataFrame:
    """D-7: rows that have a partner by null-safe equality are changed."""
    marks = other.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_hit", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = table.join(marks, on, "left")
    return update(joined, F.col("_hit"), **values).select(*table.columns)


def delete_by(table: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """D-12, D-14: without rows whose keys are among the ids; children of deleted parents go the same way."""
    return table.join(ids.select(*keys).distinct(), keys, "left_anti")


def unset_by(table: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """D-12: references to deleted rows become null."""
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    return table.join(gone, F.col(column) == F.col("_gone"), "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")
