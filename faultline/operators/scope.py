"""What keeps repositories apart: frames with a repo_id are joined, grouped and cut by it, frames without are one repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "repo_id"


def scope(df: DataFrame) -> list[str]:
    """The columns that tell repositories apart in df: repo_id or none."""
    return [KEY] if KEY in df.columns else []


def first_of(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first k rows of each repository in the order given; of the whole frame if it has no repo_id."""
    keys = scope(df)
    if not keys:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("scope_rank", rank).where(F.col("scope_rank") <= k).drop("scope_rank")


def scoped(df: DataFrame | None) -> DataFrame | None:
    """df with a repo_id, the same for all rows if it has none."""
    return df if df is None or KEY in df.columns else df.withColumn(KEY, F.lit(""))
