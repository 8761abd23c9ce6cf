"""Sinks for people: one tenant's CSV, other text formats, audit lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_view(df: DataFrame, tenant: int, at: str = "event_time", money: str = "revenue", tenant_col: str = "tenant_id") -> DataFrame:
    """A tenant's rows in time order, times as RFC 3339, money with two decimals, without the tenant's column."""
    own = df.where(F.col(tenant_col) == tenant).orderBy(at)
    shown = {at: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), money: F.col(money).cast("decimal(18,2)").cast("string")}
    return own.select(*[shown.get(c, F.col(c)).alias(c) for c in df.columns if c != tenant_col])


def export_csv(df: DataFrame, tenant: int, path: str, files: int | None = 1) -> None:
    """files=1 gives one file; None keeps the sorted parts, for tenants too large for one task."""
    out = export_view(df, tenant)
    (out.coalesce(files) if files else out).write.mode("overwrite").option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=False)


def shown(df: DataFrame, rows: int = 20, vertical: bool = False) -> str:
    """A table, or a block of lines per row, as text."""
    return df._show_string(rows, 80, vertical)


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)
