"""Stored tables that merge by key: the newest version of each row, or sums, in buckets of the key.

Appends write their rows as they are, dealt into the table's buckets. Reads merge what is there, compacted or not, within the
buckets: no shuffle. Compaction writes the merged rows as a new table and puts it in the old one's place.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .files import Files


@dataclass
class Keyed:
    """``version`` (columns, later ones settle ties) makes a table of newest versions, in which rows with a true ``deleted`` vanish; ``sums`` makes a summed one. Key columns may be null."""

    spark: SparkSession
    keys: list[str]
    version: tuple[str, ...] = ()
    deleted: str | None = None
    sums: tuple[str, ...] = ()
    buckets: int = 16
    name: str = field(default_factory=lambda: f"keyed_{uuid.uuid4().hex}")

    def __post_init__(self) -> None:
        if bool(self.version) == bool(self.sums):
            raise ValueError("a table keeps versions or adds up")
        self._settle()

    def _settle(self) -> None:
        """Finish a swap that broke off between its two renames."""
        catalog = self.spark.catalog
        if not catalog.tableExists(self.name) and catalog.tableExists(f"{self.name}_next"):
            self.spark.sql(f"ALTER TABLE {self.name}_next RENAME TO {self.name}")

    def _write(self, df: DataFrame, name: str) -> None:
        dealt = df.repartition(self.buckets, *self.keys)  # as buckets are dealt: a file a bucket
        out = dealt.write.mode("append").format("parquet")
        if not self.spark.catalog.tableExists(name):
            out = out.option("path", scratch(self.spark, name))
        out.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(name)

    def append(self, df: DataFrame) -> None:
        self._write(df, self.name)

    def rows(self) -> DataFrame:
        """All stored rows, unmerged."""
        return self.spark.table(self.name)

    def _merged(self) -> DataFrame:
        df = self.rows()
        if self.sums:
            kinds = {f.name: f.dataType for f in df.schema}
            return df.groupBy(*self.keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in self.sums])
        rest = [c for c in df.columns if c not in self.keys]
        last = df.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.version)).alias("_r"))
        return last.select(*[c if c in self.keys else F.col(f"_r.{c}").alias(c) for c in df.columns])

    def read(self) -> DataFrame:
        """One row a key."""
        out = self._merged()
        return out.where(~F.coalesce(F.col(self.deleted), F.lit(False))) if self.deleted else out

    def compact(self) -> None:
        """Leave one row a key. Deleted ones stay as such: a later append may bring an older version. A summed table must not be appended to meanwhile."""
        old = self.spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_next")
        self._write(self._merged(), f"{self.name}_next")
        self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {self.name}_old")
        self.spark.sql(f"ALTER TABLE {self.name}_next RENAME TO {self.name}")
        self.spark.sql(f"DROP TABLE {self.name}_old")
        Files(self.spark, old).delete(old)

    def drop(self) -> None:
        at = self.spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Location'").first()["data_type"]
        self.spark.sql(f"DROP TABLE {self.name}")
        Files(self.spark, at).delete(at)
