"""Parquet tables with a declared layout: sort key, month partitions, bloom filters, codecs; partition operations, retention, compaction."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from ..functions.scalars import readable_size, shard_number, yyyymm
from ..plans.queries import tagged
from .files import Files


@dataclass(frozen=True)
class Table:
    """``order``: columns rows are sorted by inside files (row groups' statistics then prune); ``by_month``: a time column that gives the partition ``yyyymm``; ``bloom``: columns with a bloom filter; ``codec``: Parquet compression."""

    path: str
    schema: StructType
    order: tuple[str, ...] = ()
    by_month: str | None = None
    bloom: tuple[str, ...] = ()
    codec: str = "zstd"
    options: dict[str, str] = field(default_factory=dict)

    def like(self, path: str, **changes: object) -> Table:
        """The same structure elsewhere, without rows."""
        return Table(**{**self.__dict__, "path": path, **changes})

    def _write(self, df: DataFrame, path: str, mode: str, moved: bool = False) -> None:
        """``moved``: rows lie in the parts that they are to be written from."""
        if self.by_month:
            df = df.withColumn("yyyymm", yyyymm(self.by_month))
        if self.by_month and not moved:
            df = df.hint("rebalance", "yyyymm")  # a month's rows come together, large months in several parts: few files each
        keys = (["yyyymm"] if self.by_month else []) + list(self.order)
        out = (df.sortWithinPartitions(*keys) if keys else df).write.mode(mode).option("compression", self.codec)
        for c in self.bloom:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        for k, v in self.options.items():
            out = out.option(k, v)
        with tagged(df.sparkSession, f"write {path}", **{"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}):  # 96-bit times have no statistics
            (out.partitionBy("yyyymm") if self.by_month else out).parquet(path)

    def append(self, df: DataFrame) -> None:
        """Columns by name; missing ones take their type's default."""
        self._write(with_defaults(df, self.schema), self.path, "append")

    def read(self, spark: SparkSession) -> DataFrame:
        if not Files(spark, self.path).listed(self.path, ".parquet"):
            return spark.createDataFrame([], self.schema)
        return spark.read.parquet(self.path).select(self.schema.names)

    def truncate(self, spark: SparkSession) -> None:
        Files(spark, self.path).delete(self.path)

    # partitions
    def partitions(self, spark: SparkSession) -> list[int]:
        return [int(f.split("=")[1]) for f in Files(spark, self.path).folders(self.path) if f.startswith("yyyymm=")]

    def _detached(self, part: int) -> str:
        return f"{self.path}/_detached/yyyymm={part}"

    def detach(self, spark: SparkSession, part: int) -> None:
        Files(spark, self.path).move(f"{self.path}/yyyymm={part}", self._detached(part))

    def attach(self, spark: SparkSession, part: int) -> None:
        files = Files(spark, self.path)
        if files.exists(f"{self.path}/yyyymm={part}"):
            for i in files.listed(self._detached(part)):
                files.move(i.path, f"{self.path}/yyyymm={part}/{uuid.uuid4().hex[:8]}-{i.path.rsplit('/', 1)[1]}")  # names may be taken
            files.delete(self._detached(part))
        else:
            files.move(self._detached(part), f"{self.path}/yyyymm={part}")

    def drop(self, spark: SparkSession, part: int) -> None:
        Files(spark, self.path).delete(f"{self.path}/yyyymm={part}")

    def expire(self, spark: SparkSession, now: str, days: int, whole_partitions: bool = True) -> list[int]:
        """Retention: months that end before the cutoff are dropped; unless ``whole_partitions``, the month that holds it is rewritten too. Returns the partitions touched."""
        cutoff = spark.range(1).select((F.to_timestamp(F.lit(now)) - F.make_dt_interval(F.lit(days))).alias("t")).first()["t"]
        month = cutoff.year * 100 + cutoff.month
        touched = [p for p in self.partitions(spark) if p < month]
        for p in touched:
            self.drop(spark, p)
        if not whole_partitions and month in self.partitions(spark):
            self._rewrite(spark, month, lambda df: df.where(F.col(self.by_month) >= F.lit(cutoff)))
            touched.append(month)
        return touched

    def _rewrite(self, spark: SparkSession, part: int, change, files: int = 1) -> None:
        """A partition's new files are written beside it and swapped in by two renames; a crash between them leaves the old ones in _old."""
        store, own, new = Files(spark, self.path), f"{self.path}/yyyymm={part}", f"{self.path}/_new"
        store.delete(new)
        df = change(spark.read.parquet(own).select([c for c in self.schema.names]))
        self._write(df.repartitionByRange(files, *self.order) if files > 1 and self.order else df.repartition(files), new, "overwrite", moved=True)
        self._swap(store, part)
        store.delete(new)

    def _swap(self, store: Files, part: int) -> None:
        own, new, old = f"{self.path}/yyyymm={part}", f"{self.path}/_new/yyyymm={part}", f"{self.path}/_old/yyyymm={part}"
        store.delete(old)
        if store.exists(own):
            store.move(own, old)
        if store.exists(new):
            store.move(new, own)
        store.delete(old)

    def alter(self, spark: SparkSession, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """Writes the table anew in this table's layout (sort key, bloom filters, codec), with its rows changed, in one job beside it; then its partitions are swapped in one by one. Returns how many there were."""
        parts, store, new = self.partitions(spark), Files(spark, self.path), f"{self.path}/_new"
        if not parts:
            return 0
        store.delete(new)
        self._write(change(spark.read.parquet(self.path).select(self.schema.names)), new, "overwrite")
        made = [int(f.split("=")[1]) for f in store.folders(new) if f.startswith("yyyymm=")]
        for p in sorted({*parts, *made}):
            self._swap(store, p)
        store.delete(new)
        return len(parts)

    def move(self, spark: SparkSession, part: int, to: Table) -> None:
        """A partition goes to another table of the same structure, on another store perhaps."""
        source, target = Files(spark, self.path), f"{to.path}/yyyymm={part}"
        source.copy_all([(i.path, f"{target}/{uuid.uuid4().hex[:8]}-{i.path.rsplit('/', 1)[1]}") for i in source.listed(f"{self.path}/yyyymm={part}")])
        self.drop(spark, part)

    def optimize(self, spark: SparkSession, part: int, target_mb: int = 512) -> None:
        """Rewrites a partition as few sorted files of about ``target_mb``."""
        size = sum(i.size for i in Files(spark, self.path).listed(f"{self.path}/yyyymm={part}"))
        self._rewrite(spark, part, lambda df: df, max(1, -(-size // (target_mb << 20))))

    # metadata
    def parts(self, spark: SparkSession) -> DataFrame:
        """A row per file: partition, rows, bytes, level of nothing but what footers and listings say."""
        items = Files(spark, self.path).listed(self.path, ".parquet")
        rows = [((re.search(r"yyyymm=(\d+)", i.path) or [None, None])[1], i.path.rsplit("/", 1)[1], i.size, i.path) for i in items]
        files = spark.createDataFrame(rows, "partition string, name string, bytes long, path string").withColumn("place", _place("path")).drop("path")
        if not rows:
            return files.select("partition", "name", F.lit(0).cast("long").alias("rows"), "bytes")
        counts = spark.read.parquet(self.path).groupBy(_place(F.input_file_name()).alias("place")).agg(F.count(F.lit(1)).alias("rows"))
        return files.join(counts, "place", "left").select("partition", "name", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes")

    def columns(self, spark: SparkSession) -> DataFrame:
        """Compressed and uncompressed bytes of each column, from the footers alone: they are read in parallel at the files' ends, a batch of files in memory at a time."""
        sizes: dict[tuple[str, str], list[int]] = {}
        for b in _row_groups(spark, self.path):
            for c in b.getColumns():
                own = sizes.setdefault((c.getPath().toDotString(), c.getPrimitiveType().getPrimitiveTypeName().toString()), [0, 0])
                own[0] += c.getTotalSize()
                own[1] += c.getTotalUncompressedSize()
        return spark.createDataFrame([(*k, *v) for k, v in sorted(sizes.items())], "name string, type string, compressed long, uncompressed long")


def _row_groups(spark: SparkSession, path: str, at_once: int = 512) -> Iterator[object]:
    files, jvm = Files(spark, path), spark._jvm
    items = files.listed(path, ".parquet")
    for i in range(0, len(items), at_once):
        statuses = jvm.java.util.ArrayList()
        for item in items[i:i + at_once]:
            statuses.add(files.fs.getFileStatus(files._path(item.path)))
        for footer in jvm.org.apache.parquet.hadoop.ParquetFileReader.readAllFootersInParallel(files.conf, statuses, False):
            yield from footer.getParquetMetadata().getBlocks()


def encodings(delta: tuple[str, ...] = (), split: tuple[str, ...] = ()) -> dict[str, str]:
    """Write options by column: differences packed in few bits for regular integers and times, bytes split by place for floats that change little. Both leave the dictionary."""
    out = {"parquet.writer.version": "v2"} if delta else {}
    out |= {f"parquet.enable.dictionary#{c}": "false" for c in (*delta, *split)}
    return out | {f"parquet.enable.bytestreamsplit#{c}": "true" for c in split}


def _place(path: Column | str) -> Column:
    """Folder and name: one task's files share their name across partitions."""
    return F.substring_index(path, "/", -2)


def with_defaults(df: DataFrame, schema: StructType) -> DataFrame:
    """All columns of the schema by name and type; those that df lacks hold 0, '', false or null."""
    zero = {"string": "", "boolean": False, "date": "1970-01-01", "timestamp": "1970-01-01 00:00:00", "timestamp_ntz": "1970-01-01 00:00:00"}

    def one(f) -> Column:
        kind = f.dataType.simpleString()
        if f.name in df.columns:
            return F.col(f.name).cast(f.dataType).alias(f.name)
        return F.lit(zero.get(kind, None if kind.startswith(("array", "map", "struct", "binary")) else 0)).cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in schema])


def storage_report(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).withColumn("on_disk", readable_size("bytes"))


def parts_pressure(parts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Groups of over ``most`` files."""
    return storage_report(parts, keys).where(F.col("parts") > most)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, order: tuple[str, ...] = (), path: str | None = None) -> None:
    """A catalog table dealt into buckets by a key: filters on the key read one bucket, joins on it need no shuffle."""
    out = df.write.mode("overwrite")
    (out.option("path", path) if path else out).bucketBy(buckets, key).sortBy(key, *[c for c in order if c != key]).format("parquet").saveAsTable(name)


def _whole(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, IntegralType)


def write_sharded(df: DataFrame, path: str, key: str, shards: int) -> None:
    """Appends each row to its shard's folder, by a hash of the key; large shards in several files."""
    df.withColumn("shard", shard_number(key, shards, _whole(df, key))).hint("rebalance", "shard").write.mode("append").partitionBy("shard").parquet(path)


def read_sharded(spark: SparkSession, path: str, key: str, shards: int, equal_to: object = None) -> DataFrame:
    """All shards as one table; for one key only its shard's folder is read."""
    df = spark.read.parquet(path)
    if equal_to is not None:
        value = F.lit(equal_to).cast(df.schema[key].dataType)
        df = df.where((F.col("shard") == shard_number(value, shards, _whole(df, key))) & (F.col(key) == value))
    return df.drop("shard")


def set_index(spark: SparkSession, path: str, column: str, most: int) -> None:
    """An index beside a table's files: each file's distinct values of a column, null for files that have more than ``most``."""
    place, seen = F.input_file_name(), F.col(column)
    held = spark.read.parquet(path).select(place.alias("file"), seen.alias("v")).distinct()
    counts = held.groupBy("file").agg(F.count("v").alias("n"))
    few = held.join(counts.where(F.col("n") <= most), "file").groupBy("file").agg(F.collect_set("v").alias("held"))  # at most ``most`` a file
    counts.select("file").join(few, "file", "left").write.mode("overwrite").parquet(f"{path}_index/{column}")


def read_indexed(spark: SparkSession, path: str, column: str, value: object) -> DataFrame:
    """Rows of one value, from the files that the index doesn't rule out; files written since the index was count as not ruled out."""
    files = Files(spark, path)
    index = spark.read.parquet(f"{path}_index/{column}")
    known = {files.qualified(r["file"]): r["may"] for r in index.select("file", (F.col("held").isNull() | F.array_contains("held", F.lit(value))).alias("may")).toLocalIterator()}
    chosen = [i.path for i in files.listed(path, ".parquet") if known.get(i.path, True)]
    whole = spark.read.parquet(path)
    return (spark.read.schema(whole.schema).option("basePath", path).parquet(*chosen) if chosen else whole.limit(0)).where(F.col(column) == F.lit(value))


def gathered_copies(copies: dict[str, DataFrame]) -> DataFrame:
    """All nodes' copies of a relation as one, with the node each row comes from."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.withColumn("host", F.lit(host)) for host, df in copies.items()])
