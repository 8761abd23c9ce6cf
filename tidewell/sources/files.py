"""Files through Hadoop's file system API, so that any store Spark reads can be listed, moved and copied."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Item:
    path: str
    size: int
    modified: int


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def listed(self, root: str, suffix: str = "") -> list[Item]:
        """All files below a folder, hidden ones (leading _ or .) left out, by path."""
        out = []
        if not self.exists(root):
            return out
        it = self.fs.listFiles(self._path(root), True)
        base = self.fs.makeQualified(self._path(root)).toString()
        while it.hasNext():
            f = it.next()
            p = f.getPath().toString()
            if p.endswith(suffix) and not any(x.startswith(("_", ".")) for x in p[len(base):].split("/")):
                out.append(Item(p, f.getLen(), f.getModificationTime()))
        return sorted(out, key=lambda i: i.path)

    def folders(self, root: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(root)) if s.isDirectory()) if self.exists(root) else []

    def move(self, a: str, b: str) -> None:
        self.fs.mkdirs(self._path(b).getParent())
        if not self.fs.rename(self._path(a), self._path(b)):
            raise OSError(f"cannot move {a} to {b}")

    def copy(self, a: str, b: str) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(a), self._path(b).getFileSystem(self.conf), self._path(b), False, self.conf)

    def copy_all(self, pairs: list[tuple[str, str]], at_once: int = 32) -> None:
        """Copies (from, to), so many at a time; the first failure is raised."""
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(lambda ab: self.copy(*ab), pairs))

    def delete(self, p: str) -> None:
        self.fs.delete(self._path(p), True)

    def qualified(self, p: str) -> str:
        return self.fs.makeQualified(self._path(p)).toString()

    def write(self, p: str, data: str) -> None:
        out = self.fs.create(self._path(p), True)
        out.write(bytearray(data.encode()))
        out.close()

    def read(self, p: str) -> str:
        stream = self.fs.open(self._path(p))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


def prompt_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: its name and whole text."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("file"), F.col("value").alias("text"))


CHAT = "model string, messages array<struct<role string, content string>>"


def chat_requests(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the typed part of a request's JSON; the raw text stays, with all fields that nobody declared. An error, and no messages, for what is no JSON object, or has messages that aren't objects or whose role or content is neither a string nor null: contents in parts are refused, as none of them would be looked at. A request may have no messages at all."""
    from pyspark.sql import functions as F

    whole = F.try_parse_json(raw)
    each = F.try_variant_get(whole, "$.messages", "array<variant>")

    def kind(v, path: str = "$"):
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    def is_text(v, path: str):
        return kind(v, path).isNull() | kind(v, path).isin("VOID", "STRING")

    def is_message(m):
        return m.isNull() | (kind(m) == "VOID") | kind(m).startswith("OBJECT") & is_text(m, "$.role") & is_text(m, "$.content")

    held = kind(whole, "$.messages")
    good = kind(whole).startswith("OBJECT") & (held.isNull() | (held == "VOID") | held.startswith("ARRAY")) & F.forall(F.coalesce(each, F.array().cast("array<variant>")), is_message)
    parsed = F.when(F.coalesce(good, F.lit(False)), F.from_json(raw, CHAT))
    return df.select("*", parsed["model"].alias("model"), parsed["messages"].alias("messages"), F.when(parsed.isNull(), "bad request").alias("error"))


def rewritten(raw, messages):
    """The request's JSON with each message's content replaced (array<string>; null keeps it); all other fields of messages and request stay what they are, strings, numbers, booleans, nulls and nested values alike. Null for what is no JSON object."""
    from pyspark.sql import functions as F

    raw, messages = (F.col(c) if isinstance(c, str) else c for c in (raw, messages))
    whole = F.from_json(raw, "map<string,variant>")
    parts = F.from_json(raw, "struct<messages:array<map<string,variant>>>")["messages"]

    def message(m, i):
        content = F.get(messages, i)
        return F.transform_values(m, lambda k, v: F.when((k == "content") & content.isNotNull(), content.cast("variant")).otherwise(v))

    new = F.to_variant_object(F.transform(parts, message))
    return F.to_json(F.transform_values(whole, lambda k, v: F.when((k == "messages") & parts.isNotNull(), new).otherwise(v)))
