"""Backups as file manifests: full, incremental on a base, restored under a new name, by partition, into what exists if asked."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .files import Files


def backup(spark: SparkSession, tables: dict[str, str], to: str, base: str | None = None) -> dict:
    """Copies the tables' files (name -> path). With a base only files that it (or its own base) doesn't hold are copied; a file is the same by name, size and time of change. Returns the manifest."""
    files = Files(spark, to)
    held = {(f["table"], f["name"], f["size"], f.get("modified")): f["at"] for f in manifest(spark, base)["files"]} if base else {}
    out, copies = [], []
    for table, path in sorted(tables.items()):
        root = files.qualified(path)
        for i in Files(spark, path).listed(path):
            name = i.path[len(root):].lstrip("/")
            at = held.get((table, name, i.size, i.modified))
            if at is None:
                at = f"{to}/{table}/{name}"
                copies.append((i.path, at))
            out.append({"table": table, "name": name, "size": i.size, "modified": i.modified, "at": at})
    files.copy_all(copies)
    found = {"base": base, "files": out}
    files.write(f"{to}/manifest.json", json.dumps(found))
    return found


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(Files(spark, path).read(f"{path}/manifest.json"))


def restore(spark: SparkSession, path: str, table: str, to: str, partitions: list[int] | None = None, allow_non_empty: bool = False) -> int:
    """Copies a table's files back, those of some partitions if named; refuses a target with files unless allowed, and then rows may be there twice. Returns the number of files."""
    files = Files(spark, to)
    if not allow_non_empty and files.listed(to):
        raise ValueError(f"{to} isn't empty")
    chosen = [f for f in manifest(spark, path)["files"] if f["table"] == table and (partitions is None or any(f["name"].startswith(f"yyyymm={p}/") for p in partitions))]
    copies = []
    for n, f in enumerate(chosen):
        folder, _, name = f["name"].rpartition("/")
        copies.append((f["at"], "/".join(x for x in (to, folder, f"r{n}-{name}" if allow_non_empty else name) if x)))
    files.copy_all(copies)
    return len(chosen)
