"""Sessions, table access and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def session(app: str = "tidewell", **conf: str) -> SparkSession:
    """A session with the engine's settings: UTC, ANSI mode, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_info(spark: SparkSession) -> DataFrame:
    """One row: the driver's host, the engine's version, and the session's macros (settings under ``tidewell.macro``)."""
    macros = {k.removeprefix("tidewell.macro."): v for k, v in spark.conf.getAll.items() if k.startswith("tidewell.macro.")}
    return spark.createDataFrame([(spark.conf.get("spark.driver.host"), spark.version, macros)], "host string, version string, macros map<string,string>")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which a cluster's machines share; a local session without one has its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.gettempdir() + '/checkpoints').rstrip('/')}/tidewell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
