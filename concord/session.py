"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on (UTC) and turn adaptive execution on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "concord", cores: str = "*", partitions: int = 8, **settings: str) -> SparkSession:
    """A one-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(
        builder
        .appName(app)
        .config("spark.driver.memory", os.environ.get("CONCORD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_LOCAL_ROOTS: dict[str, str] = {}


def _shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.conf.get("spark.app.id", "")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="concord-")
    return _LOCAL_ROOTS[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` for written intermediates and stream state.

    Only a local[*] session without the setting gets a folder on its own disk.
    """
    return f"{_shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
