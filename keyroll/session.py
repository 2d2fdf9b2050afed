"""Spark session settings and the shared scratch location.

Every job in this package is written against a plain ``SparkSession``; the
helpers here only pin what the semantics depend on (UTC session time zone,
ANSI casts at parse points) and turn on adaptive execution.
"""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import SparkSession

# Settings the results depend on (time zone) or that every plan benefits from.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "keyroll", extra: dict | None = None) -> SparkSession:
    """Session for tests, the bench and local runs (never used on a cluster,
    where the caller's session is passed in)."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.setdefault("spark.sql.maxMetadataStringLength", "2000")  # plans show whole filters, whatever their columns' numbers
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Pin the runtime settings the results depend on."""
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.adaptive.enabled"):
        spark.conf.set(k, BASE_CONF[k])
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared file system) and it is
    an error if it is not; only a local master (tests, local runs) gets a folder
    under the system temp dir.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="keyroll-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_SCOPES = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder inside the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    if getattr(_SCOPES, "paths", None) is not None:
        _SCOPES.paths.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the folders that :func:`scratch_path` names in the block when it ends: for a
    micro-batch, whose results are written elsewhere by then."""
    outer, _SCOPES.paths = getattr(_SCOPES, "paths", None), []
    try:
        yield
    finally:
        paths, _SCOPES.paths = _SCOPES.paths, outer
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shared_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder of the shared storage (file, hdfs, s3, gs)."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)
