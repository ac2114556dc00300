"""Session helpers: tables written once to the shared checkpoint folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, str], str] = {}
_own_dir: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dir[app] = tempfile.mkdtemp(prefix="barweave-")
    return _own_dir[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, name: str, build) -> DataFrame:
    """Read the table ``name``; the first call in an application writes it.

    Writing cuts the lineage with a durable table, so a lost executor re-reads
    files instead of recomputing the whole chain.
    """
    key = (spark.sparkContext.applicationId, name)
    if key in _written:
        try:
            return spark.read.parquet(_written[key])
        except AnalysisException:  # the folder was cleaned up meanwhile
            pass
    digest = hashlib.sha1(name.encode()).hexdigest()[:10]
    path = scratch_path(spark, f"table-{digest}")
    build().write.parquet(path)
    _written[key] = path
    return spark.read.parquet(path)
