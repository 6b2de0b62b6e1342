"""The folder that driver and executors share, and cuts of lineage in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder and any other one gets a
    folder below the warehouse, which is shared as well."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="tessera-")
        return _own[context.applicationId]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, without its lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
