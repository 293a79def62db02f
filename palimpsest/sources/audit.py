"""The audit trail and labelled sets as JSON lines in any store that Spark writes to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.schema import AUDIT, GOLD


def write_audit_log(entries: DataFrame, path: str, append: bool = True) -> None:
    """Append (default) or overwrite. Null fields are left out, so document_id appears only where there is one. An empty frame still makes the folder."""
    entries.write.mode("append" if append else "overwrite").json(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """All entries; none if the path doesn't exist. Blank lines are skipped; a malformed one raises."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return spark.createDataFrame([], AUDIT)
    return spark.read.schema(AUDIT).option("mode", "FAILFAST").json(path)


def write_gold(cases: DataFrame, path: str) -> None:
    cases.select(*GOLD.fieldNames()).write.mode("overwrite").json(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which all executors share; where it is unset, and all runs on one machine, in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="palimpsest-")
    return f"{shared.rstrip('/')}/palimpsest/{name}-{uuid.uuid4().hex}"
