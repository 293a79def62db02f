"""What the operators of this subpackage share: words, staged tables, packed rows."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LIBC = ctypes.CDLL(None)

#: Words are runs of anything but the six ASCII white-space characters. bytes.split() cuts UTF-8 at the same places.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_SPACE = " \t\n\x0b\x0c\r"


def encode(text: str) -> bytes:
    """UTF-8, also of lone surrogates, which Arrow never delivers but tests may."""
    return text.encode("utf-8", "surrogatepass")


def word_count(text: Column) -> Column:
    """Number of words of a text column, without leaving the JVM; null counts 0."""
    bare = F.btrim(text, F.lit(WORD_SPACE))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(bare, WORD_GAP))).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and everything runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors, keeps the column types."""
    path = f"{shared_dir(df.sparkSession)}/palimpsest/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_palimpsest_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def set_default(spark: SparkSession, key: str, value: str) -> None:
    """Set what the user hasn't. It stays set: frames are planned when they are used, which is after the operator has returned."""
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, value)


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Rows of documents are long: let Spark close an Arrow batch at some MB, not at so many rows, so that a worker's memory is bounded.

    A user's own spark.sql.execution.arrow.maxBytesPerBatch is left as it is.
    """
    set_default(spark, "spark.sql.execution.arrow.maxBytesPerBatch", f"{most}b")


def keep_bytes(spark: SparkSession, data: bytes, path: str) -> None:
    """Write a small object, such as a network's weights, where Spark writes."""
    spark.createDataFrame([(bytearray(data),)], "data binary").coalesce(1).write.mode("overwrite").parquet(path)


def kept_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(path).first()["data"])


def sample(rows: DataFrame, per_label: int, most_bytes: int) -> list[tuple[str, object]]:
    """rows(doc_id, label, text) -> (text, label)s to learn from: whole texts of at most `per_label` ids of each label, picked by a hash of the id.

    An id gives one text for each of its labels, however often it repeats. Of one label's texts, in order of the hash, those are taken that together have
    at most an equal part of `most_bytes`: so the driver's memory is bounded however long texts are. Null texts and labels don't count.
    """
    rows = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull())
    many = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}
    if not many:
        return []
    at = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in many.items() for x in (k, min(1.0, 1.5 * per_label / max(1, n))))), F.col("label"))
    named = rows.where(at < share * (1 << 30)).select("doc_id", "label", at.alias("at"), F.struct(F.xxhash64("text").alias("h"), F.octet_length("text").alias("size")).alias("of"))
    named = named.groupBy("doc_id", "label", "at").agg(F.min("of").alias("of"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("at", "doc_id"))  # of each label's share
    picked, total = [], dict.fromkeys(many, 0)
    for r in named.withColumn("rank", rank).where(F.col("rank") <= per_label).orderBy("at", "doc_id", "label").collect():
        if total[r["label"]] + r["of"]["size"] <= most_bytes // len(many):
            total[r["label"]] += r["of"]["size"]
            picked.append((r["doc_id"], r["label"], r["of"]["h"], len(picked)))
    if not picked:
        return []
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    chosen = rows.sparkSession.createDataFrame(picked, f"__id {kinds['doc_id']}, __label {kinds['label']}, __h long, __n int")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("label") == F.col("__label")) & (F.xxhash64("text") == F.col("__h"))
    found = rows.join(F.broadcast(chosen), same).groupBy("__n", "label").agg(F.first("text").alias("text")).orderBy("__n").collect()  # a row for each picked
    return [(r["text"], r["label"]) for r in found]


def trim() -> None:
    """Give memory that a finished task has freed back to the system: its worker process lives on, and so would the memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Shuffle files go once both garbage collectors have seen that their plan is gone; until then Spark's listeners still hold the last one."""
    gc.collect()
    time.sleep(1)
    spark._jvm.System.gc()


def buckets(spark: SparkSession, rows: int, each: int) -> int:
    """How many hash buckets hold about `each` rows each; at least some for each shuffle partition, that these fill evenly."""
    return max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
