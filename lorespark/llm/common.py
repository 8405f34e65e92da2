"""What several operators of this folder share: reading, shared storage, shipping code, distributed prefix sums."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Deleted by the text contracts: space and the five ASCII controls from tab to carriage return.
ASCII_SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='lorespark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there, lost executors cost no rework.

    Shuffle files of finished plans are let go, as they would fill the disks of a long chain of steps. The table goes with
    discard() or when the driver's process ends. file_rows: the most rows of a file, 0 for any number.
    """
    spark = session_of(df)
    path = f"{shared_folder(spark)}/lorespark-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    atexit.register(_remove, spark, path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def append_all(spark: SparkSession, parts: Iterator[DataFrame], schema: str) -> DataFrame:
    """Writes tables of one schema into one folder in the shared folder, one after the other, and reads them as one."""
    path = f"{shared_folder(spark)}/lorespark-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table of materialize() that no later step reads."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        _remove(session_of(table), path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended already
        pass


_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch: texts are long, and a batch is held by Python and, outside its heap, by the JVM, whose pools keep what a batch once took.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20


def ship_code(spark: SparkSession) -> None:
    """Prepares for Python workers: bounds Arrow batches, and sends this package to the executors once per application."""
    for name, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= bound:
            spark.conf.set(name, bound)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="lorespark-code-")) / "lorespark_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


#: Bits of a map of keys: 4 MB, whatever the input's size.
MAP = 1 << 25


def split_by_keys(df: DataFrame, key: str, keys: DataFrame, of: str) -> tuple[DataFrame, DataFrame]:
    """df's rows whose key may be in keys' column (all that are, and a few others), and those whose key is not in it.

    A bit map of fixed size is broadcast, so rows that a later step need not look at aren't shuffled for it. When keys are so
    many that the map is full, all rows are in the first part. Null is a key like others.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP)) + 1
    marks = keys.select(slot(keys[of]).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("marks"))
    rows = df.select(F.struct("*").alias("row"), slot(df[key]).alias("slot"))
    rows = rows.join(F.broadcast(marks), F.bitmap_bucket_number("slot") == F.col("part"), "left")
    at = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("marks", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.where(inside).select("row.*"), rows.where(~inside).select("row.*")


def only(own: str) -> None:
    """Lets go the memos and models that other operators' code holds in this Python worker. For the start of a task: workers are used again.

    What was held goes back to the system, where its C library can give it back; else it stays with the worker beside the next model.
    """
    import ctypes
    import sys

    import pyarrow as pa

    held = {"ngram_join": lambda m: m._hashes.clear(), "bpe": lambda m: m.model.cache_clear(), "licenses": lambda m: m.scanner.cache_clear(), "decontamination": lambda m: m._built.clear()}
    for name, clear in held.items():
        module = sys.modules.get(f"lorespark.llm.{name}")
        if module is not None and name != own:
            clear(module)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: For bytes of UTF-8: A-Z become a-z, and other ASCII bytes than letters and digits become spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
#: Bytes of a text whose words are held at once, besides what is left of the last word.
WORD_BLOCK = 1 << 22


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """A text's words (letters, digits and all beyond ASCII; A-Z lower-cased) in order, in lists of bounded size."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + WORD_BLOCK)
        stop = gap.start() if gap else len(text)
        if words := text[start:stop].translate(FOLD).split():
            yield words
        start = stop


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df range-sorted by keys and order over the session's shuffle partitions, with the partition's number as _pid.

    It is written to shared storage, because sampled range bounds may differ between two evaluations.
    A hot key spans several partitions, as the order columns take part in the bounds.
    """
    n = partitions(session_of(df))
    return materialize(df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id()))


def prefix_sums(placed: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds to what ranged() returned, for each expression, its exclusive running sum within the key in order, and its total.

    Per-partition totals (at most one row per key and partition) are summed first; rows then add their place within
    the partition. No task sees more than one range partition of a key.
    """
    totals = placed.groupBy(*keys, "_pid").agg(*[F.sum(e).alias(f"_all_{k}") for k, e in sums.items()])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys,
        "_pid",
        *[F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_at_{k}") for k in sums],
        *[F.sum(f"_all_{k}").over(whole).alias(f"{k}_total") for k in sums],
    )
    inside = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(starts, [*keys, "_pid"])
    out = joined.select("*", *[(F.col(f"_at_{k}") + F.coalesce(F.sum(e).over(inside), F.lit(0))).alias(k) for k, e in sums.items()])
    return out.drop(*[f"_at_{k}" for k in sums])
