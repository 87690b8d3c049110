"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = Path(__file__).resolve().parents[2]
ROWS_AT_ONCE = 256  # of a batch that become Python strings together
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Workers that inherit a PYTHONPATH holding the package need nothing; else a zip of the
    sources goes through Spark's own file server.
    """
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if str(PACKAGE_ROOT) in on_path or app in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="chronika-")) / "chronika_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (PACKAGE_ROOT / "chronika").rglob("*.py"):
            z.write(f, f.relative_to(PACKAGE_ROOT))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; set a folder of our own only in local mode without one."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir():
        return
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, so that no lineage is carried on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """A folder for what lies between the steps of one job, in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark, self.parts = spark, 0
        self.root = f"{spark.sparkContext.getCheckpointDir()}/chronika-{uuid.uuid4().hex}"
        self.path = f"{self.root}/steps"

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def saved(self, df: DataFrame) -> DataFrame:
        """The rows, written, so that no lineage is carried on."""
        self.parts += 1
        return self._written(df, f"{self.path}/{self.parts}")

    def kept(self, df: DataFrame) -> DataFrame:
        """The rows of the result, written beside the steps, whose files then go."""
        out = self._written(df, f"{self.root}/result")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return out


def bucketed(df: DataFrame, scratch: Scratch, name: str, key: str) -> DataFrame:
    """The rows, written to files bucketed by a key, so that groups of it are read without a shuffle. No table stays in the catalogue."""
    spark = df.sparkSession
    table = f"chronika_{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions(spark), key).option("path", f"{scratch.path}/{name}").option("compression", "zstd").format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # of its files, which lie elsewhere, nothing goes
    return out


def packed_blocks(text: str, most: int):
    """For mapInArrow: rows dealt to blocks of some bytes of text, or one longer text, as column b; the text becomes blob,
    compressed behind its length, null for an empty one. b goes first, blob last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, held = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                number, blobs = [], []
                for value in batch.column(text).cast(pa.large_binary()):
                    raw = value.as_py() or b""
                    if held and held + len(raw) > most:
                        b, held = b + 1, 0
                    held += len(raw)
                    number.append(b)
                    blobs.append(len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else None)
                others = [n for n in batch.schema.names if n != text]
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), *(batch.column(n) for n in others), pa.array(blobs, pa.binary())], names=["b", *others, "blob"])

    return run


def free_memory() -> None:
    """Give memory that a Python worker has used and freed back to the system, as the worker stays for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Ids that a broadcast join may hold: some 50 MB.
BROADCAST_IDS = 2_000_000


def flagged(rows: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """The rows with a boolean column that says whether their id is among some ids: by a broadcast up to BROADCAST_IDS of them, which are counted first, by a shuffle beyond."""
    some = ids.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    few = some.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(some) if few else some, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(
    batches: Iterable[pa.RecordBatch], column: str = "text", max_chars: int = 400_000
) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches whose texts hold max_chars together, or one longer text alone."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            batch = whole.slice(at, ROWS_AT_ONCE)
            texts = batch.column(column).to_pylist()
            start, held = 0, 0
            for i, t in enumerate(texts):
                n = len(t) if t else 0
                if i > start and held + n > max_chars:
                    yield batch.slice(start, i - start), texts[start:i]
                    start, held = i, 0
                held += n
            if start < len(texts):
                yield batch.slice(start), texts[start:]
