"""Shared pieces: durable intermediate tables, Arrow text access, distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many bytes, whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20
#: Rows that share one rank bucket, about.
RANK_BUCKET_ROWS = 20_000

_OWNED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, set here only if unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ruleweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ruleweave-{uuid.uuid4().hex}/{name}"
    with _small_batches(spark):
        df.write.parquet(path)
    if not _OWNED:
        atexit.register(_clean)
    _OWNED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of SLICE_BYTES, which executors hold several times over; the session's own size after."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(SLICE_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def forget(*tables: DataFrame) -> None:
    """Delete materialized tables that no returned plan reads any more."""
    for table in tables:
        for path in {p.rsplit("/", 1)[0] for p in table.inputFiles()}:
            _delete(table.sparkSession, path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Delete at the end every table materialized inside, but for those that were materialized last."""
    before = len(_OWNED)
    yield
    for spark, path in _OWNED[before:-1]:
        _delete(spark, path.rsplit("/", 1)[0])
    del _OWNED[before:-1]


def partition() -> int:
    """Number of the task's partition; 0 outside tasks."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def in_tasks(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), where a task's last act is to give its memory back: workers live on."""

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every libc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(task, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _OWNED:
        try:
            _delete(spark, path.rsplit("/", 1)[0])
        except Exception:  # the session may be gone at exit; nothing is left to do then
            return


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size + 64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts(column: pa.Array) -> list[bytes]:
    """Each text as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def keep_rows(docs: DataFrame, verdict: DataFrame, kept: str) -> DataFrame:
    """The rows of docs that a verdict (doc_id, row_hash, kept; one row per row) keeps, all columns.

    Rows are told apart by id and text hash; of rows alike in both, as many stay as the verdict keeps
    if that is none or all, else one. Spark broadcasts the dropped ids where they are few.
    """
    verdict = verdict.select("doc_id", "row_hash", F.col(kept).alias("kept"))
    gone = materialize(verdict.where("not kept").select("doc_id", "row_hash").distinct(), "gone")
    same = lambda a, hashed, t: a["doc_id"].eqNullSafe(t["doc_id"]) & (a[hashed] == t["row_hash"])
    some = verdict.where("kept")
    some = materialize(some.join(gone, same(some, "row_hash", gone), "left_semi"), "some")
    row_hash = fresh(docs, "_row_hash")
    keyed = docs.withColumn(row_hash, F.xxhash64("text"))
    left = keyed.join(gone, same(keyed, row_hash, gone), "left_anti")
    if not some.isEmpty():
        left = left.unionByName(keyed.join(some, same(keyed, row_hash, some), "left_semi").dropDuplicates(["doc_id", row_hash]))
    return left.select(*docs.columns)


def bucket_count(rows: int, least: int = 64) -> int:
    return max(least, -(-rows // RANK_BUCKET_ROWS))


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Add a gapless rank from 0 within each group, ordered by (bucket, order).

    A group is sorted bucket by bucket in many tasks; only the bucket counts of a group meet in
    one. df is read twice, so it must be a materialized table or as repeatable as one.
    """
    if taken := {"_bucket", "_n", "_start", name} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} are taken")
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    joined = keyed.join(starts, [*group, "_bucket"])
    return joined.withColumn(name, F.col("_start") + F.row_number().over(inside) - 1).drop("_bucket", "_start")
