"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contracts define it: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"
#: Rows of one Arrow batch where a column holds whole texts; bounds a Python worker's memory.
TEXT_BATCH_ROWS = 1000
#: Seconds after which py4j has let go of a dropped frame.
LET_GO = 1.5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a dataset folder. Only Spark reads the path, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size (never raise it) so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir if set, otherwise (tests) a folder of our own that becomes the checkpoint folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    own = sc._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get()


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def saved(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession, wait: float = 0) -> None:
    """Lets Spark's cleaner see, and delete, shuffles that nothing needs any more (after a checkpoint).

    An event that still waits for its listeners holds the plan that it tells of, and so the plan's shuffles;
    and py4j lets go of frames in a thread of its own, once a second: a wait of LET_GO includes what was dropped just now.
    """
    gc.collect()
    time.sleep(wait)
    with contextlib.suppress(Py4JJavaError):  # not empty in time
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    spark.sparkContext._jvm.System.gc()


def partitions_for(df: DataFrame, mb: float) -> int:
    """How many parts a frame with a column text has if each is of `mb` MB; no fewer than the session's shuffle partitions.

    The size is the planner's estimate; where it has none (frames over RDDs or
    checkpoints), the texts' bytes are summed.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 60:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, int(size / (mb * 1e6)) + 1)


class Rounds:
    """Writes a table of one step, or one that is made anew in every round, and drops the one before.

    A checkpoint carries the planner's estimate of its size on, and a cogroup's
    is the product of its sides': fed back round by round, it soon has millions
    of digits. Files have sizes of their own.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.round = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.round}"
        df.write.parquet(path)
        if self.round:
            remove(self.spark, f"{self.folder}/{self.round - 1}")
        self.round += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes what is left; no frame that reads it may be used any more."""
        remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The (small, checkpointed) frame marked for a broadcast if it has so many rows at most; otherwise as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def share_by_hash(df: DataFrame, most: int, *by: str) -> DataFrame:
    """About `most` rows, chosen by a hash of the columns `by`; all if there are no more. No other rows move."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(*by), F.lit(n)) < most)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that matter, under fixed names; others in the input cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    """(doc_id, text) of every row of the Arrow batches."""
    for batch in batches:
        texts = batch.column(1)
        for k, i in enumerate(batch.column(0).to_pylist()):
            yield i, texts[k].as_py()


def concat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for every (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def ragged_take(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists number `index` of a ragged array, concatenated, and their lengths."""
    lengths = offsets[index + 1] - offsets[index]
    return flat[concat_ranges(offsets[index].astype(np.int64), lengths)], lengths


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The white-space separated words of a text in blocks of about `size` bytes; no word is cut."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            found = _BREAK.search(data, end)
            end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def flushed(rows: list, schema: pa.Schema, least: int = 4096) -> Iterator[pa.RecordBatch]:
    """An output batch once enough rows wait; the caller flushes the rest with least=1."""
    if len(rows) >= least:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        rows.clear()
