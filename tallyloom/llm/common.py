"""Plumbing that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are worked on at once where they hold whole texts. Spark bounds a batch by its bytes
#: (spark.sql.execution.arrow.maxBytesPerBatch), so no setting of the session is touched.
TEXT_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one of our own in
    local mode, as in tests; on a cluster, whose executors can't see such a folder, an error."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tallyloom-checkpoint-")
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


_open: list[list[str]] = []


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that ``checkpoint`` writes in it, but for those that stay; nothing may read them later."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def checkpoint(df: DataFrame, stays: bool = False) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder; later reads survive the loss of any executor.

    A table is read back with the size that its files have. Spark's own checkpoints keep the size that their plan was
    guessed to have, which each join multiplies: in loops the guesses grow to numbers of millions of digits. With
    ``stays`` it outlives the ``steps`` that it is written in.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    scopes = _open[:-1] if stays else _open
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def named(df: DataFrame, name: str) -> Column:
    """The column ``name`` of ``df``, whatever characters its name holds."""
    return df["`" + name.replace("`", "``") + "`"]


def packed(df: DataFrame, alias: str = "row") -> Column:
    """All columns of ``df`` in one struct, so that helper columns can't clash with them."""
    return F.struct(*[named(df, c) for c in df.columns]).alias(alias)


def unpacked(columns: list[str], alias: str = "row") -> list[Column]:
    return [F.col(alias).getField(c).alias(c) for c in columns]


def utf8(column: Column) -> Column:
    """The UTF-8 bytes of a text; a null text counts as empty."""
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most ``rows`` rows, without copying; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def portions(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts, without copying; a part's values in ``column`` take less than ``size`` bytes before its last row."""
    lengths = pc.binary_length(batch.column(column)).to_numpy().astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(lengths) - lengths) // size)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(start, stop - start)


def map_rows(df: DataFrame, schema: str, batch: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Applies ``batch`` to slices of the Arrow batches on the executors; nothing is kept from one to the next."""
    return df.mapInArrow(lambda batches: map(batch, slices(batches)), schema)
