"""Small tables of few files, dealt to all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of files up to which a table is dealt anew.
MOST_BYTES = 64 << 20


def dealt(df: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` as it is, or with its rows dealt to all cores if it is read from fewer files than these, and small.

    A task reads a row group at least, and a small file often is one, so that all work on it would be one task's. Tables
    beyond ``most_bytes`` have row groups enough, and moving them would cost more than it gives.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores and df.rdd.getNumPartitions() <= cores
    return df.repartition(cores) if few and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most_bytes else df
