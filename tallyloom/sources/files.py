"""Reading uploaded tables and documents, and writing canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.errors import InvalidArgument
from tallyloom.functions.text import normalise

#: Separators and encodings that are tried, in order.
SEPARATORS, ENCODINGS = (",", ";", "\t"), ("UTF-8", "ISO-8859-1")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The file with every column as text, by the first separator that gives more than one column; names in normal form.

    A file is read as UTF-8 unless that leaves replacement characters in its names or values, which takes one pass to tell."""
    for separator in SEPARATORS:
        for encoding in ENCODINGS:
            df = spark.read.csv(path, header=True, sep=separator, encoding=encoding, inferSchema=False)
            if len(df.columns) < 2:
                break
            df = df.toDF(*[normalise(c) for c in df.columns])
            if encoding == ENCODINGS[-1] or df.where(F.contains(F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns]), F.lit("�"))).isEmpty():
                return df
    raise InvalidArgument("no separator gives more than one column")


def write_canonical(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Writes a table and reads it back, so that what follows works on what was kept."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))
    return df.sparkSession.read.csv(path, header=True) if fmt == "csv" else df.sparkSession.read.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(document_name, text) of text files, one row for each that is not empty: UTF-16 by its mark, else UTF-8, else Latin-1."""
    rows, head = spark.read.format("binaryFile").load(path), F.hex(F.substring("content", 1, 2))
    text = F.when(head.isin("FFFE", "FEFF"), F.expr("try_validate_utf8(decode(content, 'UTF-16'))")).when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("document_name"), text.alias("text"))
