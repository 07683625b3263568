"""BM25 over an inverted index: postings in files by term, written in one pass over the texts, read term by term."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window

from tallyloom.operators.documents import STOP_WORDS, TOKEN, tokens
from tallyloom.sources.scratch import kept

#: BM25's constants, the boost for each phrase that must be there, the score that is full strength, and
#: the least score of evidence.
K1, B, BOOST, FULL, LEAST_SCORE = 1.5, 0.75, 0.45, 9.0, 4.0
#: Parts that terms are dealt to by hash; a search opens those of its terms.
BUCKETS = 32


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """An index that ``build`` wrote: lists of (ids, tf, dl) by bucket of the term, terms' frequencies, and the pieces."""

    spark: SparkSession
    path: str
    ids: tuple[str, ...]
    buckets: int
    layout: StructType
    n: int
    average: float

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, ids, tf, dl) of ``terms``; only their buckets' files are opened, and their terms' row groups read."""
        parts = self.spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("term")).select(_bucket(F.col("term"), self.buckets)).distinct().collect() if terms else []
        rows = self.spark.read.schema(self.layout).parquet(f"{self.path}/postings")
        rows = rows.where(F.col("bucket").isin([r[0] for r in parts]) & F.col("term").isin(terms))
        return rows.select("term", F.explode(F.arrays_zip(*self.ids, "tf", "dl")).alias("x")).select("term", *[F.col(f"x.{c}").alias(c) for c in (*self.ids, "tf", "dl")])

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many pieces each of ``terms`` is; those in none are left out."""
        rows = self.spark.read.parquet(f"{self.path}/terms").where(F.col("term").isin(terms))
        return {r["term"]: r["df"] for r in rows.collect()}

    def search(self, query: str, must_include: list[str] | None = None, exclude: Column | None = None, min_score: float | None = None, limit: int | None = 10) -> DataFrame:
        """(ids, score, hits, relevance, strength): BM25 of each piece, its heading too, that holds a word of the query.

        A word asked twice counts twice. With ``must_include`` only pieces that hold one of these phrases stay, and each
        held phrase adds BOOST to the score's factor; only for that texts are read, and none is cut into words. ``exclude``
        marks, by their ids, pieces that are not wanted but count in the statistics. Relevance is the score's share of the best
        one, strength its share of FULL, at most 1; both have three places, the score four. ``min_score`` is the floor of
        evidence (LEAST_SCORE). Equal scores come by falling ids. A query without words finds nothing.
        """
        asked = [r[0] for r in self.spark.range(1).select(F.explode(tokens(F.lit(query)))).collect()]
        known = self.frequencies(sorted(set(asked)))
        worth = {t: asked.count(t) * _idf(self.n, df) for t, df in known.items()}
        rows = self.postings(list(worth))
        weight = F.create_map(*[x for t, w in worth.items() for x in (F.lit(t), F.lit(w))])[F.col("term")] if worth else F.lit(0.0)
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.average or 1.0)))
        if exclude is not None:
            rows = rows.where(~F.coalesce(exclude, F.lit(False)))
        found = rows.groupBy(*self.ids).agg(F.sum(part).alias("score"), F.count(F.lit(1)).cast("int").alias("hits"))
        if any(must_include or []):
            blob = F.lower(F.col("blob"))
            held = sum((F.contains(blob, F.lit(p.lower())).cast("int") for p in must_include if p), F.lit(0))
            gated = self.spark.read.parquet(f"{self.path}/pieces").select(*[F.col(c).alias(f"of_{c}") for c in self.ids], held.alias("phrases")).where("phrases > 0")
            same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in self.ids]
            found = found.join(gated, same).select(*self.ids, (F.col("score") * (1 + BOOST * F.col("phrases"))).alias("score"), "hits")
        best = F.col("best")
        if limit is None:
            found = kept(found)  # read for the best score and for the rows
            found = found.crossJoin(F.broadcast(found.agg(F.max("score").alias("best"))))
        else:
            found = found.orderBy(F.desc("score"), *[F.desc(c) for c in self.ids]).limit(limit).withColumn("best", F.max("score").over(Window.partitionBy()))
        shown = found.select(*self.ids, F.round("score", 4).alias("score"), "hits", F.round(F.col("score") / best, 3).alias("relevance"), F.round(F.least(F.lit(1.0), F.col("score") / FULL), 3).alias("strength"))
        return shown if min_score is None else shown.where(F.col("score") >= min_score)


def _idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _listed(pieces: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """(term, df, words, ids, tf, dl): for each Arrow batch of ``pieces`` a row for each term in it, with lists of the pieces
    that hold it, how often, and how many words each has; how many pieces and occurrences these are.

    A batch's words are counted where it lies, and what is shuffled and sorted is a row for each of its terms, not for each
    term of each piece; a row has no more entries than a batch has pieces.
    """
    kinds = {f.name: f.dataType for f in pieces.schema}
    lists = [StructField(c, ArrayType(kinds[c])) for c in ids]
    out = StructType([*StructType.fromDDL("term string, df long, words long"), *lists, *StructType.fromDDL("tf array<int>, dl array<int>")])
    longer = TOKEN.removesuffix("*") + "+"  # words of one character don't count

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, stop = re.compile(longer).findall, frozenset(STOP_WORDS)
        for batch in batches:
            words, counts, sizes, lengths = [], [], [], []
            for text in batch.column("blob").to_pylist():
                own = Counter(find(text.lower()))
                for word in stop & own.keys():
                    del own[word]
                words += own
                counts += own.values()
                sizes.append(len(own))
                lengths.append(own.total())
            coded = pa.array(words, pa.string()).dictionary_encode()
            codes, tf = coded.indices.to_numpy(), np.array(counts, np.int32)
            order = np.argsort(codes, kind="stable")
            piece = np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64))[order]
            df = np.bincount(codes, minlength=len(coded.dictionary))
            occurring = np.bincount(codes, tf, minlength=len(coded.dictionary)).astype(np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(df)]).astype(np.int32))
            columns = [*[batch.column(c).take(pa.array(piece)) for c in ids], pa.array(tf[order]), pa.array(np.array(lengths, np.int32)[piece])]
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df, pa.int64()), pa.array(occurring), *[pa.ListArray.from_arrays(ends, c) for c in columns]], out.names)

    return pieces.select(*ids, "blob").mapInArrow(count, out)


def build(pieces: DataFrame, path: str, ids: tuple[str, ...] = ("doc_id", "chunk"), text_col: str = "text", heading_col: str | None = "heading", buckets: int = BUCKETS) -> Index:
    """Writes the index of ``pieces`` under ``path``; each text, with its heading, is cut into words once.

    Postings are dealt out by bucket of their term and, so that a frequent term isn't one task's, by a hash of the first
    piece of a list. Null texts and headings are empty; pieces without words count in the statistics. No pieces give an index that
    finds nothing. Pieces are told apart by ``ids``; one that comes twice is indexed twice.
    """
    spark = pieces.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = F.concat(text(heading_col), F.lit(" "), text(text_col)) if heading_col else text(text_col)
    blobs = pieces.select(*ids, whole.alias("blob"))
    blobs.write.parquet(f"{path}/pieces")
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
    own = _listed(spark.read.schema(blobs.schema).parquet(f"{path}/pieces"), ids)
    dealt = own.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition("bucket", F.pmod(F.xxhash64(*[F.get(c, F.lit(0)) for c in ids]), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    layout = dealt.schema
    spark.read.schema(layout).parquet(f"{path}/postings").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
    spark.createDataFrame([(list(ids), buckets, layout.json())], "ids array<string>, buckets int, layout string").coalesce(1).write.parquet(f"{path}/shape")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Index:
    """An index that ``build`` wrote."""
    shape = spark.read.parquet(f"{path}/shape").first()
    n, words = spark.read.parquet(f"{path}/pieces").count(), spark.read.parquet(f"{path}/terms").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()["words"]
    return Index(spark, path, tuple(shape["ids"]), shape["buckets"], StructType.fromJson(json.loads(shape["layout"])), n, words / n if n else 0.0)
