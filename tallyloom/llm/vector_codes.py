"""Vector compression by product codes in integer arithmetic: weighted Lloyd over the distinct parts, codes joined back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpoint, named

#: Distinct parts that are compared with a codebook at once in a task.
TOGETHER = 4096
#: Integers up to this in magnitude are accepted: the squared distance of two vectors of them fits in 64 bits.
MOST = 1 << 27
#: Labels up to which their summed errors are broadcast (some 50 bytes each); beyond it they are joined by shuffle.
MOST_LABELS = 200_000


@dataclass(frozen=True)
class Codebooks:
    """The entries of each part position: ``entries[part]`` has a row for each entry."""

    entries: tuple[np.ndarray, ...]

    def sha256(self) -> str:
        """Digest of all integers in decimal, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str, digits: int = 2) -> list[int]:
        """The integer vector that a code stands for."""
        return [x for k, book in enumerate(self.entries) for x in book[int(code[k * digits : (k + 1) * digits], 16)].tolist()]


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``points`` the first of the nearest rows of ``book``, and the squared distance, all in exact integers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    # products and sums of integers are exact in double precision below 2^53, where matrix products are fast
    kind = np.float64 if 4 * most * most * max(1, book.shape[1]) < 1 << 53 else np.int64
    a, b = points.astype(kind), book.astype(kind)
    away = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    best = away.argmin(axis=1)
    return best, away[np.arange(len(a)), best].astype(np.int64)


def _points(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a batch's (pos, part, ...) rows, for each position some of the places and their integers."""
    at, lists = batch.column("pos").to_numpy(), batch.column("part")
    flat, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    for pos in np.unique(at).tolist():
        rows = np.nonzero(at == pos)[0]
        for k in range(0, len(rows), TOGETHER):
            own = rows[k : k + TOGETHER]
            width = int(starts[own[0] + 1] - starts[own[0]])
            yield pos, own, flat[starts[own][:, None] + np.arange(width)].astype(np.int64)


def _moved(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """One round of Lloyd: every weighted distinct part to its nearest entry, every used entry to the floored mean.

    Each task sums its own parts, so that entries, and not parts, are shuffled; what comes to the driver are at most
    (width + 1) numbers an entry. Place -1 has the weights.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books.entries]
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for pos, rows, points in _points(batch):
                best, _ = nearest(points, books.entries[pos])
                np.add.at(held[pos], best, np.concatenate([weights[rows][:, None], points * weights[rows][:, None]], axis=1))
        for pos, table in enumerate(held):
            used = np.nonzero(table[:, 0])[0]
            entry, place = np.repeat(used, table.shape[1]), np.tile(np.arange(-1, table.shape[1] - 1), len(used))
            columns = [np.full(len(entry), pos, np.int32), entry.astype(np.int32), place.astype(np.int32), table[used].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pos", "entry", "place", "total"])

    rows = distinct.mapInArrow(sums, "pos int, entry int, place int, total long").groupBy("pos", "entry", "place").agg(F.sum("total").alias("total")).collect()
    totals = {(r["pos"], r["entry"], r["place"]): r["total"] for r in rows}
    entries = tuple(b.copy() for b in books.entries)
    for (pos, entry, place), total in totals.items():
        if place >= 0:
            entries[pos][entry, place] = total // totals[pos, entry, -1]
    return Codebooks(entries)


def _assigned(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """(pos, part, entry, away): each distinct part's entry and squared distance."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for pos, rows, points in _points(batch):
                entry[rows], away[rows] = nearest(points, books.entries[pos])
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), pa.array(entry), pa.array(away)], ["pos", "part", "entry", "away"])

    return distinct.select("pos", "part").mapInArrow(assign, "pos int, part array<int>, entry int, away long")


def _whole(vector: Column) -> Column:
    """Not null and without null or non-finite components; a vector of no components is whole."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, most_labels: int = MOST_LABELS) -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error, label_error), codebooks): each vector's entries as hexadecimal digits, and its squared error.

    A component x becomes the integer floor(scale * x), and vectors are cut into ``parts`` consecutive parts, equal ones
    where the length allows, else the first are longer by one. The codebook of a position starts as that part of the
    ``entries`` first vectors by id. In each of ``rounds`` rounds every part goes to the nearest entry by squared
    distance (of equal ones the first), then every used entry to the floored mean of its parts; at last parts are
    assigned once more. All of that works on distinct parts with their counts: equal parts are gathered by count first, and
    codes and errors are joined back to vectors. ``label_error`` sums the errors of equal labels, null ones together.

    Null vectors and those with null or non-finite components are dropped. Repeated ids are vectors of their own; null
    ids come last. Vectors of another length than the first one's stay, with a null code and error. Integers beyond MOST
    in magnitude are an error, as their squares don't fit. An empty table gives no rows and no entries.
    """
    digits = max(2, len(f"{entries - 1:x}"))
    vector = named(table, vector_col).cast("array<double>")
    rows = table.select(named(table, id_col).cast("long").alias("vec_id"), named(table, label_col).alias("label"), vector.alias("vec")).where(_whole(F.col("vec")))
    small = F.forall("vec", lambda x: F.abs(x) * scale < MOST)
    ints = F.when(small, F.transform("vec", lambda x: F.floor(x * scale).cast("int")))
    kept = checkpoint(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", ints.alias("ints")))
    if not kept.where("ints is null").isEmpty():
        raise ValueError(f"components must be less than {MOST // scale} in magnitude")
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    width = len((kept.orderBy(*by_id).select("ints").first() or [()])[0])
    same = kept.where(F.size("ints") == width)
    first = [r["ints"] for r in same.orderBy(*by_id).select("ints").limit(entries).collect()]
    starts = np.array(first, np.int64).reshape(len(first), width)
    cuts = np.concatenate([[0], np.cumsum([width // parts + (k < width % parts) for k in range(parts)])]).tolist()
    books = Codebooks(tuple(starts[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)))
    pieces = F.posexplode(F.array(*[F.slice("ints", a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]))
    distinct = checkpoint(same.select(pieces.alias("pos", "part")).groupBy("pos", "part").agg(F.count(F.lit(1)).alias("weight")))
    for _ in range(rounds):
        books = _moved(distinct, books)
    coded = same.select("row", "vec_id", "label", pieces.alias("pos", "part")).join(_assigned(distinct, books), ["pos", "part"])
    code = F.concat(*[F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == k, F.col("entry"))))), digits, "0") for k in range(parts)])
    coded = coded.groupBy("row", "vec_id", "label").agg(code.alias("code"), F.sum("away").alias("error")).drop("row")
    rest = kept.where(F.size("ints") != width).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = checkpoint(coded.unionByName(rest))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if sums.count() <= most_labels else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").drop("of"), books
