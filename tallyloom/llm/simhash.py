"""SimHash near-duplicates whose candidates come from pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import checkpoint, map_rows, named, packed, unpacked, utf8
from tallyloom.llm.components import connected_components

BITS = 64
SEED = 42
#: Hashes whose bits are counted at once; bounds memory for a very long text.
BLOCK = 1 << 15
#: Fingerprints of a bucket that are compared in one task. Larger buckets are split by ``_refined``, exactly, and what is
#: still larger takes the exact way of ``_ball_edges``, so the work of a fingerprint doesn't grow with the table.
MOST_COMPARED = 512


def simhash64(raw: bytes, width: int = 3) -> int:
    """The SimHash of a UTF-8 text as an unsigned number; 0 for a text without words."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n, hash64 = len(words), xxhash.xxh64_intdigest
    if n <= width:
        return hash64(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count, ones = n - width + 1, np.zeros(BITS, np.int64)
    for at in range(0, count, BLOCK):
        to = min(count, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist(), strict=True)
        hashes = np.fromiter((hash64(joined[s:e], SEED) for s, e in spans), np.uint64, to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keys: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp): the signed 64-bit SimHash of every whole text. No shuffle; null and blank texts get 0.

    ``keys`` are further columns of type long that come along.
    """
    names = ["doc_id", *(keys or {})]

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([simhash64(x, width) for x in part.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*[part.column(c).cast(pa.int64()) for c in names], pa.array(values)], [*names, "fp"])

    rows = docs.select(named(docs, id_col).cast("long").alias("doc_id"), *[c.alias(k) for k, c in (keys or {}).items()], utf8(named(docs, text_col)).alias("text"))
    return map_rows(rows, ", ".join(f"{c} long" for c in [*names, "fp"]), batch)


def _segments(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of each of ``parts`` segments that cover the 64 bits, the wider ones first."""
    out, shift = [], 0
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        out.append((shift, width))
        shift += width
    return out


def _mask(segment: tuple[int, int]) -> int:
    return ((1 << segment[1]) - 1) << segment[0]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def ring_forest(values: np.ndarray, start: int, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among a bucket's fingerprints, which agree in segment ``start``.

    The chain from ``start`` around the ring of ``max_bits + 1`` segments must keep its running difference within
    ``floor(l * max_bits / segments)`` after each length l; what passes the whole chain is within ``max_bits``.
    At most one edge for each fingerprint but the first comes out, however many pairs are near.
    """
    parts = max_bits + 1
    masks = [np.uint64(_mask(s)) for s in _segments(parts)]
    chain = [masks[(start + k) % parts] for k in range(1, parts)]
    root = list(range(len(values)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for i in range(len(values) - 1):
        differ, left = values[i + 1 :] ^ values[i], np.arange(i + 1, len(values))
        so_far = np.zeros(len(left), np.int64)
        for length, mask in enumerate(chain, 2):
            so_far = so_far + np.bitwise_count(differ & mask)
            keep = so_far <= length * max_bits // parts
            differ, left, so_far = differ[keep], left[keep], so_far[keep]
            if not len(left):
                break
        for j in left.tolist():
            if (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
                edges.append((int(values[i]), int(values[j])))
    return edges


def _forest_udf(max_bits: int):
    edge = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))

    @F.pandas_udf(edge)
    def forest(starts: pd.Series, buckets: pd.Series) -> pd.Series:
        return pd.Series([[{"a": _signed(a), "b": _signed(b)} for a, b in ring_forest(np.asarray(x, np.int64).view(np.uint64), int(s), max_bits)] for s, x in zip(starts, buckets, strict=True)])

    return forest


def _ball_edges(rows: DataFrame, max_bits: int) -> DataFrame:
    """Exact links inside buckets of any size, without pairs, for ``max_bits`` of 2 or less.

    Two values differ in 2 bits or fewer exactly if a third lies within 1 bit of both. So each fingerprint goes to
    the group of itself and of each of its one-bit neighbours, and all members of such a group are linked to its
    smallest: 65 rows for a fingerprint, whatever the bucket's size.
    """
    flips = [0] + [_signed(1 << k) for k in range(BITS)] if max_bits == 2 else [0]
    near = rows.select("fp").distinct().select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x).cast("long")) for x in flips])).alias("centre"))
    if max_bits == 1:
        masked = [F.struct(F.lit(k).alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed(((1 << BITS) - 1) ^ (1 << k))).cast("long")).alias("rest")) for k in range(BITS)]
        near = rows.select("fp").distinct().select("fp", F.explode(F.array(*masked)).alias("centre"))
    least = near.groupBy("centre").agg(F.min("fp").alias("m"))
    return near.join(least, "centre").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def _refined(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, k, v, j, w): members of the buckets (k, v) dealt out by a further segment.

    The bits outside segment k are cut into ``max_bits + 1`` parts. Two members within ``max_bits`` are alike in one of
    them, so that all links of a bucket are in its smaller ones, which hold what agrees in part j too.
    """
    def outside(segment: tuple[int, int]) -> list[int]:
        rest = [x for x in range(BITS) if not segment[0] <= x < sum(segment)]
        return [sum(1 << x for x in part.tolist()) for part in np.array_split(rest, max_bits + 1)]

    masks = [outside(s) for s in _segments(max_bits + 1)]
    of = lambda j: F.get(F.array(*[F.lit(_signed(m[j])).cast("long") for m in masks]), F.col("k"))
    keys = [F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(of(j)).alias("w")) for j in range(max_bits + 1)]
    return rows.select("fp", "k", "v", F.explode(F.array(*keys)).alias("key")).select("fp", "k", "v", "key.j", "key.w")


def _split(rows: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Members of buckets of at most ``most``, and those of larger ones with their number n; None if there are none."""
    large = checkpoint(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
    return (rows, None) if large.isEmpty() else (rows.join(large, by, "left_anti"), rows.join(large, by))


def near_edges(prints: DataFrame, max_bits: int = 2, most_compared: int = MOST_COMPARED) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints of ``prints(fp)``, distinct, that links of ``max_bits`` connect.

    The fingerprint is cut into ``max_bits + 1`` segments on a ring. Of two fingerprints within ``max_bits``, some chain
    of segments starts with an equal one and keeps all its running sums within budget, so each fingerprint is dealt
    once for each segment by that segment's value, and ``ring_forest`` follows the chain inside the bucket. Buckets of
    more than ``most_compared`` are dealt out again by a further segment. Those that are still larger take the way of
    ``_ball_edges`` if ``max_bits`` is 2 or less; otherwise they are cut into pieces, any two of which are compared in one
    task. Sizes are counted before anything is gathered.
    """
    keys = [F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(_signed(_mask(s))).cast("long")), s[0]).alias("v")) for k, s in enumerate(_segments(max_bits + 1))]
    dealt = prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.k", "key.v")
    forest = lambda buckets: buckets.where(F.size("fps") > 1).select(F.explode(_forest_udf(max_bits)("k", "fps")).alias("e")).select("e.a", "e.b")
    gathered = lambda rows, by: rows.groupBy(*by).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    coarse, fine = ["k", "v"], ["k", "v", "j", "w"]
    small, hot = _split(dealt, coarse, most_compared)
    edges = forest(gathered(small, coarse))
    if hot is None:
        return edges
    small, hot = _split(_refined(hot, max_bits), fine, most_compared)
    edges = edges.unionByName(forest(gathered(small, fine)))
    if hot is None:
        return edges
    if max_bits <= 2:
        return edges.unionByName(_ball_edges(hot, max_bits))
    pieces = F.ceil(2 * F.col("n") / most_compared).cast("int")
    cut = checkpoint(hot.withColumn("piece", F.pmod(F.xxhash64("fp"), pieces).cast("int")).groupBy(*fine, "piece").agg(F.collect_list("fp").alias("own")))
    first = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("piece"))))
    second = cut.select(*fine, F.col("piece").alias("other"), F.col("own").alias("others"))
    both = first.join(second, [*fine, "other"]).select("k", F.sort_array(F.array_union("own", "others")).alias("fps"))
    return edges.unionByName(forest(both))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, width: int = 3, most_compared: int = MOST_COMPARED) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of ``docs``; component_id is the smallest id reachable by links.

    Equal fingerprints are one node, so copies are never paired. Null ids keep a row each; a group that has null ids
    only has a null component_id. An empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, width))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    components = connected_components(near_edges(nodes.select("fp"), max_bits, most_compared))
    joined = nodes.join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_print = joined.join(smallest, "component").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, width: int = 3, most_compared: int = MOST_COMPARED, most_broadcast: int = 200_000) -> DataFrame:
    """One row of each group of ``near_duplicates``, that of the smallest id, with the columns of ``docs`` unchanged.

    Rows are recognised by two 64-bit digests of id and text; of equal ids the smaller digest stays, null ids come last,
    and of wholly equal rows one stays. Null texts count as empty, and all documents without words are one group. An
    empty table gives no rows. Tables of what is linked and of what goes are broadcast if a count shows that they are
    small (some 10 MB at most), so that a large group's rows need not meet.
    """
    hinted = lambda x: F.broadcast(x) if x.count() <= most_broadcast else x
    digests = {f"d{k}": F.xxhash64(F.lit(k), named(docs, id_col), named(docs, text_col)) for k in (1, 2)}
    prints = checkpoint(fingerprints(docs, id_col, text_col, width, digests))
    nodes = prints.select("fp").distinct()
    components = hinted(connected_components(near_edges(nodes, max_bits, most_compared)).withColumnRenamed("node", "fp"))
    rows = prints.groupBy("fp", "d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    rows = checkpoint(rows.join(components, "fp", "left").select(F.coalesce("component", "fp").alias("component"), "d1", "d2", "n", F.struct(F.col("doc_id").isNull(), "doc_id", "d1", "d2").alias("order")))
    first = checkpoint(rows.groupBy("component").agg(F.min("order").alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all"))
    gone = checkpoint(rows.join(hinted(first), "component").withColumn("stays", F.col("order") == F.col("first")).where("not stays or n > 1").select("d1", "d2", "stays"))
    packed_rows = docs.select(packed(docs), *[c.alias(k) for k, c in digests.items()])
    kept = packed_rows.join(hinted(gone.select("d1", "d2")), ["d1", "d2"], "left_anti")
    again = packed_rows.join(hinted(gone.where("stays").select("d1", "d2")), ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])
    return kept.unionByName(again).select(*unpacked(docs.columns))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
