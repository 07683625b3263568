"""Document fingerprints of improbable features: rare byte windows in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import named, slices, utf8
from tallyloom.llm.ranges import bounds, range_count, range_of

#: Bytes of a window, neighbouring windows among which it must be the rarest, and in how many such neighbourhoods.
WIDTH, AROUND, POPULAR = 32, 32, 8
#: Entropies are told apart in thousandths of the greatest one; windows below WEAKEST say too little to be features.
LEVELS, WEAKEST = 1000, 100
#: Bits of a filter, features that fill it, and bits that each sets.
FILTER_BITS, FILTER_FEATURES, FEATURE_BITS = 2048, 160, 5
#: Share of the way from chance overlap to full overlap that still counts as chance.
CUTOFF = 0.1
#: Windows looked at together; bounds memory for a very long text.
BLOCK = 1 << 17

_SCALE = 1 << 20
_steps = np.arange(WIDTH + 1, dtype=np.float64)
_sums = np.rint(_SCALE * _steps * np.log2(np.maximum(_steps, 1))).astype(np.int64)
_STEP = np.concatenate([[0], np.diff(_sums)])
_FULL = int(_sums[WIDTH])


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy of each window of WIDTH bytes, 0 to LEVELS, in whole-number arithmetic.

    From window to window one byte goes and one comes. How often each occurs in the window is the number of equal bytes
    at distances up to WIDTH - 1 behind and ahead of it, which whole-array comparisons count.
    """
    n = len(data)
    behind, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for distance in range(1, WIDTH):
        same = (data[distance:] == data[:-distance]).view(np.uint8)
        behind[distance:] += same
        ahead[:-distance] += same
    first = _STEP[1 + behind[:WIDTH].astype(np.int64)].sum()
    sums = np.empty(n - WIDTH + 1, np.int64)
    sums[0] = first
    sums[1:] = first + np.cumsum(_STEP[1:].take(behind[WIDTH:]) - _STEP[1:].take(ahead[: n - WIDTH]))
    return ((_FULL - sums) * LEVELS // _FULL).astype(np.int16)


def level_counts(raw: bytes) -> np.ndarray:
    """How many windows of a text have each entropy level."""
    data, counts = np.frombuffer(raw, np.uint8), np.zeros(LEVELS + 1, np.int64)
    for at in range(0, max(0, len(data) - WIDTH + 1), BLOCK):
        counts += np.bincount(entropy_levels(data[at : at + BLOCK + WIDTH - 1]), minlength=LEVELS + 1)
    return counts


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy level, the rarest lowest; weak levels come after all others."""
    weak = np.arange(LEVELS + 1) < WEAKEST
    order = np.lexsort((np.arange(LEVELS + 1), counts, weak))
    ranks = np.empty(LEVELS + 1, np.int64)
    ranks[order] = np.arange(LEVELS + 1)
    ranks[weak] = LEVELS + 1
    return ranks


def fit_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Ranks by how often each entropy level occurs among all windows of all documents. Some 1,000 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in slices(batches):
            for raw in batch.column(0).to_pylist():
                total += level_counts(raw)
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["level", "n"])

    rows = docs.select(utf8(named(docs, text_col)).alias("text")).mapInArrow(run, "level int, n long")
    counts = np.zeros(LEVELS + 1, np.int64)
    for row in rows.groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[row["level"]] = row["n"]
    return ranks_of(counts)


def write_ranks(spark: SparkSession, ranks: np.ndarray, path: str) -> None:
    """Keeps ranks as a table, for fingerprints of other corpora that are to be compared with these."""
    spark.createDataFrame(list(enumerate(ranks.tolist())), "level int, rank long").coalesce(1).write.parquet(path)


def read_ranks(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["rank"] for r in spark.read.parquet(path).orderBy("level").collect()], np.int64)


def _positions(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Starts of the feature windows: the rarest, leftmost of ties, of POPULAR of the neighbourhoods they lie in."""
    windows, out = len(data) - WIDTH + 1, []
    if windows <= AROUND:
        return np.array([int(np.argmin(ranks[entropy_levels(data)]))])
    best = (-1, 0)
    for core in range(0, windows, BLOCK):
        low, high = max(0, core - AROUND + 1), min(windows, core + BLOCK + AROUND - 1)
        rank = ranks[entropy_levels(data[low : high + WIDTH - 1])]
        least, span = rank << 32 | np.arange(len(rank)), 1
        while span < AROUND:
            step = min(span, AROUND - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        wins = np.bincount(least & 0xFFFFFFFF, minlength=len(rank))
        inside = slice(core - low, min(windows, core + BLOCK) - low)
        chosen = np.nonzero((wins[inside] >= POPULAR) & (rank[inside] <= LEVELS))[0]
        out.append(chosen + core)
        top = int(np.argmax(wins[inside]))
        best = max(best, (int(wins[inside][top]), -(top + core)))
    found = np.concatenate(out)
    return found if len(found) else np.array([-best[1]])


def _hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[starts].view(np.uint64)
    out = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(words.shape[1]):
        out = (out ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    out *= np.uint64(0x94D049BB133111EB)
    return out ^ out >> np.uint64(29)


@dataclass
class Digest:
    """A chain of Bloom filters, each of up to FILTER_FEATURES features in the order of the text."""

    features: int
    filters: np.ndarray

    def __str__(self) -> str:
        return f"{self.features}:{base64.b64encode(self.filters.tobytes()).decode()}"

    @classmethod
    def parse(cls, text: str) -> Digest:
        features, _, coded = text.partition(":")
        return cls(int(features), np.frombuffer(base64.b64decode(coded), np.uint64).reshape(-1, FILTER_BITS // 64))


def digest(raw: bytes, ranks: np.ndarray) -> Digest:
    """The digest of a UTF-8 text. A text shorter than a window is one feature, an empty one has none."""
    if not raw:
        return Digest(0, np.zeros((0, FILTER_BITS // 64), np.uint64))
    data = np.frombuffer(raw, np.uint8)
    if len(data) < WIDTH:
        data = np.concatenate([data, np.full(WIDTH - len(data), len(data), np.uint8)])
        starts = np.zeros(1, np.int64)
    else:
        starts = _positions(data, ranks)
    hashes, bits = _hashes(data, starts), FILTER_BITS.bit_length() - 1
    chain = -(-len(starts) // FILTER_FEATURES)
    filled = np.zeros(chain * FILTER_BITS, np.uint8)
    base = np.arange(len(starts)) // FILTER_FEATURES * FILTER_BITS
    for k in range(FEATURE_BITS):
        filled[base + (hashes >> np.uint64(bits * k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return Digest(len(starts), np.packbits(filled, bitorder="little").view(np.uint64).reshape(chain, -1))


def likeness(one: Digest, other: Digest) -> float:
    """0 to 1, the same for either order: for each filter of the shorter chain the best overlap with one of the other's, beyond chance.

    Overlap counts from a cutoff somewhat above what as many random bits share to the most that can be shared. Filters
    weigh by their features. Of two with equally many features both ways count half. Equal digests give 1; of two of
    which one has no feature, 0.
    """
    if one.features == other.features and np.array_equal(one.filters, other.filters):
        return 1.0
    if not one.features or not other.features:
        return 0.0
    if one.features == other.features:
        return (_found_in(one, other) + _found_in(other, one)) / 2
    return _found_in(one, other) if one.features < other.features else _found_in(other, one)


def _found_in(a: Digest, b: Digest) -> float:
    """How much of digest ``a`` is found in ``b``."""
    of_a, of_b = (np.bitwise_count(x.filters).sum(axis=1, dtype=np.int64) for x in (a, b))
    weights = np.full(len(of_a), FILTER_FEATURES)
    weights[-1] = a.features - FILTER_FEATURES * (len(of_a) - 1)
    total = 0.0
    for row, own, weight in zip(a.filters, of_a, weights, strict=True):
        shared = np.bitwise_count(b.filters & row).sum(axis=1, dtype=np.int64)
        most, chance = np.minimum(own, of_b), own * of_b / FILTER_BITS
        least = chance + CUTOFF * (most - chance)
        total += weight * float(np.clip((shared - least) / np.maximum(most - least, 1e-9), 0, 1).max())
    return total / float(weights.sum())


def _edited(text: str, following: str) -> str:
    """The last half of a text's code points replaced by the first as many, or all, of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, tail, doc_id, text) dealt out so that each document's successor in descending id follows it.

    Ids are cut into ranges; each range is sorted by itself and ends with a copy of the first document after it (tail is
    1), the last range with the very first. So there is no global sort, and what is copied is one row for each
    range. Null ids come last; equal ids go by text.
    """
    spark = docs.sparkSession
    keyed = docs.select(named(docs, id_col).cast("long").alias("doc_id"), utf8(named(docs, text_col)).alias("text"))
    ranges = range_count(docs)
    keyed = keyed.withColumn("range", range_of(F.col("doc_id"), bounds(keyed, "doc_id", ranges)))
    heads = sorted(((r["range"], r["head"]) for r in keyed.groupBy("range").agg(F.max("doc_id").alias("head")).collect()), reverse=True)
    wanted = [(place, heads[(k + 1) % len(heads)][1]) for k, (place, _) in enumerate(heads)]
    rows = keyed.withColumn("tail", F.lit(0))
    if wanted:
        needed = F.broadcast(spark.createDataFrame(wanted, "tail_range int, head long"))
        ids = [head for _, head in wanted if head is not None]
        first = keyed.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()).groupBy("doc_id").agg(F.min("text").alias("text"))
        tails = first.join(needed, F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("tail_range").alias("range"), F.lit(1).alias("tail"))
        rows = rows.unionByName(tails)
    return rows.repartition(max(1, ranges // 4), "range").sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), "text").select("range", "tail", "doc_id", "text")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each of ``docs``.

    Each whole text is fingerprinted, and so is it with its last half replaced by the start of the next document's,
    in descending id, after the last the first. near_edited and near_next are the likeness of its fingerprint to the edited
    text's and the next document's. ``ranks`` are those of ``fit_ranks`` over ``docs`` unless given. Null texts count as
    empty. A single document is its own next. An empty table gives no rows. Of equal ids the one with the smaller text
    comes first, null ids come last; equal rows follow each other and have a row each. Very long texts are read in
    blocks, and only two of a task's texts are held at a time. Other columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    ranks = fit_ranks(docs, text_col) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in slices(batches):
            out = []
            for place, tail, doc_id, raw in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                text, own = raw.decode(), digest(raw, ranks)
                if before is not None and before[0] == place:
                    _, last_id, last_text, last_own = before
                    changed = _edited(last_text, text).encode()
                    other = digest(changed, ranks)
                    out.append((last_id, len(last_text), hashlib.sha256(changed).hexdigest(), str(last_own), str(other), likeness(last_own, other), likeness(last_own, own)))
                before = None if tail else (place, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return with_next(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
