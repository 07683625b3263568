"""Token ids in binary blocks: frequency-ranked numbers of one to four bytes beside control bytes that tell their lengths."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import checkpoint, named, portions, scratch_path, slices, utf8
from tallyloom.llm.pieces import Pieces
from tallyloom.llm.ranges import bounds, range_count, range_of

#: Layout of a block: magic, then as unsigned numbers the documents, ids and distinct ids; then the documents' numbers
#: (8 bytes each, signed) and whether they are null (1 byte each), their lengths (coded as below), the distinct ids by
#: falling frequency (4 bytes each), and the ranks of all ids (coded).
MAGIC = b"TLIDS1\0\0"
HEADER = struct.Struct("<8sQQQ")
#: Ids in a block after which the next document starts another. Bounds the memory of writing and reading.
BLOCK_IDS = 1 << 20
#: Ids below this are counted in a table; larger ones are sorted.
MOST_COUNTED = 1 << 22
#: Bytes of text that are encoded at once, a last text apart. Bounds the memory, some ten times as much.
GROUP_BYTES = 1 << 22


@lru_cache(maxsize=1)
def _lengths() -> np.ndarray:
    """For each control byte, the lengths in bytes of its four numbers: two bits each, the first lowest."""
    return (np.arange(256, dtype=np.uint8)[:, None] >> np.arange(0, 8, 2, dtype=np.uint8) & 3) + np.uint8(1)


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as control bytes, each for four numbers, and then their low bytes without leading zeros."""
    values = np.ascontiguousarray(numbers, "<u4")
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = codes
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    used = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    return control.astype(np.uint8).tobytes() + used.tobytes()


def unpack_numbers(raw: memoryview, count: int) -> tuple[np.ndarray, int]:
    """The numbers that ``pack_numbers`` packed at the start of ``raw``, and the bytes they took."""
    controls = -(-count // 4)
    lengths = _lengths()[np.frombuffer(raw, np.uint8, controls)].reshape(-1)[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    size = int(ends[-1]) if count else 0
    data = np.zeros(size + 4, np.uint8)
    data[:size] = np.frombuffer(raw, np.uint8, size, controls)
    starts, out = ends - lengths, np.zeros(count, np.uint32)
    for k in range(int(lengths.max(initial=0))):
        out |= np.where(lengths > k, data[starts + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out, controls + size


def pack_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """Documents with their token ids as one self-contained block."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    if len(flat) and flat.max() < MOST_COUNTED:
        counts = np.bincount(flat)
        distinct = np.nonzero(counts)[0].astype(np.uint32)
        order = np.lexsort((distinct, -counts[distinct]))
        ranks = np.zeros(len(counts), np.uint32)
        ranks[distinct[order]] = np.arange(len(order), dtype=np.uint32)
        ranked = ranks[flat]
    else:
        distinct, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((distinct, -count))
        ranks = np.empty(len(order), np.uint32)
        ranks[order] = np.arange(len(order), dtype=np.uint32)
        ranked = ranks[place]
    parts = [HEADER.pack(MAGIC, len(doc_ids), len(flat), len(distinct)), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes()]
    return b"".join([*parts, pack_numbers(np.array([len(x) for x in ids], np.uint32)), distinct[order].astype("<u4").tobytes(), pack_numbers(ranked)])


def unpack_block(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents' numbers, the lengths of their ids, and all ids in a row."""
    view = memoryview(raw)
    magic, docs, count, distinct = HEADER.unpack_from(view)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEADER.size
    numbers, missing = np.frombuffer(view, "<i8", docs, at).tolist(), np.frombuffer(view, np.uint8, docs, at + 8 * docs).tolist()
    at += 9 * docs
    lengths, took = unpack_numbers(view[at:], docs)
    table = np.frombuffer(view, "<u4", distinct, at + took)
    ranks, _ = unpack_numbers(view[at + took + 4 * distinct :], count)
    return [None if gone else x for x, gone in zip(numbers, missing, strict=True)], lengths.astype(np.int64), table[ranks]


def gathered(flat: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ``sizes`` that follow each other in ``flat``, those at ``places`` in a row, and their sizes."""
    counts = sizes[places]
    total = int(counts.sum())
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    shifts = (np.cumsum(sizes) - sizes)[places] - (np.cumsum(counts) - counts)
    return flat[np.repeat(shifts.astype(kind), counts) + np.arange(total, dtype=kind)], counts


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: visible Latin-1 characters stand for themselves, other bytes for those from 256 on."""
    visible = {*range(33, 127), *range(161, 256)} - {173}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Encodes texts as the tokenizers library does; words seen before come from a bounded memory.

    The byte-level pre-tokenizer cuts a text into pieces by its pattern, and merging stays within a piece; so the ids of
    a text are those of its pieces, each merged by the library's model. A text that holds an added token's string goes to the
    library whole, which finds such tokens first, and so does one with characters on which Unicode versions may differ.
    """

    def __init__(self, model: bytes, pattern: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(model)
        self.merge = self.library.model.tokenize
        self.space = _byte_letters()[32]
        self.packed = [struct.pack("<I", k) for k in range(self.library.get_vocab_size())]
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = Pieces(pattern, self._piece, b"".join, self._words)

    def _words(self, words: list[str]) -> list[bytes]:
        letters = {k: x for k, x in _byte_letters().items() if k != 10}
        others = iter("\n".join(w for w in words if not w.isascii()).encode().decode("latin-1").translate(letters).split("\n"))
        merge, packed, space = self.merge, self.packed, self.space
        return [b"".join([packed[t.id] for t in merge(space + (w if w.isascii() else next(others)))]) for w in words]

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            letters = piece.replace(" ", self.space)
        else:
            letters = piece.encode().decode("latin-1").translate(_byte_letters())
        return b"".join([self.packed[token.id] for token in self.merge(letters)])

    def _bytes(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(x in text for x in self.added) or BEYOND_PLAIN(text):
            return self._bytes(text)
        return b"".join(self.pieces.values(text))

    def encode_all(self, texts: pa.StringArray, end_id: int) -> list[np.ndarray]:
        """The ids of each text and ``end_id`` after them; a word that the texts share is looked up once."""
        end, alone = struct.pack("<I", end_id), np.ones(len(texts), bool)
        out = [np.zeros(0, "<u4")] * len(texts)
        if self.pieces.by_word:
            alone = pc.match_substring_regex(texts, BEYOND).to_numpy(zero_copy_only=False).copy()
            for x in self.added:
                alone |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if len(rest := np.flatnonzero(~alone)):
            found, parts, places, stops, uneven = self.pieces.many(texts.filter(pa.array(~alone)))
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            words, took = gathered(np.frombuffer(b"".join(found), "<u4"), sizes, parts.reshape(-1))
            words, took = np.append(words, np.frombuffer(end, "<u4")), np.append(took.reshape(-1, 2).sum(1), 1)
            ids, took = gathered(words, took, np.insert(places, stops, len(parts)))
            ends = np.cumsum(took)[stops + np.arange(len(rest))]
            for k, own in zip(rest.tolist(), np.split(ids, ends[:-1]), strict=True):
                out[k] = own
            alone[rest[uneven]] = True
        for k in np.flatnonzero(alone).tolist():
            out[k] = np.frombuffer(self.encode(texts[k].as_py()) + end, "<u4")
        return out


#: Below U+0370 all Unicode versions in use agree on letters, numbers and spaces.
BEYOND_PLAIN = re.compile("[^\x00-\u036f]").search
BEYOND = r"[\x{370}-\x{10FFFF}]"


@lru_cache(maxsize=2)
def encoder(model: bytes, pattern: str) -> Encoder:
    return Encoder(model, pattern)


def write_token_files(docs: DataFrame, path: str, model_path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of every whole text, each followed by ``end_id``, as blocks under ``path`` in ascending order of the id.

    Texts are dealt out by ranges of the id and sorted inside them; each task encodes its range, some texts at a time, and
    gives a block whenever it holds ``block_ids`` ids. A block is a row (range, part, n_docs, n_ids, payload) of Parquet
    files, which Spark's own writers commit, in whatever store and whichever executors are lost. The ranks are those
    of the block, so no pass over all documents precedes. Null ids come first; of equal ids the smaller text does.
    """
    spark = docs.sparkSession
    keyed = docs.select(named(docs, id_col).cast("long").alias("doc_id"), utf8(named(docs, text_col)).alias("text"))
    ranges = range_count(docs)
    dealt = keyed.withColumn("range", range_of(F.col("doc_id"), bounds(keyed, "doc_id", ranges)))
    dealt = dealt.repartition(max(1, ranges // 4), "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "text")
    with open(model_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value, pattern)
        now, part, held, doc_ids, ids = None, 0, 0, [], []

        def block() -> pa.RecordBatch:
            row = [[now], [part], [len(doc_ids)], [held], [pack_block(doc_ids, ids)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["range", "part", "n_docs", "n_ids", "payload"])

        for batch in (x for whole in batches for x in portions(whole, 1, GROUP_BYTES)):
            coded = own.encode_all(batch.column(1).cast(pa.string()), end_id)
            for where, doc_id, one in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), coded, strict=True):
                if doc_ids and (where != now or held >= block_ids):
                    yield block()
                    part, held, doc_ids, ids = part + 1 if where == now else 0, 0, [], []
                now = where
                doc_ids.append(doc_id)
                ids.append(one)
                held += len(one)
        if doc_ids:
            yield block()

    dealt.mapInArrow(run, "range int, part int, n_docs long, n_ids long, payload binary").write.parquet(path)


def read_token_files(blocks: DataFrame, digest: bool = False) -> DataFrame:
    """(range, part, place, doc_id, before, n_tokens, ids): one row for each document, read back from its block.

    ``before`` is the number of ids before it in the block; ids are the little-endian unsigned 32-bit ids as bytes, or
    with ``digest`` only their CRC-32, so that what follows moves short rows.
    """
    name, kind, sql = ("ids_crc32", pa.int64(), "long") if digest else ("ids", pa.binary(), "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for where, part, payload in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                doc_ids, lengths, ids = unpack_block(payload)
                n, ends = len(doc_ids), np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                own = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                values = pa.array([zlib.crc32(x) for x in own] if digest else [bytes(x) for x in own], kind)
                arrays = [pa.array([where] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), values]
                yield pa.RecordBatch.from_arrays(arrays, ["range", "part", "place", "doc_id", "before", "n_tokens", name])

    return blocks.select("range", "part", "payload").mapInArrow(run, f"range int, part int, place int, doc_id long, before long, n_tokens long, {name} {sql}")


def block_starts(blocks: DataFrame) -> DataFrame:
    """(range, part, start): ids in all blocks before each. One small row for each block; the payload is not read.

    Blocks are summed by range first. Only the ranges, whose number is fixed by the partitions, are one sorted run.
    """
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = blocks.groupBy("range").agg(F.sum("n_ids").alias("n_ids")).select("range", before(Window.orderBy("range")).alias("above"))
    inside = blocks.select("range", "part", before(Window.partitionBy("range").orderBy("part")).alias("inside"))
    return inside.join(ranges, "range").select("range", "part", (F.col("above") + F.col("inside")).alias("start"))


def token_offsets(docs: DataFrame, model_path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): writes the files in the shared folder and reads every document back.

    ``start`` counts the ids of all documents before it, n_tokens its own with the end id, and the checksum is of these
    as little-endian unsigned 32-bit numbers. A null text counts as empty: its end id alone. An empty table gives no
    rows. Rows with equal ids each keep their place and row.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_token_files(docs, path, model_path, pattern, end_id, id_col, text_col, block_ids)
    blocks = spark.read.parquet(path)
    starts = checkpoint(block_starts(blocks))
    found = read_token_files(blocks, digest=True)
    return found.join(starts, ["range", "part"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
