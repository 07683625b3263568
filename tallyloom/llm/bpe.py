"""Byte-level BPE by dynamic programming over prefixes: encoding, exact appends, re-encoding near edits, decoding."""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import map_rows, named, utf8
from tallyloom.llm.pieces import Pieces

#: Answers about pairs of tokens that a worker remembers: some 40 MB at most.
MOST_TRIED = 250_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


class Vocabulary:
    """Ranks, and for each token the two tokens that its last merge joined."""

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} single bytes have no token")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        unreachable = set()
        for rank, token in sorted(self.tokens.items()):
            if len(token) > 1:
                if (halves := self._last_merge(token, rank)) is None:
                    unreachable.add(rank)
                    continue
                self.halves[rank] = halves
        #: Finds the tokens that end at each byte, the longest first. Tokens that merging never makes are left out.
        self.finder = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if rank not in unreachable:
                self.finder.add_word(token.decode("latin-1"), (len(token), rank))
        self.finder.make_automaton()
        self.longest = max(len(token) for token, rank in ranks.items() if rank not in unreachable)
        #: Pairs that ``extend`` has tried, with the answer; emptied when it is full.
        self._tried: dict[int, bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The halves that merging leaves just before ``token`` is made, or None if it is never made."""
        ranks, parts = self.ranks, [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            least, at = min((ranks.get(parts[k] + parts[k + 1], rank), k) for k in range(len(parts) - 1))
            if least >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def stays(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two adjacent tokens leaves just these two.

        Their merges are undone from the latest on. Each undone merge shows an older pair at the seam; if that pair
        makes a token that comes before the merge which later used one of its sides, merging would have crossed the
        seam. Of two merges with one rank the left comes first.
        """
        ranks, tokens, halves = self.ranks, self.tokens, self.halves
        limit = float("inf")
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < limit:
                return False
            undo_left = left in halves and (left > right or right not in halves)
            if undo_left:
                limit, left = left, halves[left][1]
            elif right in halves:
                limit, right = right + 1, halves[right][0]
            else:
                return True


    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Appends to ``last`` the last token of each prefix of ``data`` that ends at ``len(last) + 1`` to ``stop``."""
        tried, known = self._tried, len(last)
        low = max(0, known + 1 - self.longest)
        for end, (length, token) in self.finder.iter(data[low:stop].decode("latin-1")):
            end += low
            if end < known:
                continue
            if end >= length > 1:
                left = last[end - length]
                pair = left << 32 | token
                if (stays := tried.get(pair)) is None:
                    if len(tried) >= MOST_TRIED:
                        tried.clear()
                    stays = tried[pair] = self.stays(left, token)
                if not stays:
                    continue
            last.append(token)
            known += 1


class PrefixEncoding:
    """The encoding of a byte string that can be added to and edited.

    ``_last[i]`` is the last token of the encoding of the first i + 1 bytes. A prefix has one encoding, and cutting off
    its last token leaves the encoding of the shorter prefix; so the last token is the only one that ends here and
    stays apart from the last token before it. Encoding takes time in proportion to the length.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self._v, self._data, self._last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Adds bytes at the end; nothing before is computed again."""
        self._data += data
        self._v.extend(self._data, self._last, len(self._data))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Puts ``data`` in place of the bytes from ``start`` to ``stop``; returns for how many bytes the last token was computed.

        The last token of a prefix depends on the bytes and the last tokens of at most the longest token's length
        before its end. Once that many in a row after the edit are as they were, the rest is as it was.
        """
        if not 0 <= start <= stop <= len(self._data):
            raise ValueError(f"no bytes {start} to {stop} in {len(self._data)}")
        after = self._last[stop:]
        self._data = self._data[:start] + data + self._data[stop:]
        del self._last[start:]
        same = done = 0
        while (end := len(self._last)) < len(self._data) and same < self._v.longest:
            self._v.extend(self._data, self._last, min(len(self._data), end + self._v.longest))
            for token in self._last[end:]:
                at = done - len(data)
                same = same + 1 if at >= 0 and after[at] == token else 0
                done += 1
        self._last.extend(after[len(self._last) - start - len(data) :])
        return done

    @property
    def data(self) -> bytes:
        return self._data

    def ids(self) -> list[int]:
        out, end = [], len(self._data)
        while end:
            out.append(token := self._last[end - 1])
            end -= len(self._v.tokens[token])
        return out[::-1]


class Codec:
    """Encodes and decodes texts by ranks; each match of the pattern is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = Pieces(pattern, self.encode_piece, b"".join)
        #: By id, so that looking one up is indexing.
        self.digits = [str(k) for k in range(max(ranks.values()) + 1)]
        self.texts = [self.vocabulary.tokens.get(k, b"") for k in range(max(ranks.values()) + 1)]

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one match as native 32-bit numbers, a compact form for the memory of words."""
        data = piece.encode()
        if (whole := self.vocabulary.ranks.get(data)) is not None:
            return self.packed(whole)
        return array("I", PrefixEncoding(self.vocabulary, data).ids()).tobytes()

    @staticmethod
    def packed(token: int) -> bytes:
        return token.to_bytes(4, sys.byteorder)

    def encode(self, text: str) -> list[int]:
        return memoryview(b"".join(self.pieces.values(text))).cast("I").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.texts.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(raw: bytes, pattern: str) -> Codec:
    """One codec in each Python process, whatever tasks it runs."""
    return Codec(read_ranks(raw), pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids_sha256", "decoded_sha256")) -> DataFrame:
    """(doc_id, n_tokens, ...) for each row of ``docs``, in no other order and without a shuffle.

    ``keep`` adds columns: ids (array of int), decoded (the text decoded from the ids), ids_sha256 (digest of the
    decimal ids joined by spaces), decoded_sha256. A null text counts as empty and gives no tokens; ids may be null or
    repeat. The vocabulary file is read on the driver and broadcast; its size does not depend on the documents.
    """
    spark = docs.sparkSession
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    with open(ranks_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(shared.value, pattern)
        counts, columns = [], {k: [] for k in keep}
        for raw in part.column(1).to_pylist():
            ids = own.encode(raw.decode())
            decoded = own.decode(ids)
            counts.append(len(ids))
            for k, values in columns.items():
                values.append(ids if k == "ids" else decoded.decode() if k == "decoded" else hashlib.sha256(decoded if k == "decoded_sha256" else " ".join(map(own.digits.__getitem__, ids)).encode()).hexdigest())
        arrays = [part.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), *[pa.array(v, kinds[k][1]) for k, v in columns.items()]]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", *columns])

    rows = docs.select(named(docs, id_col).cast("long").alias("doc_id"), utf8(named(docs, text_col)).alias("text"))
    return map_rows(rows, ", ".join(["doc_id long", "n_tokens long", *[f"{k} {kinds[k][0]}" for k in keep]]), batch)
