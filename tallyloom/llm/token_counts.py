"""Token counts of a piece BPE model: whole-token words by table, the rest by merging."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import map_rows, named, utf8
from tallyloom.llm.pieces import LONGEST_KEPT, MOST_PIECES

SPACE, BREAK = "▁", "\n"
SEGMENT = re.compile(" +[^ ]*|[^ ]+").findall


class Counter:
    """Counts tokens with a sentencepiece BPE model as the library does, without control tokens.

    A merge joins neighbours only if a piece of the vocabulary holds their characters side by side. If no piece has a
    space mark after another character, nothing merges into a space from the left; if no piece holds a line break,
    nothing merges with one. So each run of spaces with the word after it, and each line, can be counted alone. Both
    premises are proved on the vocabulary here, as is which of its strings alone give exactly one token.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp, size = self.model, self.model.get_piece_size()
        normal = [sp.id_to_piece(k) for k in range(size) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))]
        if odd := [p for p in normal if SPACE in p.lstrip(SPACE) or BREAK in p]:
            raise ValueError(f"pieces such as {odd[0]!r} join words or lines; they can't be counted apart")
        lead = sp.encode(BREAK)
        if len(lead) != 2:
            raise ValueError("a line break is not one token after the leading space mark")
        self.lead = len(lead)
        words = [p for p in normal if p.lstrip(SPACE) and not p.startswith(SPACE * 2)]
        alone = [p.replace(SPACE, " ") for p in words]
        proved = [w for w, n in zip(alone, self._merged(alone), strict=True) if n == 1]
        #: Words after one space, and words at the start of a line, with their counts.
        self.proved = {" ": {w[1:]: 1 for w in proved if w[0] == " "}, "": {w: 1 for w in proved if w[0] != " "} | {"": 0}}
        self.spaced, self.bare, self.whole = dict(self.proved[" "]), dict(self.proved[""]), len(proved)

    def _merged(self, segments: list[str]) -> list[int]:
        """Tokens of each segment by the library's merging: a line break before it keeps the leading space mark away."""
        return [len(ids) - self.lead for ids in self.model.encode([BREAK + s for s in segments], num_threads=1)]

    def _count(self, table: dict[str, int], words: list[str], before: str) -> int:
        try:
            return sum(map(table.__getitem__, words))
        except KeyError:
            rest = list({w for w in words if w not in table})
        found = dict(zip(rest, self._merged([before + w for w in rest]), strict=True))
        total = sum(table[w] if w in table else found[w] for w in words)
        if len(table) > self.whole + MOST_PIECES:
            table.clear()
            table.update(self.proved[before])
        table.update((w, n) for w, n in found.items() if len(w) <= LONGEST_KEPT)
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        lines = (" " + text.replace(SPACE, " ")).split(BREAK)
        total, spaced, first = len(lines) - 1, [], []
        for line in lines:
            if "  " in line or line[-1:] == " ":
                for segment in SEGMENT(line):
                    if segment[0] != " ":
                        first.append(segment)
                    elif segment[1:2] not in ("", " "):
                        spaced.append(segment[1:])
                    else:
                        total += self._count(self.bare, [segment], "")
            else:
                head, *words = line.split(" ")
                first.append(head)
                spaced += words
        return total + self._count(self.spaced, spaced, " ") + self._count(self.bare, first, "")


@lru_cache(maxsize=2)
def counter(model: bytes) -> Counter:
    """One counter in each Python process; its proofs take a tenth of a second."""
    return Counter(model)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``, without a shuffle.

    A null text counts as empty: no bytes, no tokens. Ids may be null or repeat. The model file is read on the driver
    and broadcast; its size does not depend on the documents. What a worker remembers of merged words is bounded.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        own, texts = counter(shared.value), part.column(1).to_pylist()
        counts = [own.count(x.decode()) for x in texts]
        arrays = [part.column(0).cast(pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(named(docs, id_col).cast("long").alias("doc_id"), utf8(named(docs, text_col)).alias("text"))
    return map_rows(rows, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", batch)
