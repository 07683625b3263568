"""Cutting texts into the pieces that a byte-level BPE encodes one by one, and remembering what they give."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterable
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the usual pattern of byte-level BPE, in which a space belongs to the piece after it.
SPACE_LED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Marks of which any run is one piece after a letter and before white space or the end.
MARKS = string.punctuation
#: A space before white space or the end.
_UNEVEN = re.compile(r" (?:\s|\Z)").search

#: Entries of each of the two generations of a worker's caches, and the longest piece that is kept: some 200 MB at most.
MOST_PIECES = 300_000
LONGEST_KEPT = 48


class PieceCache(dict):
    """piece -> what it is encoded to; what is missing is encoded and kept.

    A full cache becomes the older generation, from which pieces still in use are taken over; the one before is
    dropped. So memory stays bounded and frequent pieces stay.
    """

    def __init__(self, encode: Callable[[str], Any], most: int = MOST_PIECES):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, piece: str) -> Any:
        if (ids := self.older.get(piece)) is None:
            ids = self.encode(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.most:
                self._turn()
            self[piece] = ids
        return ids

    def _turn(self) -> None:
        self.older = dict(self)
        self.clear()

    def keep(self, encoded: list[tuple[str, Any]]) -> None:
        fit = [x for x in encoded if len(x[0]) <= LONGEST_KEPT]
        while fit:
            if len(self) >= self.most:
                self._turn()
            room = self.most - len(self)
            self.update(fit[:room])
            fit = fit[room:]


class Pieces:
    """What the pieces of a text are encoded to, in order.

    ``encode`` encodes one match of the pattern; ``join`` makes one value of several; ``encode_words`` encodes several
    words of letters alone, each with a space before it. With the usual pattern, a single space before a visible
    character always starts a piece, whatever stands before it. So the words that such spaces cut off are looked up
    whole. Of those not seen lately, one of letters alone is one piece; marks at the end are one
    piece after the letters before them; a line feed between visible characters is one, and what follows it is a
    word without a space; only the rest are cut by the pattern.
    """

    def __init__(self, pattern: str, encode: Callable[[str], Any], join: Callable[[Iterable[Any]], Any], encode_words: Callable[[list[str]], list[Any]] | None = None):
        self.split, self.by_word = regex.compile(pattern).findall, pattern == SPACE_LED
        self.encode, self.join = encode, join
        self.encode_words = encode_words or (lambda words: [encode(" " + w) for w in words])
        self.pieces = PieceCache(encode, MOST_PIECES // 4)
        self.words = PieceCache(partial(self._word, " "))
        self.bare = PieceCache(partial(self._word, ""), MOST_PIECES // 4)

    def _word(self, space: str, word: str) -> Any:
        if word.isalpha():
            return self.encode(space + word)
        own = self.words if space else self.bare
        body = word.rstrip(MARKS)
        if body.isalpha():
            return self.join((own[body], self.pieces[word[len(body) :]]))
        head, feed, rest = word.partition("\n")
        if feed and head and rest and not head[-1].isspace() and not rest[0].isspace():
            return self.join((own[head], self.pieces[feed], self.bare[rest]))
        return self.join(map(self.pieces.__getitem__, self.split(space + word)))

    def values(self, text: str) -> list[Any]:
        if not self.by_word or _UNEVEN(text):
            return list(map(self.pieces.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        out = [self.bare[first]] if first else []
        out.extend(map(self.words.__getitem__, rest))
        return out

    def _lettered(self, words: list[str], letters: list[bool]) -> list[Any]:
        """The values of the words that are of letters alone, after a space; those not known are encoded in one call."""
        known, older, nothing = self.words, self.words.older, self.join(())
        found = [ids if own else nothing for ids, own in zip(map(known.get, words), letters, strict=True)]
        unknown = [k for k, ids in enumerate(found) if ids is None]
        fresh = [k for k in unknown if words[k] not in older]
        for k, ids in zip(fresh, self.encode_words([words[k] for k in fresh]), strict=True):
            found[k] = ids
        for k in unknown:
            if found[k] is None:
                found[k] = older[words[k]]
        known.keep([(words[k], found[k]) for k in unknown])
        return found

    def many(self, texts: pa.StringArray) -> tuple[list[Any], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(found, parts, places, stops, uneven): the values of several texts, with each word that they share looked up once.

        Text k is the words in ``places`` between two of ``stops``, the last text's and its own, and word i the values of
        the two numbers ``parts[i]`` in ``found``: of its letters and the marks after them, or of the whole word and
        nothing. But where ``uneven[k]`` holds, its spaces don't all start a piece, and only ``values`` has it. Needs
        ``by_word``.
        """
        cut = pc.split_pattern(texts, " ")
        starts, coded = cut.offsets.to_numpy()[:-1], cut.flatten().dictionary_encode()
        words, places = coded.dictionary, coded.indices.to_numpy().copy()
        first = words.take(pa.array(places[starts])).to_pylist()
        places[starts] = np.arange(len(words), len(words) + len(first))
        spaced = np.bincount(places, minlength=len(words))[: len(words)] > 0

        bodies = pc.ascii_rtrim(words, MARKS)
        marks = pc.binary_length(words).to_numpy().astype(np.int64) - pc.binary_length(bodies).to_numpy()
        coded = bodies.dictionary_encode()
        own = _strings(coded.dictionary)
        letters = np.fromiter(map(str.isalpha, own), bool, len(own))
        found = self._lettered(own, letters.tolist())
        nothing = len(found)
        found.append(self.join(()))
        parts = np.full((len(words) + len(first), 2), nothing)
        parts[: len(words), 0] = coded.indices.to_numpy()
        lettered, tails = letters[parts[: len(words), 0]], {}

        marked = np.flatnonzero(lettered & (marks > 0))
        for k, n, word in zip(marked.tolist(), marks[marked].tolist(), _strings(words.take(pa.array(marked))), strict=True):
            if (at := tails.get(tail := word[-n:])) is None:
                at = tails[tail] = len(found)
                found.append(self.pieces[tail])
            parts[k, 1] = at
        wrong = np.zeros(len(parts), bool)
        others = np.flatnonzero(~lettered & spaced)
        for k, word in zip(others.tolist(), _strings(words.take(pa.array(others))), strict=True):
            if not word or word[0].isspace():
                wrong[k] = True
            else:
                parts[k, 0] = len(found)
                found.append(self.words[word])
        parts[len(words) :, 0] = np.arange(len(found), len(found) + len(first))
        found.extend(self.bare[word] if word else self.join(()) for word in first)
        uneven = np.logical_or.reduceat(wrong[places], starts) if wrong.any() else np.zeros(len(starts), bool)
        return found, parts, places, np.append(starts[1:], len(places)), uneven


def _strings(column: pa.StringArray) -> list[str]:
    """As ``to_pylist``, several times as fast; there must be no nulls."""
    return column.to_numpy(zero_copy_only=False).tolist()
