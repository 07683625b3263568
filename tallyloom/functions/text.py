"""Normal forms of names and phrases."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[a-z0-9_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def normalise(text: str) -> str:
    return "_".join(words(text))


def normalised(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)")), "_")


def contains_phrase(text: str, phrase: str) -> bool:
    """Whether the words of ``phrase`` stand together in ``text`` as whole words."""
    inside, wanted = re.split(r"[\W_]+", text.lower()), re.split(r"[\W_]+", phrase.lower())
    return any(inside[k : k + len(wanted)] == wanted for k in range(len(inside) - len(wanted) + 1)) if phrase else False


def has_phrase(text: Column, phrase: str) -> Column:
    """``contains_phrase`` as a column: words are runs of letters and digits of any script; null for a null text, false for a
    phrase without words."""
    wanted = [w for w in re.split(r"[\W_]+", phrase.lower()) if w]
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return spaced.contains(f" {' '.join(wanted)} ") if wanted else F.when(text.isNotNull(), F.lit(False))


def ngrams(text: str, most: int) -> list[str]:
    """Word n-grams, the longest first."""
    own = words(text)
    return [" ".join(own[k : k + n]) for n in range(min(most, len(own)), 0, -1) for k in range(len(own) - n + 1)]
