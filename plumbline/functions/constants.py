"""Word lists and tables as constant columns.

Each is one literal that is split when the plan is made, for a call for each word would take most of the time in which a
large expression is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed(words: Iterable[str]) -> Column:
    """An array of words, none of which holds a line break."""
    return F.split(F.lit("\n".join(words)), "\n")


def one_of(word: Column, *lists: Iterable[str]) -> Column:
    """Whether a word is in one of the lists; null for null."""
    return F.array_contains(listed(w for names in lists for w in names), word)


def looked_up(table: Mapping[str, str]) -> Column:
    """A map of words to words, none of which holds a tab or a line break."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in table.items())), F.lit("\n"), F.lit("\t"))
