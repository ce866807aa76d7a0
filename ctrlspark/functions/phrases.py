"""Phrases looked up in texts by one automaton: each text is read once, however many phrases there are."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: phrases of one automaton (a broadcast list of their texts); more are looked up in further passes
PART = 100_000


def _finder(words: Broadcast):
    """Distinct phrases of a broadcast list in each text, sorted."""

    @pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = ahocorasick.Automaton()
        for word in words.value:
            machine.add_word(word, word)
        machine.make_automaton()
        some = len(machine) > 0
        for texts in batches:
            yield pd.Series([sorted({w for _, w in machine.iter(t)}) if some and t else [] for t in texts], dtype=object)

    return found


def _finders(texts: DataFrame, phrases: DataFrame, name: str, part: int) -> list:
    """A lookup for each part of about ``part`` phrases."""
    known = phrases.select(name).filter(F.length(name) > 0).distinct()
    parts = max(1, -(-known.count() // part))
    mine = [known if parts == 1 else known.filter(F.pmod(F.xxhash64(name), F.lit(parts)) == p) for p in range(parts)]
    return [_finder(texts.sparkSession.sparkContext.broadcast([r[0] for r in m.collect()])) for m in mine]


def phrases_in(texts: DataFrame, column: str, phrases: DataFrame, name: str = "phrase") -> DataFrame:
    """A row of ``texts`` for each distinct phrase(``name``) that stands anywhere in its ``column``.

    Null texts and null or empty phrases match nothing; a text that is repeated is
    answered for each row.  Phrases go to the tasks in parts of about ``PART``.
    """
    out = [texts.withColumn("__found", found(column)) for found in _finders(texts, phrases, name, PART)]
    return reduce(DataFrame.unionByName, (t.filter(F.size("__found") > 0).select(*texts.columns, F.explode("__found").alias(name)) for t in out))


def phrase_sets(texts: DataFrame, column: str, phrases: DataFrame, name: str, into: str, part: int | None = None) -> DataFrame:
    """``texts`` with the array ``into`` of the distinct phrases(``name``) that stand anywhere in its ``column``, none for a null text."""
    return texts.withColumn(into, F.concat(*(found(column) for found in _finders(texts, phrases, name, part or PART))))
