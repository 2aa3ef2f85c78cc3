"""Many terms searched in one pass over each text: an automaton over all terms instead of a comparison for each pair.

Texts and terms are lower-cased by Spark; a task builds the automaton of the broadcast terms once. The time for a text grows
with its length and its hits, not with the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import bounded_batches

#: Terms of one automaton (some 100 bytes a character); more are searched in several passes.
MOST_TERMS = 100_000


def _automaton(terms: list[str]) -> tuple[ahocorasick.Automaton, list[int]]:
    """The automaton of distinct terms, and the positions of empty ones, which every text holds."""
    a = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        if t:
            a.add_word(t, i)
    a.make_automaton()
    return a, [i for i, t in enumerate(terms) if not t]


def term_hits(docs: DataFrame, terms: DataFrame, text: str, term: str = "term", keep: tuple[str, ...] = ("doc_id",), most: int = MOST_TERMS) -> DataFrame:
    """(kept columns, term): the distinct terms that a text holds anywhere, ignoring case; null texts and terms hold nothing."""
    lowered = terms.where(F.col(term).isNotNull()).select(F.lower(term).alias("low")).distinct().orderBy("low")
    spark, out = docs.sparkSession, None
    bounded_batches(spark)
    d = docs.where(F.col(text).isNotNull()).select(*keep, F.lower(text).alias("__low"))
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema[:-1]), "low string"])
    words = [r["low"] for r in lowered.collect()]  # the terms themselves, a list given by the caller
    for s in range(0, len(words), most):
        held = spark.sparkContext.broadcast(words[s : s + most])

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            found, always = _automaton(held.value)
            for b in batches:
                rows: list[int] = []
                hits: list[int] = []
                for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    h = {x for _, x in found.iter(t)} if len(found) else set()
                    h.update(always)
                    rows += [i] * len(h)
                    hits += sorted(h)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:-1]), pa.array([held.value[h] for h in hits], pa.string())], [*b.schema.names[:-1], "low"])

        part = d.mapInArrow(run, shape)
        out = part if out is None else out.union(part)
    if out is None:
        out = d.select(*keep, F.lit("").alias("low")).limit(0)
    named = terms.select(F.col(term).alias("term"), F.lower(term).alias("low")).distinct()
    return out.join(named, "low").select(*keep, "term")
