"""Line dedup: lines that several documents share stay in the first of them only.

Every text is split at line feeds and its lines exploded. A line's key is the line without white space at its ends and with
A-Z lower-cased; the key is hashed to 128 bits in Arrow batches of bounded bytes, and the distinct documents of each hash are
counted (24 bytes a line move, partly summed before). Lines whose key reaches the number of documents are
dropped except in the smallest document that holds it, and a text is put together again from the runs between its dropped
positions, in time linear in its lines.

A hash that holds more than one part in HOT_PARTS of the repeated lines is salted: there are at most HOT_PARTS of those, so
their list is broadcast, and their lines are dealt by document. Nothing is written: the plan is one query, whose shuffles are repeated for
what a lost executor held. Positions of dropped lines, never lines, are grouped, and
only within one text.

Defined results: a null text is an empty one, and an empty text is one empty line; white space is ``[\\x20\\x09-\\x0D]``; a key
shorter than ``least_length`` code points is never dropped; a line repeated inside one document counts as one document, and
all its places in the first document stay; rows of one id are one document, and each keeps its own text; rows with a null id
keep all lines and count for nothing; empty tables give no row. Other columns stay as they are, but ``n_lines`` and
``n_dropped`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

LEAST_LENGTH = 10
LEAST_DOCUMENTS = 2
#: A hash with more than this part of all repeated lines is dealt over several tasks.
HOT_PARTS = 4096
#: Lines of one hash that a task takes.
HOT_LINES = 100_000

SPACE = b" \t\n\x0b\x0c\r"


def line_hashes(text: bytes, least_length: int) -> tuple[list[int], list[bytes]]:
    """Positions and 128-bit hashes of the keys with least_length code points or more. bytes.lower() lowers A-Z alone."""
    at, digests = [], []
    for i, line in enumerate(text.lower().split(b"\n")):
        key = line.strip(SPACE)
        if len(key) >= least_length and (len(key) >= 4 * least_length or len(key.decode("utf-8", "replace")) >= least_length):
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(key))
    return at, digests


def keyed_lines(docs: DataFrame, id_col: str, text: str, least_length: int) -> DataFrame:
    """(doc, row, pos, h1, h2) of the lines that can be dropped; row tells texts of one document apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [line_hashes(t, least_length) for t in b.column(2).cast(pa.binary()).to_pylist()]
            rows = pa.array(np.repeat(np.arange(b.num_rows), [len(at) for at, _ in found]))
            pos = np.array([i for at, _ in found for i in at], np.int32)
            h = np.frombuffer(b"".join(d for _, digests in found for d in digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(pos), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc", "row", "pos", "h1", "h2"])

    d = docs.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("row"), text)
    return d.mapInArrow(run, f"doc {d.schema['doc'].dataType.simpleString()}, row long, pos int, h1 long, h2 long")


def repeated_lines(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(h1, h2, first, n): hashes that enough documents hold, the smallest of these, and the number of lines."""
    first = F.min("doc").alias("first")
    if least_documents == 2:  # two documents differ exactly where the smallest and the largest do: no distinct count
        g = lines.groupBy("h1", "h2").agg(first, F.max("doc").alias("last"), F.count("*").alias("n")).where("first < last")
    else:
        g = lines.groupBy("h1", "h2").agg(first, F.count_distinct("doc").alias("documents"), F.count("*").alias("n")).where(F.col("documents") >= least_documents)
    return g.select("h1", "h2", "first", "n")


def dropped_positions(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc, row, cut): the sorted positions that each text loses.

    repeated is used three times; all three read one shuffle of it, as they need the same aggregates.
    """
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    salted = repeated.crossJoin(F.broadcast(total)).withColumn("hot", (F.col("n") > HOT_LINES) & (F.col("n") * HOT_PARTS > F.col("total")))
    salts = F.when(F.col("hot"), F.ceil(F.col("n") / HOT_LINES)).otherwise(1).cast("int")
    salted = salted.select("h1", "h2", "first", "hot", salts.alias("salts"))
    hot = salted.where("hot").select("h1", "h2", "salts")  # at most HOT_PARTS rows
    spread = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("h1", "h2", "salt", "first")
    dealt = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("salts")), F.lit(0)).cast("int"))
    lost = dealt.join(spread, ["h1", "h2", "salt"]).where("doc <> first")
    return lost.groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("cut"))  # a set: rows may be repeated


def line_dedup(spark: SparkSession, docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text that is left, n_lines (before) and n_dropped."""
    bounded_batches(spark)
    lines = keyed_lines(docs, id_col, text, least_length)
    cuts = dropped_positions(lines, repeated_lines(lines, least_documents))

    others = [c for c in docs.columns if c not in (id_col, text, "n_lines", "n_dropped")]
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(text, F.lit("")).alias("t"), F.xxhash64(text).alias("r"), (F.struct(*others) if others else F.lit(None)).alias("o"))
    joined = rows.join(cuts, (F.col("i") == F.col("doc")) & (F.col("r") == F.col("row")), "left")
    split = joined.select("i", "t", "o", "cut", F.split("t", "\n").alias("lines"))
    # the runs between dropped positions
    starts = F.concat(F.array(F.lit(0)), F.transform("cut", lambda p: p + 1))
    ends = F.concat("cut", F.array(F.size("lines")))
    runs = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.slice("lines", x["a"] + 1, x["b"] - x["a"]))
    left = F.when(F.col("cut").isNull(), F.col("t")).otherwise(F.array_join(F.flatten(runs), "\n"))
    n_lines, n_dropped = F.size("lines").cast("long"), F.coalesce(F.size("cut"), F.lit(0)).cast("long")
    return split.select(F.col("i").alias(id_col), left.alias(text), *(F.col("o")[c].alias(c) for c in others), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
