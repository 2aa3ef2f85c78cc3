"""Packing by concatenate and cut.

Pass 1 tokenizes every document once and writes its ids with the running offset inside its partition. The partitions'
token totals give each partition's base by a prefix sum, and base + offset is the document's place in one global
stream. Pass 2 cuts that stream into fixed windows: a piece is a document's part inside one window, and its boundary
record says whether the document begins or ends there. Only the last window can be short, so padding is below one
sequence for the whole corpus. No ids are shuffled.

Defined results: null text is an empty document (its end id only); a null doc_id is kept; repeated rows are packed
each; extra columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, kept, stored, text_chunks

LENGTH = 2048
END_ID = 1
#: Partition bases are broadcast up to this number of partitions (16 bytes each); beyond it they are joined by shuffle.
MOST_BROADCAST = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """text -> uint32 ids, as the tokenizer file gives them without special tokens added.

    Byte-level files whose ids are their merge ranks run on the faster of the two installed byte-pair engines, built
    from the same file; what that engine rejects, and every other file, goes to the file's own library.
    """
    own: list = []  # loaded when first needed

    def slow(text: str) -> np.ndarray:
        if not own:
            from tokenizers import Tokenizer

            own.append(Tokenizer.from_file(path))
        return np.array(own[0].encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model, special = spec.get("pre_tokenizer") or {}, spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    if not (plain and simple and model["type"] == "BPE" and not model.get("ignore_merges")):
        return slow
    import public_tokenizers
    import tiktoken

    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    if sorted(ranks.values()) != list(range(len(ranks))):
        return slow
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except (ValueError, RuntimeError, UnicodeError):
            return slow(text)
        except BaseException as e:  # the engine's own panics don't derive from Exception
            if type(e).__name__ != "PanicException":
                raise
            return slow(text)

    return encode


def token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, part_offset, doc_tokens, ids little-endian uint32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        for b in batches:
            for i, j, data, off in text_chunks(b.column(1)):
                raw = data.tobytes()
                ids = [np.concatenate([encode(raw[off[r] : off[r + 1]].decode()), end]) for r in range(j - i)]
                n = np.array([len(x) for x in ids], np.int64)
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.full(j - i, part)), pa.array(before), pa.array(n), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                    ["doc_id", "part", "part_offset", "doc_tokens", "ids"],
                )

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, "doc_id long, part long, part_offset long, doc_tokens long, ids binary")


def cut(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, begins, ends, ids) of token_ids(), stored before.

    begins and ends: the piece holds its document's first or last id.
    """
    totals = tokens.groupBy("part").agg(F.max(F.col("part_offset") + F.col("doc_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))  # a row for each partition
    bases = kept(bases)
    if bases.count() <= MOST_BROADCAST:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, "part").select("doc_id", (F.col("base") + F.col("part_offset")).alias("at"), "doc_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            at, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            first = at // length
            pieces = (at + n - 1) // length - first + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            seq = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo, hi = np.maximum(at[doc], seq * length), np.minimum(at[doc] + n[doc], (seq + 1) * length)
            ids = b.column(3).cast(pa.large_binary())
            _, off, data = ids.buffers()
            base = np.frombuffer(off, np.int64)[ids.offset : ids.offset + len(ids) + 1]
            ends = np.append(base[doc] + 4 * (lo - at[doc]), base[-1])
            # the pieces are consecutive slices of the batch's ids
            cutids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), data])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(doc)), pa.array(lo - at[doc]), pa.array(hi - lo), pa.array(n[doc]), pa.array(seq), pa.array(lo - seq * length), pa.array(lo == at[doc]), pa.array(hi == at[doc] + n[doc]), cutids.cast(pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "begins", "ends", "ids"],
            )

    return placed.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, begins boolean, ends boolean, ids binary")


def pack(spark: SparkSession, docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Every id of every document in exactly one piece of one sequence of at most length ids."""
    bounded_batches(spark)
    return cut(stored(token_ids(docs, tokenizer or default_tokenizer(), id_col, text, end_id), "ids"), length)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the packed sequences, each of at most the packing length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    s = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    return s.select("sequence_id", F.expr("aggregate(p.ids, X'', (a, x) -> concat(a, x))").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
