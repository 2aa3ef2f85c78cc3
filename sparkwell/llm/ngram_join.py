"""Exact n-gram Jaccard join with set-relation skipping.

Two sets link when ``100 * |x & y| >= percent * |x | y|``. The plan:

1. A sketch counts every shingle of every document in ``2**BUCKET_BITS`` buckets (partial count vectors, merged as
   a tree). It only fixes the global order of shingles, rare first; any order gives the same links, so collisions
   cost time and never links.
2. Each document becomes (size, fingerprint, prefix). Documents with equal sets form one class, represented by the
   smallest doc_id; all later steps see classes only.
3. Index lists: prefix shingles with their set's size and position. Each list is first compared with its leader only
   (its smallest set), which is linear: short lists lie whole in a task, the leaders of lists over HOT_LIST sets come by
   an aggregation and a join.
4. Set relations: a set that links with a leader joins its family and keeps its two differences from the leader (what
   it lacks, what it adds). Members of a family are connected already, so a list with one family is done.
5. What is left of a list is sorted by size and position and cut into blocks; a pair of blocks whose best possible overlap
   (from sizes and positions) is too small is skipped as a whole. Of a long list the largest family is dealt over cells
   once, and only the other sets are copied to the cells, so copies grow with the sets outside that family.
6. Pairs of different families take their answers from their leaders': with l and m the leaders of x and y, the overlap
   of x and y follows from that of l and m and the stored differences. The two leaders' texts are read once for all
   their members' pairs, and pairs whose leaders' overlap is too small for their additions are dropped by it.
7. Verified links close to components in distributed star rounds.
8. Pairs inside a family cannot change a component, but each may link or not. Where all links are asked for, they are
   decided from the stored differences; no text is read again.

Defined results: null or blank text is an empty set, linked with nothing; rows with one doc_id are one node; a null
doc_id keeps a null component_id; extra columns are ignored; repeated rows return a row each; an empty table returns
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, components, drop_stored, row_shingles, runs, stored, text_chunks, words_of

BUCKET_BITS = 24
CHUNK_BITS = 16
FAN_IN = 32
HOT_LIST = 256
#: Pairs of one left set that a task verifies before the set is dealt over several.
GROUP = 256
#: Bits of the map of documents that a verification needs (1 MB).
MAP_BITS = 1 << 23
BLOCK = 64


def _sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for i, j, data, off in text_chunks(col):
        _, _, h, first = words_of(data, off)
        g, at = row_shingles(h, first, k)
        for r in range(j - i):
            yield np.unique(g[at[r] : at[r + 1]])


# ------------------------------------------------------------------ 1: the order of shingles


def _packed(x: np.ndarray) -> tuple[bytes, bytes]:
    """Counts of a chunk: a byte each where most are there, else positions (as gaps where these fit a byte) and bytes; larger counts as pairs."""
    low = np.minimum(x, 255).astype(np.uint8)
    big = np.flatnonzero(low == 255)
    more = b"".join((len(big).to_bytes(4, "little"), big.astype(np.uint16).tobytes(), x[big].astype(np.uint32).tobytes()))
    at = np.flatnonzero(low)
    gaps = np.diff(at, prepend=0)
    narrow = len(at) and gaps.max() < 256
    if (2 if narrow else 3) * len(at) >= len(x):
        return b"", more + low.tobytes()
    return (b"g" + gaps.astype(np.uint8).tobytes() if narrow else b"p" + at.astype(np.uint16).tobytes()), more + low[at].tobytes()


def _unpacked(at: bytes, n: bytes) -> np.ndarray:
    k = int.from_bytes(n[:4], "little")
    big, counts, low = np.frombuffer(n, np.uint16, k, 4), np.frombuffer(n, np.uint32, k, 4 + 2 * k), np.frombuffer(n, np.uint8, -1, 4 + 6 * k)
    x = np.zeros(1 << CHUNK_BITS, np.uint64)
    if at[:1] == b"g":
        x[np.cumsum(np.frombuffer(at, np.uint8, -1, 1), dtype=np.int64)] = low
    elif at:
        x[np.frombuffer(at, np.uint16, -1, 1)] = low
    else:
        x[:] = low
    x[big] = counts
    return x


def _level(n: np.ndarray | float) -> np.ndarray:
    return 8 * np.log2(n + 1.0)


def shingle_order(docs: DataFrame, text: str, k: int) -> bytes:
    """Log-scaled counts of all shingles by bucket, repeats in a document included: 2**BUCKET_BITS bytes whatever the size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << BUCKET_BITS, np.uint16)
        mask = np.uint64((1 << BUCKET_BITS) - 1)
        pending, n = [], 0

        def flush() -> None:
            if pending:
                at, c = np.unique((np.concatenate(pending) & mask).astype(np.uint32), return_counts=True)
                total[at] = np.minimum(total[at] + c, 65535)
                pending.clear()

        for b in batches:
            for _, _, data, off in text_chunks(b.column(0)):
                _, _, h, first = words_of(data, off)
                pending.append(row_shingles(h, first, k)[0])
                n += len(pending[-1])
                if n > 500_000:
                    flush()
                    n = 0
        flush()
        part = TaskContext.get().partitionId()
        for c in range(1 << (BUCKET_BITS - CHUNK_BITS)):
            x = total[c << CHUNK_BITS : (c + 1) << CHUNK_BITS]
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([c], pa.int32()), *(pa.array([b], pa.binary()) for b in _packed(x))], ["part", "chunk", "at", "n"])

    def merge(table: pa.Table) -> pa.Table:
        x = np.zeros(1 << CHUNK_BITS, np.uint64)
        for at, n in zip(table["at"], table["n"], strict=True):
            x += _unpacked(at.as_py(), n.as_py())
        at, n = _packed(np.minimum(x, 0xFFFFFFFF).astype(np.uint32))
        return pa.table({"part": pa.array([table["part"][0].as_py() // FAN_IN], pa.int64()), "chunk": table["chunk"][:1].cast(pa.int32()), "at": pa.array([at], pa.binary()), "n": pa.array([n], pa.binary())})

    shape = "part long, chunk int, at binary, n binary"
    counts = docs.select(text).mapInArrow(count, shape)
    level, parts = counts, max(1, docs.rdd.getNumPartitions())
    while parts > 1:
        level = level.groupBy((F.col("part") / FAN_IN).cast("long").alias("up"), "chunk").applyInArrow(merge, shape)
        parts = -(-parts // FAN_IN)
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in level.select("chunk", "at", "n").collect():  # at most 2**(BUCKET_BITS - CHUNK_BITS) rows of fixed size
        n = _unpacked(r["at"], r["n"])
        out[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.minimum(255, _level(n)).astype(np.uint8)
    return out.tobytes()


# ------------------------------------------------------------------ 2: sets


def shingle_sets(docs: DataFrame, id_col: str, text: str, k: int, percent: int, order: bytes) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, prefix, light) of each row.

    light: how many of the prefix's shingles are in buckets that count at most HOT_LIST; only the others can have long lists.
    """
    held = docs.sparkSession.sparkContext.broadcast(order)
    bound = min(255, int(_level(HOT_LIST)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(held.value, np.uint8)
        mask = np.uint64((1 << BUCKET_BITS) - 1)
        for b in batches:
            for i, j, data, off in text_chunks(b.column(1)):
                _, _, h, first = words_of(data, off)
                g, at = row_shingles(h, first, k)
                for r in range(j - i):
                    g[at[r] : at[r + 1]].sort()
                new = np.ones(len(g), bool)
                new[1:] = g[1:] != g[:-1]
                new[at[:-1][at[:-1] < at[1:]]] = True
                g, at = g[new], np.append(0, np.cumsum(new))[at]
                n = np.diff(at)
                most = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                level = rank[g & mask]
                digests = [xxhash.xxh3_128_digest(g[at[r] : at[r + 1]]) for r in range(j - i)]
                taken = [at[r] + np.argsort(level[at[r] : at[r + 1]], kind="stable")[: most[r]] for r in range(j - i)]  # rare first, ties by hash
                low = np.append(0, np.cumsum(level < bound))[at]
                f = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                values = g[np.concatenate(taken)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(most)), pa.int32()), pa.array(values)), pa.array(np.minimum(np.diff(low), most), pa.int32())],
                    ["doc_id", "n_shingles", "f1", "f2", "prefix", "light"],
                )

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(make, "doc_id long, n_shingles long, f1 long, f2 long, prefix array<long>, light int")


# ------------------------------------------------------------------ 3: index lists


def _enough(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m with a common shingle at positions p and q can link."""
    best = 1 + np.minimum(n - p, m - q) - 1
    return ((100 + percent) * best >= percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _place(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, position and side of packed places."""
    return n >> 32, (n >> 1) & 0x7FFFFFFF, n & 1


def index_lists(reps: DataFrame, percent: int) -> DataFrame:
    """(token, rep, place, hot, leader, star) of the lists with two sets or more.

    place: the set's size and the shingle's position; hot: the list holds more than HOT_LIST sets; star: whether the set
    can link with the list's leader, its smallest rep.
    """
    place = F.shiftleft(F.col("n_shingles"), 32) + F.shiftleft(F.col("pos").cast("long"), 1)
    p = reps.select(F.col("doc_id").alias("rep"), "n_shingles", "light", F.posexplode("prefix").alias("pos", "token")).withColumn("place", place)
    # only shingles in full buckets can have long lists; they are counted exactly
    hot = p.where("pos >= light").groupBy("token").agg(F.count("*").alias("sets"), F.min(F.struct("rep", "place")).alias("l")).where(F.col("sets") > HOT_LIST)
    hot = stored(hot.select("token", F.col("l.rep").alias("leader"), F.col("l.place").alias("first")), "hot", 0, summed=True)
    p = p.select("token", "rep", "place")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, at in runs(batches, ["token"]):
            length = np.diff(at)
            ok = np.repeat(length > 1, length)
            if not ok.any():
                continue
            which = np.repeat(np.arange(len(length)), length)
            by = np.lexsort((c["rep"], which))
            lead = by[at[:-1]][which]  # the smallest rep of each run
            n, pos, _ = _place(c["place"])
            star = _enough(n, pos, n[lead], pos[lead], percent) & (c["rep"] != c["rep"][lead])
            yield pa.RecordBatch.from_arrays([*(pa.array(c[x][ok]) for x in ("token", "rep", "place")), pa.array(c["rep"][lead][ok]), pa.array(star[ok])], ["token", "rep", "place", "leader", "star"])

    short = p.join(hot.select("token"), "token", "left_anti").repartition("token").sortWithinPartitions("token")
    short = short.mapInArrow(keep, "token long, rep long, place long, leader long, star boolean")
    n, q = F.shiftright("place", 32), F.expr("shiftright(place, 1) & 2147483647L")
    m, r = F.shiftright("first", 32), F.expr("shiftright(first, 1) & 2147483647L")
    can = ((100 + percent) * F.least(n - q, m - r) >= percent * (n + m)) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.col("rep") != F.col("leader"))
    long = p.join(hot, "token").select("token", "rep", "place", "leader", can.alias("star"))
    return short.withColumn("hot", F.lit(False)).union(long.withColumn("hot", F.lit(True)))


def deal(lists: DataFrame) -> DataFrame:
    """(token, cell, rep, place, leader, family): lists as cells in which every two sets of different families meet.

    A short list is one cell. Of a long list the largest family is dealt over ``parts`` columns, once for each of the
    ``rows`` parts of the other sets; those lie in all columns of their part, and meet each other in a triangle of cells.
    Long lists of one family are left out.
    """
    columns = ("token", "cell", "rep", "place", "leader", "family")
    short = lists.where("not hot").withColumn("cell", F.lit(0).cast("long")).select(*columns)
    sizes = lists.where("hot").groupBy("token", "family").agg(F.count("*").alias("sets")).groupBy("token").agg(F.max(F.struct("sets", "family")).alias("top"), F.sum("sets").alias("all"))
    sizes = sizes.where("all > top.sets").select("token", F.col("top.family").alias("largest"), F.ceil(F.col("top.sets") / HOT_LIST).cast("int").alias("parts"), F.ceil((F.col("all") - F.col("top.sets")) / HOT_LIST).cast("int").alias("rows"))
    long = lists.where("hot").join(stored(sizes, "sizes", 0, summed=True), "token")
    inside = F.col("family") == F.col("largest")
    long = long.withColumn("b", F.when(inside, F.col("rows") + F.pmod(F.xxhash64("rep"), F.col("parts"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("rows"))).cast("int"))
    long = long.withColumn("x", F.explode(F.when(inside, F.sequence(F.lit(0), F.col("rows") - 1)).otherwise(F.sequence(F.lit(0), F.col("rows") + F.col("parts") - 1))))
    i, j = F.least("b", "x").cast("long"), F.greatest("b", "x").cast("long")
    long = long.withColumn("cell", F.shiftleft(i, 31) + j).withColumn("place", F.col("place") + (F.col("b") > F.col("x")).cast("long"))
    return short.union(long.select(*columns))


def cross_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b, fa, fb), fa < fb: pairs of sets of different families that a list holds and that can link, block by block."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, at in runs(batches, ["token", "cell"]):
            size, where, side = _place(c["place"])
            got: list[tuple[np.ndarray, np.ndarray]] = []
            two = at[:-1][np.diff(at) == 2]
            got.append((two, two + 1))
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s < 3 or (c["family"][s:e] == c["family"][s]).all():
                    continue
                order = s + np.lexsort((where[s:e], size[s:e]))
                n, p = size[order], where[order]
                for x in range(0, e - s, BLOCK):
                    nx = n[x : x + BLOCK]
                    for y in range(x, e - s, BLOCK):
                        ny, py = n[y : y + BLOCK], p[y : y + BLOCK]
                        if 100 * nx[-1] < percent * ny[0]:  # sorted by size: later blocks are larger still
                            break
                        room = min((nx - p[x : x + BLOCK]).max(), (ny - py).max())
                        if (100 + percent) * room < percent * (nx[0] + ny[0]):
                            continue
                        ok = _enough(nx[:, None], p[x : x + BLOCK, None], ny[None], py[None], percent)
                        if x == y:
                            ok = np.triu(ok, 1)
                        u, v = np.nonzero(ok)
                        got.append((order[x + u], order[y + v]))
            u, v = (np.concatenate(z) for z in zip(*got, strict=True))
            ru, rv, fu, fv = c["rep"][u], c["rep"][v], c["family"][u], c["family"][v]
            ok = _enough(size[u], where[u], size[v], where[v], percent) & (fu != fv) & (ru != rv)
            ok &= (ru != c["leader"][u]) & (rv != c["leader"][v])  # compared before
            ok &= (c["cell"][u] >> 31 == c["cell"][u] & 0x7FFFFFFF) | (side[u] != side[v])
            if ok.any():
                first = fu < fv
                rows = np.unique(np.stack([np.where(first, ru, rv)[ok], np.where(first, rv, ru)[ok], np.minimum(fu, fv)[ok], np.maximum(fu, fv)[ok]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["a", "b", "fa", "fb"])

    dealt = cells.repartition("token", "cell").sortWithinPartitions("token", "cell")
    return dealt.mapInArrow(pairs, "a long, b long, fa long, fb long").distinct()


# ------------------------------------------------------------------ 4: verification


def _bit(ids: np.ndarray) -> np.ndarray:
    return (ids ^ (ids >> 23)) % MAP_BITS


def texts_of(pairs: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, t) of at least all documents in pairs: a bitmap of MAP_BITS bits leaves most others out before a shuffle."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    at = F.expr(f"pmod(id ^ shiftright(id, 23), {MAP_BITS}L) + 1")  # bitmap buckets of positive numbers begin at 1
    rows = ids.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    bits = np.zeros(MAP_BITS, bool)
    for r in rows:  # at most MAP_BITS / 32768 rows of 4 KB
        bits[(r["k"] - 1) * 32768 + np.flatnonzero(np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little"))] = True
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for b in batches:
            known = np.asarray(b.column(0).is_valid())
            ids = b.column(0).fill_null(0).to_numpy()
            yield b.filter(pa.array(wanted[_bit(ids)] & known))

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(keep, "id long, t string")


LINK = "a long, b long, overlap long, n_a long, n_b long, lacks array<long>, adds array<long>"


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The number of values of y in x; both sorted and distinct."""
    if not len(x) or not len(y):
        return 0
    return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())


def derived(base: int, left: np.ndarray, right: np.ndarray, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """The overlap of two sets from that of their leaders (base): x and y are (lacking, added) of left's and right's member."""
    (lx, ax), (ly, ay) = x, y
    both = base - _overlap(right, lx) - _overlap(left, ly) + _overlap(lx, ly)  # what remains of the leaders' overlap
    both += _overlap(right, ax) - _overlap(ax, ly)  # x's additions that y kept
    both += _overlap(left, ay) - _overlap(lx, ay)
    return both + _overlap(ax, ay)


def verified(pairs: DataFrame, rows: int, docs: DataFrame, id_col: str, text: str, k: int, percent: int, family: DataFrame | None = None) -> DataFrame:
    """LINK rows of the pairs (a, b, fa, fb) that link; fa and fb are the leaders of a and b, or a and b themselves.

    A task reads the text of fa once, then for each fb its text and the members' differences from ``family``
    (rep, lacks, adds). An fa with more than GROUP pairs is dealt over parts. rows: about how many pairs there can be.
    Differences are given where both ids have one set (rows of one doc_id may have several: any two of them may link).
    """
    pairs = stored(pairs, "pairs", rows)
    t = stored(texts_of(pairs.select(F.col("fa").alias("a"), F.col("fb").alias("b")), docs, id_col, text), "texts")
    big = pairs.groupBy("fa").count().where(F.col("count") > GROUP).select("fa", F.ceil(F.col("count") / GROUP).cast("int").alias("parts"))
    p = pairs.join(big, "fa", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts"))).cast("int")).drop("parts")
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("lx", "ax", "ly", "ay")]
    lefts = p.select("fa", "part").distinct().select(F.col("fa").alias("id"), "fa", "part", F.lit(None).cast("long").alias("fb"))
    rights = p.select("fa", "part", "fb").distinct().select(F.col("fb").alias("id"), "fa", "part", "fb")
    texts = lefts.union(rights).join(t, "id").select("fa", "part", "fb", "t", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), *none)
    if family is not None:
        more = p.where("a <> fa or b <> fb")
        more = more.join(family.select(F.col("rep").alias("a"), F.col("lacks").alias("lx"), F.col("adds").alias("ax")), "a", "left")
        more = more.join(family.select(F.col("rep").alias("b"), F.col("lacks").alias("ly"), F.col("adds").alias("ay")), "b", "left")
        texts = texts.union(more.select("fa", "part", "fb", F.lit(None).cast("string").alias("t"), "a", "b", "lx", "ax", "ly", "ay"))
    dealt = texts.repartition("fa", "part").sortWithinPartitions("fa", "part", F.col("fb").asc_nulls_first(), F.col("a").asc_nulls_first(), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lefts, rights, base, decided = (None, None, None), [], [], [], True
        out: list[tuple] = []

        def links(both: int, n: int, m: int) -> bool:
            return both > 0 and 100 * both >= percent * (n + m - both)

        def leaders() -> None:
            """Decide the pair of leaders, once all their texts are known."""
            base[:] = [(x, y, _overlap(x, y)) for x in lefts for y in rights]
            for x, y, both in base:
                if links(both, len(x), len(y)):
                    lacks, adds = (np.setdiff1d(*z, assume_unique=True).view(np.int64) if len(base) == 1 else None for z in ((x, y), (y, x)))
                    out.append((key[0], key[2], both, len(x), len(y), lacks, adds))

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:5]), *(pa.array(x, pa.list_(pa.int64())) for x in columns[5:])], ["a", "b", "overlap", "n_a", "n_b", "lacks", "adds"])

        for batch in batches:
            fa, part, fb, a, b = (batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5))
            lists = [(c.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), c.offsets.to_numpy()) for c in batch.columns[6:]]
            for i, held in enumerate(_sets(batch.column(3), k)):
                if (fa[i], part[i], fb[i]) != key:
                    if not decided:
                        leaders()
                    if (fa[i], part[i]) != key[:2]:
                        lefts.clear()
                    key, decided = (fa[i], part[i], fb[i]), False
                    rights.clear()
                if a[i] is None:
                    into = lefts if fb[i] is None else rights
                    if not any(np.array_equal(held, x) for x in into):
                        into.append(held)
                    continue
                if not decided:
                    leaders()
                    decided = True
                lx, ax, ly, ay = (v[at[i] : at[i + 1]] for v, at in lists)
                for left, right, known in base:
                    n, m = len(left) - len(lx) + len(ax), len(right) - len(ly) + len(ay)
                    if not links(min(known + len(ax) + len(ay), n, m), n, m):
                        continue
                    both = derived(known, left, right, (lx, ax), (ly, ay))
                    if links(both, n, m):
                        out.append((a[i], b[i], both, n, m, None, None) if a[i] < b[i] else (b[i], a[i], both, m, n, None, None))
            if out:
                yield taken()
        if not decided:
            leaders()
        if out:
            yield taken()

    found = stored(dealt.select("fa", "part", "fb", "t", "a", "b", "lx", "ax", "ly", "ay").mapInArrow(check, LINK), "links")
    drop_stored(pairs)
    drop_stored(t)
    return found


# ------------------------------------------------------------------ 8: links inside families


def family_links(family: DataFrame, percent: int) -> DataFrame:
    """(a, b, overlap, n_a, n_b) of all links between two members of one family, without the leader's own.

    With d the shingles that a member lacks or adds, the overlap of x and y is ``|leader| - lacking x - lacking y + |dx & dy|``.
    A family is a grid of cells of at most about HOT_LIST members by HOT_LIST.
    """
    several = family.groupBy("family").count().where("count > 1").select("family", F.ceil(F.col("count") / HOT_LIST).cast("int").alias("parts"))
    m = family.join(several, "family").withColumn("p", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    m = m.select("family", F.least("p", "x").alias("i"), F.greatest("p", "x").alias("j"), (F.col("p") > F.col("x")).alias("side"), "rep", "size", "n", F.size("lacks").cast("long").alias("lacking"), F.concat("lacks", "adds").alias("d"))

    def decide(table: pa.Table) -> pa.Table:
        rep, n, lacking, side = (table[c].to_numpy() for c in ("rep", "n", "lacking", "side"))
        lists = table["d"].combine_chunks()
        token, which = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        owner = np.repeat(np.arange(len(rep)), lists.value_lengths().to_numpy())
        both = np.zeros((len(rep), len(rep)), np.int64)
        for s in range(0, len(token), 4096):
            here = (which >= s) & (which < s + 4096)
            x = np.zeros((len(rep), 4096), np.float32)
            x[owner[here], which[here] - s] = 1
            both += (x @ x.T).astype(np.int64)
        both += table["size"][0].as_py() - lacking[:, None] - lacking[None]
        ok = (100 * both >= percent * (n[:, None] + n[None] - both)) & (both > 0) & (rep[:, None] < rep[None])
        if table["i"][0].as_py() != table["j"][0].as_py():
            ok &= side[:, None] != side[None]
        u, v = np.nonzero(ok)
        return pa.table({"a": rep[u], "b": rep[v], "overlap": both[u, v], "n_a": n[u], "n_b": n[v]})

    return m.groupBy("family", "i", "j").applyInArrow(decide, "a long, b long, overlap long, n_a long, n_b long")


# ------------------------------------------------------------------ the operator


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, n_shingles, rep, component_id) of every row, and the verified links between classes.

    links: (a, b, overlap, n_a, n_b), all between class representatives. Without complete, those between two members of
    one family are left out, which keeps the components: for callers that only need the membership.
    """
    bounded_batches(spark)
    docs = docs.select(id_col, text)
    sets = stored(shingle_sets(docs, id_col, text, k, percent, shingle_order(docs, text, k)), "sets")
    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"))
    classes = stored(classes, "classes", sets.count())
    reps = sets.join(classes, (sets.doc_id == classes.rep) & (sets.f1 == classes.f1) & (sets.f2 == classes.f2), "left_semi").dropDuplicates(["doc_id", "f1", "f2"])
    reps = stored(reps.select("doc_id", "n_shingles", "prefix", "light"), "reps")
    heads = stored(sets.drop("prefix", "light"), "heads")
    drop_stored(sets)
    lists = stored(index_lists(reps, percent), "lists")
    drop_stored(reps)
    size = lists.count()
    star = lists.where("star").select(F.col("leader").alias("a"), F.col("rep").alias("b"), F.col("leader").alias("fa"), F.col("rep").alias("fb")).distinct()
    first = verified(star, size, docs, id_col, text, k, percent)
    nearest = first.where("lacks is not null").groupBy("b").agg(F.min("a").alias("a"))
    family = first.where("lacks is not null").join(nearest, ["a", "b"]).select(F.col("b").alias("rep"), F.col("a").alias("family"), F.col("n_a").alias("size"), F.col("n_b").alias("n"), "lacks", "adds")
    family = stored(family, "family")
    rest = lists.drop("star").join(family.select("rep", "family"), "rep", "left").withColumn("family", F.coalesce("family", "rep"))
    second = verified(cross_pairs(deal(stored(rest, "rest", size)), percent), size, docs, id_col, text, k, percent, family)
    drop_stored(lists)
    links = first.union(second).drop("lacks", "adds")
    nodes = components(links.select("a", "b"))
    named = heads.join(classes, ["f1", "f2"], "left")
    named = named.withColumn("rep", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).otherwise(F.col("doc_id")))
    nodes = nodes.select(F.col("node").alias("rep"), "component")
    out = named.join(nodes, "rep", "left").select("doc_id", "n_shingles", "rep", F.coalesce("component", "rep").alias("component_id"))
    if complete:
        links = links.union(family_links(family, percent))
    return out, links.dropDuplicates(["a", "b"])
