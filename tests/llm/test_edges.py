"""Very long values, repeated ids and rows, and drawn documents computed again: cases of several operators."""

import base64
import hashlib
import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwell.llm import mixing
from sparkwell.llm.packing import default_tokenizer, encoder, pack
from sparkwell.llm.topk_search import top_k
from sparkwell.llm.url_filter import Rule, host_and_path, url_filter
from sparkwell.llm.warc import write_and_read


def text(x):
    return tuple(str(v) for v in x)


def test_warc_of_large_payloads_and_repeated_ids(spark):
    """Payloads of several MB, one twice; an id with two payloads is two records."""
    large = "0123456789abcdef" * 400_000
    rows = [(1, "a", large), (2, "b", large), (3, "c", large + "x"), (4, "d", "one"), (4, "d", "two"), (5, "e", "one"), (3, "f", "two"), (5, "e", "one")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = []
    for i, _, h in rows:
        first = min(j for j, _, g in rows if g == h)
        want.append((i, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if i != first else "response", first if i != first else None))
    got = [tuple(r) for r in write_and_read(spark, df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=text) == sorted(want, key=text)


def test_top_k_of_very_long_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 20_000).astype(float).tolist()) for i in range(12)] + [(i, [1.0, 2.0]) for i in range(20, 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(spark, df, F.col("vec_id") % 5 == 0, 3).collect()}
    for q, v in ((i, v) for i, v in rows if i % 5 == 0):
        best = sorted((-int(np.dot(256 * np.array(v), 256 * np.array(c))), i) for i, c in rows if i != q and len(c) == len(v))[:3]
        assert [got[q, n + 1] for n in range(len(best))] == [(i, -s) for s, i in best]


def test_urls_null_repeated_and_very_long(spark):
    long = "http://Sub.Example.com/en/7" + "a/b?" * 50_000 + "#/casino-"
    rows = [(None, "http://x.com/en/1"), (1, long), (1, long), (2, "http://" + "h" * 100_000 + ".net/de/9"), (3, None), (3, "http://ads.x.org/"), (None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    rules = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("block", "net", "/de/")]
    got = sorted((text((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in url_filter(spark, df, rules).collect()))
    rule = {None: ("com/en/", "block"), 1: ("example.com/en/7", "allow"), 2: ("net/de/", "block")}
    want = []
    for i, u in rows:
        name, verdict = rule[i] if u and i in rule else (None, "block" if u else "allow")
        want.append(text((i, *host_and_path(u), name, verdict)))
    assert got == sorted(want)


def test_tokenizer_on_random_texts():
    """The faster engine gives the ids of the file's own library on texts of every kind of character."""
    rng = random.Random(7)
    own, enc = Tokenizer.from_file(default_tokenizer()), encoder(default_tokenizer())
    kinds = [lambda: chr(rng.randrange(32, 127)), lambda: rng.choice(" \n\t\r 　"), lambda: chr(rng.randrange(0xA0, 0x500)), lambda: chr(rng.randrange(0x4E00, 0x5000)), lambda: chr(rng.randrange(0x1F300, 0x1F650)), lambda: rng.choice("0123456789"), lambda: rng.choice("'s't're"), lambda: chr(rng.randrange(0x300, 0x370))]
    for _ in range(600):
        some = rng.sample(kinds, rng.randrange(1, len(kinds)))
        t = "".join(rng.choice(some)() for _ in range(rng.randrange(0, 120)))
        assert enc(t).tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_of_repeated_and_null_ids(spark):
    """Rows of one id, or of none, are documents of their own: the pieces hold every row's ids, gapless in their sequences."""
    rows = [(1, "a b c " * 40), (1, "a b c " * 40), (1, "other"), (None, "none " * 30), (None, "none " * 30), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = Tokenizer.from_file(default_tokenizer())
    want = sorted(n for n in (len(own.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows))
    pieces = pack(spark, df, 16).collect()
    by = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sum(x.length for x in by[p.sequence_id])
        by[p.sequence_id].append(p)
    stream = [p for s in sorted(by) for p in by[s]]
    docs, at = [], 0
    for p in stream:  # a document's pieces follow each other
        assert p.start == at
        at = 0 if p.ends else at + p.length
        if p.ends:
            docs.append((p.doc_id, p.start + p.length))
    assert sorted(n for _, n in docs) == want and sum(p.length for p in pieces) == sum(want)
    assert sorted(str(i) for i, _ in docs) == sorted(str(i) for i, _ in rows)


def test_the_drawn_documents_computed_again(spark):
    """What each source's quota draws: whole rounds, then the first documents by block key and document key that fit the rest."""
    rng = random.Random(3)
    data = [(i, "w " * rng.randrange(0, 9), rng.choice("aaaaaaabbc")) for i in range(500)] + [(900, "long " * 40_000, "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    out, settled = mixing.mixture(spark, df, most_repeats=2.0, seed=5)
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    size = {i: len(t.split()) + 1 for i, t, _ in data}
    totals = defaultdict(int)
    for i, _, s in data:
        totals[s] += size[i]
    whole = sum(totals.values())
    a, budget = settled["exponent"], settled["budget"]
    z = sum((n / whole) ** a for n in totals.values())
    for s, tokens in totals.items():
        mine = [i for i, _, x in data if x == s]
        quota = math.floor(budget * (tokens / whole) ** a / z * (1 + 1e-9))
        full, rest = divmod(quota, tokens)
        blocks = max(mixing.BLOCKS, -(-len(mine) // mixing.BLOCK_ROWS))
        ids = spark.createDataFrame([(str(i),) for i in mine], "id string")
        epoch = F.lit(full).cast("long")
        b = F.pmod(F.xxhash64(F.lit(6), epoch, "id"), F.lit(blocks).cast("long")).cast("int")
        key = df.where(F.col("source") == s).select(mixing._key("source").alias("k")).first()["k"]
        keyed = ids.select("id", b.alias("b"), F.xxhash64(F.lit(7), epoch, F.lit(key), b).alias("bk"), F.xxhash64(F.lit(5), epoch, "id").alias("dk")).collect()
        order = sorted(keyed, key=lambda r: (r.bk, r.b, r.dk))
        drawn, used = set(), 0
        for r in order if rest else []:
            if used + size[int(r.id)] > rest:
                break
            used += size[int(r.id)]
            drawn.add(int(r.id))
        assert {i: got[i] for i in mine} == {i: full + (i in drawn) for i in mine}
