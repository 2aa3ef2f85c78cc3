"""The pipeline's stages on a small corpus, each against brute force on its own input."""

from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import corpus_pipeline as cp
from sparkwell.llm.common import stored
from sparkwell.llm.packing import default_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, k):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def groups(rows, k, percent):
    sets = {r.doc_id: shingles(r.text, k) for r in rows}
    lists = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    both = Counter(p for x in lists.values() for p in combinations(sorted(x), 2))
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return {i: root(i) for i in sets}


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, "en", "src1", 0), (10_001, "12 34 !!", None, None, 8), (None, "the thion and thing of the thion ned", "en", None, 3), (10_002, "", "en", "new", 0)], source.schema)
    twice = source.where("doc_id = 3")
    docs = stored(source.union(odd).union(twice), "docs")
    stages = [f for _, f in cp.STAGES]
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality", "near_copies", "mixing", "packing"]

    one = stored(stages[0](spark, docs, sf), "s1")
    assert one.columns == COLUMNS
    assert Counter(r.doc_id for r in one.collect()) == Counter(r.doc_id for r in docs.collect()) - Counter([10_000, 10_001, 10_002])

    two = stored(stages[1](spark, one, sf), "s2")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in d.collect()} for d in (one, two))
    good = [i in after for i in before if labels.get(i) == 1]
    bad = [i in after for i in before if labels.get(i) == 0]
    assert two.columns == COLUMNS and after <= before and sum(good) > 0.98 * len(good) and sum(bad) < 0.2 * len(bad)

    three = stored(stages[2](spark, two, sf), "s3")
    low = groups([r for r in two.collect() if r.doc_id is not None], 5, 80)
    assert sorted(r.doc_id for r in three.where("doc_id is not null").collect()) == sorted(i for i in low if low[i] == i)
    assert three.columns == COLUMNS and three.where("doc_id is null").count() == two.where("doc_id is null").count()

    four = stored(stages[3](spark, three, sf), "s4")
    seen = Counter((r.doc_id, r.text) for r in four.collect())
    assert four.columns == COLUMNS and set(seen) == {(r.doc_id, r.text) for r in three.collect()} and max(seen.values()) <= 3

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(default_tokenizer())
    want = Counter()
    for (i, t), n in seen.items():
        want[i] += n * (len(own.encode(t, add_special_tokens=False).ids) + 1)
    pieces = stages[4](spark, four, sf).collect()
    got, fill = Counter(), Counter()
    for p in pieces:
        got[p.doc_id] += p.length
        fill[p.sequence_id] += p.length
    assert got == want and all(fill[s] == 2048 for s in range(len(fill) - 1))


def test_extra_columns_come_back(spark, sf):
    extra = ("lang_pred", "score", "kept", "quality", "evidence", "epoch", "block", "full", "last", "own score", "component_id", "rep")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    wide = docs.select("*", *(docs.doc_id.cast("string").alias(c) for c in extra))
    wide = stored(wide, "wide")
    for _, f in cp.STAGES[:4]:
        wide = stored(f(spark, wide, sf), "wide")
        assert wide.columns == [*COLUMNS, *extra]
        rows = wide.collect()
        assert rows and all(r[c] == str(r.doc_id) for r in rows for c in extra)


def test_run_returns_the_last_stage(spark, sf):
    assert cp.run(spark, sf).columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


def test_empty(spark, sf, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert Path(tmp_path / "documents.parquet").exists() and cp.run(spark, str(tmp_path)).count() == 0


def test_rows_of_one_id_are_documents_of_their_own(spark, sf):
    text = lambda c, n=40: " ".join(f"{c}{j}" for j in range(n))
    near = text("a", 60) + " end"
    rows = [(1, text("a", 60)), (1, text("b")), (1, text("b")), (2, near), (3, text("b") + " x"), (4, text("c")), (None, text("c") + " y"), (None, text("d")), (None, text("d")), (5, None), (5, None), (None, None), (6, "")]
    docs = stored(spark.createDataFrame([(i, t, "en", f"s{k % 2}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long"), "rows")
    got = sorted(((r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, sf).collect()), key=str)
    want = [(1, text("a", 60)), (1, text("b")), (4, text("c")), (None, text("d")), (5, None), (None, None), (6, "")]
    assert got == sorted(want, key=str)


def test_unknown_scripts_go_and_short_texts_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90_000, "\u0531\u0562\u0563 \u0564\u0565\u0566\u0567 " * 60, None, "x", 0), (90_001, "qzx", "en", "x", 3), (90_002, "\u00b2 \u2460", None, "x", 3)], docs.schema)
    got = {r.doc_id for r in cp.identify_languages(spark, stored(docs.union(odd), "docs"), sf).collect()}
    assert {r.doc_id for r in docs.where("text rlike '[a-zA-Z]'").collect()} <= got
    assert 90_000 not in got and 90_001 in got and 90_002 not in got
