"""Language identification: filters against sets, corrections, edges and held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

import sparkwell.llm.language_id as m
from sparkwell.llm.language_id import cells, identify, learn, windows


def test_windows_cover_word_ends_and_skip_separators():
    (i, j, w, first), = windows(["Ab1é", "", "xyz"])
    text = [bytes([x & 255, x >> 8 & 255, x >> 16 & 255, x >> 24]) for x in w.tolist()]
    assert (i, j) == (0, 3)
    assert text[: first[1]] == [b" ab ", b" \xc3\xa9 "]
    assert text[first[2] :] == [b" xyz", b"xyz "]


def test_filter_returns_every_language_of_a_window(spark):
    rows = [(1, "abcd abcd abcd abcd", "p"), (2, "abcd abcd abcd abcd wxyz wxyz wxyz wxyz", "q"), (3, None, "p"), (4, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(spark, docs, F.lit(True))
    assert model.languages == ["p", "q"] and model.share == [0.5, 0.5]

    def languages(s):
        (_, _, w, _), = windows([s])
        a, b = cells(w)
        return [int(x) for x in model.filters[0][a] & model.filters[0][b]]

    assert set(languages("abcd")) == {3} and set(languages("wxyz")) == {2}
    assert model.predict(["wxyz", None, "12 !", "k", "", "абв"])[0] == ["q", "und", "und", "p", "und", "p"]


def test_false_positives_are_corrected():
    model = m.LanguageModel(["a", "b"], [0.5, 0.5], np.full((1, 1 << m.CELL_BITS), 1, np.uint64))
    assert model.wrong.tolist() == [1.0, 0.0]
    names, scores, *_ = model.predict(["hello there"])
    assert scores == [0.5] and names == ["a"]  # a full filter proves nothing


def test_more_languages_than_one_word(spark):
    rows = [(i, " ".join([chr(97 + i % 26) + chr(97 + i // 26) + "qw"] * 5), f"l{i:03}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(spark, docs, F.lit(True))
    assert model.filters.shape[0] == 2
    assert model.predict([r[1] for r in rows])[0] == [r[2] for r in rows]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = learn(spark, docs, ~held)
    got = identify(spark, docs.withColumn("score", F.lit("old")), model, ["doc_id", "lang", "score"]).where(held).collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = learn(spark, docs, F.lit(True))
    assert model.languages == [] and identify(spark, docs, model, ["doc_id"]).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify(spark, one, model, ["doc_id"]).collect()[0].lang_pred == "und"


def test_letters_are_unicodes_letters():
    model = m.LanguageModel(["a"], [1.0], np.zeros((1, 1 << m.CELL_BITS), np.uint64))
    texts = ["²", "½ ①", "Ⅷ", "_1", "٣", "ª", "ǅ", "ʰ", "中", "x²"]
    assert model.predict(texts)[0] == ["und"] * 5 + ["a"] * 5


def test_a_larger_corpus_gives_the_same_filter(spark):
    rows = [(i, t, "p" if i % 2 else "q") for i, t in enumerate(["some words go here", "andere Worte stehen dort", "words again", "noch mehr Worte"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = docs.crossJoin(spark.range(50)).select(*docs.columns)
    one, more = learn(spark, docs, F.lit(True)), learn(spark, many, F.lit(True))
    assert (one.filters == more.filters).all() and one.share == more.share


def brute(rows, texts):
    """Shares by plain sets, window by window, for the languages in order."""
    def count(text):
        out = {}
        raw = b" " + text.lower().encode() + b" "
        letter = [97 <= c < 123 or c >= 128 for c in raw]
        raw = bytes(c if ok else 32 for c, ok in zip(raw, letter))
        for i in range(len(raw) - 3):
            if letter[i + 1] and letter[i + 2]:
                out[raw[i : i + 4]] = out.get(raw[i : i + 4], 0) + 1
        return out

    names = sorted({g for _, t, g in rows if t is not None and g is not None})
    n = {g: {} for g in names}
    for _, t, g in rows:
        if t is not None and g is not None:
            for w, k in count(t).items():
                n[g][w] = n[g].get(w, 0) + k
    rate = {g: {w: k / sum(n[g].values()) for w, k in n[g].items()} for g in names}
    top = {}
    for g in names:
        for w, r in rate[g].items():
            top[w] = max(top.get(w, 0), r)
    sets = {g: {w for w, r in rate[g].items() if r * m.RATIO >= top[w] and r >= m.LEAST_RATE} for g in names}
    out = []
    for t in texts:
        c = count(t or "")
        total = max(1, sum(c.values()))
        out.append([sum(k for w, k in c.items() if w in sets[g]) / total for g in names])
    return names, np.array(out)


def test_predictions_match_brute_force(spark):
    """Every document of the table, with null ids, repeated rows, a very long text and ties: the share of each language by plain sets."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(None, rows[0][1], rows[0][2]), rows[1], rows[1], (9001, rows[2][1] * 400, rows[2][2]), (9002, None, "de"), (9003, "no language", None), (9004, "zzzz", "aa"), (9005, "zzzz", "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = learn(spark, df, F.lit(True))
    texts = [t for _, t, _ in rows] + ["zzzz zzzz"]
    names, shares = brute(rows, texts)
    got, score, largest, size = model.predict(texts)
    assert model.languages == names and model.wrong.max() < 0.01
    for t, g, s, k, share in zip(texts, got, score, largest, shares):
        if not t or not any(map(str.isalpha, t)):
            assert (g, s) == ("und", 0.0)
        elif share.max() > 0.05:
            assert share[names.index(g)] >= share.max() - 0.02 and abs(k - share.max()) < 0.02 and abs(s - share.max() / share.sum()) < 0.05
    assert got[-1] == "aa"  # a tie
    out = identify(spark, df, model, ["doc_id", "text"]).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in out) == sorted((str(i), g) for (i, _, _), g in zip(rows, got))
