"""Line dedup against brute force."""

from collections import defaultdict

from sparkwell.llm import line_dedup as m
from sparkwell.llm.line_dedup import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(SPACE))


def brute(rows, least=10, documents=2):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(key(x)) < least or len(holders[key(x)]) < documents or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


SHARED = "This line is shared by many documents"
ROWS = [
    (5, f"a\n{SHARED}\nb\n{SHARED}"), (3, f" \t{SHARED.upper()}\r\nown line of document three"), (9, f"{SHARED}\n{SHARED}\n\n\n"), (3, SHARED), (9, f"{SHARED}\n{SHARED}\n\n\n"),
    (1, None), (2, ""), (4, "\n"), (None, SHARED), (None, None), (6, "short\nshort"), (7, "short\nexactly 10\nÉcole des É"), (8, "EXACTLY 10\nécole des É\nÉCOLE DES É"), (10, "\u00a0exactly 10\n\x1cexactly 10"),
    (11, "äöüäöüäöü\n\U0001f600" + "x" * 9), (12, "äöüäöüäöü\n\U0001f600" + "X" * 9), (13, "\n".join(f"line number {i}" for i in range(50))), (14, "\n".join(f"line number {i}" for i in range(0, 80, 2))),
]


def test_small(spark):
    df = spark.createDataFrame([(*r, 1, "c", "r") for r in ROWS], "doc_id long, text string, n_lines int, cut string, row string").repartition(5)
    out = line_dedup(spark, df)
    assert out.columns == ["doc_id", "text", "cut", "row", "n_lines", "n_dropped"] and {(r.cut, r.row) for r in out.collect()} == {("c", "r")}
    assert got(out) == brute(ROWS)
    assert got(line_dedup(spark, df, least_length=3, least_documents=3)) == brute(ROWS, 3, 3)
    assert line_dedup(spark, df.limit(0)).count() == 0
    assert got(line_dedup(spark, df.select("doc_id", "text"))) == brute(ROWS)


def test_line_hashes():
    assert m.line_hashes(b"", 1) == ([], []) and m.line_hashes(b"", 0)[0] == [0]
    at, h = m.line_hashes("ABC \n\tabc\r\nab\n\u00c9bc\nébc".encode(), 3)
    assert at == [0, 1, 3, 4] and h[0] == h[1] and len(set(h)) == 3


def test_hot_lines_are_salted(spark, monkeypatch):
    monkeypatch.setattr(m, "HOT_LINES", 4)
    rows = [(i, f"{SHARED}\nline of {i} alone\nof a few: {i // 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(line_dedup(spark, df)) == brute(rows)
    lines = m.keyed_lines(df, "doc_id", "text", 10)
    plan = m.dropped_positions(lines, m.repeated_lines(lines))._jdf.queryExecution().optimizedPlan().toString()
    assert "salts" in plan


def test_very_long_text_in_linear_time(spark):
    """200,000 lines, every other one dropped: quadratic work would not end."""
    long = "\n".join(f"numbered line {i}" for i in range(200_000))
    other = "\n".join(f"numbered line {i}" for i in range(0, 200_000, 2))
    df = spark.createDataFrame([(1, other), (2, long)], "doc_id long, text string")
    rows = {r.doc_id: r for r in line_dedup(spark, df).collect()}
    assert (rows[1].n_dropped, rows[2].n_lines, rows[2].n_dropped) == (0, 200_000, 100_000)
    assert rows[2].text == "\n".join(f"numbered line {i}" for i in range(1, 200_000, 2))


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(line_dedup(spark, df)) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_one_count_of_lines(spark, sf):
    """The counts by hash are shuffled once though they are used three times."""
    df = line_dedup(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") >= 2 and final.count("MapInArrow") <= 2
