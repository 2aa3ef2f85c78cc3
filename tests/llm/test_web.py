"""WARC archives: an exact round trip; URL filters against trying every rule."""

import base64
import gzip
import hashlib
import random
import re
from pathlib import Path

import pytest

import sparkwell.llm.warc as m

from sparkwell.llm.url_filter import PATTERNS, Rule, host_and_path, token_counts, url_filter
from sparkwell.llm.warc import parse, read_warc, write_and_read, write_warc

PAGES = [
    (5, "http://a.example/1", "<p>x</p>"), (2, "http://b.example/2", "<p>x</p>"), (9, None, "<p>x</p>"), (3, "u", None), (4, "u\r\nX: y", ""), (7, "v", "\r\n\r\nWARC/1.1\r\n\r\n"),
    (8, "w", "é🙂\x00"), (None, "n", "<p>x</p>"), (None, "n", "only null"), (11, "r", "same"), (11, "r", "same"), (12, "long", "z" * 300_000),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("broadcast", [True, False])
def test_round_trip(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:  # many repeated digests: bitmaps and a join of headers
        monkeypatch.setattr(m, "MOST_BROADCAST", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(m, "ROW_BYTES", 300)
    got = write_and_read(spark, pages(spark).repartition(3)).collect()
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        same = [j for j, _, g in PAGES if (g or "") == (h or "") and j is not None]
        first = min(same, default=None)
        revisit = first is not None and i != first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    key = lambda r: tuple(str(x) for x in r)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)


def test_unique_payloads_are_not_shuffled(spark, monkeypatch):
    """Beyond the broadcast, 400 unique payloads stay; the one original of 300 copies and of each pair is fetched."""
    monkeypatch.setattr(m, "MOST_BROADCAST", 0)
    rows = [(i, f"u{i}", f"unique {i}") for i in range(400)] + [(1000 + i, "c", "hot") for i in range(300)] + [(2000 + i, "d", f"pair {i // 2}") for i in range(40)]
    got = m.resolved(pages(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.original is None for r in got) == 400 + 1 + 20
    assert all((r.html is None) == (r.original is not None) for r in got)
    assert {r.original for r in got if r.html is None} == {1000, *range(2000, 2040, 2)}


def test_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "ROW_BYTES", 2000)
    monkeypatch.setattr(m, "FILE_ROWS", 3)
    path = str(tmp_path / "w")
    write_warc(pages(spark, [(i, "u", f"{i:04}" * 200) for i in range(60)]).coalesce(1), path, date="2030-01-02T03:04:05Z")
    files = list(Path(path).glob("part-*.gz"))
    assert len(files) > 5 and max(len(gzip.decompress(f.read_bytes())) for f in files) < 3 * (2000 + 1500)
    assert {h["warc-date"] for f in files for h, _ in parse(gzip.decompress(f.read_bytes()))} == {"2030-01-02T03:04:05Z"}
    assert read_warc(spark, path).count() == 60


def test_files_are_warc(spark, tmp_path):
    path = str(tmp_path / "w")
    write_warc(pages(spark).coalesce(1), path)
    (file,) = Path(path).glob("part-*.gz")
    records = list(parse(gzip.decompress(file.read_bytes())))
    assert records[0][0]["warc-type"] == "warcinfo" and len(records) == len(PAGES) + 1
    html = {r.page_id: r.html for r in read_warc(spark, path).collect() if r.record_type == "response" and r.page_id is not None}
    assert html[7] == PAGES[5][2] and html[8] == PAGES[6][2] and html[2] == "<p>x</p>" and 5 not in html
    revisit = next(h for h, b in records if h["warc-type"] == "revisit" and h["x-page-id"] == "5")
    original = next(h for h, b in records if h["warc-type"] == "response" and h["x-page-id"] == "2")
    assert revisit["warc-refers-to"] == original["warc-record-id"] and revisit["warc-profile"].endswith("identical-payload-digest")
    assert len({h["warc-record-id"] for h, _ in records}) == len(records) - 1  # the repeated row


def test_small_payloads_are_responses(spark):
    got = write_and_read(spark, pages(spark), min_payload=5).collect()
    assert {r.record_type for r in got if r.payload_bytes < 5} == {"response"}
    assert any(r.record_type == "revisit" for r in got)


def test_empty_and_damaged(spark, tmp_path):
    assert write_and_read(spark, pages(spark).limit(0)).count() == 0
    path = tmp_path / "w"
    write_warc(pages(spark, PAGES[:1]).coalesce(1), str(path), compression="none")
    (file,) = path.glob("part-*.txt")
    file.write_bytes(file.read_bytes().replace(b"<p>x", b"<p>y"))
    (path / f".{file.name}.crc").unlink()
    with pytest.raises(Exception, match="digest"):
        read_warc(spark, str(path)).collect()


URLS = [None, "", "no scheme", "http://", "HTTP://EN.Example.COM/en/7x?y=/en/#z", "http://example.com/en/8", "http://badexample.com/en/7", "http://a.net/de/8", "http://x.example.net/de/80", "http://example.org/es/", "http://org/es", "http://example.com?/en/7", "http://example.com#/en/7",
        "http://www.cheap-pills.example.com/x", "http://ads.x.com/", "http://badads.x.com/", "http://a/casino-1", "http://a/track/b/c.gif", "http://a/track/b.gifx", "http://click.a/redirect?x", "https://u:p@example.com:80/en/7", "http://a.com/en/\n7", "://example.com/en/7", "http://a\nb.example.com/en/7", "http://x\nexample.com/en/7", "http://a/b.example.com\n/en/7", "http://long.example.net/de/8" + "z" * 300_000]
RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("block", "net", "/de/"), Rule("allow", "example.net", "/de/8"), Rule("block", "org", "/es/")]


def brute(url, rules, patterns):
    host, path = host_and_path(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    low = (url or "").lower()
    pattern = next((p for p in patterns if re.search(p.expression(), low, re.DOTALL)), None)
    won = rule or pattern
    return host, path, rule and rule.name, pattern and pattern.name, won.verdict if won else "allow"


def test_verdicts(spark):
    rng = random.Random(4)
    urls = URLS + ["http://" + ".".join(rng.choices(["a", "example", "ads", "click", "b"], k=2)) + rng.choice([".com", ".net", ".org"]) + rng.choice(["/en/", "/de/", "/es/", "/track/", "/"]) + rng.choice(["7", "80", "x.gif", "redirect", ""]) for _ in range(200)]
    rows = [(i, u, "h") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    extra = (*PATTERNS, Rule("block", pattern="*e*"), Rule("block", pattern="|http://b.a"))
    got = {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in url_filter(spark, df, RULES, extra).collect()}
    assert got == {i: brute(u, RULES, extra) for i, u, _ in rows}
    assert got[4] == ("en.example.com", "/en/7x", "example.com/en/7", "*e*", "allow")
    assert url_filter(spark, df.limit(0), RULES).count() == 0


def test_few_expressions_run(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    rules = [Rule("block", f"site{i}.example", "/x/") for i in range(500)] + RULES
    tried = [r.tried for r in url_filter(spark, df, rules).select("tried").collect()]
    assert max(tried) < 20
    counts = token_counts(df, "url", {"com", "en"})
    assert counts["com"] == df.where("url rlike '(?i)(^|[^a-z0-9])com([^a-z0-9]|$)'").count()
