import base64
import hashlib
import random
import tempfile

from pyspark.sql import functions as F

from reportlake.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows):
    first = {}
    for page, _, html in sorted(r for r in rows if r[0] is not None):
        first.setdefault(html or "", page)
    out = []
    for page, _, html in rows:
        to = first.get(html or "")
        to = None if to == page else to
        out.append((page, len((html or "").encode()), digest(html), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_round_trip(spark):
    rng = random.Random(3)
    html = [f"<p>é{i}\r\n\r\nWARC/1.1</p>" * rng.randint(1, 50) for i in range(40)] + ["", None, "x" * 3_000_000]
    rows = [(i, rng.choice([None, "", "no url", "HTTP://User@www.Example.com:80/a b?q=1#f", f"https://h{i % 5}.ex.org/{i}", "http://a.b/\r\nx"]), rng.choice(html)) for i in range(300)]
    rows += [(300, "http://a.b/c", "x" * 3_000_000), (None, "http://a.b/", "only"), (301, None, None)]
    rng.shuffle(rows)
    df = pages(spark, rows).selectExpr("*", "1 as key", "2 as sha1", "3 as page").repartition(5)
    got = sorted(map(tuple, warc.round_trip(df, archive_bytes=20_000).collect()), key=repr)
    assert got == brute(rows)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_repeated_rows_are_responses(spark):
    got = sorted(tuple(r)[3:] for r in warc.round_trip(pages(spark, [(1, "u", "a"), (1, "u", "a"), (2, "u", "a")])).collect())
    assert sorted(got, key=repr) == sorted([("response", None)] * 2 + [("revisit", 1)], key=repr)


def test_index_finds_every_page_also_in_pieces(spark):
    rows = [(i, f"http://w{i % 7}.site.org/{i // 50}", f"page {i}") for i in range(700)] + [(None, "http://w1.site.org/0", "none")]
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    captures = warc.write_archives(pages(spark, rows), folder)
    directory = warc.build_index(captures, folder, block_lines=11)
    assert directory.count() > 50
    wanted = captures.select("key", F.coalesce("page", F.lit(warc.NO_PAGE)).alias("page")).unionAll(spark.createDataFrame([("a)", 1), ("org,site,w1)/0", 10**9)], "key string, page bigint"))
    for limit in (1 << 20, 2000):
        got = {r.page: bytes(r.payload).decode() for r in warc.look_up(wanted, directory, folder, limit).collect()}
        assert got == {warc.NO_PAGE if i is None else i: h for i, _, h in rows}


def test_key():
    assert warc.base32_sha1(b"") == digest("")


def test_url_key(spark):
    df = pages(spark, [(1, "https://Blog.Example.com:8080/A/b?c=1#top", ""), (2, None, "")]).select(warc.url_key(F.col("url")).alias("k"))
    assert sorted(r.k for r in df.collect()) == [")", "com,example,blog)/A/b?c=1"]
