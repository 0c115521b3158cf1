"""Operators 2 and 3: extraction, archives and salvage."""

import base64
import hashlib
import html
import random
import re

import duckdb
import pytest

from examlytics.llm import html_text, warc

SF = "/root/testdata/sf0.001"


def test_articles_of_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html_text.query(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.sub(r"<br>", " ", re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1])
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>
<ul class="menu"><li><a href=x>one</a><li><a href=y>two</a></ul><div id="wrap"><aside>side</aside><div class="post-content">
<h2>Title &amp; x</h2><div><p>First para, long text here with many words.<p>Second &lt;one&gt;<br/>line   two.</div>
<div><p>The third section is as long as the others.</p></div><form>go <input></form><script>if (a < b) "</p>"</script></div>
<section class="comments"><p>a really long comment about this and all that</p></section></div><footer>end</footer></body>"""


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, "Title & x\n\nFirst para, long text here with many words.\n\nSecond <one> line two.\n\nThe third section is as long as the others."),
        (None, ""),
        ("", ""),
        ("plain < text & more", "plain < text & more"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<!-- x --><body><p>a<b>c</p>d", "ac\n\nd"),
        ("<script>x", ""),
        ("<div " * 50, ""),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LONG = "many plain words in a row " * 38


@pytest.mark.parametrize(
    "page, text",
    [
        # the body is the container: title and short paragraphs below the threshold stay
        (f"<body><h1>{'t' * 20}</h1><p>{LONG}</p><p>{'z' * 30}</p></body>", f"{'t' * 20}\n\n{LONG.strip()}\n\n{'z' * 30}"),
        # a dense subtree elsewhere in the body and bare text beside the container stay, a row of links goes
        (
            f"<body><a href=x>one</a> | <a href=y>two</a><div id=a><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div>bare <i>text</i> here"
            f"<div id=b><div><a href=z>far away and off</a></div><div><p>{LONG}</p></div></div></body>",
            f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}\n\nbare text here\n\n{LONG.strip()}",
        ),
        # a cell of a layout table is a container
        (f"<body><table><tr><td><a href=x>menu</a></td><td><p>{LONG}</p><p>short</p></td></tr></table></body>", f"{LONG.strip()}\n\nshort"),
        # an article element does not hide a denser text outside it
        (f"<body><article><p>teaser</p></article><div><p>{LONG}</p><p>end.</p></div></body>", f"{LONG.strip()}\n\nend."),
    ],
)
def test_threshold_over_the_body(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("mark", [r"<\1div>", r"<\1section>", ""])
def test_articles_without_the_article_element(spark, mark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert html_text.main_text(re.sub(r"<(/?)article>", mark, r.html)) == html_text.main_text(r.html) != ""


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 20_000 + "x") == "x"
    assert len(html_text.main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>")) == 20_000 * 11 - 2


def test_archives_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE})").fetchall()
    assert sorted(map(tuple, warc.query(spark, SF).collect())) == sorted(want)


def test_round_trip_of_awkward_pages(spark, tmp_path):
    rows = [(1, "u", "a\r\n\r\nWARC/1.1\r\n\x00é"), (2, None, None), (3, "x\ny", "same"), (4, "u", "same"), (None, "u", "same"), (5, "u", ""), (5, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, str(tmp_path / "a"), records_per_archive=2)
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows) and not any(r.quarantined for r in got)
    payloads = sorted((r.record_id, r.record_type, r.refers_to, bytes(r.payload).decode()) for r in got)
    page = "urn:page:"
    assert payloads == sorted(
        [
            (f"{page}1", "response", None, rows[0][2]), (f"{page}2", "response", None, ""), (f"{page}3", "response", None, "same"),
            (f"{page}4", "revisit", f"{page}3", ""), (f"{page}none", "revisit", f"{page}3", ""), (f"{page}5", "revisit", f"{page}2", ""),
            (f"{page}5", "revisit", f"{page}2", ""),
        ]
    )
    same = [r for r in got if r.payload_bytes == 4]
    assert len(same) == 3 and len({r.payload_digest for r in same}) == 1
    warc.write_archives(pages.where("page_id = 99"), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).collect() == []


def record(payload: bytes, digest: bool = True) -> bytes:
    head = b"WARC/1.1\r\nWARC-Type: resource\r\n"
    if digest:
        head += b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()) + b"\r\n"
    return head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"


@pytest.mark.parametrize("pack", [bytes, warc.gzip_member])
def test_salvage_recovers_what_follows(pack):
    rng = random.Random(6)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(5, 400))) for _ in range(12)]
    parts = [bytearray(pack(record(p))) for p in payloads]
    parts[3][len(parts[3]) // 2] ^= 0xFF  # a flipped byte
    del parts[6][-9:]  # cut short
    parts[9][:4] = b"????"  # no magic
    data = b"junk in front" + b"".join(parts) + b"tail"
    got = list(warc.salvage(bytes(data)))
    assert [rec["payload"] for _, _, rec, _ in got if rec] == [p for k, p in enumerate(payloads) if k not in (3, 6, 9)]
    at = 0
    for s, e, rec, why in got:  # every byte is in a record or in a gap
        assert s == at and e > s and bool(why) == (rec is None)
        at = e
    assert at == len(data)


def test_salvage_of_mixed_archives():
    data = record(b"a") + warc.gzip_member(record(b"b") + record(b"c")) + record(b"d")
    assert [rec["payload"] for _, _, rec, _ in warc.salvage(data)] == [b"a", b"b", b"c", b"d"]
    assert list(warc.salvage(b"")) == []
