import base64
import gzip
import hashlib
import html
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from contentprint.llm.html_text import extract_text, main_text
from contentprint.llm.warc import derivatives, derive, field, parse, read_warc, responses, serialize

PAGES = "page_id long, url string, html string"
P = "This is the first long paragraph of the article and it has many of the words that are in any text. " * 3
PAGE = f"""<!DOCTYPE html><html lang="en"><head><title>T &amp; U</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">The menu</a></li></ul></nav><div class="cookie-notice">We use cookies and you are the one</div>
<!-- a <p>comment</p> --><div id="sidebar"><p>{P}</p></div><article><h1>Head&shy;line</h1><p>{P}<br>more&nbsp;text<p><b>Short.<br></article>
<div class="comments"><p>{P}</p></div><form><p>{P}</p></form><footer>&copy; x</footer></body></html>"""


def want():
    return " ".join(html.unescape(f"Head&shy;line {P} more&nbsp;text Short.").split())


def test_main_text():
    assert main_text(PAGE) == want()
    assert main_text(PAGE.replace("</body></html>", "")) == want()
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<!-- open") == ""
    assert main_text(f"<p>{P}") == P.strip() and main_text("a < b") == "a < b"


def test_long_and_broken_pages():
    assert main_text("<div>" * 20_000 + P) == P.strip()
    assert main_text(f"<article>{'<p>' + P}" * 500) == " ".join([P.strip()] * 500)
    assert main_text("<" * 5000) == ""


RU = "Это первый длинный абзац статьи о реках и горах и городах между ними, и в нём много слов, которые есть в любом тексте на этом языке. " * 3
ZH = "这是一篇关于河流和山脉以及它们之间城镇的文章的第一个长段落里面有许多任何文本中都会出现的词语。" * 5


def test_furniture_that_holds_the_article():
    for page in (f'<div class="page has-sidebar"><article><p>{P}</p></article></div>', f'<div class="sidebar-layout"><article><p>{P}</p></article></div>', f'<form id="aspnetForm"><article><p>{P}</p></article></form>',
                 f'<form id="aspnetForm"><div><p>{P}</p></div></form>', f'<div class="tags"><div id="comments-page"><main><p>{P}</p></main><div class="comments"><p>{P}</p></div></div></div>'):
        assert main_text(page) == P.strip(), page
    card = f'<article><p>{P}</p></article><div class="related"><article><p>Other {P}</p></article></div>'
    assert main_text(card) == main_text(f'<div class="has-sidebar">{card}</div>') == P.strip()
    assert main_text(f'<nav><article><p>{P}</p></article></nav>') == ""
    own = f'<article><header class="entry-header"><h1>The title of this one</h1></header><p>{P}</p><p>It is <math>a + b</math> and so on</p></article>'
    assert main_text(own) == f"The title of this one {P.strip()} It is a + b and so on"


def test_languages_without_stop_words():
    menu = '<div class="menu"><a href="/">x</a></div><div><a href="/a">ссылка на другую страницу этого сайта, очень длинная ссылка на другую страницу</a></div>'
    for text in (RU, ZH):
        assert main_text(f"<body>{menu}<div><p>{text}</p></div></body>") == text.strip() == main_text(f"<article><p>{text}</p></article>")


@pytest.mark.parametrize("page", ["<a " * 300_000, '<a "' * 250_000, '<a x="' * 170_000, "<a x='>" * 150_000 + ">", "<div>" * 100_000 + "</b>" * 120_000, "<head>" * 170_000, "<script>" * 120_000, "</script" * 120_000, "<!--" * 250_000, "<" * 1_000_000, "<p class='" * 100_000 + ">", "<title" * 170_000, "&" * 1_000_000])
def test_broken_pages_of_a_megabyte(page):
    began = time.process_time()
    main_text(page)
    derivatives({}, b"HTTP/1.1 200 OK\r\n\r\n" + page.encode())
    assert time.process_time() - began < 8


def test_extraction_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "")]
    df = spark.createDataFrame(rows, PAGES).withColumn("TEXT", F.lit(1)).withColumn("n_chars", F.lit(9))
    got = sorted([tuple(r) for r in extract_text(df).collect()], key=str)
    assert got == sorted([(1, "u", want(), len(want()))] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert extract_text(spark.createDataFrame([], PAGES)).count() == 0


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives_refer_to_their_response(spark):
    rows = [(1, "http://a/", PAGE), (2, "http://b/", None), (None, None, ""), (1, "http://a/", PAGE)]
    made = responses(spark.createDataFrame(rows, PAGES).withColumn("block", F.lit("x")))
    source = {r.page_id: (json.loads(r.headers), bytes(r.block)) for r in made.collect()}
    out = derive(made.withColumn("Text", F.lit(0))).collect()
    assert len(out) == 2 * len(rows)
    for r in out:
        headers, block = source[r.page_id]
        body = block.partition(b"\r\n\r\n")[2]
        assert r.refers_to == field(headers, "WARC-Record-ID") and r.source_digest == sha1(body) == field(headers, "WARC-Payload-Digest")
        own = json.loads(r.headers)
        assert own["WARC-Block-Digest"] == sha1(bytes(r.block)) and own["Content-Length"] == str(len(r.block)) and own["WARC-Date"] == headers["WARC-Date"]
        if r.warc_type == "metadata":
            assert f"source-block-digest: {sha1(block)}".encode() in bytes(r.block)
    one = {r.warc_type: bytes(r.block).decode() for r in out if r.page_id == 1}
    assert "title: T & U" in one["metadata"] and "outlink: /x" in one["metadata"] and "html-lang: en" in one["metadata"] and "http-status: HTTP/1.1 200 OK" in one["metadata"]
    assert "The menu" in one["conversion"] and "Short." in one["conversion"] and not re.search(r"<\w|var a|comment</p>", one["conversion"])
    assert len({r.record_id for r in out if r.page_id == 1}) == 2
    assert derive(responses(spark.createDataFrame([], PAGES))).count() == 0


def test_round_trip_of_files(spark, tmp_path):
    made = responses(spark.createDataFrame([(i, f"http://a/{i}", PAGE) for i in range(5)], PAGES)).collect()
    records = [(json.loads(r.headers), bytes(r.block)) for r in made] + [({"WARC-Type": "request", "Content-Length": "2"}, b"hi")]
    plain = b"".join(serialize(h, b) for h, b in records)
    assert list(parse(plain)) == records and list(parse(b"junk")) == [] and list(parse(b"WARC/1.1\r\nA: b")) == []
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(serialize(h, b)) for h, b in records))
    (tmp_path / "b.warc").write_bytes(plain)
    found = read_warc(spark.read.format("binaryFile").load(str(tmp_path)))
    assert found.count() == 12
    assert derive(found.withColumn("page_id", F.col("position"))).filter("warc_type = 'conversion'").count() == 10
    no_id = spark.createDataFrame([(1, None, bytearray(b"plain <b>x</b>"))], "page_id long, headers string, block binary")
    assert {r.warc_type for r in derive(no_id).collect()} == {"metadata", "conversion"}


def record(body, *heads, block=None, **fields):
    block = b"HTTP/1.1 200 OK\r\n" + "".join(f"{h}\r\n" for h in heads).encode() + b"\r\n" + body if block is None else block
    return serialize({"WARC-Type": "response", "WARC-Target-URI": "http://a/", "Content-Length": str(len(block)), **fields}, block)


def texts_of(data):
    return [raw.decode() for headers, block in parse(data) for h, raw in derivatives(headers, block) if h["WARC-Type"] == "conversion"]


def test_codings_and_charsets():
    import zlib

    import zstandard

    page = "<p>é one</p><p>two</p>".encode()
    chunked = b"5;x=1\r\n" + page[:5] + b"\r\n%x\r\n" % len(page[5:]) + page[5:] + b"\r\n0\r\n\r\n"
    html_ = "Content-Type: text/html"
    for data in (record(page, html_), record(chunked, html_, "Transfer-Encoding: chunked"), record(gzip.compress(page), html_, "Content-Encoding: gzip"), record(page, "Content-Encoding: gzip"),
                 record(zlib.compress(page), html_, "Content-Encoding: deflate"), record(zlib.compress(page)[2:-4], "Content-Encoding: deflate"), record(zstandard.compress(page), "Content-Encoding: zstd"),
                 record(page, "Content-Type: text/html; charset=idna"), record(page, "Content-Type: text/html; charset=nosuch"), record(page, "Content-Type: text/html; charset=hex"), record(page, "Content-Type: text/html; charset=punycode"),
                 record("<p>é one</p><p>two</p>".encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1")):
        assert texts_of(data) == ["é one\ntwo"], data
    assert texts_of(record(b"\x01\x02", "Content-Encoding: br")) == texts_of(record(b"\x89PNG", "Content-Type: image/png")) == texts_of(record(b"broken", "Content-Encoding: zstd")) == [""]
    assert texts_of(record(b"a <b> c", "Content-Type: text/plain")) == ["a <b> c"]


def test_broken_archives(spark):
    good = record(b"<p>fine</p>")
    (headers, block), = parse(good[:-14])
    assert headers["WARC-Truncated"] == "unspecified" and len(block) < int(headers["Content-Length"])
    assert "source-truncated: unspecified" in derivatives(headers, block)[0][1].decode()
    assert texts_of(record(b"<p>odd</p>", **{"Content-Length": "many"}) + good) == ["odd", "fine"] == texts_of(record(b"<p>odd</p>", **{"Content-Length": "-4"}) + good)
    packed = gzip.compress(good)
    assert texts_of(packed + packed[:20] + b"\x00" * 30) == ["fine"] and texts_of(packed + b"junk") == ["fine"]
    assert list(parse(gzip.compress(good * 3)[:40])) == []
    files = spark.createDataFrame([("a", bytearray(packed * 3)), ("b", None), ("c", bytearray(b""))], "path string, content binary")
    assert read_warc(files).count() == 3
    rows = [(1, "{not json", bytearray(b"<p>x</p>")), (2, "[1]", None), (3, '{"WARC-Type": 7}', bytearray(b"")), (4, '{"WARC-Target-URI": null}', bytearray(b"HTTP/1.1"))]
    out = derive(spark.createDataFrame(rows, "page_id long, headers string, block binary")).collect()
    assert sorted({r.page_id for r in out}) == [1, 2, 4]


def test_many_small_members_and_a_long_page():
    began = time.process_time()
    member = gzip.compress(record(b"<p>x</p>"))
    assert sum(1 for _ in parse(member * 20_000)) == 20_000
    long_ = b"<p>" + b"word " * 2_000_000 + b"</p>"
    assert len(texts_of(record(long_))[0]) == 10_000_000 - 1
    assert time.process_time() - began < 20


def test_derivatives_of_the_generated_pages(spark):
    """The query's rows against records made here from the pages by regular expressions."""
    from contentprint.llm.queries import op1_warc_derivatives

    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = op1_warc_derivatives(spark, d).collect()
    assert len(got) == 2 * len(pages)
    for r in got:
        page = pages[r.page_id]
        body = page.html.encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        assert r.source_digest == sha1(body) and r.target_uri == page.url and r.refers_to.startswith("<urn:uuid:") and r.record_id != r.refers_to
        own = json.loads(r.headers)
        assert own["WARC-Refers-To"] == r.refers_to and own["WARC-Source-Payload-Digest"] == sha1(body)
        if r.warc_type == "conversion":
            text = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->", "", page.html)
            parts = re.split(r"</?(?:html|body|nav|ul|li|div|article|h1|p|footer)\b[^>]*>", text)
            lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
            assert r.text == "\n".join(x for x in lines if x)
        else:
            title = " ".join(html.unescape(re.search(r"<title>(.*?)</title>", page.html)[1]).split())
            links = [html.unescape(x) for x in re.findall(r'<a href="([^"]*)"', page.html)]
            want = [f"source-record-id: {r.refers_to}", f"source-block-digest: {sha1(block)}", f"source-payload-digest: {sha1(body)}", "source-content-type: application/http; msgtype=response", "http-status: HTTP/1.1 200 OK",
                    "http-headers: " + json.dumps({"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(body))}), f"title: {title}", f"html-lang: {re.search('lang=.(..)', page.html)[1]}", f"payload-length: {len(body)}", *[f"outlink: {x}" for x in links]]
            assert r.block_sha256 == hashlib.sha256(("\r\n".join(want) + "\r\n").encode()).hexdigest()
