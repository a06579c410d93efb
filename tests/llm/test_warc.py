import base64
import gzip
import hashlib
import os
from html.parser import HTMLParser

from salesgrid.llm import queries, warc

SF = "/root/testdata/sf0.001"


class _Text(HTMLParser):
    """Words that a parser finds outside of hidden elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _parse(data):
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        block = data[end + 4:end + 4 + size]
        assert version == "WARC/1.1" and data[end + 4 + size:end + 8 + size] == b"\r\n\r\n"
        out.append((fields, block))
        at = end + 8 + size
    return out


def test_records_of_the_whole_table_against_a_parser(spark):
    pages = {r.url: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op1_warc(spark, SF).collect()
    assert len(rows) == 2 * spark.read.parquet(f"{SF}/pages.parquet").count()
    for r in rows:
        digest = "sha1:" + base64.b32encode(hashlib.sha1(r.block.encode()).digest()).decode()
        assert r.block_digest == digest and r.content_length == len(r.block.encode())
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.header
        if r.warc_type == "conversion":
            parser = _Text()
            parser.feed(pages[r.target_uri].html)
            assert "".join(r.block.split()) == "".join("".join(parser.out).split())


def test_links_between_the_records(spark):
    rows = queries.op1_warc(spark, SF).collect()
    conversions = {r.refers_to: r for r in rows if r.warc_type == "conversion"}
    for m in rows:
        if m.warc_type == "metadata":
            c = conversions[m.refers_to]
            assert f"conversion-record: {c.record_id}\r\n" in m.block
            assert f"source-payload-digest: {m.source_payload_digest}\r\n" in m.block
            assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in m.block
            assert f"WARC-Source-Payload-Digest: {c.source_payload_digest}" in c.header


def test_files_round_trip(spark, tmp_path):
    records = queries.op1_warc(spark, SF).cache()
    warc.write_warc(records, f"file://{tmp_path}/w")
    found = [x for f in sorted(os.listdir(tmp_path / "w")) if f.endswith(".gz")
             for x in _parse(gzip.decompress((tmp_path / "w" / f).read_bytes()))]
    want = {r.record_id: r.block.encode() for r in records.collect()}
    assert {f["WARC-Record-ID"]: b for f, b in found} == want and len(found) == len(want)
    records.unpersist()


def test_nulls_broken_markup_repeats_and_extra_columns(spark):
    pages = spark.createDataFrame(
        [(1, None, "<p>a<b>c</p>", "x"), (None, "http://e/\r\nX: y", None, "x"), (2, "http://e/", "", "x"),
         (3, "u", "<a href='/x'>1 &lt; 2</a><script>var s='<p>'", "x"), (3, "u", "<a href='/x'>1 &lt; 2</a><script>"
                                                                       "var s='<p>'", "x"),
         (4, "v", "word " * 50_000 + "<", "x")],
        "page_id long, url string, html string, record_id string")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len(rows) == 12
    text = {(r.target_uri, r.block) for r in rows if r.warc_type == "conversion"}
    assert (None, "ac") in text and ("u", "1 < 2") in text and ("http://e/", "") in text
    assert all(line.count(": ") >= 1 for r in rows for line in r.header.split("\r\n")[1:])
    assert any(len(b) > 249_000 for _, b in text)
    assert warc.derive(warc.responses(pages.limit(0))).collect() == []


def test_hostile_markup_takes_linear_time():
    import time
    for unit in ("<a ", "<a href=", "<p ", "<head>", "<title>", "<html ", "<script ", "<script>", "< ", "<!--", "<", "</script ", "<svg><", "<a href=\"",
                 "<meta charset", "<html lang ", "&amp", "</head ", "\n", "<a href='\" "):
        page = unit * (250_000 // len(unit))
        began = time.time()
        warc.visible_text(page), warc.page_fields(page), warc.visible_text(page + ">"), warc.page_fields(page + ">")
        assert time.time() - began < 5, unit


def test_markup_inside_quotes_and_broken_tags():
    page = '<html lang=de><head><title>T &amp; U</title></head><body><a href="x>y">one</a><p>two<br/>three <a href=z>four<b <p>five'
    assert warc.visible_text(page) == 'y">one\ntwo\nthree fourfive'
    assert warc.page_fields(page) == [("title", "T & U"), ("language", "de"), ("outlink", "x>y"), ("outlink", "z")]
    assert warc.visible_text("a <script>x</script> b <style>c") == "a b" and warc.visible_text("<head><title>t</title> x") == "t\nx"
