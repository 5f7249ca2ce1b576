import base64
import gzip
import hashlib
import html
import json
import re
import time
from html.parser import HTMLParser

import pytest

from shelflight.llm import warc
from shelflight.llm.queries import QUERIES

PAGE = (
    "<!DOCTYPE html><html><head><title>A &amp; B</title><meta name='description' content='About it'>"
    "<script>var x='<p>no</p>';</script><style>p{}</style></head><body><nav><a href=\"/one?a=1&amp;b=2\">One</a></nav>"
    "<!-- hidden --><p>First <b>line</b><br>second<p>Third &eacute;</p><img src=pic.png></body></html>"
)


def _sha1(content):
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def test_page_text_and_metadata():
    assert warc.page_text(PAGE) == "A & B\nOne\nFirst line\nsecond\nThird é"
    found = warc.page_metadata(PAGE)
    assert (found["title"], found["description"]) == ("A & B", "About it")
    assert found["links"] == [{"path": "a@/href", "url": "/one?a=1&b=2"}, {"path": "img@/src", "url": "pic.png"}]
    assert warc.page_text("") == "" and warc.page_metadata("<a href='x'")["links"] in ([], [{"path": "a@/href", "url": "x"}])


def test_records_are_linked_and_round_trip(spark, tmp_path):
    rows = [(1, "http://a.example/x", PAGE, 9), (2, None, None, 9), (None, "http://b.example/", "<p>plain", 9), (1, "http://a.example/x", PAGE, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind int")
    responses = warc.responses(pages)
    derived = warc.derivatives(responses)
    sources = {r.record_id: r for r in responses.collect()}
    made = derived.collect()
    assert len(made) == 2 * len(rows)
    for r in made:
        source = sources[r.refers_to]
        assert r.headers["WARC-Refers-To"] == source.record_id and r.url == source.url
        assert r.headers["WARC-Block-Digest"] == _sha1(r.block)
        _, _, payload = warc.parse_http(source.block)
        assert r.headers["WARC-Payload-Digest" if r.kind == "metadata" else "WARC-Payload-Digest"] == _sha1(payload)
        if r.kind == "metadata":
            envelope = json.loads(r.block)
            assert envelope["WARC-Header"]["WARC-Record-ID"] == source.record_id and envelope["Payload-Digest-Holds"]
            assert ["Content-Type", "text/html; charset=utf-8"] in envelope["HTTP-Response"]["Headers"]
    path = f"file://{tmp_path}/warc"
    assert sum(r.records for r in warc.write_records(derived, path).collect()) == len(made)
    key = lambda r: (r.page_id or 0, r.kind, r.record_id, bytes(r.block), sorted(r.headers.items()))
    assert sorted(map(key, warc.read_records(spark, path).collect())) == sorted(map(key, made))
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


class _Shown(HTMLParser):
    """Visible text by the standard library's parser: a plain second reading of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        self.out.append(" " if tag in HIDDEN else "\n" if tag in warc._BREAKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN
        self.out.append("\n" if tag in warc._BREAKS else "")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)

    def handle_comment(self, data):
        self.out.append(" ")


HIDDEN = {"script", "style", "noscript", "template"}


def _brute_text(page):
    reader = _Shown()
    reader.feed(page)
    reader.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(reader.out).split("\n")) if x)


def test_query_agrees_with_a_second_reader(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op9_warc_derivatives"](spark, sf_dir).collect()
    assert sorted((r.page_id, r.kind) for r in rows) == sorted((p, k) for p in pages for k in ("conversion", "metadata"))
    titles = {p: re.search(r"<title>(.*?)</title>", r.html)[1] for p, r in pages.items() if "<title>" in (r.html or "")}
    for r in rows:
        page = pages[r.page_id].html or ""
        assert r.url == pages[r.page_id].url and r.payload_digest == _sha1(page.encode())
        if r.kind == "conversion":
            assert r.text == _brute_text(page) and r.block_digest == _sha1(r.text.encode()) and r.n_bytes == len(r.text.encode())
        elif r.page_id in titles:
            assert r.title == " ".join(html.unescape(titles[r.page_id]).split())
    refers = {r.page_id: r.refers_to for r in rows}
    assert len(set(refers.values())) == len(pages) and all(refers[r.page_id] == r.refers_to for r in rows)


def test_headers_hold_any_url_and_files_roll_over(spark, tmp_path):
    urls = ["http://a.example/\r\nWARC-Type: response", "http://b.example/: x", " http://c ", "", None, "http://d/\x00é"]
    pages = spark.createDataFrame([(i, u, "<p>x" * 50) for i, u in enumerate(urls)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    manifest = warc.write_derivatives(pages.coalesce(1), path, file_bytes=300).collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == 12
    got = {(r.page_id, r.kind): r for r in warc.read_records(spark, path).collect()}
    made = {(r.page_id, r.kind): r for r in warc.derivatives(warc.responses(pages)).collect()}
    assert got.keys() == made.keys()
    for k, r in got.items():
        assert (r.url, bytes(r.block), sorted(r.headers.items())) == (made[k].url, bytes(made[k].block), sorted(made[k].headers.items()))
    assert got[0, "metadata"].url == "http://a.example/%0D%0AWARC-Type: response" and got[4, "metadata"].url is None
    none = f"file://{tmp_path}/none"
    assert warc.write_derivatives(pages.limit(0), none).count() == 0 and warc.read_records(spark, none).count() == 0


def test_damage_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")
    name = warc.write_derivatives(pages, str(tmp_path / "w")).first().file
    file = tmp_path / "w" / name
    content = gzip.decompress(file.read_bytes())
    file.write_bytes(gzip.compress(content.replace(b'"title"', b'"tItle"')))
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(spark, str(tmp_path / "w")).collect()


@pytest.mark.parametrize("part", ["<a ", "<script ", "<meta name ", "<!--", "<a href='", "</script ", "<title>", "&amp", "<p>x", "<a x=' \" >"])
def test_long_broken_pages_take_linear_time(part):
    page = part * (4_000_000 // len(part))
    for page in (page, page + ">"):
        began = time.perf_counter()
        warc.read_page(page)
        assert time.perf_counter() - began < 20
