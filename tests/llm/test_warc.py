import glob
import gzip
import hashlib
import re
import time

import pytest

from cartwright.llm import warc

PAGES = [
    (1, "http://a/x", "<html lang=en><head><title>One &amp; two</title><meta charset=UTF-8></head><body><p>Hello"
     " <b>you</b><p>é日 <a href='/y'>y</a> <a class=z href=\"http://b/?q=1&amp;r\">b</a></body></html>"),
    (2, None, "plain words"),
    (3, "http://a/\r\nX-Evil: 1", "<script>var x = '<p>no</p>'</script>text<!-- gone -->"),
    (4, "http://a/empty", ""),
    (5, "http://a/null", None),
    (6, "http://a/twice", "<p>same</p>"),
    (6, "http://a/twice", "<p>same</p>"),
    (6, "http://a/twice", "<p>same</p>"),
    (None, None, None),
    (None, None, None),
    (7, "http://a/long", "<p>" + "long line of words\n" * 20_000),
]
KINDS = "page_id bigint, url string, html string, type string, record string, copy int"


@pytest.fixture(scope="module")
def derived(spark):
    pages = spark.createDataFrame([(*p, "x", "y", 9) for p in PAGES], KINDS)
    answers = warc.responses(pages, date="2024-05-06T07:08:09Z").cache()
    records = warc.derived_records(answers, date="date", record_id="record_id", headers="headers")
    return answers, records.cache()


def parsed(data):
    """Records of a WARC file, read by their lengths alone, as (headers, block)."""
    out = []
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        first, *lines = head.decode().split("\r\n")
        assert first == "WARC/1.1"
        named = [line.split(": ", 1) for line in lines]
        headers = dict(named)
        assert len(headers) == len(named)
        n = int(headers["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        out.append((headers, rest[:n]))
        data = rest[n + 4 :]
    return out


def sha(data):
    return "sha256:" + hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_saved_files_hold_linked_records(derived, tmp_path, compression):
    answers, records = derived
    path = str(tmp_path / "out")
    warc.save(records, path, compression)
    found = []
    for name in glob.glob(path + "/part-*"):
        data = (gzip.open if name.endswith(".gz") else open)(name, "rb").read()
        found += parsed(data)
    assert len(found) == 2 * len(PAGES)
    given = {r["record_id"]: r for r in answers.collect()}
    assert len(given) == len(PAGES)  # every response has a number of its own
    assert len({h["WARC-Record-ID"] for h, _ in found} | set(given)) == 3 * len(PAGES)
    for answer in given.values():
        own = [(h, b) for h, b in found if h["WARC-Refers-To"] == answer["record_id"]]
        assert sorted(h["WARC-Type"] for h, _ in own) == ["conversion", "metadata"]
        html = answer["html"] or ""
        for h, block in own:
            assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>", h["WARC-Record-ID"])
            assert h["WARC-Date"] == "2024-05-06T07:08:09Z"
            assert h["WARC-Payload-Digest"] == sha(html.encode())
            assert h["WARC-Block-Digest"] == sha(block)
            assert h.get("WARC-Target-URI") == (
                answer["url"].replace("\r", "%0D").replace("\n", "%0A") if answer["url"] else None
            )
            if h["WARC-Type"] == "conversion":
                assert h["Content-Type"] == "text/plain; charset=UTF-8"
                assert block.decode() == warc.plain_text(html)
            else:
                lines = block.decode().split("\r\n")
                assert lines.pop() == ""
                kept = [x.removeprefix("source-header: ") for x in lines if x.startswith("source-header")]
                assert kept == answer["headers"]
                title, language, charset, links = warc.page_facts(html)
                assert [x.removeprefix("outlink: ") for x in lines if x.startswith("outlink")] == links
                assert ("title: " + str(title) in lines) == (title is not None)
                assert ("language: " + str(language) in lines) == (language is not None)
                assert ("charset: " + str(charset) in lines) == (charset is not None)


def test_what_a_page_says():
    title, language, charset, links = warc.page_facts(PAGES[0][2])
    assert (title, language, charset) == ("One & two", "en", "utf-8")
    assert links == ["/y", "http://b/?q=1&r"]
    assert warc.plain_text(PAGES[0][2]) == "Hello you\né日 y b"
    assert warc.plain_text(PAGES[2][2]) == "text"


def test_headers_tell_the_type(derived):
    answers = {r["page_id"]: r["headers"] for r in derived[0].collect()}
    assert answers[1][1] == "Content-Type: text/html; charset=UTF-8"
    assert answers[2][1:] == ["Content-Type: text/html", "Content-Length: 11"]


def test_reruns_agree_and_records_stay_without_responses(derived, spark):
    answers, records = derived
    again = warc.derived_records(
        warc.responses(answers.select("page_id", "url", "html").repartition(5), date="2024-05-06T07:08:09Z"),
        date="date", record_id="record_id", headers="headers",
    )
    assert sorted(r["record"] for r in again.collect()) == sorted(r["record"] for r in records.collect())
    plain = warc.derived_records(answers.select("page_id", "url", "html"))
    assert plain.where("date <> '1970-01-01T00:00:00Z'").count() == 0
    none = answers.limit(0).select("page_id", "url", "html")
    assert warc.derived_records(warc.responses(none)).collect() == []


@pytest.mark.parametrize(
    "unit", ["<a ", "<a href=", '<a href="', "<script ", "<title ", "<html ", "<meta ", "<!--", "<a '", "</", "<p "]
)
def test_broken_pages_are_read_through_once(unit):
    page = unit * (1_000_000 // len(unit))
    start = time.perf_counter()
    warc.plain_text(page)
    warc.page_facts(page)
    assert time.perf_counter() - start < 5  # a second where nothing else runs


def test_unfinished_parts():
    assert warc.plain_text("a<!-- b <p>c") == "a"
    assert warc.plain_text("a<script>b <p>c") == "a"
    assert warc.plain_text("a<script b") == "a<script b"
    assert warc.plain_text("x > y <b") == "x > y <b"
    assert warc.page_facts("<a title='>' href=x><a\nhref = \"y z\">")[3] == ["y z"]
