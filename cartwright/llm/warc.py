"""Derivative records of web archives: metadata and plain text linked to their responses.

A response (address, payload, optionally date, identifier and headers of its own) gives two
records of the WARC 1.1 form: ``metadata`` (title, language, character set and links of the page
as ``application/warc-fields``, then the source's header lines) and ``conversion`` (its plain text). Both refer to the
response by identifier and carry its address, date and payload digest; each has the digest of its
own block. Identifiers are name-based (a hash of kind, address, key and payload digest, and of the
number of the copy from the second equal response on), so a rerun or a retried task gives the same
records and no two records share one. :func:`responses` makes responses of plain pages.

A null payload is an empty one; a null address leaves the line out; line breaks in header values
become ``%0D`` and ``%0A``. An empty page gives both records, with an empty text. Pages of any
length are converted whole. An empty table gives no records. Columns beyond those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.session import materialize

RECORD_END = "\r\n\r\n"
UNDATED = "1970-01-01T00:00:00Z"
SENT_ROWS = 200_000  # repeated pages, of which key, address and digest are sent to every task

_DROPPED = re.compile(
    r"<!--.*?(?:(?P<comment>-->)|\Z)"
    r"|<(?P<element>script|style|template|noscript|title)\b[^>]*>.*?(?:(?P<closed></(?P=element)\s*>)|\Z)"
    r"|(?P<mark><!\[CDATA\[|\]\]>)",
    re.I | re.S,
)
_OPEN = re.compile(r"<!--.*|<!\[CDATA\[", re.I | re.S)
# Fixed: elements that begin a new line.
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|"
    r"footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|"
    r"th|thead|tr|ul)\b[^>]*>",
    re.I,
)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>", re.I)
_TITLE_END = re.compile(r"</title", re.I)
_LINK = (re.compile(r"<a\b", re.I), re.compile(r"\bhref\s*=\s*", re.I), re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)"))
_LANGUAGE = (re.compile(r"<html\b", re.I), re.compile(r"\blang\s*=\s*", re.I), re.compile(r"[\"']?([A-Za-z0-9-]+)"))
_CHARSET = (
    re.compile(r"<meta\b", re.I), re.compile(r"\bcharset\s*=\s*", re.I), re.compile(r"[\"']?([A-Za-z0-9_.:-]+)"),
)


def attributes(html: str, kind: tuple[re.Pattern, re.Pattern, re.Pattern]) -> Iterator[str]:
    """The attribute's first value in each tag of a kind (start of the tag, attribute, value).

    The places of tags, attributes and ``>`` only move forward, so a page is read through once,
    also one whose tags never end.
    """
    tag, name, value = kind
    at, close, found = 0, -1, None
    while begin := tag.search(html, at):
        at = begin.end()
        if close < at:
            close = html.find(">", at)
            close = len(html) if close < 0 else close
        while True:
            if found is None or found.start() < at:
                found = name.search(html, at)
            if found is None:
                return
            if found.start() >= close:
                break
            held = value.match(html, found.end())
            at = found.end() if held is None else held.end()
            if held:
                yield next(filter(None, held.groups()), "")
                break


def visible(html: str) -> str:
    """The page without comments, scripts and the like. Beyond the last ``>`` nothing but a comment can
    begin, so the patterns that look for one are kept off that part."""
    last = html.rfind(">") + 1
    parts, at = [], 0
    for m in _DROPPED.finditer(html, 0, last):
        parts += [html[at : m.start()], " "]
        at = m.end()
        if not (m["comment"] or m["closed"] or m["mark"]):  # it never ends
            return "".join(parts)
    return "".join([*parts, html[at:last], _OPEN.sub(" ", html[last:])])


def plain_text(html: str) -> str:
    """Visible text of a page: one line per block element, blanks run together."""
    text = visible(html)
    last = text.rfind(">") + 1  # no tag ends beyond
    text = _TAG.sub("", _BREAK.sub("\n", text[:last])) + text[last:]
    return _LINES.sub("\n", _BLANKS.sub(" ", unescape(text).replace("\r", "\n"))).strip()


def page_facts(html: str) -> tuple[str | None, str | None, str | None, list[str]]:
    """Title, language, character set and link targets of a page."""
    title, begin = None, _TITLE.search(html, 0, html.rfind(">") + 1)
    if begin:
        end = _TITLE_END.search(html, begin.end())
        title = " ".join(unescape(html[begin.end() : end.start() if end else None]).split())
    language, charset = (next(attributes(html, kind), None) for kind in (_LANGUAGE, _CHARSET))
    links = [unescape(link).strip() for link in attributes(html, _LINK)]
    return title, language, charset.lower() if charset else None, [x for x in links if x]


def _page(payload: Column) -> Column:
    kinds = "title string, language string, charset string, links array<string>, text string"

    @F.arrow_udf(kinds)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            pages = [t.as_py() or "" for t in batch]
            facts = [page_facts(p) for p in pages]
            columns = [pa.array([f[k] for f in facts], pa.string()) for k in range(3)]
            columns.append(pa.array([f[3] for f in facts], pa.list_(pa.string())))
            columns.append(pa.array([plain_text(p) for p in pages], pa.string()))
            yield pa.StructArray.from_arrays(
                columns, ["title", "language", "charset", "links", "text"]
            )

    return read(payload)


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def identifier(*parts: Column) -> Column:
    """``<urn:uuid:...>`` of version 8 (custom), from a hash of the parts; nulls are told apart."""
    named = F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts])
    h = F.sha2(named, 256)
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"),
        F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"),
    )


def responses(
    pages: DataFrame, key: str = "page_id", target_uri: str = "url", payload: str = "html", date: str = UNDATED
) -> DataFrame:
    """Pages as responses of a crawl: ``record_id, date, headers`` besides their own three columns.

    ``headers`` are the lines of the answer: status, type with the page's own character set where the
    page states one, and length. A page that is there several times is as many responses with
    numbers of their own; they are numbered by counting, not by lining them up.
    """
    whole = F.coalesce(F.col(payload), F.lit(""))
    read = pages.select(
        F.col(key).alias(key), F.col(target_uri).alias(target_uri), F.col(payload).alias(payload),
        _digest(whole).alias("payload_digest"),
    )
    same = [F.col(key), F.col(target_uri), F.col("payload_digest"), F.col(payload).isNull().alias("missing")]
    several = read.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    several = materialize(several, "copies").toDF("k", "u", "d", "m", "copies")
    meets = (
        F.col(key).eqNullSafe(F.col("k")) & F.col(target_uri).eqNullSafe(F.col("u"))
        & (F.col("payload_digest") == F.col("d")) & (F.col(payload).isNull() == F.col("m"))
    )
    once = F.lit(0).alias("copy")
    if several.isEmpty():
        numbered = read.select("*", once)
    else:
        few = several.limit(SENT_ROWS + 1).count() <= SENT_ROWS
        wanted = F.broadcast(several) if few else several
        alone = read.join(wanted, meets, "left_anti").select("*", once)
        # one row of each, map-side first, and then as many as there were
        kept = read.join(wanted, meets).dropDuplicates([key, target_uri, "payload_digest", "m"])
        copies = F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy")
        numbered = alone.unionByName(kept.select(*read.columns, copies))
    charset = F.regexp_extract(whole, r"(?i)<meta[^<>]*\bcharset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", 1)
    kind = F.when(charset == "", F.lit("text/html")).otherwise(F.concat(F.lit("text/html; charset="), charset))
    return numbered.select(
        key, target_uri, payload,
        identifier(
            F.lit("response"), F.col(key).cast("string"), _one_line(F.col(target_uri)), F.col("payload_digest"),
            *[F.when(F.col("copy") > 0, F.col("copy").cast("string"))],
        ).alias("record_id"),
        F.lit(date).alias("date"),
        F.array(
            F.lit("HTTP/1.1 200 OK"), F.concat(F.lit("Content-Type: "), kind),
            F.concat(F.lit("Content-Length: "), F.octet_length(whole).cast("string")),
        ).alias("headers"),
    )


def derived_records(
    responses: DataFrame,
    key: str = "page_id",
    target_uri: str = "url",
    payload: str = "html",
    date: str | None = None,
    record_id: str | None = None,
    headers: str | None = None,
) -> DataFrame:
    """Two rows per response, its ``metadata`` and its ``conversion``.

    ``date`` (text), ``record_id`` and ``headers`` (an array of lines) name columns of the
    response; without them records are undated, refer to a name-based identifier and keep no
    source lines. ``record`` is the whole record as text, without the two line ends after it.
    """
    whole = F.coalesce(F.col(payload), F.lit(""))
    read = responses.select(
        F.col(key).alias("key"),
        _one_line(F.col(target_uri)).alias("target_uri"),
        (F.coalesce(F.col(date), F.lit(UNDATED)) if date else F.lit(UNDATED)).alias("date"),
        (F.col(record_id) if record_id else F.lit(None).cast("string")).alias("given"),
        (F.col(headers) if headers else F.array().cast("array<string>")).alias("source"),
        _digest(whole).alias("payload_digest"),
        _page(whole).alias("page"),
    )
    named = [F.col("key").cast("string"), F.col("target_uri"), F.col("payload_digest")]
    linked = read.withColumn("refers_to", F.coalesce("given", identifier(F.lit("response"), *named)))

    def fields(name: str, values: Column) -> Column:
        kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())
        return F.transform(kept, lambda v: F.concat(F.lit(f"{name}: "), _one_line(v), F.lit("\r\n")))

    page = F.col("page")
    about = F.array_join(
        F.concat(
            fields("title", F.array(page["title"])),
            fields("language", F.array(page["language"])),
            fields("charset", F.array(page["charset"])),
            fields("outlink", page["links"]),
            fields("source-header", F.col("source")),
        ),
        "",
    )
    kinds = F.array(
        F.struct(
            F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"),
            about.alias("block"),
        ),
        F.struct(
            F.lit("conversion").alias("type"), F.lit("text/plain; charset=UTF-8").alias("content_type"),
            page["text"].alias("block"),
        ),
    )
    parts = linked.select(
        "key", "target_uri", "date", "refers_to", "payload_digest", F.explode(kinds).alias("r")
    ).select("key", "target_uri", "date", "refers_to", "payload_digest", "r.*")
    full = parts.withColumns(
        {
            "record_id": identifier(F.col("type"), F.col("refers_to"), *named),
            "block_digest": _digest(F.col("block")),
            "content_length": F.octet_length("block").cast("long"),
        }
    )
    lines = [
        ("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"),
        ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"),
        ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{n}: "), F.col(c).cast("string")) for n, c in lines]
    )
    return full.withColumn("record", F.concat(head, F.lit(RECORD_END), "block")).select(
        F.col("key").alias(key), *[c for _, c in lines], "block", "record"
    )


def save(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write the records as WARC files: each record, then two line ends, and nothing else."""
    records.select("record").write.option("lineSep", RECORD_END).option(
        "compression", compression
    ).text(path)
