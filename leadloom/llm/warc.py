"""WARC records: reading, responses from pages, and linked metadata and plain-text conversions."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import sys
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.dom import block_text, read

VERSION = "WARC/1.1"
#: What stands between two records, and ends the last.
RECORD_END = "\r\n\r\n"
PAIRS = T.MapType(T.StringType(), T.StringType())
RESPONSE = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("warc_headers", PAIRS),
        T.StructField("status", T.IntegerType()),
        T.StructField("http_headers", PAIRS),
        T.StructField("payload", T.BinaryType()),
    ]
)
DERIVED = T.StructType(
    [
        T.StructField("warc_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("block_digest", T.StringType()),
        T.StructField("source_digest", T.StringType()),
        T.StructField("block", T.StringType()),
    ]
)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title>", re.I | re.S)
_LINK = re.compile(r"<(a|link|img|iframe|form)\b[^>]*?\b(?:href|src|action)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*\"?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(kind: str, source: str) -> str:
    """The same id on every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]+", lambda m: " " if m[0] == " " else "".join(f"%{ord(c):02X}" for c in m[0]), value)


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of stored pages, with ``page_id`` beside them.

    The record id follows from page id and url. A null url has no target; a null page an empty
    payload with status 204.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                name = record_name("response", f"{page} {url}")
                http = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
                own = {
                    "WARC-Type": "response", "WARC-Record-ID": name, "WARC-Date": date,
                    "WARC-Payload-Digest": digest(payload), "Content-Type": "application/http; msgtype=response",
                }
                if url:
                    own["WARC-Target-URI"] = _line(url)
                rows.append((page, name, _line(url) if url else None, date, list(own.items()), 204 if html is None else 200, list(http.items()), payload))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds],
                names=["page_id", *RESPONSE.fieldNames()],
            )

    page_kind = pages.schema["page_id"].dataType
    pairs = pa.map_(pa.string(), pa.string())
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(page_kind.simpleString(), pa.string())
    kinds = [arrow, pa.string(), pa.string(), pa.string(), pairs, pa.int32(), pairs, pa.binary()]
    page = F.col("page_id") if arrow != pa.string() else F.col("page_id").cast("string")
    out = T.StructType([T.StructField("page_id", page_kind if arrow != pa.string() else T.StringType()), *RESPONSE.fields])
    return pages.select(page.alias("page_id"), "url", "html").mapInArrow(build, out)


def _gunzipped(data: bytes) -> bytes:
    """The contents of all members; what follows the last one, or is cut off, is left out."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def _inflated(data: bytes) -> bytes:
    """With or without the zlib header; both are sent under this name."""
    try:
        return zlib.decompress(data)
    except zlib.error:
        return zlib.decompressobj(-15).decompress(data)


def _unchunked(data: bytes) -> bytes:
    """The chunks put together; data that is not in chunks (already put together) stays as it is."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = data[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return data
        if not (n := int(size, 16)):
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out else data


def body_of(payload: bytes, headers: dict[str, str]) -> tuple[bytes, list[str]]:
    """The body without transfer and content encodings, and the encodings that could not be undone."""
    lowered = {k.lower(): (v or "").lower() for k, v in headers.items()}
    if "chunked" in lowered.get("transfer-encoding", ""):
        payload = _unchunked(payload)
    names = [n.strip() for n in lowered.get("content-encoding", "").split(",") if n.strip() not in ("", "identity")]
    while names:
        undo = {"gzip": _gunzipped, "x-gzip": _gunzipped, "deflate": _inflated}.get(names[-1])
        if undo is None:
            break
        if undo is _gunzipped and payload[:2] != b"\x1f\x8b":
            names.pop()  # already undone by whoever stored it
            continue
        try:
            payload = undo(payload)
        except zlib.error:
            break
        names.pop()
    return payload, names


def _decoded(body: bytes, headers: dict[str, str]) -> str:
    """Text of a body: charset of the header, else UTF-8; what doesn't decode is marked."""
    lowered = {k.lower(): v for k, v in headers.items()}
    found = _CHARSET.search(lowered.get("content-type") or "")
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def plain_text(html: str) -> str:
    """All text of a page, a line for each block; scripts, styles and the title left out."""
    blocks: list[list[str]] = []
    last = None
    for text in read(html)[1]:
        if text.block != last:
            blocks.append([])
            last = text.block
        blocks[-1].append(text.value)
    return "\n".join(t for t in map(block_text, blocks) if t)


def derivatives(
    record_id: str | None, uri: str | None, date: str | None, warc: dict[str, str], status: int | None,
    http: dict[str, str], payload: bytes,
) -> list[tuple]:
    """The metadata and the conversion record of a response; both refer to it."""
    body, undecoded = body_of(payload, http)
    html = "" if undecoded else _decoded(body, http)
    source = warc.get("WARC-Payload-Digest") or digest(payload)
    title = _TITLE.search(html)
    facts = {
        "refers-to": record_id,
        "source-headers": {k: warc[k] for k in sorted(warc)},
        "http-status": status,
        "http-headers": {k: http[k] for k in sorted(http)},
        "payload-digest": source,
        "payload-length": len(payload),
        "title": block_text([unescape(title[1])]) if title else None,
        "links": [{"element": e.lower(), "url": unescape(a or b or c)} for e, a, b, c in _LINK.findall(html)],
    }
    if undecoded:  # the text of such a body is empty, not noise
        facts["undecoded"] = undecoded
    out = []
    for kind, content, block in (
        ("metadata", "application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True)),
        ("conversion", "text/plain; charset=utf-8", plain_text(html)),
    ):
        data = block.encode("utf-8", "replace")
        out.append(
            (kind, record_name(kind, record_id or ""), record_id, uri, date, content, len(data), digest(data), source, data.decode())
        )
    return out


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response: its metadata and its plain-text conversion; other columns go along.

    Both keep the id of the response in ``refers_to``, its target, date and payload digest (taken
    anew if the source has none); the metadata block holds all WARC and HTTP headers of the
    source, title and links. Null headers count as none, a null payload as empty. Row by row, no
    shuffle; repeated rows give repeated records; an empty table gives none. Other columns named
    like a column of the result are dropped.
    """
    names = RESPONSE.fieldNames()
    others = [c for c in responses.columns if c not in names and c not in DERIVED.fieldNames()]
    rows = responses.select(*others, *names)
    made = T.ArrayType(DERIVED)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[len(others):]]
            found = [
                derivatives(i, uri, date, dict(warc or ()), status, dict(http or ()), payload or b"")
                for i, uri, date, warc, status, http, payload in zip(*columns, strict=True)
            ]
            records = [[dict(zip(DERIVED.fieldNames(), r, strict=True)) for r in pair] for pair in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(records, shape)], names=[*others, "_records"]
            )

    shape = pa.list_(pa.struct([(f.name, pa.int64() if f.name == "content_length" else pa.string()) for f in DERIVED.fields]))
    schema = T.StructType([*[rows.schema[c] for c in others], T.StructField("_records", made)])
    return rows.mapInArrow(build, schema).select(*others, F.explode("_records").alias("_r")).select(*others, "_r.*")


def serialised() -> Column:
    """A derived record as text, without the record end."""
    head = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), "warc_type"),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), "target_uri"),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"),
        F.concat(F.lit("WARC-Block-Digest: "), "block_digest"),
        F.concat(F.lit("WARC-Source-Payload-Digest: "), "source_digest"),
        F.concat(F.lit("Content-Type: "), "content_type"),
        F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *head), F.lit(RECORD_END), "block")


def write_records(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files of the records, one per task, by Spark's own writer."""
    derived.select(serialised().alias("value")).write.option("lineSep", RECORD_END).option(
        "compression", compression
    ).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record in a WARC file, packed or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(part for line in lines if len(part := tuple(x.strip() for x in line.split(":", 1))) == 2)
        size = int(headers.get("Content-Length", "0"))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """headers, block of every record below ``path``; a file is read by one task, whole."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                found = list(parse(content or b""))
                columns = [pa.array([list(h.items()) for h, _ in found], pairs), pa.array([b for _, b in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["headers", "block"])

    pairs = pa.map_(pa.string(), pa.string())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(records, "headers map<string,string>, block binary")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records below ``path``, as :func:`derive` takes them."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                headers = dict(own)
                head, _, body = block.partition(b"\r\n\r\n")
                first, *lines = head.decode("iso-8859-1").split("\r\n")
                http = [p for line in lines if len(p := tuple(x.strip() for x in line.split(":", 1))) == 2]
                status = first.split(" ")[1] if first.count(" ") else ""
                rows.append(
                    (
                        headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI"), headers.get("WARC-Date"), own,
                        int(status) if status.isdigit() else None, list(dict(http).items()), body,
                    )
                )
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=RESPONSE.fieldNames()
            )

    pairs = pa.map_(pa.string(), pa.string())
    kinds = [pa.string(), pa.string(), pa.string(), pairs, pa.int32(), pairs, pa.binary()]
    responses = read_records(spark, path).where(F.col("headers")["WARC-Type"] == "response")
    return responses.mapInArrow(split, RESPONSE)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
