"""WARC derivative builder: each response gives a metadata and a plain-text conversion record.

Records follow WARC/1.1. Both derivatives name the response in WARC-Refers-To, keep its target URI
and date, and carry digests of their own block; the metadata block keeps the source's HTTP headers,
payload digest and outlinks, the conversion's named fields keep the source's payload digest.
Record ids are name-based UUIDs of the response's id, so reruns agree.

`read` gives the records of WARC files, `derive_records` the derivatives of those that are responses, with their
true headers; `build_derivatives` makes responses of (url, html) rows first. Chunked and gzipped payloads are decoded;
a payload that is no text by its headers gives a metadata record only.

A page is read by one forward scan whose time is linear in its length, whatever it holds: an unclosed tag
or comment ends the page, script and style run to their end tag or the page's end, other elements without text to
their end tag, if there is one. A quote that is never closed inside a tag does not count.

Results of `build_derivatives`: two rows for each page, equal rows included (with equal ids). A null html is an empty
payload, a null URL leaves the target URI out, a null date is the epoch. Empty tables give no rows. Other columns are ignored.
Everything is row by row: nothing is shuffled, and a page's size alone bounds the memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.session import ship

#: Elements whose content is no markup, other elements whose content is no text, and elements that end a line. Fixed values.
RAW = {"script", "style", "iframe"}
NO_TEXT = {"noscript", "template", "svg", "object"}
LINES = set(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
# all repetition is possessive, so no pattern goes back over what it has read
_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([A-Za-z][^\s/>]*+))")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_SPACES = re.compile(r"[ \t\r\f\v\u00a0]++")
_ZEROS, _HUGE = re.compile(r"&#([xX]?)0{8,}+"), re.compile(r"&#(?:[xX]0*+[0-9a-fA-F]{8,}+|0*+[0-9]{8,}+);?")
_CHARSET = re.compile(rb"charset\s*+=\s*+[\"']?([\w.:-]++)", re.I)
_KNOWN = {x: x for x in LINES | RAW | NO_TEXT | {"a", "b", "i", "em", "strong", "span", "img"}}
_LOWER = {c: c + 32 for c in range(65, 91)}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's for URLs


def unescape(text: str) -> str:
    """Entities decoded; numbers beyond any character are U+FFFD."""
    return html.unescape(_HUGE.sub("\ufffd", _ZEROS.sub(r"&#\g<1>0", text)) if "&#" in text else text)


def scan(page: str) -> tuple[str, list[str]]:
    """A page's text (one line for each block, entities decoded, white space folded) and the targets of its links."""
    parts: list[str] = []
    links: dict[str, None] = {}
    at, last, strict, lower = 0, 0, True, None  # last: where the text before the next tag begins
    inside, depth, last_end = "", 0, {}  # an element without text that the scan is in
    while m := _OPEN.search(page, at):
        comment, end_mark, name = m.groups()
        begin, at = m.span()
        if not inside:
            parts.append(page[last:begin])
        if name is None:
            if comment:
                short = 1 if page.startswith(">", at) else 2 if page.startswith("->", at) else 0
                stop = at + short if short else page.find("-->", at) + 3
            else:
                stop = page.find(">", at) + 1
            if stop < at:  # nothing closes it
                return _folded(parts), list(links)
            at = last = stop
            continue
        rest = _REST.match(page, at) if strict else None
        if rest is None:
            stop = page.find(">", at) + 1
            if not stop:
                return _folded(parts), list(links)
            strict = False  # a quote is never closed; from here on none counts, so that no stretch is read again and again
        else:
            stop = rest.end()
        attributes, at = at, stop
        last = stop
        name = _KNOWN.get(name) or name.lower()
        if name in LINES:
            if not inside:
                parts.append("\n")
            continue
        if name == "a":
            if not end_mark:
                links |= dict.fromkeys(_target(page[attributes : stop - 1]))
            continue
        if name not in RAW and name not in NO_TEXT:
            continue
        if end_mark:
            if name == inside:
                depth -= 1
        else:
            if name not in last_end:
                if lower is None:
                    lower = page.lower()
                    lower = lower if len(lower) == len(page) else page.translate(_LOWER)  # places must stay
                last_end[name] = lower.rfind(f"</{name}")
            closed = page[stop - 2] == "/"
            if name in RAW and not (closed and name == "iframe"):
                if last_end[name] >= stop:
                    at = last = lower.find(f"</{name}", stop)
                elif name != "iframe":
                    return _folded(parts), list(links)
                if not inside:
                    parts.append(" ")
            elif name in NO_TEXT and not closed:
                if not inside and last_end[name] >= stop:
                    inside, depth = name, 1
                    parts.append(" ")
                elif name == inside:
                    depth += 1
        if inside and (not depth or at > last_end[inside]):
            inside = ""
    if not inside:
        parts.append(page[last:])
    return _folded(parts), list(links)


def _target(attributes: str) -> list[str]:
    """The value of the first href, if there is one and it is not empty."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() == "href":
            return [x for x in [unescape(next(filter(None, values), "")).strip()] if x]
    return []


def _folded(parts: list[str]) -> str:
    return "\n".join(filter(None, map(str.strip, _SPACES.sub(" ", unescape("".join(parts))).split("\n"))))


def plain_text(page: str) -> str:
    return scan(page)[0]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record(fields: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of one record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


#: Named fields as they are written. Fixed values.
FIELDS = {x.lower(): x for x in "WARC-Type WARC-Record-ID WARC-Date WARC-Refers-To WARC-Target-URI WARC-Block-Digest WARC-Payload-Digest WARC-Source-Payload-Digest Content-Type Content-Length".split()}


def parse(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of uncompressed WARC bytes: (named fields, block). Blank lines between records, bare line feeds, missing
    blanks after a colon and folded lines are taken; a record without a length raises."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        name = ""
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and name:
                fields[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = FIELDS.get(name.strip().lower(), name.strip())
            fields[name] = value.strip()
        if not fields.get("Content-Length", "").isdecimal():
            raise ValueError(f"record {fields.get('WARC-Record-ID')} has no length")
        yield fields, stream.read(int(fields["Content-Length"]))


def response(uri: str | None, date: str, payload: bytes, key: object) -> tuple[dict[str, str], bytes]:
    """Named fields and block of a response record for a fetched page; the key, URI and payload make its id."""
    of = digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    name = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key} {uri} {of}')}>"
    fields = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Target-URI": uri or "", "WARC-Date": date, "Content-Type": "application/http; msgtype=response"}
    return fields | {"WARC-Block-Digest": digest(block), "WARC-Payload-Digest": of}, block


def _split(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    ends = [(i, len(x)) for x in (b"\r\n\r\n", b"\n\n") if (i := block.find(x)) >= 0]
    cut, skip = min(ends, default=(len(block), 0))
    status, *lines = block[:cut].decode("latin-1").splitlines() or [""]
    return status, [(x.partition(":")[0].strip().lower(), x.partition(":")[2].strip()) for x in lines], block[cut + skip :]


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out else body


def content_of(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer and content coding; as it is where that fails."""
    named = dict(headers)
    if named.get("transfer-encoding", "").lower() == "chunked":
        payload = _dechunked(payload)
    if named.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            return zlib.decompressobj(47).decompress(payload)
        except zlib.error:
            return payload
    return payload


def derive(fields: dict[str, str], block: bytes) -> list[tuple[str, str, str, str, str, bytes]]:
    """(type, id, refers to, payload digest of the source, block digest, record) of a response's derivatives."""
    status, headers, payload = _split(block)
    refers, uri, date = fields.get("WARC-Record-ID", ""), fields.get("WARC-Target-URI", ""), fields.get("WARC-Date", "")
    of = fields.get("WARC-Payload-Digest") or digest(payload)
    body = content_of(headers, payload)
    kind = dict(headers).get("content-type", "").lower()
    is_text = not kind or kind.startswith("text/") or "html" in kind or "xml" in kind
    text, links = b"", []
    if is_text:
        named = _CHARSET.search(kind.encode("latin-1", "replace")) or _CHARSET.search(body[:1024])
        try:
            page = body.decode(named[1].decode() if named else "utf-8", "replace")
        except LookupError:
            page = body.decode("utf-8", "replace")
        if kind.startswith("text/plain"):
            text = page.encode("utf-8", "replace")
        else:
            found, links = scan(page)
            text = found.encode("utf-8", "replace")
    facts = [("source-status", status), *((f"source-header-{k}", v) for k, v in headers if k), ("source-payload-digest", of), ("source-length", str(len(payload))), ("text-length", str(len(text)))]
    about = "".join(f"{k}: {v}\r\n" for k, v in [*facts, *(("outlink", x.replace("\r", "").replace("\n", "")) for x in links)]).encode("utf-8", "replace")
    out = []
    for kind, content, made in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text)):
        if kind == "conversion" and not is_text:
            continue
        name = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{refers} {kind}')}>"
        own = digest(made)
        named = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", refers), ("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", content), ("WARC-Block-Digest", own), ("WARC-Source-Payload-Digest", of)]
        out.append((kind, name, refers, of, own, record(named, made)))
    return out


_MADE = (*[pa.string()] * 6, pa.binary())
_NAMES = ["record_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "record"]
_SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, record binary"


def build_derivatives(pages: DataFrame, *, id: str = "page_id", url: str = "url", page: str = "html", date: str | None = None) -> DataFrame:
    """id, record_type, record_id, refers_to, target_uri, source_digest, block_digest, record (binary): two rows per page."""
    ship(pages.sparkSession)
    kind = pages.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (big.slice(at, 64) for big in batches for at in range(0, big.num_rows, 64)):
            rows, who = [], []
            for i, (k, u, p, d) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                payload = (p or "").encode()
                for x in derive(*response(u, d, payload, k)):
                    rows.append((*x[:3], u, *x[3:]))
                    who.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), *_columns(rows)], names=[id, *_NAMES])

    when = F.coalesce(F.date_format(F.col(date), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date else F.lit(None).cast("string"), F.lit("1970-01-01T00:00:00Z"))
    rows = pages.select(F.col(id), F.col(url).cast("string").alias("u"), F.col(page).cast("string").alias("p"), when.alias("w"))
    return rows.mapInArrow(run, f"`{id}` {kind}, {_SCHEMA}")


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(_MADE), _MADE, strict=True)]


def derive_records(records: DataFrame) -> DataFrame:
    """The derivatives of the responses in what `read` gives: metadata, and conversion if the payload is text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (big.slice(at, 64) for big in batches for at in range(0, big.num_rows, 64)):
            rows = []
            for f, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fields = dict(f)
                rows += [(*x[:3], fields.get("WARC-Target-URI"), *x[3:]) for x in derive(fields, block)]
            yield pa.RecordBatch.from_arrays(_columns(rows), names=_NAMES)

    return records.where("record_type = 'response'").select("fields", "block").mapInArrow(run, _SCHEMA)


def pack(records: DataFrame, per_file: int = 5000, file_bytes: int = 256 << 20) -> DataFrame:
    """(name, content): WARC files of at most `per_file` records, closed once they hold `file_bytes`; each record is gzipped by itself. Save with any binary sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, number, part = 0, 0, TaskContext.get().partitionId()

        def out():
            body = b"".join(held)
            name = f"{part:06d}-{number:06d}-{hashlib.sha1(body).hexdigest()[:16]}.warc.gz"  # files of equal records have other names
            return pa.RecordBatch.from_pydict({"name": [name], "content": [body]})

        for b in batches:
            for r in b.column(0):
                held.append(gzip.compress(r.as_py(), mtime=0))
                size += len(held[-1])
                if len(held) >= per_file or size >= file_bytes:
                    yield out()
                    held.clear()
                    size, number = 0, number + 1
        if held:
            yield out()

    return records.select("record").mapInArrow(run, "name string, content binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to, target_uri, fields, block): the records of WARC files, gzipped or not, one after the other."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out():
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record_type", "record_id", "refers_to", "target_uri", "fields", "block"])

        held = 0
        for b in batches:
            for raw in b.column(0):
                data = raw.as_buffer()
                stream = pa.BufferReader(data) if bytes(data[:2]) != b"\x1f\x8b" else gzip.GzipFile(fileobj=pa.BufferReader(data))
                for f, block in parse(io.BufferedReader(stream)):
                    rows.append((f.get("WARC-Type"), f.get("WARC-Record-ID"), f.get("WARC-Refers-To"), f.get("WARC-Target-URI"), list(f.items()), block))
                    held += len(block)
                    if held > 8 << 20 or len(rows) >= 1024:
                        yield out()
                        rows.clear()
                        held = 0
        if rows:
            yield out()

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record_type string, record_id string, refers_to string, target_uri string, fields map<string,string>, block binary")
