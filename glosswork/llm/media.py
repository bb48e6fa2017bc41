"""Media columns: interleaved document sequences over a content-addressed payload store.

HTML is parsed into an ordered sequence of text and media-reference structs. A reference names its
payload by digest; payloads are stored once as lossless 8-bit grey PNG images, and joins on the
digest bring what was read back from them to the reference, whose position and caption stay with it.

A plain text is a page too: its lines are paragraphs, and after the first of them stands a figure
that refers to the payload made of the whole text. What is known of a document's payload, its
unpadded length too, comes from the stored bytes (a padding byte, 255, is in no UTF-8 text).

Defined results: null and empty texts have a payload of 576 bytes of 255; null HTML is an empty
sequence; repeated rows each keep their own; a reference whose payload is missing resolves to nulls;
an empty table gives an empty table. Only the named columns of the input are read.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, store

#: Samples in a row of the stored image.
WIDTH = 576
PAD = b"\xff"
MEDIA_TAGS = ("img", "video", "audio", "source")
SKIPPED = ("script", "style", "noscript", "template")
BLOCKS = ("p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav", "title", "blockquote", "pre", "br", "figure", "figcaption")
SEQUENCE = "array<struct<pos:int,kind:string,text:string,src:string,digest:string,caption:string>>"


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    missing = -len(data) % WIDTH if data else WIDTH
    return data + PAD * missing


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of rows of 576 samples, none of them filtered."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), np.uint8)
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that to_png() made; a damaged one raises ValueError."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, packed, size = 8, b"", None
    while at < len(image):
        (length,), name = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", image, at + 8 + length)[0] != zlib.crc32(name + body):
            raise ValueError(f"damaged chunk {name!r}")
        if name == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        at += 12 + length
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not written by this store")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean sample, shares of eight ranges of samples in thousandths, and a 64-bit average hash."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 5, minlength=8) * 1000 // len(samples)
    parts = samples.reshape(64, -1).sum(axis=1, dtype=np.int64)
    bits = parts * 64 > parts.sum()
    code = int("".join("01"[int(b)] for b in bits), 2)
    return f"mean={int(samples.sum(dtype=np.int64)) * 1000 // len(samples)};bins={','.join(map(str, bins))};ahash={code:016x}"


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.skip = 0
        self.figure: list[dict] | None = None

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text = []
        if words:
            self.items.append({"kind": "text", "text": words, "src": None, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag in MEDIA_TAGS:
            given = dict(attrs)
            if src := given.get("src"):
                self.flush()
                digest = re.fullmatch(r"sha256:([0-9a-f]{64})", src)
                self.items.append({"kind": "media", "text": None, "src": src, "digest": digest and digest[1], "caption": given.get("alt") or None})
                if self.figure is not None:
                    self.figure.append(self.items[-1])
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = []
            elif tag == "figcaption":
                self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.figure or ():
                item["caption"] = words or item["caption"]
            if not self.figure and words:  # a caption of nothing is text
                self.items.append({"kind": "text", "text": words, "src": None, "digest": None, "caption": None})
        elif tag == "figure":
            self.figure = None
            self.flush()
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(page: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    if parser.caption:
        parser.text += parser.caption
    parser.flush()
    return [{"pos": i, **item} for i, item in enumerate(parser.items)]


def page_of(text: str | None) -> str:
    """A text as a page: a paragraph for each line, and the figure of its payload after the first."""
    lines = [html.escape(x, quote=False) for x in (text or "").split("\n")]
    name = hashlib.sha256(payload_of(text)).hexdigest()
    figure = f'<figure><img src="sha256:{name}" alt="samples"><figcaption>{len((text or "").encode())} bytes of text</figcaption></figure>'
    return f"<article><p>{lines[0]}</p>{figure}<p>{'</p><p>'.join(lines[1:])}</p></article>"


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", as_page: Callable[[str | None], str | None] | None = None) -> DataFrame:
    """(id, sequence) of every page: its texts and media references in document order.

    ``as_page`` makes the page of what the column holds, if that isn't HTML itself.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    schema = pages.sparkSession.createDataFrame([], f"id {dict(rows.dtypes)['id']}, sequence {SEQUENCE}").schema
    struct_type = pa.list_(pa.struct([("pos", pa.int32()), *[(k, pa.string()) for k in ("kind", "text", "src", "digest", "caption")]]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held = (x.as_py() for x in part.column(1))
                found = [sequence_of(as_page(x) if as_page else x) for x in held]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, struct_type)], names=["id", "sequence"])

    return rows.mapInArrow(parse, schema)


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """One row for every element, in its place, with the columns of ``media`` for its digest."""
    rows = sequences.select("id", F.explode("sequence").alias("e")).select("id", "e.*")
    return rows.join(media, "digest", "left")


def write_payloads(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """Store every text's payload; returns (digest, media) as read from the store. A task stores a payload once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                digests, images = [], []
                for text in batch.column(0).slice(at, 512):
                    payload = payload_of(text.as_py())
                    digest = hashlib.sha256(payload)
                    if digest.digest() not in seen:
                        seen.add(digest.digest())
                        digests.append(digest.hexdigest())
                        images.append(to_png(payload))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=["digest", "media"])

    return store(docs.select(F.col(text_col).alias("text")).mapInArrow(write, "digest string, media binary"), "media", path)


def read_payloads(stored: DataFrame) -> DataFrame:
    """What each stored payload holds, one row a digest, from the stored bytes alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                image = image.as_py()
                payload = from_png(image)
                own = hashlib.sha256(payload).hexdigest()
                if own != digest:
                    raise ValueError(f"payload {digest} was stored as {own}")
                rows.append((digest, len(payload.rstrip(PAD)), len(payload), own, zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(payload)))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]
    found = stored.select("digest", "media").mapInArrow(read, schema)
    return found.groupBy("digest").agg(*[F.first(n).alias(n) for n in names[1:]])


def media_columns(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media columns of each document, by way of its page's sequence and the payload store.

    position: the place of the reference in the sequence; elements: how many that has.
    """
    # cut here, so that the join deals out both sides itself and a digest with many rows is split
    media = cut_lineage(read_payloads(write_payloads(docs, path, text_col)))
    pages = interleave(docs.select(F.col(id_col).cast("long").alias("page_id"), F.col(text_col).alias("html")), as_page=page_of)
    references = pages.select("id", F.size("sequence").alias("elements"), F.filter("sequence", lambda e: e["kind"] == "media").alias("sequence"))
    rows = references.select("id", "elements", F.explode("sequence").alias("e")).select("id", "elements", "e.pos", "e.digest", "e.caption")
    rows = rows.join(media, "digest", "left")
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return rows.select(F.col("id").alias("doc_id"), *names, F.col("pos").alias("position"), "elements", "caption")


def page_sequences(pages: DataFrame) -> DataFrame:
    """page_id, elements, media, text_chars, digest (of all elements in order) of every page."""
    rows = interleave(pages)
    joined = F.array_join(F.transform("sequence", lambda e: F.concat_ws(":", e["pos"].cast("string"), e["kind"], F.coalesce(e["text"], e["src"]))), "\n")
    chars = F.aggregate("sequence", F.lit(0).cast("long"), lambda n, e: n + F.coalesce(F.length(e["text"]), F.lit(0)))
    media = F.size(F.filter("sequence", lambda e: e["kind"] == "media"))
    return rows.select(F.col("id").alias("page_id"), F.size("sequence").alias("elements"), media.alias("media"), chars.alias("text_chars"), F.sha2(joined, 256).alias("digest"))
