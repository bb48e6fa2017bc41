"""Zip containers and office documents: parts out of archives, processed, and back in."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import Format, deformat, format_of, reformat

#: Parts with text, by kind of document.
PARTS = {
    "odt": r"(?:content|styles|meta)\.xml$",
    "docx": r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$",
    "pptx": r"ppt/(?:slides|notesSlides)/[^/]+\.xml$",
    "xlsx": r"xl/sharedStrings\.xml$",
}
FORMAT_OF = {"odt": "odt", "docx": "wxml", "pptx": "pptx", "xlsx": "xlsx"}
_MARK = re.compile(r'<file name="([^"]*)">')


def join_parts(data: bytes, kind: str) -> str:
    """The text parts of an archive in one string, each after a tag with its name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if re.search(PARTS[kind], n))
        return "".join(f'<file name="{n}">{z.read(n).decode("utf-8")}' for n in names)


def split_parts(text: str) -> dict[str, str]:
    pieces = _MARK.split(text)
    return dict(zip(pieces[1::2], pieces[2::2]))


def replace_parts(data: bytes, text: str) -> bytes:
    """The archive with the parts of the string in the place of its own; dates and order stay."""
    parts, out = split_parts(text), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            new.writestr(info, parts[info.filename].encode() if info.filename in parts else old.read(info))
    return out.getvalue()


def translate_document(data: bytes, kind: str, step: Callable[[str], str]) -> bytes:
    """A whole document through a segment function: unpack, deformat, step, reformat, pack."""
    fmt: Format = format_of(FORMAT_OF[kind])
    text = join_parts(data, kind)
    return replace_parts(data, reformat(step(deformat(adapt_runs(text) if kind == "docx" else text, fmt)), fmt))


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, content, stream) of the archives of a folder, deformatted."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).select("path", "content")
    fmt = format_of(FORMAT_OF[kind])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # an archive at a time
                one = batch.slice(i, 1)
                stream = deformat(join_parts(one.column(1)[0].as_py(), kind), fmt)
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([stream], pa.string())], names=["path", "content", "stream"])

    return rows.mapInArrow(work, "path string, content binary, stream string")


def packed(df: DataFrame, kind: str) -> DataFrame:
    """(path, content) with each row's ``stream`` written back into its archive."""
    fmt = format_of(FORMAT_OF[kind])

    @F.arrow_udf("binary")
    def pack(content: pa.Array, stream: pa.Array) -> pa.Array:
        return pa.array([replace_parts(c, reformat(s, fmt)) for c, s in zip(content.to_pylist(), stream.to_pylist())], pa.binary())

    return df.select("path", pack("content", "stream").alias("content"))


# word-processor runs

_RUN = re.compile(r"<w:r(?: [^>]*)?>.*?</w:r>", re.DOTALL)
_TEXT = re.compile(r"(<w:t(?: [^>]*)?>)([^<]*)(</w:t>)")


def adapt_runs(xml: str) -> str:
    """Move the ends of formatted runs to where words end, and drop runs that this empties.

    A word that a run boundary cuts goes to the run that it starts in; text, in order, stays the same.
    """

    def paragraph(m: re.Match) -> str:
        body, runs = m[0], list(_RUN.finditer(m[0]))
        texts = [(r, list(_TEXT.finditer(r[0]))) for r in runs]
        simple = [k for k, (_, t) in enumerate(texts) if len(t) == 1]
        contents = {k: texts[k][1][0][2] for k in simple}
        for a, b in zip(simple, simple[1:]):
            adjacent = b == a + 1 and runs[a].end() == runs[b].start()
            if not adjacent or not contents[a] or contents[a][-1].isspace():
                continue
            start = re.match(r"(?:\w|&\w+;|['’-](?=\w))+", contents[b])
            if start and (contents[a][-1].isalnum() or contents[a][-1] == ";"):
                contents[a] += start[0]
                contents[b] = contents[b][start.end() :]
        out, at = [], 0
        for k, (r, t) in enumerate(texts):
            out.append(body[at : r.start()])
            at = r.end()
            if k not in contents:
                out.append(r[0])
            elif contents[k] or not t[0][2]:
                text = t[0]
                head = text[1] if "xml:space" in text[1] or contents[k] == contents[k].strip() else text[1][:-1] + ' xml:space="preserve">'
                out.append(r[0][: text.start()] + head + contents[k] + text[3] + r[0][text.end() :])
        return "".join(out) + body[at:]

    return re.sub(r"<w:p(?: [^>]*)?>.*?</w:p>", paragraph, xml, flags=re.DOTALL)


def plain_text(xml: str) -> str:
    """All characters of an XML part, without its tags."""
    return "".join(ET.fromstring(xml).itertext())
