"""Resume files to text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenforge.functions.text import file_format, is_blank
from screenforge.session import bound_batches, give_memory_back
from screenforge.sources.resumes import plain_text

# XML names of the two document formats (fixed values).
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ODT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_PARAGRAPH, _RUN, _LINK, _TEXT = (f"{_W}{tag}" for tag in ("p", "r", "hyperlink", "t"))
_WORD_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
_ODT_PARAGRAPH, _SPACES, _COUNT = (f"{_ODT}{tag}" for tag in ("p", "s", "c"))
_ODT_MARKS = {f"{_ODT}tab": "\t", f"{_ODT}line-break": "\n"}

Decoder = Callable[[bytes], str]


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, joined by line ends. Text in tables is not part of it."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")

    lines = []
    for paragraph in body.findall(_PARAGRAPH):
        parts = []
        for child in paragraph:
            tag = child.tag
            for run in (child,) if tag == _RUN else child.findall(_RUN) if tag == _LINK else ():
                for e in run:
                    part = e.text if e.tag == _TEXT else _WORD_MARKS.get(e.tag)
                    if part:
                        parts.append(part)
        lines.append("".join(parts))
    return "\n".join(lines)


def odt_text(content: bytes) -> str:
    """All paragraphs, joined by line ends. Headings are not part of it."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("content.xml"))

    def inner(element) -> str:
        out = [element.text or ""]
        for child in element:
            tag = child.tag
            if tag == _SPACES:
                out.append(" " * int(child.get(_COUNT, "1")))
            elif tag in _ODT_MARKS:
                out.append(_ODT_MARKS[tag])
            else:
                out.append(inner(child) if len(child) else child.text or "")
            out.append(child.tail or "")
        return "".join(out)

    return "\n".join(inner(p) for p in root.iter(_ODT_PARAGRAPH))


def decoder_column(decoders: dict[str, Decoder]) -> Callable[[Column, Column], Column]:
    """Arrow batch function (content, format) to text; null content stays null, a failure gives null.

    It is marked non-deterministic, so that a later filter on fields of the text is not pushed below
    it with a second decoding of every file. After a task the worker gives its memory back.
    """

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(data, kind):
            if data is None or kind not in decoders:
                return None
            try:
                return decoders[kind](bytes(data))
            except Exception:
                return None

        for content, fmt in batches:
            yield pd.Series([one(c, f) for c, f in zip(content, fmt, strict=True)], dtype=object)
        give_memory_back()

    return decode.asNondeterministic()


def extract_docx(files: DataFrame) -> DataFrame:
    """Add ``text`` of DOCX files; ``""`` where a file is unreadable."""
    bound_batches(files.sparkSession)
    return files.withColumn("text", F.coalesce(decoder_column({"docx": docx_text})("content", F.lit("docx")), F.lit("")))


def extract_odt(files: DataFrame) -> DataFrame:
    """Add ``text`` of ODT files; ``""`` where a file is unreadable."""
    bound_batches(files.sparkSession)
    return files.withColumn("text", F.coalesce(decoder_column({"odt": odt_text})("content", F.lit("odt")), F.lit("")))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Texts of a document's pages in page order, without separator. A null page adds nothing."""
    joined = F.expr("listagg(text, '') WITHIN GROUP (ORDER BY page_no)")
    return pages.groupBy("doc_id").agg(F.coalesce(joined, F.lit("")).alias("text"))


def with_fallback(primary: Column, source: Column, fallback: Callable[[Column], Column]) -> Column:
    """``primary`` text, continued by ``fallback(source)`` where it is blank or failed (null).

    ``primary`` should be a column that is computed already, for it is looked at twice. The fallback sees null for all other rows, so it works only where it is needed, in one pass.
    """
    needed = is_blank(primary)
    second = fallback(F.when(needed, source))
    first = F.coalesce(primary, F.lit(""))
    return F.when(needed, F.concat(first, F.coalesce(second, F.lit("")))).otherwise(first)


def extract_text(
    files: DataFrame,
    decoders: dict[str, Decoder] | None = None,
    fallbacks: dict[str, Decoder] | None = None,
) -> DataFrame:
    """Add ``text`` to files of every format; ``""`` for formats without a decoder.

    Text files are decoded by Spark itself. DOCX and ODT go to the built-in decoders; ``decoders``
    adds others (``pdf``, ``image``). ``fallbacks`` are tried where the first text is blank, as
    character recognition is for scanned PDF files.
    """
    known: dict[str, Decoder] = {"docx": docx_text, "odt": odt_text, **(decoders or {})}
    bound_batches(files.sparkSession)
    fmt = file_format(F.col("path"))
    decode = decoder_column(known)
    # Contents Spark reads itself, or nobody can read, are not sent to Python.
    decoded = files.withColumn("_text", decode(F.when(fmt.isin(*known), F.col("content")), fmt))
    text = F.when(fmt == "txt", plain_text(F.col("content"))).otherwise(F.col("_text"))
    if fallbacks:
        again = decoder_column(fallbacks)
        decoded = decoded.withColumn("_text", text)
        text = with_fallback(F.col("_text"), F.when(fmt.isin(*fallbacks), F.col("content")), lambda c: again(c, fmt))
    return decoded.withColumn("text", F.coalesce(text, F.lit(""))).drop("_text")
