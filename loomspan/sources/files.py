"""File sources: text, Markdown, HTML and EPUB files as rows; formats that need other libraries say so."""

from __future__ import annotations

import io
import posixpath
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TEXT, HTML, EPUB, NEEDS = (".txt", ".md"), (".html", ".htm"), (".epub",), {".pdf": "a PDF library"}
#: Of a book's manifest, the media type of its texts.
XHTML = "application/xhtml+xml"


class _Text(HTMLParser):
    """The text of a page without scripts and styles, pieces apart by line breaks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def text_of_html(page: str | None) -> str:
    p = _Text()
    p.feed(page or "")
    p.close()
    return "\n".join(p.out)


@F.pandas_udf(StringType())
def _html(s: pd.Series) -> pd.Series:
    return s.map(text_of_html)


def html_text(html: Column) -> Column:
    return _html(html)


def text_of_epub(book: bytes | None) -> str | None:
    """The texts of a book's documents in the order of its manifest, one after the other. A broken archive fails, and names what is wrong."""
    if book is None:
        return None
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("}rootfile") or e.tag == "rootfile")
        items = [e.attrib for e in ElementTree.fromstring(z.read(package)).iter() if e.tag.rsplit("}", 1)[-1] == "item"]
        at = posixpath.dirname(package)
        places = [posixpath.normpath(posixpath.join(at, unquote(i["href"]))) for i in items if i.get("media-type") == XHTML]
        return "\n".join(text_of_html(z.read(p).decode("utf-8", "replace")) for p in places)


@F.pandas_udf(StringType())
def _epub(s: pd.Series) -> pd.Series:
    return s.map(text_of_epub)


def load_epub(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the EPUB files at a path."""
    books = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(path)
    return books.select(F.col("path").alias("file"), _epub("content").alias("text"))


def load_any(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of the files at a path, by their suffix. PDF needs a library that isn't here; other suffixes are refused."""
    suffix = F.lower(F.regexp_extract("file", r"(\.[^./]*)$", 1))
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))  # no contents are read
    seen = {r[0] for r in names.select(suffix).distinct().collect()}
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").where(~suffix.isin(*EPUB))
    for s in sorted(seen - set(TEXT) - set(HTML) - set(EPUB)):
        raise NotImplementedError(f"{s} files need {NEEDS[s]}") if s in NEEDS else ValueError(f"no loader for {s or 'files without a suffix'}")
    out = files.select("file", F.when(suffix.isin(*HTML), html_text(F.when(suffix.isin(*HTML), F.col("value")))).otherwise(F.col("value")).alias("text"))
    return out.union(load_epub(spark, path)) if seen & set(EPUB) else out


def ocr(path: str) -> str:
    raise NotImplementedError("no OCR here: give the text of scanned pages")
