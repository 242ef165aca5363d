"""HTML tables and links of pages."""

from __future__ import annotations

import html
import io
import re
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import delimited
from .export import looks_like_export, read_export, read_list  # noqa: F401

LONGEST_ROW = 32 << 20
_row = re.compile(r"(?i)<tr\b[^>]*>")


def html_cells(row: str) -> list[str]:
    """Cells of a row; a span of n columns leaves n - 1 blanks after it."""
    out: list[str] = []
    row = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", row)
    for m in re.finditer(r"(?is)<t[dh]\b([^>]*)>(.*?)(?=<t[dh]\b|</tr\b|\Z)", row):
        out.append(delimited.clean_cell(html.unescape(re.sub(r"<[^>]*>", " ", m[2]))))
        if (span := re.search(r"(?i)\bcolspan\s*=\s*[\"']?(\d+)", m[1])) and int(span[1]) > 1:
            out += [""] * (int(span[1]) - 1)
    return out


def html_rows(text: str) -> list[list[str]]:
    """All rows of a page; the last may lack its end."""
    return list(html_stream(io.StringIO(text)))


def html_stream(page: TextIO, chunk: int = 1 << 18) -> Iterator[list[str]]:
    """Rows of a page as it is read; a row and a chunk are held, and a row longer than LONGEST_ROW is passed over."""
    left, inside = "", False
    while block := page.read(chunk):
        *whole, left = _row.split(left + block)
        for part in whole:
            if inside and len(part) <= LONGEST_ROW and (cells := html_cells(part)):
                yield cells
            inside = True
        if len(left) > LONGEST_ROW:  # a tag may have begun at the end
            left, inside = left[-64:], False
    if inside and (cells := html_cells(left)):
        yield cells


def transcode(content: Column, encoding: str = "windows-1251") -> Column:
    """Bytes of an older encoding as text; cp1251 needs spark.sql.legacy.javaCharsets."""
    return F.decode(content, encoding)


def links(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """Links of each page, made absolute, each at its first place."""
    href = F.regexp_extract_all(page, F.lit(r"""href\s*=\s*["']([^"'#]+)["']"""), F.lit(1))
    host = F.regexp_extract(url, "^(https?://[^/]+)", 1)
    scheme, folder = F.regexp_extract(url, "^(https?:)", 1), F.regexp_replace(url, "(?<=[^/])/[^/]*$", "")
    raw = pages.select("page_id", F.col(url).alias("base_"), host.alias("host_"), scheme.alias("scheme_"), folder.alias("folder_"), F.posexplode(href).alias("pos", "href"))
    full = F.when(F.regexp_like("href", F.lit("^[a-z]+:")), F.col("href")).when(F.col("href").startswith("//"), F.concat("scheme_", "href")).when(F.col("href").startswith("/"), F.concat("host_", "href")).otherwise(F.concat("folder_", F.lit("/"), "href"))
    return raw.select("page_id", "pos", full.alias("link")).groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
