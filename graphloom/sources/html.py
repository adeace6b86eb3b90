"""Main content of HTML pages, by the standard library's parser over Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is never text, blocks that end a line, and names of boilerplate.
SKIPPED = frozenset(
    "script style noscript template svg canvas iframe form button select option nav footer header aside figure figcaption picture source video audio advert "
    "advertisement".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div section article main li ul ol h1 h2 h3 h4 h5 h6 tr table blockquote pre br dd dt figure".split())
BOILERPLATE = re.compile(r"(^|[-_ ])(nav|menu|footer|header|sidebar|cookie|banner|ad|ads|advert|share|social|related|newsletter|breadcrumb)s?($|[-_ ])", re.I)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = [""]
        self.skipped: list[str] = []
        self.stack: list[str] = []
        self.title, self.meta, self.lang, self.heading = "", {}, "", ""
        self.inside = ""

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = named.get("lang", "")
        if tag == "meta":
            self.meta.setdefault(named.get("property") or named.get("name") or "", named.get("content", ""))
        if tag in VOID:
            if tag in BLOCKS:
                self.lines.append("")
            return
        if self.skipped or tag in SKIPPED or BOILERPLATE.search(f"{named.get('class', '')} {named.get('id', '')}"):
            self.skipped.append(tag)
        self.inside = tag if tag in ("title", "h1") else self.inside
        if tag in BLOCKS:
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag in self.skipped:
            while self.skipped and self.skipped.pop() != tag:
                pass
        if tag == self.inside:
            self.inside = ""
        if tag in BLOCKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.inside == "title":
            self.title += data
        elif not self.skipped:
            if self.inside == "h1":
                self.heading += data
            self.lines[-1] += data


def main_text(html: str | None) -> dict:
    """Title (social titles first, then the title element, then the first heading), language, and text."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    lines = [re.sub(r"\s+", " ", line).strip() for line in reader.lines]
    kept, short = [], []
    for line in [*(x for x in lines if x), "." * 99]:
        if len(line) < 25:
            short.append(line)
            continue
        if len(short) <= 3:  # a longer run of short lines is a menu
            kept += short
        short = []
        kept.append(line)
    title = reader.meta.get("og:title") or reader.meta.get("twitter:title") or reader.title or reader.heading
    return {"title": re.sub(r"\s+", " ", title).strip(), "lang": reader.lang, "text": "\n".join(kept[:-1])}


_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "lang", "text")])


@F.pandas_udf(_SCHEMA)
def extract(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([main_text(h) for h in html], columns=["title", "lang", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, lang, text) of whole pages."""
    return pages.withColumn("_page", extract("html")).select("page_id", "url", "_page.title", "_page.lang", "_page.text")
