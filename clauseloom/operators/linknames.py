"""Names and descriptions of the links of pages, from the elements around them.

A Python table function reads the tags of a page once, with a stack of the elements that are open, and is joined laterally, so a page gives
its links where it stands. Elements are numbered in the order of their begin tags; an element's inside is a range of those numbers and of the page's
texts, so what stands in or beside an element is found by bisection, however many links a page has.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: elements without an end tag, and where descriptions stand --------------------------------
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
DESCRIBING = {"p", "dd", "span", "div"}
BESIDE = {"p", "span", "div"}
DESCRIBED = re.compile("desc|summary|abstract", re.I)
LEVELS, SHORTEST, LONGEST, KEPT, NAME, DESCRIPTION = 3, 20, 1000, 500, 200, 1000
# ----------------------------------------------------------------------------------------------------------


class _Page(HTMLParser):
    """Elements as numbers: 0 is the page, others come in the order of their begin tags."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.end, self.first_text, self.last_text = [-1], [0], [0], [0]
        self.texts: list[str] = []
        self.described: list[int] = []
        self.beside: dict[int, list[int]] = {}
        self.links: list[tuple[int, dict]] = []
        self.meta: str | None = None
        self.open, self.names = [0], [""]
        self.feed(html)
        self.close()
        while self.open:
            self._shut()

    def _shut(self) -> None:
        i = self.open.pop()
        self.names.pop()
        self.end[i], self.last_text[i] = len(self.parent), len(self.texts)

    def handle_starttag(self, tag, attrs):
        given = {}
        for name, value in attrs:
            given.setdefault(name, value or "")
        i, above = len(self.parent), self.open[-1]
        self.parent.append(above)
        self.end.append(0)
        self.first_text.append(len(self.texts))
        self.last_text.append(0)
        if tag in DESCRIBING and any(DESCRIBED.search(c) for c in (*given.get("class", "").split(), given.get("class", ""))):
            self.described.append(i)
        if tag in BESIDE:
            self.beside.setdefault(above, []).append(i)
        if tag == "a" and "href" in given:
            self.links.append((i, given))
        if tag == "meta" and given.get("name") == "description" and self.meta is None:
            self.meta = given.get("content", "")
        self.open.append(i)
        self.names.append(tag)
        if tag in VOID:
            self._shut()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._shut()

    def handle_endtag(self, tag):
        if tag in self.names[1:]:
            while self.names[-1] != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        if data.strip() and not SILENT & set(self.names):
            self.texts.append(data.strip())

    def text(self, i: int, most: int) -> str:
        out, size = [], 0
        for t in self.texts[self.first_text[i] : self.last_text[i]]:
            out.append(t)
            size += len(t)
            if size > most:
                break
        return "".join(out)

    def description(self, link: int) -> str:
        after = self.beside.get(self.parent[link], [])
        at = bisect_left(after, self.end[link])
        near = self.text(after[at], LONGEST) if at < len(after) else ""
        i = self.parent[link]
        for _ in range(LEVELS):
            if i < 0:
                break
            k = bisect_right(self.described, i)
            if k < len(self.described) and self.described[k] < self.end[i]:
                return self.text(self.described[k], KEPT)[:KEPT]
            if SHORTEST < len(near) < LONGEST:
                return near[:KEPT]
            i = self.parent[i]
        return ""


def _title(name: str) -> str:
    plain = re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub(r"[-_]+", " ", re.sub(r"(?<=.)\.[^.]*$", "", name)))
    return plain.strip().title()


class _Links:
    def eval(self, html: str, base: str):
        page = _Page(html or "")
        for n, (i, given) in enumerate(page.links):
            try:
                url = urljoin(base or "", given["href"].strip())
                parts = urlparse(url)
            except ValueError:  # an address that is none
                url, parts = given["href"], urlparse("")
            filename = parts.path.rsplit("/", 1)[-1]
            name = page.text(i, NAME) or given.get("title", "") or _title(filename)
            description = page.description(i) or (page.meta or "")[:KEPT]
            if not description:
                above = [p for p in parts.path.split("/") if p and p != filename]
                description = f"Document from {parts.netloc}: {' > '.join(above[-3:])}" if above else f"Document hosted on {parts.netloc}"
            yield n, url, name[:NAME] or filename, description[:DESCRIPTION], filename


def named_links(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", documents_only: bool = False) -> DataFrame:
    """(key, pos, link, name, description, filename) of each link of a page, in order.

    The name is the link's text, else its title, else its file name in words. The description is the text of the first element marked as description, summary or
    abstract within the three elements around the link, or of the next paragraph or block beside it if that has 21 to 999 characters, whichever level shows
    one first; else the page's own description, else the path. Links without an address are left out; a page without any
    has no rows. End tags close what is open inside, those without a begin tag do nothing, comments and scripts are no text.
    """
    from ..functions import text as X

    table = F.udtf(_Links, returnType="pos int, link string, name string, description string, filename string")
    source = pages.select(F.col(key).alias(key), F.col(html).cast("string").alias("_html"), F.col(url).cast("string").alias("_url"))
    out = source.lateralJoin(table(F.col("_html").outer(), F.col("_url").outer())).drop("_html", "_url")
    return out.where(X.document_url(F.col("link"))) if documents_only else out
