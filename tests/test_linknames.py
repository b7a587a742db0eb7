"""Link names against a plain tree that is walked by recursion."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import linknames as L

from .conftest import SF

TAG = re.compile(r"<!--.*?-->|<(/?)([a-z]+)((?:\s+[a-z]+(?:=\"[^\"]*\")?)*)\s*>|([^<]+)", re.S)


def tree(html):
    """(tag, attributes, children, parent) nodes; texts are strings."""
    root = ["", {}, [], None]
    now = root
    for m in TAG.finditer(html):
        if m[4]:
            now[2].append(m[4])
        elif m[2] and not m[1]:
            node = [m[2], dict(re.findall(r'([a-z]+)="([^"]*)"', m[3])), [], now]
            now[2].append(node)
            if m[2] not in L.VOID:
                now = node
        elif m[2]:
            up = now
            while up is not root and up[0] != m[2]:
                up = up[3]
            if up is not root:
                now = up[3]
    return root


def walk(node):
    for c in node[2]:
        if isinstance(c, list):
            yield c
            yield from walk(c)


def words(node):
    if node[0] in L.SILENT:
        return ""
    return "".join(c.strip() if isinstance(c, str) else words(c) for c in node[2])


def plain(html):
    root = tree(html)
    meta = next((n[1].get("content", "") for n in walk(root) if n[0] == "meta" and n[1].get("name") == "description"), "")
    out = []
    for a in walk(root):
        if a[0] != "a" or "href" not in a[1]:
            continue
        description, up = "", a[3]
        for _ in range(3):
            if up is None:
                break
            marked = next((n for n in walk(up) if n[0] in L.DESCRIBING and re.search("desc|summary|abstract", n[1].get("class", ""), re.I)), None)
            if marked:
                description = words(marked)[:500]
                break
            later = a[3][2][next(i for i, c in enumerate(a[3][2]) if c is a) + 1 :]
            beside = next((n for n in later if isinstance(n, list) and n[0] in L.BESIDE), None)
            if beside and 20 < len(words(beside)) < 1000:
                description = words(beside)[:500]
                break
            up = up[3]
        out.append((words(a)[:200] or a[1].get("title", ""), description or meta[:500]))
    return out


def noise(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if kind < 0.25 or depth > 5:
            out.append(rng.choice(["word ", " a text of more than twenty letters ", "é" * 30, "x" * 1200, "\n "]))
        elif kind < 0.45:
            inner = rng.choice(["Name", "<b>Bold</b> name", "", "<i> </i>", "<img>"])
            out.append(f'<a href="/{rng.choice(["d", "e/f"])}/file-{rng.randint(0, 9)}.pdf"{rng.choice(["", chr(32) + "title=" + chr(34) + "T" + chr(34)])}>{inner}</a>')
        elif kind < 0.55:
            out.append(rng.choice(["<!-- <a href=\"/no\">no</a> -->", "</b>", "</div>", "<br>", "</p>", "<script>var a</script>", "<style>p</style>"]))
        else:
            tag = rng.choice(["p", "div", "span", "li", "dd", "ul", "b"])
            cls = rng.choice(["", "", "", ' class="x-Summary y"', ' class="ad"', ' class="desc"'])
            out.append(f"<{tag}{cls}>" + noise(rng, depth + 1) + rng.choice([f"</{tag}>", f"</{tag}>", f"</{tag}>", ""]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_like_a_plain_tree(spark, seed):
    rng = random.Random(seed)
    pages = [(i, rng.choice(["", '<meta name="description" content="of the page">']) + noise(rng)) for i in range(150)]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit("https://x.gov/a/b.html")).withColumn("name", F.lit(1))
    got = {}
    for r in L.named_links(df.select("page_id", "html", "url")).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.name, r.description))
    checked = 0
    for i, html in pages:
        expected = plain(html)
        assert len(expected) == len(got.get(i, []))
        for (name, description), (n, d) in zip(expected, got.get(i, []), strict=True):
            assert n == (name or n) and re.match(r"File \d$", n if not name else "File 1")
            assert d == (description or d) and (description or d.startswith("Document from x.gov: "))
            checked += 1
    assert checked > 100


def test_names_from_files_and_odd_pages(spark):
    rows = [
        (1, '<a href="Docs/myReport-2024_final.v2.pdf"></a><a name="x">no</a><A HREF=//y.gov/>T &amp; U</A>', "https://x.gov/a/p.html"), (2, None, None), (3, "", "u"), (4, "<a href='http://[bad'>b", "https://x.gov"),
        (5, '<p class="abstract">' + "z" * 700 + '</p><a href="q.pdf" href="r.pdf">' + "n" * 300, "https://x.gov/"), (None, '<a href="s.pdf">s</a>', "https://x.gov/"),
    ]
    got = {(r.page_id, r.pos): (r.link, r.name, r.description, r.filename) for r in L.named_links(spark.createDataFrame(rows, "page_id long, html string, url string")).collect()}
    assert got == {
        (1, 0): ("https://x.gov/a/Docs/myReport-2024_final.v2.pdf", "My Report 2024 Final.V2", "Document from x.gov: a > Docs", "myReport-2024_final.v2.pdf"),
        (1, 1): ("https://y.gov/", "T & U", "Document hosted on y.gov", ""),
        (4, 0): ("http://[bad", "b", "Document hosted on ", ""),
        (5, 0): ("https://x.gov/q.pdf", "n" * 200, "z" * 500, "q.pdf"),
        (None, 0): ("https://x.gov/s.pdf", "s", "Document hosted on x.gov", "s.pdf"),
    }
    assert L.named_links(spark.createDataFrame(rows, "page_id long, html string, url string"), documents_only=True).count() == 3


def test_a_page_of_many_links_takes_no_longer_than_its_links(spark):
    html = "<div>" * 200 + '<a href="/a.pdf">a</a>' * 20_000 + "<p>" + "x" * 100_000
    df = spark.createDataFrame([(1, html, "https://x.gov/")], "page_id long, html string, url string")
    assert L.named_links(df).count() == 20_000


def test_links_of_the_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = L.named_links(pages)
    n = sum(len(re.findall(r"<a\b[^>]*\bhref=", re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", r.html or ""))) for r in pages.collect())
    assert 0.98 * n <= got.count() <= 1.02 * n
