"""Web pages: a section walker over raw HTML, and the crawl's filters.

Browsers render; here pages come as HTML, so the walk is one Arrow-batched pass with the standard library's parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What is skipped, what splits sections, where pages say when they changed, and tags that never have an end.
SKIP = {"script", "style", "nav", "footer", "header", "noscript"}
SPLIT = {"h2", "h3"}
STAMPS = {"article:modified_time", "last-modified", "article:published_time"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    """An element with its children, which are nodes and strings."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def find(self, test) -> Node | None:
        todo = [self]
        while todo:
            node = todo.pop()
            if test(node):
                return node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        return None

    def all(self, *tags: str) -> list[Node]:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if node is not self and node.tag in tags:
                out.append(node)
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        return out

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in ("script", "style"):
                todo += reversed(node.children)
        return squeeze(" ".join(out))


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs) -> None:
        node = Node(tag, dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def table_lines(table: Node) -> str:
    """A line for each row: its first two cells, and the headers of the columns from the third that have a mark.

    A third cell over several columns gives its text instead; header rows and rows without marks give nothing.
    """
    heads = [th.text() for head in table.all("thead") for row in head.all("tr") for th in row.all("th")]
    lines = []
    for row in table.all("tr"):
        cells = row.all("td", "th")
        texts = [squeeze(c.text().replace(" ", "")) for c in cells]
        if not cells:
            continue
        if all(c.tag == "th" for c in cells):
            heads = heads or texts
            continue
        name = " ".join(t for t in texts[:2] if t)
        if not name:
            continue
        span = cells[2].attrs.get("colspan") if len(cells) > 2 else None
        if span and span.isdigit() and int(span) > 1:
            marks = [texts[2]] if texts[2] else []
        else:
            marks = [(heads[i] if i < len(heads) else "") or t for i, t in enumerate(texts) if i > 1 and t]
        if marks:
            lines.append(f"{name}: {', '.join(marks)}")
    return "\n".join(lines)


def page_facts(tree: Tree) -> tuple[str, str | None]:
    """(text of the body, time of the last change that the page's head gives, if any)."""
    body = tree.root.find(lambda n: n.tag == "body") or tree.root
    stamps = [n.attrs.get("content") for n in tree.root.all("meta") if n.attrs.get("property") in STAMPS or n.attrs.get("name") in STAMPS]
    return body.text(), next((s for s in stamps if s), None)


def parsed(html: str | None, references: list[str] | None = None) -> Tree:
    """The tree of a page. Character references are read as browsers do, or only those named, where a semicolon ends them."""
    html = html or ""
    if references is not None:
        html = re.sub(f"&(?!(?:{'|'.join(map(re.escape, references))});)", "&amp;", html)
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree


def page_parts(html: str | None) -> tuple[str, list[tuple[str, str]], list[str]]:
    """(h1, sections, links) of a page. The walk starts at main, article, #content or body, whichever there is."""
    return tree_parts(parsed(html))


def tree_parts(tree: Tree) -> tuple[str, list[tuple[str, str]], list[str]]:
    root = None
    for test in (lambda n: n.tag == "main", lambda n: n.tag == "article", lambda n: n.attrs.get("id") == "content", lambda n: n.tag == "body"):
        root = root or tree.root.find(test)
    root = root or tree.root
    sections, heading, parts = [], "", []
    todo: list = list(reversed(root.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if t := squeeze(node):
                parts.append(t)
        elif node.tag in SPLIT:
            if t := squeeze(" ".join(parts)):
                sections.append((heading, t))
            heading, parts = node.text(), []
        elif node.tag == "table":
            if t := table_lines(node):
                parts.append(t)
        elif node.tag not in SKIP:
            todo += reversed(node.children)
    if t := squeeze(" ".join(parts)):
        sections.append((heading, t))
    h1 = tree.root.find(lambda n: n.tag == "h1")
    links = [a.attrs["href"] for a in tree.root.all("a") if a.attrs.get("href")]
    return h1.text() if h1 else "", sections, links


PAGE = "page_id long, url string, h1 string, text string, sections array<struct<heading:string,text:string>>, links array<string>, page_timestamp string, _error string"


def walk_pages(pages: DataFrame, references: list[str] | None = None) -> DataFrame:
    """(page_id, url, h1, text, sections, links, page_timestamp, _error) of pages (page_id, url, html).

    A null page has no sections. A page that can't be read has a message in _error and nothing else. With `references` only
    these character references are decoded (`parsed`). Pages are dealt out by hash first: a small file of many pages is one
    task's otherwise, which walks them all.
    """
    spark = pages.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def facts(html: str | None) -> tuple:
        try:
            tree = parsed(html, references)
            return *tree_parts(tree), *page_facts(tree), None
        except Exception as e:  # one bad page must not lose the batch
            return "", [], [], "", None, str(e) or type(e).__name__

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())]))
        for batch in batches:
            h1, sections, links, text, stamp, error = zip(*map(facts, batch.column(2).to_pylist())) if len(batch) else [()] * 6
            sections = pa.array([[{"heading": h, "text": t} for h, t in s] for s in sections], kind)
            strings = [pa.array(x, pa.string()) for x in (h1, text, stamp, error)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), strings[0], strings[1], sections, pa.array(links, pa.list_(pa.string())), *strings[2:]], ["page_id", "url", "h1", "text", "sections", "links", "page_timestamp", "_error"])

    return pages.select("page_id", "url", "html").repartition(tasks, "page_id", "url").mapInArrow(walk, PAGE)


def allowed(url: Column, hosts: list[str], prefixes: list[str], denied: list[str]) -> Column:
    """Whether a link has an allowed scheme, host and path prefix and no denied part."""
    scheme, host, path = (F.try_parse_url(url, F.lit(part)) for part in ("PROTOCOL", "HOST", "PATH"))
    path = F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path)
    good = scheme.isin("http", "https") & F.lower(host).isin(hosts)
    if prefixes:
        start = F.lit(False)
        for p in prefixes:
            start = start | path.startswith(p)
        good = good & start
    for d in denied:
        good = good & ~url.contains(d)
    return F.coalesce(good, F.lit(False))


def crawl_queue(lists: list[DataFrame], most: int = 60) -> DataFrame:
    """(url, seq) of links (url, at) from the root, the seeds and the listed pages, each once, the first `most`.

    The order is that in which links are first seen: list by list, and within a list by `at`.
    """
    both = None
    for i, df in enumerate(lists):
        one = df.select("url", F.struct(F.lit(i).alias("list"), F.col("at").cast("long").alias("at")).alias("_at"))
        both = one if both is None else both.unionByName(one)
    first = both.groupBy("url").agg(F.min("_at").alias("_at"))
    top = first.orderBy("_at", "url").limit(most)  # at most `most` rows go on
    return top.select("url", F.row_number().over(Window.orderBy("_at", "url")).alias("seq"))


def long_enough(pages: DataFrame, least: int = 100) -> DataFrame:
    return pages.where(F.length("text") > least)


def with_more_sections(pages: DataFrame, more: DataFrame) -> DataFrame:
    """Sections of a page's further views (url, view, sections), in order of the views, after its own."""
    views = F.array_sort(F.collect_list(F.struct("view", "sections")))  # the views of one page
    extra = more.groupBy("url").agg(F.flatten(F.transform(views, lambda v: v["sections"])).alias("_more"))
    joined = pages.join(extra, "url", "left")
    return joined.withColumn("sections", F.when(F.col("_more").isNull(), F.col("sections")).otherwise(F.concat("sections", "_more"))).drop("_more")
