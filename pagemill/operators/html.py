"""HTML to columns: one parse of a page gives every extractor its raw material.

Spark has no HTML expressions, so this is an Arrow UDF, called once for a row;
what can be an expression (joining lines, choosing a description) is one.

The tree follows the common lenient reading of HTML: an end tag closes up to the
nearest open element of its name or is ignored, void elements close themselves,
no end tags are implied, the last of repeated attributes counts. A node is
removed if it or an ancestor is a bloat element or has a noise class or id;
extractors read either all nodes or the nodes that are left, so the order of
extractors becomes a choice of columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements and class or id words that are no content; where content is looked for.
BLOAT = frozenset({"script", "style", "nav", "header", "footer", "aside", "form", "iframe", "noscript"})
POOLED_BLOAT = frozenset({"script", "style", "nav", "header", "footer", "aside"})
NOISE = re.compile(r"\b(?:ads?|advertisement|banner|promo|sponsor|popup|modal|cookie|newsletter|sidebar|social|share|comments?|related|recommended)\b", re.I)
CONTENT = re.compile("content|article|post|entry", re.I)
CONTENT_CLASSES = frozenset({"content", "article", "post", "entry"})
# End of fixed values.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer", "keygen", "menuitem"})
#: Text below these is not text of the page.
APART = frozenset({"script", "style", "template", "rt", "rp"})


class Node:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.children, self.parent = name, attrs, [], parent


class Note(str):
    """Text of a comment or a declaration."""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while True:
            name = self.at.name
            self.open[name] -= 1
            self.at = self.at.parent
            if name == tag:
                return

    def _text(self, text):
        last = self.at.children
        if last and type(last[-1]) is str and type(text) is str:
            last[-1] += text
        else:
            last.append(text)

    def handle_data(self, data):
        self._text(data)

    def handle_comment(self, data):
        self._text(Note(data))

    handle_decl = unknown_decl = handle_pi = handle_comment


def tree(html: str) -> Node:
    b = _Builder()
    try:
        b.feed(html)
        b.close()
    except (AssertionError, ValueError):  # markup that the tokenizer gives up on: what came before counts
        pass
    return b.root


def walk(node: Node) -> Iterator[Node]:
    """Elements below a node in document order, without recursion."""
    stack = [iter(node.children)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, Node):
                yield x
                stack.append(iter(x.children))
                break
        else:
            stack.pop()


def is_noise(node: Node) -> bool:
    classes = node.attrs.get("class", "").split()
    return any(map(NOISE.search, classes)) or bool(NOISE.search(" ".join(classes))) or bool(NOISE.search(node.attrs.get("id", "")))


def kept(root: Node, bloat=BLOAT, noise: bool = True) -> list[Node]:
    """The elements that are left when bloat and noise are gone, in document order."""
    out, stack = [], [iter(root.children)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, Node) and x.name not in bloat and not (noise and is_noise(x)):
                out.append(x)
                stack.append(iter(x.children))
                break
        else:
            stack.pop()
    return out


def texts(node: Node, left: set[int]) -> list[str]:
    """Texts below a node as they stand, of elements in left."""
    out, stack = [], [iter(node.children)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, Node):
                if id(x) in left and x.name not in APART:
                    stack.append(iter(x.children))
                    break
            elif type(x) is str:
                out.append(x)
        else:
            stack.pop()
    return out


def strings(node: Node, left: set[int]) -> list[str]:
    """Stripped texts below a node, of elements in left."""
    return [s for x in texts(node, left) if (s := x.strip())]


def _split(parts: list[str]) -> list[str]:
    return [s for p in parts for x in p.split("\n") if (s := x.strip())]


def first(nodes: list[Node], *tests) -> Node | None:
    for test in tests:
        for n in nodes:
            if test(n):
                return n
    return None


def content_element(nodes: list[Node], profile: str) -> Node | None:
    named = lambda x: lambda n: n.name == x
    classes = lambda n: n.attrs.get("class", "").split()
    like = lambda n: any(map(CONTENT.search, classes(n))) or bool(CONTENT.search(" ".join(classes(n))))
    tests = {
        "static": (named("article"), named("main"), like, lambda n: bool(CONTENT.search(n.attrs.get("id", ""))), named("body")),
        "rendered": (named("article"), named("main"), lambda n: not CONTENT_CLASSES.isdisjoint(classes(n)) or n.attrs.get("class") in CONTENT_CLASSES, named("body")),
        "pooled": (named("article"), named("main"), named("body")),
    }[profile]
    return first(nodes, *tests)


def content_lines(root: Node, nodes: list[Node], profile: str) -> tuple[list[str], bool]:
    """(lines, whether there was no content element and the whole tree was taken)."""
    left, main = {id(n) for n in nodes}, content_element(nodes, profile)
    if main is not None:
        return _split(strings(main, left)), False
    return ([], True) if profile == "pooled" else (strings(root, left), True)


def only_string(node: Node | None) -> str | None:
    """The text of an element with that one child, or of its only child."""
    while isinstance(node, Node):
        if len(node.children) != 1:
            return None
        node = node.children[0]
    return None if node is None else str(node)


def resolve(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:  # a broken address stays as it is written
        return href


def _distinct(links: Iterator[str]) -> list[str]:
    return sorted(set(links))


PAGE = (
    "title string, metas array<struct<name:string,property:string,content:string>>, lines array<string>, fallback boolean, links_all array<string>, links_kept array<string>, "
    "images_all array<string>, images_kept array<string>, json_ld array<string>, rendered_lines array<string>, rendered_fallback boolean, rendered_links_kept array<string>, rendered_images_kept array<string>, pooled_lines array<string>, pooled_links array<string>, texts array<string>"
)
FIELDS = tuple(x.split()[0] for x in re.sub(r"<[^>]*>+", "", PAGE).split(", "))


def parse_page(html: str | None, url: str | None, want: frozenset[str] = frozenset(FIELDS)) -> dict | None:
    """The fields of PAGE that are wanted, null for null or empty html."""
    if not html:
        return None
    root, base, out = tree(html), url or "", {}
    nodes = list(walk(root))
    if "title" in want:
        out["title"] = only_string(first(nodes, lambda n: n.name == "title"))
    if "metas" in want:
        out["metas"] = [{"name": n.attrs.get("name", "").lower(), "property": n.attrs.get("property", "").lower(), "content": n.attrs.get("content", "")} for n in nodes if n.name == "meta"]
    if "json_ld" in want:
        out["json_ld"] = [s for n in nodes if n.name == "script" and n.attrs.get("type") == "application/ld+json" and (s := only_string(n)) is not None]
    links = lambda ns: _distinct(resolve(base, n.attrs["href"]) for n in ns if n.name == "a" and "href" in n.attrs)
    images = lambda ns: _distinct(resolve(base, n.attrs["src"]) for n in ns if n.name == "img" and "src" in n.attrs)
    if "links_all" in want:
        out["links_all"] = links(nodes)
    if "images_all" in want:
        out["images_all"] = images(nodes)
    if want & {"lines", "fallback", "links_kept", "images_kept"}:
        left = kept(root)
        out["lines"], out["fallback"] = content_lines(root, left, "static")
        out["links_kept"], out["images_kept"] = links(left), images(left)
    if "texts" in want:  # of the static content element, or of the whole tree, neither stripped nor split
        left = kept(root)
        out["texts"] = texts(content_element(left, "static") or root, {id(n) for n in left})
    if want & {"rendered_lines", "rendered_fallback", "rendered_links_kept", "rendered_images_kept"}:
        left = kept(root, noise=False)
        out["rendered_lines"], out["rendered_fallback"] = content_lines(root, left, "rendered")
        out["rendered_links_kept"], out["rendered_images_kept"] = links(left), images(left)
    if want & {"pooled_lines", "pooled_links"}:
        left = kept(root, POOLED_BLOAT, noise=False)
        out["pooled_lines"] = content_lines(root, left, "pooled")[0]
        out["pooled_links"] = [n.attrs["href"] for n in left if n.name == "a" and n.attrs.get("href", "").startswith("http")]
    return out


def parsed(pages: DataFrame, *fields: str, html: str = "html", url: str = "url", out: str = "page") -> DataFrame:
    """pages and a struct column of the wanted fields of PAGE. Each page is parsed
    once, for those fields only; filters on other columns are best put before."""
    want = frozenset(fields) or frozenset(FIELDS)
    schema = ", ".join(x for x in re.split(r", (?![^<]*>)", PAGE) if x.split()[0] in want)

    @F.pandas_udf(_struct(schema))
    def parse(htmls, urls):
        import pandas as pd

        names = [x for x in FIELDS if x in want]
        rows = [parse_page(h, u, want) for h, u in zip(htmls, urls)]
        return pd.DataFrame({n: [None if r is None else r[n] for r in rows] for n in names}, index=htmls.index)

    return pages.withColumn(out, parse.asNondeterministic()(F.col(html), F.col(url)))


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def without_repeats(lines: Column) -> Column:
    """Lines that differ from the one before."""
    return F.filter(lines, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(lines, i - 1)))


def whole_texts(page: str = "page") -> Column:
    """The page's texts that are not blank, each in one piece, without blanks, tabs and line ends at its ends."""
    return F.filter(F.transform(F.col(f"{page}.texts"), lambda t: F.btrim(t, F.lit(" \n\t\r"))), lambda t: t != "")


def clean_text(page: str = "page") -> Column:
    """Text of the content element: lines without repeats, a blank line between; of
    the whole tree, line by line, where there is no content element."""
    lines = F.col(f"{page}.lines")
    return F.when(F.col(f"{page}.fallback"), F.array_join(lines, "\n")).otherwise(F.array_join(without_repeats(lines), "\n\n"))


def rendered_text(page: str = "page") -> Column:
    lines = F.col(f"{page}.rendered_lines")
    return F.when(F.col(f"{page}.rendered_fallback"), F.array_join(lines, "\n")).otherwise(F.array_join(lines, "\n\n"))


def pooled_text(page: str = "page") -> Column:
    return F.array_join(F.col(f"{page}.pooled_lines"), "\n")


def _meta(page: str, test) -> Column:
    return F.try_element_at(F.filter(F.col(f"{page}.metas"), test), F.lit(-1)).getField("content")


def _named(page: str, name: str) -> Column:
    return _meta(page, lambda m: m["name"] == name)


def metadata(page: str = "page") -> Column:
    """struct(title, description, keywords, author, published_date, og_data,
    twitter_data); of repeated metas the last counts."""
    metas = F.col(f"{page}.metas")
    plain = ("description", "keywords", "author")

    def last_of(field: str, prefix: str) -> Column:
        own = F.filter(metas, lambda m: m[field].startswith(prefix))
        keys = F.array_distinct(F.transform(own, lambda m: m[field]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.try_element_at(F.filter(own, lambda m: m[field] == k), F.lit(-1)).getField("content")))

    return F.struct(
        F.col(f"{page}.title").alias("title"),
        *[_named(page, n).alias(n) for n in plain],
        _meta(page, lambda m: ~m["name"].isin(*plain) & (m["name"].contains("date") | m["name"].contains("published"))).alias("published_date"),
        last_of("property", "og:").alias("og_data"),
        last_of("name", "twitter:").alias("twitter_data"),
    )


def rendered_metadata(page: str = "page") -> Column:
    return F.struct(
        F.col(f"{page}.title").alias("title"),
        _named(page, "description").alias("description"),
        _meta(page, lambda m: (m["name"] != "description") & (m["property"] == "og:title")).alias("og_title"),
        _meta(page, lambda m: (m["name"] != "description") & (m["property"] == "og:description")).alias("og_description"),
    )


def json_ld(page: str = "page") -> Column:
    """The JSON-LD blocks that are valid, as variants."""
    return F.filter(F.transform(F.col(f"{page}.json_ld"), lambda s: F.try_parse_json(s)), lambda v: v.isNotNull())


#: What each kind of content needs of a parse.
_NEEDS = {"clean_text": ("lines", "fallback"), "full_html": (), "metadata": ("title", "metas"), "links": ("links_all", "links_kept"), "images": ("images_all", "images_kept"), "structured": ("json_ld",)}


def scrape(pages: DataFrame, types: tuple[str, ...] = ("clean_text", "metadata"), method: str = "static", keep: tuple[str, ...] = (), text: Callable[[Column], Column] | None = None) -> DataFrame:
    """url, title, content, metadata, links, images, structured_data, status_code of
    captured pages (url, html[, status_code]), and the columns of keep as they are.

    Extractors count in the order of types: what comes after clean_text sees only
    what that left, so links lose those of the navigation and there is no JSON-LD;
    of clean_text and full_html the last one is the content. Pages without html
    have url and status alone. method 'rendered' reads pages as after a browser:
    no noise rules, no JSON-LD, status 200. text makes the clean text of
    whole_texts in place of the method's.
    """
    unknown = set(types) - set(_NEEDS)
    if unknown:
        raise ValueError(f"unknown content types: {sorted(unknown)}")
    need = {f for t in types for f in _NEEDS[t]}
    if method == "rendered":
        need = {"links_all" if f == "links_kept" else f for f in need if f not in ("lines", "fallback", "json_ld", "images_kept")}
        need |= {"rendered_lines", "rendered_fallback", "rendered_links_kept", "rendered_images_kept"} if "clean_text" in types else set()
    if text and "clean_text" in types:
        need = need - {"lines", "fallback", "rendered_lines", "rendered_fallback"} | {"texts"}
    status = F.col("status_code") if "status_code" in pages.columns else F.lit(200)
    if method == "rendered":
        status = F.when(F.coalesce(F.col("html"), F.lit("")) == "", 0).otherwise(200)
    x = pages.select("url", "html", status.cast("int").alias("status_code"), *keep)
    x = parsed(x, *sorted(need)) if need else x.withColumn("page", F.lit(None).cast("struct<title:string>"))
    cleaned = types.index("clean_text") if "clean_text" in types else len(types)
    after = lambda t: t in types and types.index(t) > cleaned
    field = lambda t: f"page.{'rendered_' * (method == 'rendered')}{t}_kept" if after(t) else f"page.{t}_all"
    null = lambda t: F.lit(None).cast(t)
    content = [t for t in types if t in ("clean_text", "full_html")]
    has = F.coalesce(F.col("html"), F.lit("")) != ""
    if text and "clean_text" in types:  # a column first, as what is made of it reads it again and again
        x = x.withColumn("_whole", whole_texts())
        cleaned_text = text(F.col("_whole"))
    else:
        cleaned_text = clean_text() if method == "static" else rendered_text()
    strings_ = "array<string>"
    meta = (metadata() if method == "static" else rendered_metadata()) if "metadata" in types else null("struct<title:string>")
    structured = null("array<variant>")
    if "structured" in types and method == "static":
        structured = json_ld() if not after("structured") else F.array().cast("array<variant>")
    return x.select(
        "url",
        (F.when(has, F.col("page.title")) if "metadata" in types else null("string")).alias("title"),
        (F.when(has, F.col("html") if content[-1] == "full_html" else cleaned_text) if content else null("string")).alias("content"),
        F.when(has, meta).alias("metadata"),
        (F.when(has, F.col(field("links"))) if "links" in types else null(strings_)).alias("links"),
        (F.when(has, F.col(field("images"))) if "images" in types else null(strings_)).alias("images"),
        F.struct(F.when(has, structured).alias("json_ld"), F.when(has & F.lit("structured" in types), F.array().cast(strings_)).alias("microdata")).alias("structured_data"),
        "status_code",
        *keep,
    )
