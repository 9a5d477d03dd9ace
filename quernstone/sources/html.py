"""Text of HTML pages: a small tree over the standard parser, then containers, noise and text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the text is looked for, in this order.
CONTAINERS = ["article", "role=main", "main", ".article-content", ".post-content", ".entry-content", ".article", ".post", ".entry", ".content"]
#: Elements that are no text, by tag, role and class.
STRIPPED = frozenset("script style noscript iframe template".split())
NOISE_TAGS = STRIPPED | frozenset("nav header footer aside".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary".split())
NOISE_CLASSES = frozenset(
    "nav navigation navbar nav-menu site-nav global-nav primary-nav secondary-nav footer-nav menu dropdown sub-menu submenu breadcrumb breadcrumbs pagination drawer offcanvas skip-link back-to-top scroll-to-top site-header site-footer global-footer sidebar aside "
    "ad advertisement ad-banner ad-slot ad-container ad-wrapper banner cookie-banner consent-banner cookie-notice cookie-consent promo promotion sponsored donate paywall overlay interstitial outbrain taboola recirc signup sign-up email-capture lead-capture modal popup notification tooltip lightbox age-gate "
    "share social social-share newsletter subscribe subscription widget comments comment related recommended related-posts author-bio post-meta entry-meta reading-time word-count byline dateline syndication toc table-of-contents disclaimer legal legal-notice copyright privacy privacy-policy terms terms-of-service carousel slider sr-only visually-hidden".split()
)
#: Where a page says its date.
DATE_META = [("property", "article:published_time"), ("name", "pubdate"), ("name", "publishdate"), ("name", "date"), ("itemprop", "datePublished"), ("name", "DC.date.issued"), ("name", "citation_date")]
DATE_CLASSES = ["date", "published", "post-date", "entry-date", "article-date"]
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("tag", "attrs", "inner", "classes")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.inner = tag, attrs, []
        self.classes = (attrs.get("class") or "").split()

    def walk(self):
        """This element and all within, in order, without deep recursion."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.inner) if isinstance(x, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.inner)
        return "".join(out)

    def drop(self, unwanted) -> None:
        for node in list(self.walk()):
            node.inner = [x for x in node.inner if isinstance(x, str) or not unwanted(x)]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].inner.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].inner.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].inner.append(data)


def is_noise(node: Node) -> bool:
    a = node.attrs
    if node.tag in NOISE_TAGS or a.get("role") in NOISE_ROLES or "share" in a.get("aria-label", "").lower() or "aria-hidden" in a or "hidden" in a:
        return True
    if any(c in NOISE_CLASSES or re.match(r"(?:ad|sponsor)[-_]", c) for c in node.classes):
        return True
    return bool(re.search(r"\b(?:ad|sponsor)\b", a.get("id", "").lower(), re.ASCII))


def _fits(node: Node, wanted: str) -> bool:
    if wanted.startswith("."):
        return wanted[1:] in node.classes
    if "=" in wanted:
        key, value = wanted.split("=")
        return node.attrs.get(key) == value
    return node.tag == wanted


def read_html(html: str | None, least: int = 100) -> dict:
    """success, title, content, publish_date, error_code, redirect_url of a page."""
    out = dict(success=False, title=None, content=None, publish_date=None, error_code=None, redirect_url=None)
    if not html or not html.strip():
        return out | {"error_code": "EMPTY_HTML"}
    tree = _Tree()
    try:
        tree.feed(html)
        tree.close()
    except Exception:
        return out | {"error_code": "EMPTY_HTML"}
    nodes = list(tree.root.walk())
    for n in nodes:
        if n.tag == "meta" and n.attrs.get("http-equiv", "").lower() == "refresh":
            if m := re.search(r"url\s*=\s*[\"']?(.+?)[\"']?\s*$", n.attrs.get("content", ""), re.I):
                return out | {"error_code": "META_REFRESH", "redirect_url": m.group(1)}
            break
    first = lambda test: next((n for n in nodes if test(n)), None)
    said = lambda key, name: (n.attrs.get("content", "").strip() if (n := first(lambda n: n.tag == "meta" and n.attrs.get(key) == name)) else "")
    inner = lambda tag: (n.text().strip() if (n := first(lambda n: n.tag == tag)) else "")
    title = inner("h1") or said("property", "og:title") or said("name", "twitter:title") or re.sub(r"\s+", " ", inner("title"))
    date = next((v for k, name in DATE_META if (v := said(k, name))), "")
    if not date:
        if stamp := first(lambda n: n.tag == "time" and "datetime" in n.attrs):
            date = stamp.attrs["datetime"].strip()
        else:
            date = next((n.text().strip() for c in DATE_CLASSES if (n := first(lambda n, c=c: c in n.classes)) and n.text().strip()), "")
    tree.root.drop(lambda n: n.tag in STRIPPED)
    nodes = list(tree.root.walk())
    box = None
    for wanted in CONTAINERS:
        node = first(lambda n, w=wanted: n.tag != "#" and _fits(n, w))
        if node and len(node.text().strip()) >= least:
            box = node
            break
    box = box or first(lambda n: n.tag == "body") or tree.root
    box.drop(is_noise)
    text = box.text()
    alts = [f"[图] {a}" for n in box.walk() if n.tag == "img" and (a := n.attrs.get("alt", "").strip())]
    if alts:
        text += "\n\n【配图说明】\n" + "\n".join(alts)
    text = re.sub(r"\s+", " ", text).strip()
    if len(text) < 50 and sum(1 for _ in box.walk()) - 1 < 20:
        return out | {"title": title, "error_code": "REQUIRES_JS"}
    if len(text) < least:
        return out | {"title": title, "error_code": "CONTENT_TOO_SHORT"}
    return out | {"success": True, "title": title, "content": text, "publish_date": date}


FIELDS = "success boolean, title string, content string, publish_date string, error_code string, redirect_url string"


def extract(pages: DataFrame, key: str, html: str, least: int = 100) -> DataFrame:
    """``key`` and what read_html gives; null and empty pages have an error code."""
    kind = pages.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(batches):
        for batch in batches:
            got = [read_html(x, least) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[n] for g in got], pa.bool_() if n == "success" else pa.string()) for n in names]], names=[key, *names])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, {FIELDS}")
