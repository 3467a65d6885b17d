"""Markdown, links and metadata of HTML pages: a tree of elements, of which the content root is rendered block by block."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

from .urls import canonical

# Elements that are left out whole, that stand alone, that are blocks, whose blocks are their text alone, and code within text.
LEFT_OUT = frozenset("script style noscript svg canvas template".split())
ALONE = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
TEXT_BLOCKS = frozenset("p figcaption caption summary address dt".split())
CODE = frozenset("code kbd samp".split())
MAX_LINKS, TITLE_CHARS = 200, 200
#: What an opening element ends if it is open, and within which it looks for it.
ENDS = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("tr thead tbody tfoot", "table"), "tbody": ("tr thead tbody tfoot caption", "table"), "tfoot": ("tr thead tbody tfoot", "table"), "option": ("option", "select"), "body": ("head", "html")}
#: Addresses that lead to no page.
NOWHERE = re.compile(r"#|(?:javascript|mailto|tel|data):", re.I)


class Node:
    """An element: name, attributes, and what is in it, elements and texts."""

    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def every(self, *tags: str) -> Iterator[Node]:
        """Elements of these names in it, in the page's order."""
        todo: list = [self]
        while todo:
            node = todo.pop()
            if node is not self and (not tags or node.tag in tags):
                yield node
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def first(self, tag: str) -> Node | None:
        return next(self.every(tag), None)

    def text(self, breaks: str = "") -> str:
        """All text in it, ``breaks`` where a line is broken."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag == "br":
                out.append(breaks)
            else:
                todo += reversed(node.kids)
        return "".join(out)


class Tree(HTMLParser):
    """The elements of a page below ``root``; ends that are left out are put where HTML has them."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(page)
        self.close()

    def _end(self, names: str, within: str = "") -> None:
        stop, asked = within.split(), names.split()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in asked:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            self._end(*ENDS[tag])
        elif tag in BLOCKS:  # no paragraph holds a block
            self._end("p", "table button td th li blockquote div section article")
        node = Node(tag, dict(attrs))
        self.open[-1].kids.append(node)
        if tag not in ALONE:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in ALONE and tag in ("svg", "path", "g", "rect", "circle", "use", "line"):  # only foreign elements can be empty by themselves
            self.open.pop()

    def handle_endtag(self, tag):
        self._end(tag)

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def one_line(text: str) -> str:
    return " ".join(text.split())


def absolute(href: str | None, base: str) -> str | None:
    """A web address as a browser writes it out, or none."""
    href = (href or "").strip()
    if not href or NOWHERE.match(href):
        return None
    try:
        parts = urlsplit(urljoin(base, href))
        if parts.scheme not in ("http", "https") or not parts.hostname:
            return None
        safe = "/%:@!$&'()*+,;=~-._?[]|"
        return urlunsplit((parts.scheme, parts.netloc.lower() if parts.netloc.isascii() else parts.netloc.encode("idna").decode(), quote(parts.path, safe) or "/", quote(parts.query, safe), quote(parts.fragment, safe)))
    except (ValueError, UnicodeError):
        return None


class Writer:
    """Markdown of elements of a page with this address."""

    def __init__(self, base: str):
        self.base = base

    def inline(self, kids: list) -> str:
        return "".join(k if isinstance(k, str) else self.within(k) for k in kids)

    def within(self, node: Node) -> str:
        """An element that stands in a line."""
        if node.tag == "br":
            return "\n"
        if node.tag in CODE:
            code = one_line(node.text(breaks="\n"))
            ticks = "`` " if "`" in code else "`"
            return f"{ticks}{code}{ticks[::-1]}" if code else ""
        inner = self.inline(node.kids)
        if node.tag != "a":
            return f" {inner} " if node.tag in BLOCKS else inner
        label, to = one_line(inner), absolute(node.attrs.get("href"), self.base)
        if to is None or not label or label == to:
            return label
        return f"[{label}](<{to}>)" if re.search(r"[()\s]", to) else f"[{label}]({to})"

    def blocks(self, kids: list) -> list[str]:
        """Blocks in order; text and elements between them make blocks of their own."""
        out: list[str] = []
        line: list[str] = []
        for kid in [*kids, None]:
            if isinstance(kid, str):
                line.append(kid)
            elif kid is not None and kid.tag not in BLOCKS:
                line.append(self.within(kid))
            else:
                if text := one_line("".join(line)):
                    out.append(text)
                line = []
                out += self.block(kid) if kid is not None else []
        return out

    def block(self, node: Node) -> list[str]:
        tag = node.tag
        if tag in TEXT_BLOCKS or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = one_line(self.inline(node.kids))
            made = f"{'#' * int(tag[1])} {text}" if text and tag[0] == "h" else text
        elif tag == "blockquote":
            made = "\n".join(f"> {x}" if x else ">" for x in "\n\n".join(self.blocks(node.kids)).split("\n")) if self.blocks(node.kids) else ""
        elif tag == "pre":
            made = self.fence(node)
        elif tag in ("ul", "ol"):
            made = "\n".join(self.items(node))
        elif tag == "dl":
            made = "\n".join(self.definitions(node))
        elif tag == "table":
            return self.table(node)
        else:
            return [] if tag == "hr" else self.blocks(node.kids)
        return [made] if made else []

    def items(self, node: Node) -> list[str]:
        """Lines of a list, what is in an item moved in by the width of its mark."""
        out: list[str] = []
        number = 0
        for kid in node.kids:
            if isinstance(kid, str):
                continue
            if kid.tag in ("ul", "ol"):
                out += [f"  {x}" for x in self.items(kid)]
            elif kid.tag == "li" and (inner := self.blocks(kid.kids)):
                number += 1
                mark = f"{number}. " if node.tag == "ol" else "- "
                first, *more = "\n".join(inner).split("\n")
                out += [mark + first, *(x and " " * len(mark) + x for x in more)]
        return out

    def table(self, node: Node) -> list[str]:
        """Captions, then the rows, filled up to the widest."""
        out, rows = [], []
        todo = list(reversed(node.kids))
        while todo:
            kid = todo.pop()
            if isinstance(kid, str):
                continue
            if kid.tag in ("thead", "tbody", "tfoot"):
                todo += reversed(kid.kids)
            elif kid.tag == "caption" and (said := one_line(self.inline(kid.kids))):
                out.append(said)
            elif kid.tag == "tr" and (cells := [one_line(self.inline(c.kids)).replace("|", r"\|") for c in kid.kids if isinstance(c, Node) and c.tag in ("td", "th")]):
                rows.append(cells)
        if rows:
            width = max(map(len, rows))
            rows.insert(1, ["---"] * width)
            out.append("\n".join("| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows))
        return out

    def definitions(self, node: Node) -> list[str]:
        """A line for the terms that stand together and what is said of them."""
        groups: list[tuple[list[str], list[str]]] = [([], [])]
        todo = list(reversed(node.kids))
        while todo:
            kid = todo.pop()
            if isinstance(kid, str):
                continue
            if kid.tag == "div":
                todo += reversed(kid.kids)
            elif kid.tag in ("dt", "dd"):
                if kid.tag == "dt" and groups[-1][1]:
                    groups.append(([], []))
                groups[-1][kid.tag == "dd"].append(one_line(self.inline(kid.kids)))
        pairs = ((", ".join(filter(None, terms)), "; ".join(filter(None, said))) for terms, said in groups)
        return ["- " + ": ".join(filter(None, pair)) for pair in pairs if any(pair)]

    def fence(self, node: Node) -> str:
        text = node.text(breaks="\n").lstrip("\n").rstrip()
        if not text.strip():
            return ""
        ticks = "```"
        while ticks in text:
            ticks += "`"
        classes = " ".join(n.attrs.get("class") or "" for n in (node, *(k for k in node.kids if isinstance(k, Node) and k.tag == "code")))
        language = re.search(r"(?i)(?:language|lang)-([\w+-]+)", classes)
        return f"{ticks}{language[1].lower() if language else ''}\n{text}\n{ticks}"


def _without(node: Node, tags: frozenset[str]) -> None:
    todo = [node]
    while todo:
        now = todo.pop()
        now.kids = [k for k in now.kids if isinstance(k, str) or k.tag not in tags]
        todo += [k for k in now.kids if isinstance(k, Node)]


def read_page(page: str | None, base: str = "") -> dict:
    """title, markdown, links [(address, title)] and metadata of a page.

    Markdown is of the first main element, else the first article, else the body. Links are of the whole page, menus too, each canonical address once, at most MAX_LINKS.
    """
    tree = Tree(page or "").root
    about = metadata(tree, base)
    _without(tree, LEFT_OUT)
    found = {m.attrs["property"]: (m.attrs.get("content") or "").strip() for m in reversed(list(tree.every("meta"))) if m.attrs.get("property")}
    named = (one_line(n.text()) if (n := tree.first(t)) else "" for t in ("title", "h1"))
    title = found.get("og:title") or next(filter(None, named), base)
    root = tree.first("main") or tree.first("article") or tree.first("body")
    if root is None:  # no body is written out: all that isn't of the head
        root = Node("body", {})
        top = tree.first("html") or tree
        root.kids = [k for k in top.kids if isinstance(k, str) or k.tag not in ("head", "title", "meta", "link", "base")]
    text = "\n\n".join(Writer(base).blocks(root.kids)) or root.text()
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()
    links: dict[str, tuple[str, str]] = {}
    for a in tree.every("a"):
        if len(links) < MAX_LINKS and (to := absolute(a.attrs.get("href"), base)):
            links.setdefault(canonical(to), (to, one_line(a.text())[:TITLE_CHARS]))
    return {"title": title, "markdown": text, "links": list(links.values()), "metadata": about}


_LOOSE = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


def closed_titles(page: str) -> str:
    """A page whose titles have character references only where a semicolon ends them, ``&amp`` of a title that was cut staying as it is; HTML itself reads some without."""
    return re.sub(r"(?is)(<title\b[^>]*>)(.*?)(?=</title>)", lambda m: m[1] + _LOOSE.sub("&amp;", m[2]), page)


def markdown(page: str | None, base: str = "") -> tuple[str, list[str]]:
    """(markdown, canonical links) of a page."""
    read = read_page(page, base)
    return read["markdown"], [canonical(to) for to, _ in read["links"]]


def metadata(tree: Node, base: str = "") -> dict:
    """canonical, author, articleAuthor, publishedTime, modifiedTime, description, language and jsonLd of a page, as far as it tells them."""
    said: dict[tuple[str, str], str] = {}
    for m in tree.every("meta"):
        for by in ("name", "property"):
            if m.attrs.get(by):
                said.setdefault((by, m.attrs[by]), (m.attrs.get("content") or "").strip())
    of = lambda *asked: next((said[a] for a in asked if said.get(a)), None)
    linked = next((n.attrs.get("href") for n in tree.every("link") if n.attrs.get("rel") == "canonical"), None)
    blocks = []
    for n in tree.every("script"):
        if n.attrs.get("type") == "application/ld+json":
            try:
                blocks.append(json.loads(n.text()))
            except ValueError:
                continue
    page = tree.first("html")
    out = {
        "canonical": absolute(linked, base), "author": of(("name", "author")), "articleAuthor": of(("property", "article:author")),
        "publishedTime": of(("property", "article:published_time"), ("name", "date"), ("name", "pubdate")), "modifiedTime": of(("property", "article:modified_time"), ("name", "last-modified")),
        "description": of(("name", "description"), ("property", "og:description")), "language": (page and (page.attrs.get("lang") or "").strip()) or None, "jsonLd": blocks[0] if len(blocks) == 1 else blocks or None,
    }
    return {k: v for k, v in out.items() if v is not None}
