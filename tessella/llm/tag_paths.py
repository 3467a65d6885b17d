"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf path of block elements. Text length and
punctuation are averaged per path, smoothed along the page, multiplied and held against a threshold: the paths above it are content,
with all their blocks. Around them the text is completed by the shape of the page alone: what stands in the same element as a content block,
what lies between the first and the last one unless it is a bar of links, the headings ahead, and such sentences of the elements around whose text is mostly content.
Blocks of elements that are boilerplate by name or role are left out before, articles that call themselves comments or adverts too.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template noembed noframes xmp svg math object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
BOILER = frozenset("aside button dialog footer form header menu nav search select".split())
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: A class or id is one of these roles, as a whole name or as its last word before words for a box: site-header, comment-list.
BOILER_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promotion recommendations recommended related replies respond sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
BOXES = frozenset("area bar block body bottom box button col column container content form frame group holder inner item items left link links list main outer panel right row section slot text top unit wrap wrapper".split())
#: Before a role these say something of the element around it: has-header, no-comments.
STATES = frozenset("has have no not with without hide show is under below above after before pre post".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that hold a piece of running text; what holds them holds the text.
LEAVES = HEADINGS | frozenset("p li dt dd td th tr tbody thead tfoot blockquote pre caption figcaption summary legend address center".split())
#: Elements whose items stand for themselves: their box is what holds the list.
LISTS = frozenset("ul ol dl menu dir table".split())
#: Of a block: an article element says by its name or role that it is an advert, a comment or the like.
ARTICLE = 1
#: A block that is a link for more than this share of its text.
LINKED = 0.7
#: The threshold of main_text().
SHARE = 0.5
#: An open element of the set is closed by the start of one of these.
CLOSED_BY = {
    "p": BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "legend", "figcaption"},
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]),
}
#: An end tag or an implied end doesn't reach beyond these.
FENCE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"]), "p": frozenset(["td", "th", "table"])}

_token = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|[^<]++|<""", re.S)
_attribute = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_name_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_sentence_end = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_punctuation = re.compile(r"[.,;:!?…。，、！？；：]")
_ends = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def _is_role(name: str) -> bool:
    """Whether a class or id names boilerplate: its last word that isn't for a box or a number does, and no word before turns it into a state."""
    words = [w.lower() for w in _name_parts.findall(name)]
    while len(words) > 1 and words[-1] not in BOILER_WORDS and (words[-1] in BOXES or words[-1].isdigit()):
        words.pop()
    return bool(words) and words[-1] in BOILER_WORDS and STATES.isdisjoint(words[:-1])


def _is_boiler(tag: str, raw: str) -> bool:
    if tag in BOILER:
        return True
    if not raw or tag in ("html", "body"):
        return False
    for m in _attribute.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and any(map(_is_role, value.split())):
            return True
        if name == "role" and value.lower() in BOILER_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _hidden.search(value):
            return True
    return False


def blocks(page: str) -> list[tuple[tuple[int, ...], tuple[str, ...], int, str, float]]:
    """(element numbers from the root, tags from the root, in boilerplate, text, share of the text in links) of each block with text.

    In boilerplate is 0 or, if only the name or role of an article or main element says so, ARTICLE, else 2."""
    out: list = []
    stack: list[tuple[str, int, int]] = []  # tag, number, in boilerplate
    inline: list[tuple[str, bool]] = []  # open inline elements that are boilerplate
    text: list[str] = []
    count, linked, in_link, at = 0, 0, False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(_html.unescape("".join(text)).split())
            if whole:
                out.append((tuple(n for _, n, _ in stack), tuple(t for t, _, _ in stack), stack[-1][2] if stack else 0, whole, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def close(tag: str) -> None:
        fence = FENCE.get(tag, frozenset())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                flush()
                del stack[k:]
                return
            if stack[k][0] in fence:
                return

    while m := _token.match(page, at):
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            s = m[0]
            if s[0] != "<" or s == "<":
                if not inline:
                    text.append(s)
                    if in_link:
                        linked += len(s.strip())
            continue
        tag, closing, raw = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if tag in RAW:
            if not closing and not (raw or "").endswith("/"):
                end = _ends[tag].search(page, at)
                at = end.start() if end else len(page)
            if tag == "textarea":
                continue
            text.append(" ")
        elif tag == "br" or tag == "hr":
            text.append(" ")
        elif tag in VOID:
            pass
        elif tag not in BLOCK and tag not in BOILER:
            if tag == "a":
                in_link = not closing
            if closing:
                if inline and inline[-1][0] == tag:
                    inline.pop()
                elif inline and any(t == tag for t, _ in inline):
                    while inline.pop()[0] != tag:
                        pass
            elif inline:
                if not raw.endswith("/"):
                    inline.append((tag, True))
            elif raw and _is_boiler(tag, raw):
                inline.append((tag, True))
        elif closing:
            in_link = False
            inline.clear()
            if tag == "p" and not any(t == "p" for t, _, _ in stack):
                flush()
            else:
                close(tag)
        else:
            in_link = False
            inline.clear()
            flush()
            while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                stack.pop()
            if tag not in ("html", "body") or not any(t == tag for t, _, _ in stack):
                for k in range(len(stack) - 1, -1, -1):  # a list item closes the one it follows, whatever is open in it
                    if tag in CLOSED_BY.get(stack[k][0], ()) and tag in FENCE:
                        del stack[k:]
                        break
                    if stack[k][0] in FENCE.get(tag, ()) or stack[k][0] in ("article", "section", "div", "main", "body"):
                        break
                above = stack[-1][2] if stack else 0
                own = (ARTICLE if tag in ("article", "main") else 2) if _is_boiler(tag, raw) else 0
                count += 1
                in_article = any(t in ("article", "main") for t, _, _ in stack)
                if tag == "header" and own and in_article and not above:
                    own = 0  # its headings and sentences are the article's; the rest of it is held back in main_text()
                stack.append((tag, count, max(above, own)))
    flush()
    return out


def _of_article(block: tuple) -> bool:
    """Whether a block may be of an article: of what stands in an article's header only headings and whole sentences are."""
    return "header" not in block[1] or not HEADINGS.isdisjoint(block[1]) or block[4] <= LINKED and _sentence_end.search(block[3]) is not None


def ratios(found: list) -> dict[tuple[str, ...], float]:
    """The fused ratio of each path of blocks(): mean length, of text outside links, times one more than mean punctuation, each smoothed along the page."""
    sums: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0, 0.0, 0])
    for _, path, _, text, links in found:
        s = sums[path]
        s[0] += 1
        s[1] += len(text) * (1 - links)
        s[2] += len(_punctuation.findall(text))

    def smooth(x: list[float]) -> list[float]:
        return [(x[max(i - 1, 0)] + 2 * x[i] + x[min(i + 1, len(x) - 1)]) / 4 for i in range(len(x))]

    length, marks = smooth([sums[b[1]][1] / sums[b[1]][0] for b in found]), smooth([1 + sums[b[1]][2] / sums[b[1]][0] for b in found])
    fused: dict[tuple[str, ...], float] = defaultdict(float)
    for (_, path, _, _, _), a, b in zip(found, length, marks, strict=True):
        fused[path] += a * b / sums[path][0]
    return fused


def main_text(page: str, share: float = SHARE) -> str:
    """The article's blocks in page order, joined by an empty line; empty if the page has none.

    A path is content if its fused ratio reaches ``share`` of the standard deviation over all blocks, or of the largest one if that is less.
    """
    every = [b for b in blocks(page) if b[2] < 2 and b[1] and "head" not in b[1] and _of_article(b)]
    # an article that calls itself a comment or an advert goes, unless the page has no other sentences
    found = [b for b in every if not b[2]]
    if not any(_punctuation.search(b[3]) and b[4] <= LINKED for b in found):
        found = every
    if not found:
        return ""
    fused = ratios(found)
    each = [fused[b[1]] for b in found]
    least = min(share * pstdev(each), share * max(each))
    heads = [not HEADINGS.isdisjoint(b[1]) for b in found]
    # links without a sentence don't pass, however long what stands around them is
    linked = [b[4] > LINKED and not head and not _punctuation.search(b[3]) for b, head in zip(found, heads, strict=True)]
    passing = [f >= least and f > 0 and not bar for f, bar in zip(each, linked, strict=True)]
    if not any(passing):
        return ""
    # elements that hold a content block directly, and those of whose text content is the most
    near: set[int] = set()
    own: dict[int, int] = defaultdict(int)
    whole: dict[int, int] = defaultdict(int)
    for (elements, path, _, text, _), passes in zip(found, passing, strict=True):
        for n, tag in zip(elements, path, strict=True):
            if tag not in ("html", "body"):
                whole[n] += len(text)
                own[n] += passes * len(text)
        if passes:
            holder = next((n for n, tag in zip(elements[::-1], path[::-1], strict=True) if tag not in LEAVES), None)
            if holder in whole:
                near.add(holder)
    around = {n for n in whole if 2 * own[n] >= whole[n]}
    first, last = passing.index(True), len(passing) - 1 - passing[::-1].index(True)
    kept = []
    for i, (elements, _, _, text, links) in enumerate(found):
        sentence = links <= LINKED and _punctuation.search(text) is not None and not around.isdisjoint(elements)
        kept.append(first <= i <= last or not near.isdisjoint(elements) or sentence)
    # in a box of their own, one that holds no content, links go wherever it stands, and with them a heading that has nothing else below it
    box = lambda b: next((n for n, tag in zip(b[0][::-1], b[1][::-1], strict=True) if tag not in LEAVES and tag not in LISTS), None)
    bars = [bar and box(b) not in near for b, bar in zip(found, linked, strict=True)]
    kept = [k and not bar for k, bar in zip(kept, bars, strict=True)]
    for i in range(len(found) - 2, -1, -1):
        kept[i] = kept[i] or kept[i + 1] and heads[i]
    below = True  # whether what stands below is a heading, or nothing
    for i in range(len(found) - 1, -1, -1):
        if kept[i] and heads[i] and below and i + 1 < len(found) and bars[i + 1]:
            kept[i] = False
        below = heads[i] if kept[i] else below
    return "\n\n".join(b[3] for b, keeps in zip(found, kept, strict=True) if keeps)


def extracted(pages: DataFrame, key: str = "page_id", html: str = "html", share: float = SHARE) -> DataFrame:
    """``pages`` without ``html`` and with text and n_chars, its code points, on a narrow map without a shuffle.

    A null or empty page has an empty text and 0 characters. Rows are independent: repeated ones give equal
    results, null keys stay, an empty table gives an empty table, a very long page is one item of its batch.
    Columns named text or n_chars are replaced; all other columns are kept as they are.
    """
    small_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema), "text string", "n_chars long"])

    def run(batches):
        for batch in batches:
            texts = [main_text(h, share) if h else "" for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.select(*kept, html).mapInArrow(run, schema)


def op9_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of each page, a row for a row; nulls, empty and repeated rows as extracted() says."""
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
