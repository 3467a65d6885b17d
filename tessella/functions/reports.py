"""Reports and notes: sentences about their own making, citations bound to sources, source lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CAVEAT, CAVEAT_CHARS, CAVEAT_CONTEXT, CONCESSION, KEPT_BRACKETS, NON_EVIDENCE, NOTE_LEADS

_caveat, _context, _aside, _leads, _kept, _no_evidence = (re.compile(p, re.I) for p in (CAVEAT, CAVEAT_CONTEXT, CONCESSION, NOTE_LEADS, KEPT_BRACKETS, NON_EVIDENCE))
_left_over = re.compile(r"\b(?:PLACEHOLDER[_A-Za-z0-9]*|TODO|FIXME|XXX)\b", re.A)
#: Lines that stay as they are: headings, tables, quotes and items of lists.
_structure = re.compile(r"\s*(?:#|\||[-*>]\s|\d+[.)]\s)")


def about_process(sentence: str) -> bool:
    """Whether a sentence tells what the search couldn't do rather than what was found."""
    return bool(_caveat.search(sentence) and _context.search(sentence))


def sentences_without(text: str, drop: Callable[[str], bool]) -> str:
    return " ".join(s for s in re.split(r"(?<=[.!?])\s+", text) if not drop(s))


def without_process_caveats(report: str) -> str:
    """A report without placeholders, asides and shorter sentences about its own making; what isn't running text keeps them."""
    short = lambda s: len(s.strip()) < CAVEAT_CHARS and about_process(s)
    lines = _aside.sub("", _left_over.sub("", report)).split("\n")
    text = "\n".join(x if _structure.match(x) else sentences_without(x, short) for x in lines)
    for pattern, by in ((r"[ \t]{2,}", " "), (r" +([.,;:])", r"\1"), (r"\n{3,}", "\n\n")):
        text = re.sub(pattern, by, text)
    return text.strip()


def without_caveats(note: str) -> str:
    """A note as a report takes it: without its mark, the marks of sources and the sentences about leads or about the search itself."""
    plain = re.sub(r"(?i)\[(?:source_[^\]]*|note)\]", "", re.sub(r"^[-*]\s*", "", note))
    return re.sub(r"\s{2,}", " ", sentences_without(plain, lambda s: bool(_leads.search(s)) or about_process(s))).strip()


def _loose(inner: str) -> bool:
    """Whether brackets around this cite something that isn't bound: a source by its mark, or an author and a year."""
    if re.fullmatch(r"[\d\s,;&–-]+", inner) or not re.search("[A-Za-z]", inner):
        return False
    if re.search(r"(?i)\bsource[_-]", inner):
        return True
    return not _kept.match(inner) and bool(re.match("[A-Z]", inner) and re.search(r"(?:19|20)\d{2}[a-z]?\b", inner) and re.search("[A-Za-z]{3,}", inner))


def _numbered(order: list) -> Callable[[object], str]:
    """Marks by first appearance, which ``order`` collects."""

    def mark(name: object) -> str:
        if name not in order:
            order.append(name)
        return f"[{order.index(name) + 1}]"

    return mark


def _tidy(text: str) -> str:
    return re.sub(r" +([.,;:)])", r"\1", re.sub(" {2,}", " ", text)).strip()


def _with_sources(text: str, cited: Sequence[tuple[str, str]]) -> str:
    lines = [f"{i}. [{title}]({url})" for i, (title, url) in enumerate(cited, 1)]
    return "\n".join([text, "", "## Sources", "", *lines]) if lines else text


def renumbered(draft: str, known: Mapping[str, tuple[str, str, Sequence[str]]]) -> tuple[str, list[str], list[str]]:
    """(report, sources in order, unknown sources) of a draft: marks numbered by first appearance, with a list of titles and addresses.

    ``known`` has (title, url, warnings). A source whose warnings say that it is no evidence loses its marks, as unknown ones do; brackets with an author and a year, which cite
    nothing, go too, tables, figures, pages and the like stay.
    """
    order: list[str] = []
    unknown: dict[str, None] = {}
    mark = _numbered(order)

    def bound(m: re.Match) -> str:
        name = f"source_{m[1]}"
        if name not in known:
            unknown[name] = None
            return ""
        return "" if any(_no_evidence.search(w) for w in known[name][2]) else mark(name)

    text = re.sub(r"\[source_([^\]]+)\]", bound, draft)
    text = re.sub(r"\[([^\]\n]{1,80})\](?!\()", lambda m: "" if _loose(m[1].strip()) else m[0], text)
    text = _tidy(re.sub(r"\(?\bsource_\d+\b\)?", "", text))
    return _with_sources(text, [known[s][:2] for s in order]), order, list(unknown)


def roster_bound(text: str, roster: Sequence[tuple[str, str]]) -> tuple[str, list[int], list[str]]:
    """(report, places in the roster in order, marks beyond it) of a merged report whose sources are (title, url).

    A link to a source of the roster becomes its label and the source's mark; marks are numbered anew by first appearance, and those beyond the roster go.
    """
    place: dict[str, int] = {}
    for i, (_, url) in enumerate(roster, 1):
        place.setdefault(url, i)
    if urls := sorted(filter(None, place), key=len, reverse=True):
        link = re.compile(rf"\[([^\]]+)\]\(({'|'.join(map(re.escape, urls))})\)")
        text = link.sub(lambda m: f"{m[1]} [{place[m[2]]}]", text)
    order: list[int] = []
    beyond: dict[str, None] = {}
    mark = _numbered(order)

    def numbered(m: re.Match) -> str:
        n = int(m[1])
        if 1 <= n <= len(roster):
            return mark(n)
        beyond[f"source_{n}"] = None
        return ""

    bound = _tidy(re.sub(r"\[(\d+)\](?!\()", numbered, text, flags=re.A))
    return _with_sources(bound, [roster[n - 1] for n in order]), order, list(beyond)


def without_sources_section(report: Column) -> Column:
    """A report up to its first heading of sources or references."""
    return F.regexp_replace(F.regexp_replace(report, r"(?is)\n#{1,6}\s*(?:sources|references)(?![A-Za-z0-9_]).*$", ""), r"\s+$", "")
