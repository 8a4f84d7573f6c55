"""Pages as tables. A page is parsed once, in the tasks; everything after that is columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import any_of
from ..functions.text import labelled_value
from ..functions.urls import absolute, is_allowed_url

_SKIPPED = {"script", "style", "nav", "footer", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "br", "li", "h1", "h2", "h3", "tr", "section", "article", "ul", "ol"}
_NOISE = ("ad", "comment", "share")


#: Where a page's content is looked for, in this order: an attribute ("tag" for the element's name)
#: and a value that it has among its words. The whole page comes last.
REGIONS = (
    ("tag", "article"), ("tag", "main"), ("role", "main"), ("class", "wiki-content"), ("class", "article-content"), ("class", "detail-content"),
    ("class", "content"), ("id", "content"),
)


def _matches(tag: str, attrs: Mapping[str, str], attribute: str, value: str) -> bool:
    return tag == value if attribute == "tag" else value in attrs.get(attribute, "").split()


class _Page(HTMLParser):
    def __init__(self, regions: Sequence[tuple[str, str]] = REGIONS) -> None:
        super().__init__(convert_charrefs=True)
        self.regions = regions
        # each open element: its tag, whether it hides what it holds, the regions that it is
        self.open: list[tuple[str, bool, tuple[int, ...]]] = []
        self.title, self.heading, self.og, self.canonical = [], [], "", ""
        self.body: list[list[str]] = [[] for _ in range(len(regions) + 1)]
        self.links: dict[str, list[str]] = {}
        self.spare: dict[str, str] = {}
        self.link: str | None = None

    def hidden(self) -> bool:
        return any(h for _, h, _ in self.open)

    def inside(self, tag: str) -> bool:
        return any(t == tag for t, _, _ in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("property") == "og:title":
            self.og = a.get("content", "")
        if tag == "link" and a.get("rel") == "canonical":
            self.canonical = a.get("href", "")
        if tag == "a" and a.get("href"):
            # the first label of an address counts, not all of its links' labels together
            known = "".join(self.links.setdefault(a["href"], [])).strip()
            self.link = None if known else a["href"]
            self.spare.setdefault(a["href"], a.get("title", ""))
        if tag == "img" and self.link is not None:
            self.spare[self.link] = a.get("alt") or a.get("title") or self.spare[self.link]
        if tag in _BLOCKS:
            self.text("\n")
        if tag not in _VOID:
            noisy = any(c in _NOISE for c in a.get("class", "").split()) or a.get("aria-hidden") == "true"
            own = tuple(i for i, r in enumerate(self.regions) if _matches(tag, a, *r))
            self.open.append((tag, tag in _SKIPPED or noisy, own))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        if tag in _BLOCKS:
            self.text("\n")
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def text(self, data: str) -> None:
        if self.hidden():
            return
        for i in {len(self.regions), *(i for _, _, own in self.open for i in own)}:
            self.body[i].append(data)

    def handle_data(self, data: str) -> None:
        if self.inside("title"):
            self.title.append(data)
            return
        if self.inside("h1"):
            self.heading.append(data)
        if self.link is not None:
            self.links[self.link].append(data)
        self.text(data)


def _clean(parts: list[str]) -> str:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def parse(html: str | None) -> dict:
    """title (og:title, else title, else the first heading), canonical URL, text of the first region
    with over 20 characters, links with labels (their text, else their image's, else their title, else
    their address), and whether the page needs rendering."""
    page = _Page()
    page.feed(html or "")
    page.close()
    text = next((t for t in map(_clean, page.body) if len(t) > 20), "")
    title = page.og.strip() or "".join(page.title).strip() or "".join(page.heading).strip()
    links = [{"href": k, "label": " ".join("".join(v).split()) or page.spare[k].strip() or k} for k, v in page.links.items()]
    thin = len(text) < 200 or text.lower().startswith("loading")
    return {"title": title, "canonical": page.canonical, "text": text, "links": links, "needs_render": thin}


def extract_html(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page; a null page has empty fields and needs rendering."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [{key: k} | parse(h) for k, h in zip(pdf[key], pdf[html])]
            yield pd.DataFrame(rows, columns=[key, "title", "canonical", "text", "links", "needs_render"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(
        run, f"{key} {kind}, title string, canonical string, text string, links array<struct<href:string,label:string>>, needs_render boolean"
    )


class _Sections(_Page):
    """Also keeps headings, and the text of noise nodes instead of losing it."""

    def __init__(self, noise: tuple[str, ...]):
        super().__init__()
        self.noise, self.headings, self.notices = noise, [], []
        self.depth = 0
        self.under: dict[str, int] = {}  # how many headings stand before each link

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        if tag in ("h1", "h2", "h3"):
            self.headings.append("")
        if self.link is not None:
            self.under.setdefault(self.link, len(self.headings))
        if tag not in _VOID and set(dict(attrs).get("class", "").split()) & set(self.noise) and not self.depth:
            self.depth = len(self.open)
            self.notices.append("")

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag)
        if self.depth and len(self.open) < self.depth:
            self.depth = 0

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        if self.depth and self.notices:
            self.notices[-1] += data
        elif self.headings and any(self.inside(t) for t in ("h1", "h2", "h3")):
            self.headings[-1] += data


def extract_sections(pages: DataFrame, noise: tuple[str, ...] = ("ad",), key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, kind, value): a page's headings, links and notices (the text of nodes of the noise
    classes, which the other kinds leave out), in one pass over the page."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, h in zip(pdf[key], pdf[html]):
                page = _Sections(noise)
                page.feed(h or "")
                page.close()
                for kind, values in (("heading", page.headings), ("link", page.links), ("notice", page.notices)):
                    rows += [(k, kind, " ".join(v.split())) for v in values if v.strip()]
            yield pd.DataFrame(rows, columns=[key, "kind", "value"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, kind string, value string")


def sections(pages: DataFrame, noise: tuple[str, ...] = ("ad",), key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, title, text, headings, links, notices) of every page, in one pass over it: links with
    their label and section, the heading before them or, before any, the page's title; notices are
    the texts of nodes of the noise classes, which the rest leaves out."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, h in zip(pdf[key], pdf[html]):
                page, plain = _Sections(noise), parse(h)
                page.feed(h or "")
                page.close()
                heads = [" ".join(x.split()) for x in page.headings]
                links = [x | {"section": heads[n - 1] if (n := page.under.get(x["href"], 0)) else plain["title"]} for x in plain["links"]]
                rows.append((k, plain["title"], plain["text"], [x for x in heads if x], links, [" ".join(x.split()) for x in page.notices if x.strip()]))
            yield pd.DataFrame(rows, columns=[key, "title", "text", "headings", "links", "notices"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(
        run, f"{key} {kind}, title string, text string, headings array<string>, links array<struct<href:string,label:string,section:string>>, notices array<string>"
    )


def navigation(rows: DataFrame, key: str, labels: Mapping[str, Iterable[str]], before: Iterable[str], after: Iterable[str]) -> DataFrame:
    """(key, title, a column for each of ``labels``, prerequisites, followups): labelled values of the
    page's text, and the labels of links in sections that come before or after it."""

    def named(words: Iterable[str]) -> Column:
        return F.array_distinct(F.transform(F.filter("links", lambda x: any_of(x["section"], words)), lambda x: x["label"]))

    values = [labelled_value(F.col("text"), names).alias(c) for c, names in labels.items()]
    return rows.select(key, "title", *values, named(before).alias("prerequisites"), named(after).alias("followups"))


def outbound(rows: DataFrame, key: str, url: str, allowed: Mapping[str, Iterable[str]]) -> DataFrame:
    """(key, href, label) of the links, seen from the page's ``url``, that lead to allowed places."""
    each = rows.select(key, url, F.explode("links").alias("_l")).select(key, absolute(F.col("_l.href"), F.col(url)).alias("href"), "_l.label")
    return each.filter(is_allowed_url(F.col("href"), allowed)).distinct()


def keyword_headings(rows: DataFrame, key: str, words: Iterable[str]) -> DataFrame:
    """(key, heading) of the headings that hold one of the words."""
    return rows.select(key, F.explode("headings").alias("heading")).filter(any_of(F.col("heading"), words))


def notices(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.explode("notices").alias("notice"))


class _Stage(HTMLParser):
    """Texts of actors and contents of the lines of a stage, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.lines: list[dict[str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            return
        names = (dict(attrs).get("class") or "").split()
        role = "stage" if tag == "section" and "stage" in names else next((n for n in ("dialog-line", "dialog-actor", "dialog-content") if n in names), "")
        inside = {r for _, r in self.open}
        if role == "dialog-line" and "stage" in inside:
            self.lines.append({})
        if role in ("dialog-actor", "dialog-content") and "dialog-line" in inside and self.lines:
            # of several in a line the first counts
            role = "" if role in self.lines[-1] else role
            if role:
                self.lines[-1][role] = []
        self.open.append((tag, role))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        inside = [r for _, r in self.open]
        if self.lines and "stage" in inside and "dialog-line" in inside:
            for role in ("dialog-actor", "dialog-content"):
                if role in inside and role in self.lines[-1]:
                    self.lines[-1][role].append(data)


_LABELLED = re.compile(r"^([^：:\n]{1,30})[：:]\s*(.+)$")


def dialogue_of(html: str | None, narrators: Sequence[str]) -> list[tuple[str | None, str]]:
    """(speaker, said) of a page's turns: of its stage's lines if it has any with content, else of
    the lines of its text that start with a label. A turn without a speaker, or whose speaker is one
    of ``narrators``, is narration and has none."""
    stage = _Stage()
    stage.feed(html or "")
    stage.close()
    joined = lambda parts: " ".join(" ".join(parts).split())
    found = [(joined(x.get("dialog-actor", [])).rstrip("：:"), joined(x.get("dialog-content", []))) for x in stage.lines]
    found = [x for x in found if x[1]]
    if not found:
        found = [m.groups() for line in parse(html)["text"].split("\n") if (m := _LABELLED.match(line))]
    return [(None if not a.strip() or a.strip() in narrators else a.strip(), said.strip()) for a, said in found]


def dialogue_turns(pages: DataFrame, key: str = "page_id", html: str = "html", narrators: Sequence[str] = ()) -> DataFrame:
    """(key, turn, speaker, kind, said): the turns of each page, from 1; kind is dialogue or narration."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(k, i, a, "narration" if a is None else "dialogue", said) for k, h in zip(pdf[key], pdf[html]) for i, (a, said) in enumerate(dialogue_of(h, narrators), 1)]
            yield pd.DataFrame(rows, columns=[key, "turn", "speaker", "kind", "said"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, turn int, speaker string, kind string, said string")


#: A string, a brace, or what leads to one of them.
_PIECES = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]|[^"{}]+|"', re.S)


def balanced(page: str | None, marker: str) -> str | None:
    """The object that follows a marker, up to the brace that closes it; braces within strings, which
    may hold escaped quotes, don't count. None if there is no whole object."""
    at = (page or "").find(marker)
    start = page.find("{", at + len(marker)) if at >= 0 else -1
    depth = 0
    for piece in _PIECES.finditer(page, start) if start >= 0 else ():
        depth += (piece[0] == "{") - (piece[0] == "}")
        if depth == 0:
            return page[start : piece.end()]
    return None


def embedded_objects(page: Column, marker: str, schema: str) -> Column:
    """The object after a marker in a page, by a schema that may be nested; null if there is none or
    it isn't JSON."""

    @F.arrow_udf("string")
    def scanned(pages: pa.Array) -> pa.Array:
        return pa.array([balanced(x.as_py(), marker) for x in pages], pa.string())

    return F.from_json(scanned(page), schema)


_VIDEO = "videoData struct<title: string, pages: array<struct<page: int, part: string, duration: int>>, subtitle: struct<list: array<struct<lan: string, subtitle_url: string>>>>"


def video_metadata(pages: DataFrame, key: str = "page_id", html: str = "html", marker: str = "window.__INITIAL_STATE__") -> tuple[DataFrame, DataFrame]:
    """Parts (key, title, part, name, seconds) and subtitle tracks (key, track, language, url) of the
    state object that a video's page holds."""
    held = pages.select(key, embedded_objects(F.col(html), marker, _VIDEO)["videoData"].alias("v"))
    parts = held.select(key, F.col("v.title").alias("title"), F.explode("v.pages").alias("p")).select(key, "title", F.col("p.page").alias("part"), F.col("p.part").alias("name"), F.col("p.duration").alias("seconds"))
    tracks = held.select(key, F.posexplode("v.subtitle.list").alias("at", "t")).select(key, (F.col("at") + 1).alias("track"), F.col("t.lan").alias("language"), F.col("t.subtitle_url").alias("url"))
    return parts, tracks
