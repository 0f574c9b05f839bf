"""Main text of web pages by consensus of each host's pages.

1. A task parses a page to a light tree. What is never main text (menus, headers,
   footers, asides, scripts, elements that are hidden or whose role says so) is marked.
   A class, an id or a form only hints at it: such an element is none of the text unless
   it holds the page's main element, its largest article or its title, or over half
   of its text where no article or main element lies outside hints. Comments and what is
   hidden stay out, unless nothing would be left. Every remaining text block gives its length, less what is in links, to
   the containers around it, less the further out they are, to half of it; the
   container with the highest score, or the ``article`` or ``main`` around it, is the
   page's candidate. It is widened to the container around it as long as that adds
   text of its own (a title, an introduction) or containers of the same label, and
   this text isn't mostly links.
2. Spark counts the candidates' paths by host. A path is the chain of tags and
   classes from the root, digits left out. The paths with most votes win.
3. Pages are parsed again and the elements on their host's first winning path
   that hold at least half of the text of the page's own candidate are extracted
   (a single one is widened as above), together with the candidate if they are inside
   it and leave any of its text outside links; a page with none takes its candidate.

Only paths and counts are shuffled; the winners are a written table, so Spark
joins by its true size, and a host with a third of all pages is one row there.
Parsing takes time in proportion to the page, however deep its elements lie.

Blocks end where a block-level element begins or ends. References are decoded,
white space inside a block becomes one space, blocks are joined by line feeds.
Quotes count in tags only where a value begins, as HTML has it.

Nulls: a null or empty page has an empty text; a null URL belongs to the host "".
Repeated rows are extracted alike, each with its vote. Paths with equal votes are
ordered by pages, then by the path's number. Columns named text and n_chars are
replaced; all others but the source are kept, whatever their names.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batches, saved, texts
from .urls import url_host

_VALUE = r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:[^a-zA-Z>][^>]*)?>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?[^\s/>=]++{_VALUE}|=)*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?""")
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.IGNORECASE) for x in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
_CLOSES_P = _BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
_CONTAINER = {"article": 1.3, "main": 1.2, "section": 1.0, "div": 1.0, "body": 0.9, "td": 0.9, "blockquote": 0.6, "center": 0.9, "html": 0.5}
#: An opening tag on the left ends an open element on the right that lies above none of the third.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_NEVER = frozenset("head script style noscript template nav header footer aside button input select textarea iframe object svg canvas audio video dialog menu fieldset search title xmp noembed noframes".split())
_NOISE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation navi menu menus breadcrumb breadcrumbs sidebar rail widget widgets footer masthead topbar cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations teaser teasers pagination pager toolbar copyright outbrain taboola".split())
_COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Whole classes of what is there for screen readers only, or not shown.
_UNSEEN = frozenset("hidden sr-only visually-hidden visuallyhidden screen-reader-text screen-reader skip-link skip-to-content".split())
_SHOWN = re.compile(r"^\w+:(?:block|flex|grid|inline\S*|table\S*|contents)$")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_PARTS = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")
#: A class that says what a page has or lacks, not what the element is.
_STATE = re.compile(r"^(?:no|has|with|without)[-_]|[-_](?:open|closed|enabled|disabled|free)$", re.IGNORECASE)
#: The share of a block's text that counts for every container around it, and what comes on top for the first ones.
_FAR = 0.5
_NEAR = (0.5, 0.4, 0.3, 0.2, 0.1)
#: What ends the search for an open ``p``.
_P_STOPS = frozenset({"button", "table", "td", "th", "article", "section", "div", "main", "li", "blockquote"})


#: What an element is by itself: text, never text, hidden, with a hint that it is none, with a hint at comments.
TEXT, NEVER, HIDDEN, HINT, COMMENT = range(5)


class Node:
    __slots__ = ("tag", "up", "place", "noise", "path", "label", "first", "last")

    def __init__(self, tag: str, up: Node | None, label: str, noise: int):
        self.tag, self.up, self.label, self.noise = tag, up, label, noise  # up: the container around it
        self.place, self.path = -1, xxhash.xxh64_intdigest(label, seed=up.path if up else 0)
        self.first = self.last = 0  # blocks inside: [first, last)


def _attributes(text: str) -> dict[str, str]:
    """By lower-case name; the first of a repeated name counts."""
    if not text.strip(" /\n\t\r"):
        return {}
    return {k.lower(): html.unescape(v[1:-1] if v[:1] in ("'", '"') else v) for k, v in reversed(_ATTRIBUTE.findall(text))}


def _noise(tag: str, at: dict[str, str]) -> int:
    role = at.get("role", "").lower()
    if tag in _NEVER:
        return NEVER
    if "hidden" in at or at.get("aria-hidden") == "true" or role in _ROLES or _HIDDEN.search(at.get("style", "")):
        return HIDDEN
    if tag in ("html", "body", "main"):
        return TEXT
    names = [name for k in ("class", "id") for name in at.get(k, "").split() if not _STATE.search(name)]
    words = {x.lower() for name in names for x in _PARTS.findall(name)}
    if not words.isdisjoint(_COMMENTS):
        return COMMENT
    unseen = not _UNSEEN.isdisjoint(names) and not any(map(_SHOWN.match, names))
    return HINT if tag == "form" or role == "form" or unseen or not words.isdisjoint(_NOISE) else TEXT


class Page:
    """The containers of a page and its text blocks in order: (text, letters outside links, innermost container, noise)."""

    def __init__(self, source: str):
        self.nodes: list[Node] = []
        self._hints: list[Node] = []
        self._owned: list[Node] = []  # main elements, articles and titles
        self.blocks: list[tuple[str, int, Node | None, bool]] = []
        self._text: list[str] = []
        self._linked = self._links = self._noisy = 0
        self._open: list[Node] = []
        self._at: dict[str, list[int]] = {}  # where each tag's open elements lie in _open
        self._inside: list[Node] = []  # open containers
        at = 0
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if raw := _RAW.get(tag):
                stop = raw.search(source, at)
                at = stop.start() if stop else len(source)
        if at < len(source):
            self._add(source[at:])
        while self._open:
            self._pop()
        self._flush()
        self._weigh()
        self._count()

    def _add(self, text: str) -> None:
        text = html.unescape(text)
        self._text.append(text)
        if self._links:
            self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            if text := " ".join("".join(self._text).split()):
                self.blocks.append((text, max(0, len(text) - self._linked), self._inside[-1] if self._inside else None, self._noisy > 0))
            self._text = []
        self._linked = 0

    def _is_open(self, *tags: str) -> bool:
        return any(self._at.get(x) for x in tags)

    def _pop(self) -> None:
        node = self._open[-1]
        if node.tag in _BLOCK or node.noise:
            self._flush()
        self._open.pop()
        self._at[node.tag].pop()
        if node.place >= 0:
            self._inside.pop()
        node.last = len(self.blocks)
        self._noisy -= node.noise == NEVER
        self._links -= node.tag == "a"

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        """The place of the innermost open element with one of the tags, -1 without one."""
        return max((found[-1] for x in tags if (found := self._at.get(x))), default=-1)

    def _until(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Close the innermost open element with one of the tags, and all in it, unless one to stop at is open in it."""
        place = self._last(tags)
        if place >= 0 and place >= self._last(stop):
            while len(self._open) > place:
                self._pop()

    def _end(self, tag: str) -> None:
        if self._is_open(tag):
            self._until({tag}, {"table"} - {tag} if tag not in _BLOCK else set())
        elif tag in ("br", "p"):
            self._text.append(" ")

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _CLOSES_P and self._is_open("p"):
            self._until({"p"}, _P_STOPS)
        if tag in _ENDS:
            self._until(*_ENDS[tag])
        if tag == "a" and self._is_open("a"):
            self._until({"a"}, _BLOCK)
        if tag in _BLOCK:
            self._flush()
        if tag in _VOID:
            if tag in ("br", "hr", "wbr", "img"):
                self._text.append(" " if tag != "wbr" else "")
            return
        at = _attributes(attributes)
        noise = _noise(tag, at)
        if tag == "header" and self._is_open("article", "main"):
            noise = TEXT  # an article's own title
        if noise:
            self._flush()
        contains = tag in _CONTAINER
        classes = sorted(_DIGITS.sub("", x) for x in at.get("class", "").split()) if contains else []
        node = Node(tag, self._inside[-1] if self._inside else None, ".".join([tag, *classes]) if contains else "", noise)
        node.first = len(self.blocks)
        self._at.setdefault(tag, []).append(len(self._open))
        self._open.append(node)
        if noise >= HIDDEN:
            self._hints.append(node)
        elif noise == TEXT and self._noisy == 0 and tag == "h1":
            self._owned.append(node)
        if tag in ("article", "main"):
            self._owned.append(node)
        self._noisy += noise == NEVER
        self._links += tag == "a"
        if contains:
            node.place = len(self.nodes)
            self.nodes.append(node)
            self._inside.append(node)

    def _weigh(self) -> None:
        """Blocks in elements that hints make noise are noise. If that leaves no text, hidden elements and hints count for nothing."""
        if not self._hints and any(own and not noise for _, own, _, noise in self.blocks):
            return
        free = np.array([0 if noise else own for _, own, _, noise in self.blocks], np.int64)
        before = np.concatenate([[0], np.cumsum(free)])
        inside = lambda x: int(before[x.last] - before[x.first])
        total = int(before[-1])
        articles = [x for x in self._owned if x.tag == "article"]
        largest = max(articles, key=inside, default=None)
        kept = [x for x in self._owned if inside(x) and (x.tag != "article" or (x is largest and 4 * inside(x) >= total))]
        size = len(self.blocks) + 1
        ends, hinting = np.full(size, size), np.zeros(size, np.int64)  # by where they begin: the nearest end of those to keep, the farthest of hints
        for x in kept:
            ends[x.first] = min(ends[x.first], x.last)
        for x in self._hints:
            if x.noise != HIDDEN:
                hinting[x.first] = max(hinting[x.first], x.last)
        ends, hinting = np.minimum.accumulate(ends[::-1])[::-1], np.maximum.accumulate(hinting)
        plain = any(x.tag != "h1" and inside(x) and hinting[x.first] < x.last for x in self._owned)
        noise = [x for x in self._hints if x.noise != HINT or (ends[x.first] > x.last and (2 * inside(x) <= total or plain))]
        for some in (noise, [x for x in noise if 2 * inside(x) <= total], []):
            edges = np.zeros(size, np.int64)
            for x in some:
                edges[x.first] += 1
                edges[x.last] -= 1
            hinted = np.cumsum(edges)[:-1] > 0
            if (free[~hinted] > 0).any():
                break
        self.blocks = [(t, own, node, bool(noise or h)) for (t, own, node, noise), h in zip(self.blocks, hinted, strict=True)]

    def _count(self) -> None:
        """Sums over blocks that aren't noise: all text and text outside links before each block, text right inside each container, and text by parent and label of containers."""
        kept = np.array([0 if noise else len(text) for text, _, _, noise in self.blocks], np.int64)
        plain = np.array([0 if noise else own for _, own, _, noise in self.blocks], np.int64)
        self._all, self._plain = (np.concatenate([[0], np.cumsum(x)]).tolist() for x in (kept, plain))
        self._direct = [0] * len(self.nodes)
        self._near = [0.0] * len(self.nodes)
        for _, own, node, noise in self.blocks:
            if own and not noise and node is not None:
                self._direct[node.place] += own
                for share in _NEAR:
                    self._near[node.place] += share * own
                    if (node := node.up) is None:
                        break
        self._alike: dict[tuple[int, str], int] = {}
        for x in self.nodes:
            if x.up is not None:
                key = (x.up.place, x.label)
                self._alike[key] = self._alike.get(key, 0) + self.plain(x)

    def plain(self, node: Node) -> int:
        """Letters outside links and noise."""
        return self._plain[node.last] - self._plain[node.first]

    def letters(self, node: Node) -> int:
        return self._all[node.last] - self._all[node.first]

    def score(self, node: Node) -> float:
        return _CONTAINER[node.tag] * (self._near[node.place] + _FAR * self.plain(node))

    def widened(self, node: Node) -> Node:
        """The container around, as long as it adds text of its own or containers like this one, not mostly links."""
        chosen = child = node
        while (up := child.up) is not None:
            more = self.letters(up) - self.letters(chosen)
            if more:
                belongs = self._direct[up.place] or self._alike[up.place, child.label] > self.plain(child)
                if not belongs or 2 * (self.plain(up) - self.plain(chosen)) < more:
                    break
                chosen = up
            child = up
        return chosen

    def candidate(self) -> Node | None:
        """The container of the main text; null without text outside links and noise."""
        best = max((x for x in self.nodes if self.plain(x)), key=lambda x: (self.score(x), x.place), default=None)
        if best is None:
            return None
        around, found = best, {}
        while around is not None:
            found.setdefault(around.tag, around)
            around = around.up
        return self.widened(found.get("article") or found.get("main") or best)

    def on_path(self, path: int) -> list[Node]:
        return [x for x in self.nodes if _signed(x.path) == path and self.plain(x)]

    def text(self, nodes: list[Node]) -> str:
        out, done = [], 0
        for node in nodes:
            out += [t for t, _, _, noise in self.blocks[max(done, node.first) : node.last] if not noise]
            done = max(done, node.last)
        return "\n".join(out)


def _signed(path: int) -> int:
    return path - (1 << 64) if path >> 63 else path


def candidate(source: str) -> tuple[int, float] | None:
    """The path of a page's candidate and its share of the page's text outside links and noise."""
    page = Page(source)
    node = page.candidate()
    return None if node is None else (_signed(node.path), page.plain(node) / page._plain[-1])


def main_text(source: str, paths: list[int]) -> str:
    """The main text by the first of the host's paths that holds enough of the page, else by the page's own candidate."""
    page = Page(source)
    own = page.candidate()
    if own is None:
        return "\n".join(t for t, _, _, noise in page.blocks if not noise)
    for path in paths:
        found = page.on_path(path)
        if 2 * sum(map(page.plain, found)) >= page.plain(own):
            found = [page.widened(found[0])] if len(found) == 1 else found
            inside = [x for x in found if own.first <= x.first and x.last <= own.last]
            if inside and sum(map(page.plain, inside)) < page.plain(own):
                found = sorted([own, *(x for x in found if x not in inside)], key=lambda x: x.first)
            return page.text(found)
    return page.text([own])


def host_paths(pages: DataFrame, keep: int = 3) -> DataFrame:
    """Saved (host, paths): the paths with most votes of each host's pages, most voted first."""

    @by_batches
    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [candidate(x) for x in texts(batch.column(1))]
        votes = [x if x else (None, None) for x in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in votes], pa.int64()), pa.array([x for _, x in votes], pa.float64())], ["host", "path", "share"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path long, share double").where("path IS NOT NULL")
    counts = votes.groupBy("host", "path").agg(F.count("*").alias("pages"), F.round(F.sum("share"), 3).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("weight"), F.desc("pages"), "path"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= keep)
    lists = best.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("paths"))
    return saved(lists.select("host", F.col("paths.path").alias("paths")), "host-paths")


def extract_main_text(df: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """``df`` without its html, with text and n_chars (code points)."""
    kept = [c for c in df.columns if c not in (source, "text", "n_chars")]
    pages = df.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(kept)), F.col(f"`{source}`").alias("html"), url_host(F.col(f"`{url}`")).alias("host"))
    joined = pages.join(host_paths(pages), "host", "left").drop("host")
    at = len(kept)

    @by_batches
    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(x, p or []) for x, p in zip(texts(batch.column(at)), batch.column(at + 1).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, pa.string()), pa.array(np.array([len(x) for x in found], np.int64))], [*kept, "text", "n_chars"])

    schema = "".join(f"`{c}` {joined.schema[f'own_{i}'].dataType.simpleString()}, " for i, c in enumerate(kept)) + "text string, n_chars long"
    return joined.mapInArrow(extract, schema)
