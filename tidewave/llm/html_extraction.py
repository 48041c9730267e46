"""Main text of web pages by site style trees.

The pages of a host are merged into one tree whose nodes are element paths (tags with their classes). The importance of a node
that holds blocks comes from two entropies over the host's distinct pages: that of its presentation (the numbers of blocks seen
there) and that of its content (a text that recurs on all pages tells nothing). Importances go up the tree: that of an element is
the mean over the blocks below it. A block without evidence of its own takes the importance of the nearest element around it that
has some, so branches of low importance are removed as a whole. Elements whose tag or role states that they are no article text go
first; the tree decides on everything else. Marks of an article and names of classes only raise or lower an importance. Few pages of
a host give no evidence: their blocks are ``PLAIN``.

Pages are parsed twice, first for numbers that name nodes and texts, then with the importances: no text is stored or shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, numbered, release, spread_join

THRESHOLD = 0.2
LEAST_PAGES = 3
#: Importance without evidence; factors of a class that states no article text and of a place outside the article a page marks; what a place inside adds.
PLAIN, HINT, OUTSIDE, INSIDE = 0.5, 0.3, 0.6, 0.1
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP = set("head title script style noscript template nav footer aside form button select textarea iframe svg canvas object dialog menu".split())
BLOCKS = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NOISE = re.compile(r"^(ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|header|masthead|footer|sidebar|cookie\w*|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|commentlist|respond|replies|widget|login|search)$")
NO_CLASSES = SKIP | {"header", "html", "body", "article", "main"}


#: Elements whose content is text to their end tag, whatever it looks like.
RAW = set("script style textarea title iframe xmp noembed noframes".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())
_TAG = r"""<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>"""
_TOKEN = re.compile(rf"(?P<text>[^<]+)|{_TAG}|<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<stray><)", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: End tags that may be left out: a new block ends an open paragraph, an item its neighbour.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


@lru_cache(maxsize=100_000)
def _element(tag: str, attrs: str) -> tuple[str, bool, bool, int]:
    """Of a start tag: its label, whether it is dropped wherever it is, whether it marks an article, and how strongly a name hints at none (0 to 2)."""
    held: dict[str, str] = {}
    for name, *values in _ATTR.findall(attrs):
        held.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    role = held.get("role")
    label = ".".join([tag, *sorted(held.get("class", "").split())])
    names = f"{held.get('class', '')} {held.get('id', '')}".lower().split()
    whole = any(map(NOISE.match, names))
    strength = 0 if tag in NO_CLASSES else 2 if whole else int(any(NOISE.match(w) for name in names for w in re.split(r"[-_]+", name)))
    return label, tag in SKIP or "hidden" in held or role in ROLES, tag in ("article", "main") or role == "main", strength


class _Page:
    """Blocks of one page, read from its tags in order."""

    def __init__(self, html: str):
        self.stack: list[tuple[str, str, bool, bool, tuple]] = []  # tag, label, dropped, in the article, hinted elements
        self.blocks: list[list] = []  # path, text, dropped, in the article, hinted elements
        self.hinted, self.fresh, at = 0, True, 0
        while m := _TOKEN.match(html, at):
            at = m.end()
            kind = m.lastgroup
            if kind == "text" or kind == "stray":
                text = m[0]
                self._add(unescape(text) if "&" in text else text)
            elif kind == "attrs":
                tag, attrs = m["tag"].lower(), m["attrs"]
                if m["end"]:
                    self._end(tag)
                    continue
                self._start(tag, attrs)
                if attrs.endswith("/"):
                    self._end(tag)
                elif tag in RAW:
                    stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                    at = stop.start() if stop else len(html)

    def _start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._add(" ")
        stack = self.stack
        if tag in BLOCKS:
            self.fresh = True
            closes = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name == "p" or name in closes:
                    del stack[k:]
                    break
                if name in BLOCKS:
                    break
        if tag in VOID:
            return
        label, noise, article, strength = _element(tag, attrs)
        dropped, inside, hints = stack[-1][2:] if stack else (False, False, ())
        if strength:
            self.hinted += 1
            hints = (*hints, (self.hinted, strength))
        stack.append((tag, label, dropped or noise or (tag == "header" and not inside), inside or article, hints))

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.fresh = True
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def _add(self, data: str) -> None:
        dropped, inside, hints = self.stack[-1][2:] if self.stack else (False, False, ())
        # A run of text that is dropped, hinted or in the article otherwise than the block so far is a block of its own; dropped inline text only leaves the block.
        other = self.blocks and not self.fresh and (self.blocks[-1][2:] != [dropped, inside, hints]) and not dropped
        if self.fresh or not self.blocks or other:
            if not data.strip():
                return
            path = "/".join([label for tag, label, *_ in self.stack if tag in BLOCKS])
            self.blocks.append([path, "", dropped, inside, hints])
            self.fresh = False
        if not dropped or self.blocks[-1][2]:
            self.blocks[-1][1] += data


def blocks_of(html: str | None) -> list[tuple[str, str, str, bool]]:
    """(path, text, state, hint) of each block: ``no`` dropped by tag or role, else ``in`` or ``out`` of a marked article, or ``ask``.

    ``hint``: a class or id of an element around it states no article text. A part of a name
    counts only if the element holds less than half of the page's text.
    """
    page = _Page(html or "")
    blocks = [(path, text, *rest) for path, raw, *rest in page.blocks if (text := " ".join(raw.split()))]
    live = [b for b in blocks if not b[2]]
    marked, held = any(b[3] for b in live), {}
    for _, text, _, _, hints in live:
        for h in hints:
            held[h] = held.get(h, 0) + len(text)
    half = sum(len(b[1]) for b in live) / 2
    return [(path, text, "no" if dropped else "in" if inside else "out" if marked else "ask", any(h[1] == 2 or held.get(h, 0) < half for h in hints)) for path, text, dropped, inside, hints in blocks]


@lru_cache(maxsize=200_000)
def _nodes(host: str, path: str) -> tuple[int, ...]:
    """Names of a path and of all elements around it, the inner ones first."""
    parts = path.split("/")
    return tuple(xxhash.xxh64_intdigest(f"{host}\0{'/'.join(parts[:k])}") - (1 << 63) for k in range(len(parts), 0, -1))


def _weight(importance, state, hint):
    """The importance a block counts with. ``importance``, ``state`` and ``hint`` are columns."""
    weight = F.coalesce(importance, F.lit(PLAIN)) * F.when(hint, HINT).otherwise(1.0) * F.when(state == "out", OUTSIDE).otherwise(1.0)
    return weight + F.when(state == "in", INSIDE).otherwise(0.0)


def _kept(html: str | None, stays) -> str:
    """The text of the blocks (by number and block) that stay, dropped ones never."""
    return "\n".join(b[1] for i, b in enumerate(blocks_of(html)) if b[2] != "no" and stays(i, b))


def importances(blocks: DataFrame) -> DataFrame:
    """(node, importance) of the merged trees; nodes with blocks need ``LEAST_PAGES`` pages. Counts are pre-aggregated; repeated pages of a host count once.

    ``blocks`` has (row, page, nodes, text), ``nodes`` being the names of the block's element and of those around it.
    """
    blocks = blocks.withColumn("leaf", F.get("nodes", 0))
    texts = blocks.groupBy("leaf", "text", "page").agg(F.count("*").alias("c"))
    texts = texts.groupBy("leaf", "text").agg(F.count("*").alias("pages"), F.sum("c").alias("c"))
    looks = blocks.groupBy("leaf", "row").agg(F.count("*").alias("look"), F.min("page").alias("page"))
    looks = looks.groupBy("leaf", "page").agg(F.min("look").alias("look")).groupBy("leaf", "look").agg(F.count("*").alias("n"))
    looks = looks.groupBy("leaf").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn")).filter(F.col("m") >= LEAST_PAGES)
    look = (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")
    text = texts.groupBy("leaf").agg(F.avg(F.log("pages")).alias("spread"), F.sum("c").alias("blocks"))
    leaves = looks.join(text, "leaf").select("leaf", (0.5 * look + 0.5 * (1 - F.col("spread") / F.log("m"))).alias("importance"), "blocks")
    around = blocks.select("leaf", "nodes").distinct().join(leaves, "leaf").select(F.explode(F.slice("nodes", 2, 1_000)).alias("node"), "importance", "blocks")
    mean = F.sum(F.col("importance") * F.col("blocks")) / F.sum("blocks")
    # An element that holds blocks itself keeps the importance they give it.
    inner = around.groupBy("node").agg(mean.alias("importance")).join(leaves.select(F.col("leaf").alias("node")), "node", "left_anti")
    return leaves.select(F.col("leaf").alias("node"), "importance").union(inner)


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (blocks joined by newlines; empty if none).

    Null html counts as empty and null urls share one host. Repeated rows each give a row and count once as evidence; ties cannot
    arise, blocks stay in page order. Broken markup is read as far as it goes. Pages of any length are read whole. Other columns are
    not read, whatever their names. An empty table gives an empty result. White space inside a block, line breaks included, becomes
    one space.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = numbered(pages.select("page_id", "url", "html"), "row").withColumn("host", host)

    @F.pandas_udf("array<struct<at int, nodes array<long>, text long, state string, hint boolean>>")
    def parse(html: pd.Series, host: pd.Series) -> pd.Series:
        out = []
        for h, name in zip(html, host):
            live = [(i, b) for i, b in enumerate(blocks_of(h)) if b[2] != "no"]
            out.append([{"at": i, "nodes": _nodes(name, path), "text": xxhash.xxh64_intdigest(text) - (1 << 63), "state": state, "hint": hint} for i, (path, text, state, hint) in live])
        return pd.Series(out, dtype=object)

    rows = cut(pages.select("row", parse("html", "host").alias("blocks")))
    page = F.xxhash64(F.transform("blocks", lambda b: b["text"]), F.transform("blocks", lambda b: F.get(b["nodes"], 0)))
    blocks = cut(rows.select("row", page.alias("page"), F.explode("blocks").alias("b")).select("row", "page", "b.*"))
    known = cut(importances(blocks))
    if known.count() * 16 <= BROADCAST_BYTES:
        table = known.toPandas().sort_values("node")
        sent = pages.sparkSession.sparkContext.broadcast((table["node"].to_numpy(np.int64), table["importance"].to_numpy(np.float64)))

        met: dict[tuple[str, str], float] = {}

        def importance_of(host: str, path: str) -> float:
            found = met.get((host, path))
            if found is None:
                names, values = sent.value
                at = ((node, int(np.searchsorted(names, node))) for node in _nodes(host, path))
                found = next((float(values[k]) for node, k in at if k < len(names) and names[k] == node), PLAIN)
                if len(met) > 200_000:
                    met.clear()
                met[host, path] = found
            return found

        def stays(host: str, block: tuple) -> bool:
            path, _, state, hint = block
            return importance_of(host, path) * (HINT if hint else 1) * (OUTSIDE if state == "out" else 1) + (INSIDE if state == "in" else 0) >= threshold

        @F.pandas_udf("string")
        def text(html: pd.Series, host: pd.Series) -> pd.Series:
            return pd.Series([_kept(h, lambda i, b, name=name: stays(name, b)) for h, name in zip(html, host)], dtype=object)

        release(rows, blocks, known)
        return pages.select("page_id", "url", text("html", "host").alias("text"))

    # Too many nodes to send: blocks look theirs up by a join, and pages are joined with the numbers of the blocks that go.
    asked = blocks.select("row", "at", "state", "hint", F.posexplode("nodes").alias("up", "node"))
    found = spread_join(asked, known, "node", "row").groupBy("row", "at", "state", "hint").agg(F.min_by("importance", F.when(F.col("importance").isNotNull(), F.col("up"))).alias("importance"))
    gone = found.filter(_weight(F.col("importance"), F.col("state"), F.col("hint")) < threshold).groupBy("row").agg(F.collect_set("at").alias("gone"))

    @F.pandas_udf("string")
    def rest(html: pd.Series, gone: pd.Series) -> pd.Series:
        away = [set() if g is None else set(g) for g in gone]
        return pd.Series([_kept(h, lambda i, b, g=g: i not in g) for h, g in zip(html, away)], dtype=object)

    return pages.join(gone, "row", "left").select("page_id", "url", rest("html", "gone").alias("text"))
