"""Main text of web pages by minimum cut.

A page is read as a row of blocks (runs of text between block-level tags). A logistic score from the block's
place and text gives the capacity of its edge to one of two terminals: to "content" if the score is
positive, else to "boilerplate". Blocks next to each other in the page, and blocks of one parent, are joined by edges
whose capacity falls with their distance in the DOM. The minimum cut between the terminals is the labelling that
pays least for going against scores and for separating neighbours; it is found by maximum flow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.registry import query, table

# fixed values: HTML's element kinds
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title noscript template textarea iframe svg math object canvas audio video select button".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}

# weights of the score: what an ancestor's tag or one of its class, id and role words says
TAGS = {"article": 3.0, "main": 2.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "header": -8.0}
AGAINST = frozenset("ad ads adv advert advertisement advertorial adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
                    "notice notification alert popup modal overlay sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer foot "
                    "header masthead topbar comment comments commentlist respond reply replies disqus discussion share sharing social related "
                    "recommended recommendation recommendations newsletter subscribe subscription signup login search widget pagination pager "
                    "toolbar skip copyright legal disclaimer contentinfo complementary hidden dialog alertdialog feedback discuss".split())
FOR = frozenset("article content post entry story main text body".split())
WORD_AGAINST, WORD_FOR = -8.0, 1.5
BIAS, PER_LENGTH, LINKS, SENTENCE = 0.0, 0.5, -5.0, 0.8
NEAR, SIBLING = 1.2, 0.8  # capacities between neighbours in the page and between children of one parent


def read_blocks(html: str) -> list[tuple[str, float, tuple[int, ...]]]:
    """Text, score and path (numbers of the open elements) of every block with text, in page order."""
    import math
    import re
    from html import unescape

    tag = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
    attribute = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
    word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
    layout = re.compile(r"\b(?:with|has|no|without)[-_]?\w+", re.I)  # "with-sidebar" speaks of a neighbour
    blocks: list[tuple[str, float, tuple[int, ...]]] = []
    stack: list[tuple[str, float, int]] = []  # tag, score so far, number
    parts: list[str] = []
    linked, in_link, count, at = 0, False, 0, 0

    def end_block() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            score = BIAS + (stack[-1][1] if stack else 0.0) + PER_LENGTH * math.log1p(len(text) / 20)
            score += LINKS * min(1.0, linked / len(text)) + (SENTENCE if re.search(r"[.!?:;,]", text) else 0.0)
            blocks.append((text, score, tuple(s[2] for s in stack)))
        parts.clear()
        linked = 0

    def judge(name: str, attrs: str) -> float:
        score = TAGS.get(name, 0.0)
        if name == "header" and any(s[0] == "article" for s in stack):
            score = 0.0  # the heading of the article itself
        for a in attribute.finditer(attrs) if attrs else ():
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key in ("hidden", "aria-hidden"):
                score += WORD_AGAINST if value.lower() != "false" else 0.0
            elif key == "style":
                score += WORD_AGAINST if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else 0.0
            elif name not in ("html", "body"):
                words = {w.lower() for w in word.findall(layout.sub("", value))}
                score += WORD_AGAINST if words & AGAINST else WORD_FOR if words & FOR else 0.0
        return score

    def put(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if in_link:
            linked += len(text)

    while True:
        m = tag.search(html, at)
        if m is None:
            rest = html[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the end of the page cuts off
            put(rest if cut is None else rest[:cut.start()])
            break
        if m.start() > at:
            put(html[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in SILENT and not closing:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else len(html)
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = not closing
            elif not closing and attrs and judge(name, attrs) < 0:  # a hidden or advertising piece inside a block
                name = name + "*"
                end_block()
                stack.append((name, (stack[-1][1] if stack else 0.0) + judge(name[:-1], attrs), count := count + 1))
            elif closing and stack and stack[-1][0] == name + "*":
                end_block()
                stack.pop()
            continue
        end_block()
        if closing:
            if any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        for old in CLOSES.get(name, ()):
            if stack and stack[-1][0] == old:
                stack.pop()
        if name not in VOID and not attrs.endswith("/"):
            count += 1
            stack.append((name, (stack[-1][1] if stack else 0.0) + judge(name, attrs), count))
    end_block()
    return blocks


def neighbour_edges(paths: list[tuple[int, ...]]) -> list[tuple[int, int, float]]:
    """Edges between neighbouring blocks and between blocks of one parent, with their capacities."""
    edges, last = [], {}
    for i, path in enumerate(paths):
        if i:
            before = paths[i - 1]
            same = 0
            for x, y in zip(before, path):
                if x != y:
                    break
                same += 1
            edges.append((i - 1, i, NEAR / (1 + len(before) + len(path) - 2 * same)))
        parent = path[:-1]
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SIBLING / (i - last[parent])))
        last[parent] = i
    return edges


def content_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks the minimum cut leaves with the content terminal (maximum flow by blocking flows)."""
    n = len(scores)
    source, sink, unit = n, n + 1, 1000
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(x: int, y: int, forth: int, back: int) -> None:
        out[x].append(len(to))
        to.append(y)
        room.append(forth)
        out[y].append(len(to))
        to.append(x)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            join(source, i, round(s * unit), 0)
        else:
            join(i, sink, round(-s * unit), 0)
    for x, y, c in edges:
        join(x, y, round(c * unit), round(c * unit))
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        row = [source]
        for x in row:
            for e in out[x]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    row.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if not room[e])
                x = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[x] < len(out[x]):
                e = out[x][turn[x]]
                if room[e] and level[to[e]] == level[x] + 1:
                    path.append(e)
                    x = to[e]
                    break
                turn[x] += 1
            else:
                if x == source:
                    break
                turn[to[path[-1] ^ 1]] += 1
                x = to[path.pop() ^ 1]


def main_text(html: str) -> str:
    """The content blocks of a page in page order, joined by one space."""
    blocks = read_blocks(html)
    if not blocks:
        return ""
    keep = content_side([b[1] for b in blocks], neighbour_edges([b[2] for b in blocks]))
    return " ".join(b[0] for b, k in zip(blocks, keep) if k)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of every page (null and empty pages: empty).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one.
    A column of the name of ``out`` is replaced; all others, and repeated rows, stay. One narrow pass.
    """
    def run(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in htmls:
            yield pd.Series([main_text(h or "") for h in s.tolist()], dtype=object)

    return pages.withColumn(out, F.pandas_udf(run, "string")(F.col(html_col)))


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))
