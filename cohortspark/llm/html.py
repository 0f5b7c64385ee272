"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that stands in them; the best one's path of tags and classes
(numbers generalised) gets the page's vote. Votes are counted per host in Spark, and every page is then
extracted anew with the path that won its host; a page that lacks that path falls back on its own best container.

Tags and class words of menus, adverts, comments and the like are marks. Text under a mark counts for no container
outside it and is left out of a container round it, unless the marked element holds the article: an article or main
element, or for the less certain marks most of the page's paragraphs, or for the doubtful ones any prose. Marks on the winning
path or above it say nothing, nor do marks on elements within a line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.sources.tables import materialize

NAME = re.compile(r"/?([a-zA-Z][^\s/><]*)")
PLAIN = re.compile(r"[^>\"'<]*")
NAMES = re.compile(r"(?:^|\s)(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW = {"script", "style", "textarea", "title", "xmp", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that hold no text of a page's own, elements that mark, surely or less surely, something other than the article.
DROPPED = RAW | {"head", "noscript", "template", "button", "select", "option", "svg", "canvas", "object"}
SURE, LESS_SURE, DOUBTFUL = 3, 2, 1
MARKS = dict.fromkeys(("nav", "footer", "aside", "menu", "dialog"), SURE) | dict.fromkeys(("header", "form"), LESS_SURE)
CONTAINERS = {"body", "article", "main", "section", "div", "td"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Words of a class, id or role that mark something other than the article: surely if the word stands alone; as a part of a
#: compound, or in the second list, less surely. Of the second list only the last part of a compound counts. Words of the
#: third list are doubtful: they mark only what holds no prose, that is no block of PROSE characters that isn't mostly links.
SURE_WORD = re.compile(r"ads?|advert\w*|sponsor(?:ed|s)?|promo(?:tion|tions)?|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|footer|comments?|replies|disqus|cookies?|consent|popup|modal|newsletter|subscribe|signup|login|complementary|contentinfo")
OTHER_WORD = re.compile(r"banner|side|header|masthead|notices?|widget|toolbar|search|alert")
DOUBTFUL_WORD = re.compile(r"share|sharing|social|related|recommended")
PROSE = 80


def host_of(url) -> object:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def _mark(name: str, marks: dict[str, str]) -> int:
    if name in ("html", "body"):
        return 0
    found = MARKS.get(name, 0)
    if not marks or found == SURE:
        return found
    if "hidden" in marks or marks.get("aria-hidden") == "true":
        return SURE
    for token in " ".join((marks.get("class", ""), marks.get("id", ""), marks.get("role", ""))).lower().split():
        if SURE_WORD.fullmatch(token):
            return SURE
        parts = re.split(r"[_-]+", token)
        if OTHER_WORD.fullmatch(parts[-1]) or len(parts) > 1 and any(map(SURE_WORD.fullmatch, parts)):
            found = max(found, LESS_SURE)
        elif any(map(DOUBTFUL_WORD.fullmatch, parts)):
            found = max(found, DOUBTFUL)
    return found


class Tags:
    """Tags and comments of a page, found from any place on. Every character is looked at a few times at most.

    A tag's name is followed by attributes up to a ``>`` outside quotes; a quote that never closes is none. A ``<`` that begins no tag
    name, or whose tag meets another ``<`` outside quotes or the page's end, is text. A comment that the page's end cuts off ends there.
    """

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in "\"'>"}

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(start, end, name or None for a comment, whether it closes, attributes) of the first one from ``at`` on."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith(("<!", "<?"), start):
                comment = html.startswith("<!--", start)
                end = html.find("-->", start + 2) if comment else html.find(">", start)  # <!--> is one, too
                return start, len(html) if end < 0 else end + (3 if comment else 1), None, False, ""
            name = NAME.match(html, start + 1)
            if name is None:
                at = start + 1
                continue
            end = self._end(name.end())
            if end >= 0:
                return start, end, name[1].lower(), html[start + 1] == "/", html[name.end() : end - 1]
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """The place after the tag whose attributes begin at ``at``; -1 if it is none."""
        html, n = self.html, len(self.html)
        while True:
            at = PLAIN.match(html, at).end()
            if at == n:
                return -1
            c = html[at]
            if c == ">":
                return at + 1
            if c == "<":
                return -1
            if self.last[c] > at:
                at = html.find(c, at + 1) + 1
            else:
                at += 1


class Page:
    """Nodes and blocks of a page. A node is a container or a marked element: its path's number, its parent node, its mark.

    Paths are numbered by (number of the parent's path, step), so a page takes memory in proportion to its length, however
    deep its tags lie. A block is (node, text, characters of it in links).
    """

    def __init__(self, html: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(-1, "")]
        self.path, self.parent, self.mark, self.article = [0], [-1], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(html)
        self._weigh()

    def _step(self, parent: int, step: str) -> int:
        got = self.paths.get((parent, step))
        if got is None:
            got = self.paths[parent, step] = len(self.steps)
            self.steps.append((parent, step))
        return got

    def path_of(self, node: int) -> str:
        out, at = [], self.path[node]
        while at > 0:
            at, step = self.steps[at]
            out.append(step)
        return "".join(f"/{x}" for x in reversed(out))

    def number_of(self, path: str) -> int | None:
        at = 0
        for step in path.split("/")[1:]:
            at = self.paths.get((at, step))
            if at is None:
                return None
        return at

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int, int, bool]] = []  # name, path, node, dropped
        opened: dict[str, int] = {}
        text: list[str] = []
        at, owner, links, linked = 0, 0, 0, 0
        lowered = None

        def flush() -> None:
            nonlocal linked
            if text:
                block = " ".join(unescape("".join(text)).split())
                if block:
                    self.blocks.append((owner, block, linked))
                text.clear()
            linked = 0

        def close(k: int) -> None:
            nonlocal owner, links
            if any(x[0] not in INLINE for x in stack[k:]):
                flush()
            for x in stack[k:]:
                opened[x[0]] -= 1
            links = opened.get("a", 0)
            del stack[k:]
            owner = stack[-1][2] if stack else 0

        tags = Tags(html)
        while (tag := tags.next(at)) is not None:
            start, end, name, closes, told = tag
            dropped = bool(stack and stack[-1][3])
            if not dropped and start > at:
                text.append(html[at:start])
                if links:
                    linked += start - at
            at = end
            if name is None:
                continue
            if closes:
                if opened.get(name):
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
                elif name not in INLINE and not dropped:
                    flush()
                continue
            if name in VOID:
                if not dropped:
                    if name == "hr":
                        flush()
                    else:
                        text.append(" " if name == "br" else "")
                continue
            if name not in INLINE:
                if not dropped:
                    flush()
                for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph, an item the item before it
                    if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                        close(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
                dropped = bool(stack and stack[-1][3])
            marks = {x[0].lower(): (x[1] or x[2] or x[3]) for x in NAMES.findall(told)} if told else {}
            mark = _mark(name, marks)
            if not dropped and (name in DROPPED or name in INLINE and ("hidden" in marks or marks.get("aria-hidden") == "true")):
                dropped = True
                if name not in INLINE:
                    flush()
            path = stack[-1][1] if stack else 0
            if name not in INLINE and not dropped:
                classes = ".".join(sorted(re.sub(r"\d+", "N", c) for c in marks.get("class", "").replace("/", "|").split()))
                path = self._step(path, f"{name}.{classes}" if classes else name)
                if name in CONTAINERS or mark:
                    self.path.append(path if name in CONTAINERS else -1)
                    self.parent.append(owner)
                    self.mark.append(mark)
                    self.article.append(name in ("article", "main"))
                    owner = len(self.path) - 1
            if told.endswith("/") and name not in RAW:
                owner = stack[-1][2] if stack else 0
                continue
            stack.append((name, path, owner, dropped))
            opened[name] = opened.get(name, 0) + 1
            links = opened.get("a", 0)
            if name in RAW:
                lowered = lowered if lowered is not None else html.lower() if len(html.lower()) == len(html) else re.sub(r"[A-Z]", lambda c: c[0].lower(), html)
                found = lowered.find(f"</{name}", at)  # no tag is sought inside
                at = len(html) if found < 0 else found
        if not (stack and stack[-1][3]):
            text.append(html[at:])
            flush()

    def _weigh(self) -> None:
        """Takes back the marks of elements that hold the article, and finds what lies under a mark."""
        n = len(self.path)
        holds = [False] * n
        for k in range(n - 1, 0, -1):
            if holds[k] or self.article[k] and self.mark[k] != SURE:
                holds[self.parent[k]] = True
        marked = [self.mark[k] if not holds[k] else 0 for k in range(n)]
        under = [marked[k] == SURE for k in range(n)]
        for k in range(1, n):
            under[k] = under[k] or under[self.parent[k]]
        held, prose = [0] * n, [False] * n
        for node, text, linked in self.blocks:
            if len(text) >= 40 and 2 * linked < len(text) and not under[node]:
                held[node] += len(text)
                prose[node] |= len(text) >= PROSE
        for k in range(n - 1, 0, -1):
            held[self.parent[k]] += held[k]
            prose[self.parent[k]] |= prose[k]
        few = [2 * h <= held[0] for h in held]
        self.marked = [m == SURE or few[k] and (m == LESS_SURE or m == DOUBTFUL and not prose[k]) for k, m in enumerate(marked)]
        self.under = list(self.marked)
        for k in range(1, n):
            self.under[k] = self.under[k] or self.under[self.parent[k]]

    def _round(self, node: int) -> int:
        """The container that a node lies in, or is."""
        while node and self.path[node] < 0:
            node = self.parent[node]
        return node

    def best(self) -> tuple[int, float]:
        """The best container and its score: an unmarked block counts for its container, and half for the one around it."""
        score = [0.0] * len(self.path)
        for node, text, _ in self.blocks:
            if not self.under[node]:
                s = 1 + min(len(text) / 100, 5) + min(text.count(","), 5) / 5
                own = self._round(node)
                score[own] += s
                if own:
                    score[self._round(self.parent[own])] += s / 2
        k = max(range(len(score)), key=lambda k: (score[k], -k))
        return k, score[k]

    def extract(self, path: str | None) -> str:
        """The blocks in containers of ``path``, or else in the page's best container, without those under a mark inside it."""
        wanted = self.number_of(path) if path is not None else None
        inside = self._inside([p == wanted for p in self.path]) if wanted is not None else []
        if not any(inside):
            best = self.path[self.best()[0]]
            inside = self._inside([p == best for p in self.path])
        return "\n".join(text for node, text, _ in self.blocks if inside[node])

    def _inside(self, chosen: list[bool]) -> list[bool]:
        inside = list(chosen)
        for k in range(1, len(inside)):
            if not inside[k]:
                inside[k] = inside[self.parent[k]] and not self.marked[k]
        return inside


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, scores = [], []
        for html in batch.column(1).to_pylist():
            page = Page(html or "")
            node, score = page.best()
            paths.append(page.path_of(node) if score else None)
            scores.append(score)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes): the path that most pages of the host vote for; ties by score, then by the path's code points."""
    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_vote, "host string, path string, score double")
    counted = votes.where("path IS NOT NULL").groupBy("host", "path").agg(F.count("*").alias("votes"), F.round(F.sum("score"), 6).alias("score"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    return counted.withColumn("at", F.row_number().over(order)).where("at = 1").select("host", "path", "votes")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(html or "").extract(path) for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)],
            ["page_id", "url", "text", "n_chars", "path"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, path (the host's).

    Null html counts as empty, a null url as a host of its own. Blocks are joined by line ends, white space within
    a block is one space, character references are decoded. Pages that are cut off or broken are read as far as they go, in time
    that grows with their length. Repeated rows are extracted each on its own; an empty
    table gives an empty result; other columns are ignored.
    """
    winners = materialize(host_paths(pages)).select("host", "path")
    small = winners.count() <= 100_000
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = keyed.join(F.broadcast(winners) if small else winners.hint("merge"), "host", "left").select("page_id", "url", "html", "path")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long, path string")
