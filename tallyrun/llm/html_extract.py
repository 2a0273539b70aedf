"""Main text of web pages by consensus of their host.

Each page scores its containers; the score goes as a vote to the container's path of tags and
classes, with numbers in class names generalised. Votes are summed per host in Spark, the
path with most votes wins, and each page is read again with its host's winning path: what lies below it, and
around it what the text goes on with (see around()). A page on which that path has no text, or next to none of
what the page's own best container scores, falls back to that container.

A page is read in one pass that never looks back: work and memory grow with its length, whatever its nesting and however
broken its markup. Sums over an element's inside go from children to parents, marks from parents to children.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stash, strings

SCHEMA = "page_id long, url string, text string, n_chars long"
#: a tag whose attribute values hold no angle bracket, up to its end
SIMPLE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s=\"'>/]++(?:=(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>=`]++))?+)*+)\s*+(/?)>")
OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:=(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[\s/]*+(=?[^\s/>=]*+)")
EQUALS = re.compile(r"\s*+=\s*+")
UNQUOTED = re.compile(r"[^\s>]*+")
#: references to numbers that no character has, or that are written with many zeros, are made short before decoding
ZEROS = re.compile(r"&#([xX]?)0{6,}+")
TOO_LARGE = re.compile(r"&#(?:[1-9][0-9]{7,}+|[xX][1-9a-fA-F][0-9a-fA-F]{7,}+);?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: their content is not markup
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: a new one ends an open one of the group
CLOSES = {t: g for g in (frozenset(["p"]), frozenset(["li"]), frozenset(["dt", "dd"]), frozenset(["tr"]), frozenset(["td", "th"]), frozenset(["option"])) for t in g}
NO_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: their text belongs to the element around them
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt".split())
LISTS = PARAGRAPHS | frozenset("ul ol dl".split())
ASIDE_TAGS = frozenset("nav header footer aside form button select dialog menu svg canvas object video audio map fieldset head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
ASIDE_NAME = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|adbox|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|reply|responses?|pagination|pager|toolbar|skip|hidden|copyright|legal|disclaimer)(?=$|[-_\s\d])",
    re.I,
)
#: parts of names that tell of a page's layout or state rather than name a region
LAYOUT_NAME = re.compile(r"(?:^|[-_])(?:has|no|not|non|with|without|by|fixed|sticky|open|opened|closed|collapsed|layout)(?=$|[-_])", re.I)
COMMENT_NAME = re.compile(r"(?:^|[-_])(?:comments?|commentlist|disqus|replies|reply|responses?)(?=$|[-_\d])", re.I)
BONUS = {"article": 1.5, "main": 1.2}
DECAY = 0.8
#: share of its own best container's score that the host's path must have on a page
LEAST_SHARE = 0.05
#: characters of a path that takes part in a vote; a page with a longer one reads its own best container
LONGEST_PATH = 4096
#: with more hosts than this, only hosts with over one in so many of all pages have their paths broadcast
MOST_HOT = 10_000


class Node:
    """An element. Its path is an index into its page's table of paths; flags hold for all below it too."""

    __slots__ = ("tag", "path", "parent", "aside", "link", "named", "score", "depth", "under_named", "remark", "listed")

    def __init__(self, tag: str, path: int, parent: Node | None, aside: bool, link: bool, named: str = ""):
        self.tag, self.path, self.parent, self.aside, self.link, self.named, self.score = tag, path, parent, aside, link, named, 0.0
        self.depth = 0 if parent is None else parent.depth + 1
        self.under_named = bool(named) or parent is not None and parent.under_named
        self.remark = bool(named and COMMENT_NAME.search(named)) or parent is not None and parent.remark
        # the nearest element above that is no paragraph or list; None for such an element itself
        self.listed = (parent.listed or parent) if parent is not None and tag in LISTS else None


def aside_name(names: str) -> str:
    """The first of an element's class or id tokens that names a region to set aside; a layout's token names none."""
    return next((t for t in names.split() if ASIDE_NAME.search(t) and not LAYOUT_NAME.search(t)), "")


def step_of(tag: str, found: dict[str, str]) -> tuple[str, bool, str]:
    """The path step of a tag (classes sorted, numbers generalised), whether it is set aside, and the name that asks for it."""
    if not found:
        return tag, tag in ASIDE_TAGS, ""
    classes, name = found.get("class", ""), found.get("id", "")
    aside = tag in ASIDE_TAGS or found.get("role", "").lower() in ASIDE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    named = ""
    if not aside and tag not in ("html", "body", "article", "main") and (classes or name):
        named = aside_name(f"{classes} {name}")
    elif not aside and tag == "article" and (classes or name):  # a reader's comment may be an article by itself
        aside = bool(re.search(r"(?:^|[-_\s])comments?(?=$|[-_\s\d])", f"{classes} {name}", re.I))
    steps = sorted({re.sub(r"\d+", "0", c) for c in classes.split()})
    return ".".join([tag, *steps]), aside, named


@lru_cache(1 << 12)
def _short_step(tag: str, raw: str) -> tuple[str, bool, str]:
    return step_of(tag, {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)})


class Page:
    """A page's elements in page order, its blocks (element, text, link characters), and its table of paths."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = {'"': 0, "'": 0}
        self.steps: dict[tuple[int, str], int] = {}
        self.parents, self.names, self.lengths = [-1], ["root"], [4]
        self.nodes = [Node("root", 0, None, False, False)]
        self.blocks: list[tuple[Node, str, int]] = []
        self._read()

    def path_under(self, path: int, step: str) -> int:
        found = self.steps.setdefault((path, step), len(self.names))
        if found == len(self.names):
            self.parents.append(path)
            self.names.append(step)
            self.lengths.append(self.lengths[path] + 1 + len(step))
        return found

    def path_text(self, path: int) -> str:
        out = []
        while path >= 0:
            out.append(self.names[path])
            path = self.parents[path]
        return ">".join(reversed(out))

    def path_id(self, path: str | None) -> int:
        """The page's number of a path, -1 if it has none such."""
        if path is None:
            return -1
        steps, at = path.split(">"), 0
        if steps[0] != "root":
            return -1
        for step in steps[1:]:
            if (at := self.steps.get((at, step), -1)) < 0:
                return -1
        return at

    def _quote(self, mark: str, at: int) -> int:
        """The next such quote, or -1; what has been looked through is not looked through again."""
        if 0 <= self.quotes[mark] < at:
            self.quotes[mark] = self.page.find(mark, at)
        return self.quotes[mark]

    def _attributes(self, at: int) -> tuple[int, dict[str, str], bool]:
        """Where a tag ends whose attributes start here (-1: the page ends before), the attributes, and whether it closes itself.

        A quoted value ends at the next such quote. If there is none, or what follows it shows that it opens another
        value (neither white space, a slash nor the tag's end), the quote was never closed, and the tag ends
        at the next angle bracket.
        """
        page, found = self.page, {}
        while True:
            m = NAME.match(page, at)
            at = m.end()
            if at >= len(page):
                return -1, found, False
            if not m[1] and page[at] == ">":
                return at + 1, found, page[at - 1] == "/"
            value = ""
            if e := EQUALS.match(page, at):
                at = e.end()
                mark = page[at : at + 1]
                if mark in ("'", '"'):
                    end = self._quote(mark, at + 1)
                    if end < 0 or end + 1 < len(page) and page[end + 1] not in " \t\n\r\f/>" and page.find(">", at, end) >= 0:
                        end = page.find(">", at)
                        found.setdefault(m[1].lower(), page[at + 1 : end] if end >= 0 else "")
                        return (end + 1 if end >= 0 else -1), found, False
                    value, at = page[at + 1 : end], end + 1
                else:
                    u = UNQUOTED.match(page, at)
                    value, at = u[0], u.end()
            found.setdefault(m[1].lower(), value)

    def _read(self) -> None:
        page, end = self.page, len(self.page)
        root = node = self.nodes[0]
        # elements open now; of these the places of blocks, and of each tag's
        stack, solid, places = [root], [0], defaultdict(list)
        pieces, links, at = [], 0, 0

        def close() -> None:
            nonlocal links
            if pieces:
                text = "".join(pieces)
                if "&" in text:
                    text = html.unescape(TOO_LARGE.sub("\ufffd", ZEROS.sub(r"&#\g<1>0", text)))
                text = " ".join(text.split())
                if text:
                    self.blocks.append((node, text, links))
                pieces.clear()
            links = 0

        def push(n: Node) -> None:
            self.nodes.append(n)
            places[n.tag].append(len(stack))
            if n.tag not in INLINE:
                solid.append(len(stack))
            stack.append(n)

        def pop() -> Node:
            n = stack.pop()
            places[n.tag].pop()
            if solid[-1] == len(stack):
                solid.pop()
            return n

        def read(run: str) -> None:
            nonlocal links
            if run and not stack[-1].aside:
                pieces.append(run)
                if stack[-1].link:
                    links += len(run)

        while at < end:
            start = page.find("<", at)
            if start < 0:
                read(page[at:])
                break
            read(page[at:start])
            kind = page[start + 1 : start + 2]
            m = SIMPLE_TAG.match(page, start)
            if m:
                at, tag, raw, ends_itself, found = m.end(), m[2].lower(), m[3], m[4] == "/", None
                closing = m[1]
            elif m := OPEN_TAG.match(page, start):
                closing, tag = m[1], m[2].lower()
                at, found, ends_itself = self._attributes(m.end())
                if at < 0:  # the page ends within a tag
                    break
            elif kind == "!" or kind == "?" or kind == "/":
                opening, ending = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(x[0], start)), ("<" + kind, ">"))
                upto = page.find(ending, start + len(opening) - (opening == "<!--") * 2)
                inside = page[start + len(opening) : upto if upto >= 0 else end]
                at = upto + len(ending) if upto >= 0 else end
                if opening == "<![CDATA[":
                    read(html.escape(inside))
                continue
            else:
                read("<")
                at = start + 1
                continue
            top = stack[-1]
            if closing:
                if tag in VOID or not places[tag]:
                    if tag == "p":
                        close()
                    elif tag == "br" and not top.aside:
                        pieces.append(" ")
                    continue
                if tag not in INLINE:
                    close()
                elif solid[-1] > places[tag][-1]:
                    continue  # an inline end tag does not close blocks
                while pop().tag != tag:
                    pass
                node = stack[solid[-1]]
                continue
            if tag in RAW:
                if not ends_itself:
                    stop = RAW_END[tag].search(page, at)
                    at = stop.end() if stop else end
                    pieces.append(" ")
                continue
            if tag in VOID:
                if tag in ("br", "wbr", "img", "input"):
                    if tag != "wbr" and not top.aside:
                        pieces.append(" ")
                else:
                    close()
                continue
            if found is not None:
                step, aside, named = step_of(tag, found)
            else:
                step, aside, named = _short_step(tag, raw) if len(raw) <= 256 else _short_step.__wrapped__(tag, raw)
            if tag in INLINE:
                push(Node(tag, top.path, top, top.aside or aside or bool(named), top.link or tag == "a"))
                continue
            close()
            group = CLOSES.get(tag)
            if tag in NO_PARAGRAPH or group:
                for i in range(len(stack) - 1, 0, -1):
                    t = stack[i].tag
                    if group and t in group or t == "p" and tag in NO_PARAGRAPH:
                        while len(stack) > i:
                            pop()
                        break
                    if t not in INLINE and not (tag in NO_PARAGRAPH and t == "p"):
                        break
            # inline elements left open do not reach over a block's edge
            while stack[-1].tag in INLINE:
                pop()
            node = top = stack[-1]
            if not ends_itself:
                node = Node(tag, self.path_under(top.path, step), top, top.aside or aside, False, named)
                push(node)
        close()

    def below(self, mark) -> dict[Node, object]:
        """mark(element, its parent's mark) for each element, parents first."""
        out: dict[Node, object] = {None: None}
        for n in self.nodes:
            out[n] = mark(n, out[n.parent])
        return out


def above(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def with_all_above(nodes) -> set[Node]:
    out: set[Node] = set()
    for n in nodes:
        while n is not None and n not in out:
            out.add(n)
            n = n.parent
    return out


def outside_named(page: Page) -> list[tuple[Node, str, int]]:
    """The blocks that lie in no region set aside by its name.

    A name does not count on an element that holds a main or the longest article (in a named region, teasers apart: one
    with a quarter of the text that is no comment), nor, on a page without these, on one that holds over half of
    the page's text (links do not count, and a region of comments stays one).
    """
    if not any(n.under_named for n, _, _ in page.blocks):
        return page.blocks
    inside: dict[Node, int] = defaultdict(int)
    total, remarks = 0, 0
    for node, text, links in page.blocks:
        gain = max(0, len(text) - 2 * links)
        total += gain
        remarks += gain * node.remark
        inside[node] += gain
    for n in reversed(page.nodes):
        if n in inside and n.parent is not None:
            inside[n.parent] += inside[n]
    contents = [n for n in page.nodes if n.tag in ("main", "article") and inside.get(n)]
    free = [n for n in contents if not n.under_named]
    hearts = [n for n in contents if n.tag == "main"]
    if articles := [n for n in contents if n.tag == "article"]:
        longest = max(articles, key=inside.get)
        if longest in free or 4 * inside[longest] >= total - remarks:
            hearts.append(longest)
    holds = with_all_above(hearts)
    if not hearts and not free:
        holds = {n for n in page.nodes if n.named and 2 * inside.get(n, 0) > total and not COMMENT_NAME.search(n.named)}
    out = page.below(lambda n, up: bool(up) or bool(n.named) and n not in holds)
    return [b for b in page.blocks if not out[b[0]]]


def score(text: str) -> Page:
    """The page; its blocks are those outside set-aside regions, and containers have their scores."""
    page = Page(text)
    page.blocks = outside_named(page)
    for node, text, links in page.blocks:
        container_of(node).score += max(0, len(text) - 2 * links)
    for n in reversed(page.nodes):
        if n.parent is not None:
            n.parent.score += DECAY * n.score
    return page


def best_paths(page: Page) -> dict[int, float]:
    """path -> score of all containers of a page that hold a block."""
    votes: dict[int, float] = defaultdict(float)
    for n in with_all_above(n for n, _, _ in page.blocks):
        if n.score:
            votes[n.path] += n.score * BONUS.get(n.tag, 1.0)
    return votes


def best_path(page: Page, votes: dict[int, float] | None = None) -> int:
    """The path with the highest score (-1: none has any); ties go to the shorter, then the smaller one."""
    votes = best_paths(page) if votes is None else votes
    if not votes:
        return -1
    most = max(round(v, 6) for v in votes.values())
    tied = [p for p, v in votes.items() if round(v, 6) == most]
    shortest = min(page.lengths[p] for p in tied)
    return min((p for p in tied if page.lengths[p] == shortest), key=page.path_text)


def container_of(node: Node) -> Node:
    """The element that a block's text belongs to: the parent of a paragraph or the like."""
    return node.parent if node.tag in PARAGRAPHS else node


def around(page: Page, path: int, chosen: list[bool]) -> list[bool]:
    """The chosen blocks, below elements of a path, and those that go on with them: titles, leads, text between parts.

    The lowest element above that adds text is taken whole, unless what it adds is mostly links; of elements further
    up, and of body and what is above it, only blocks that are the element's own, in no container beside the text.
    """
    found = page.blocks
    holding = with_all_above(n for (n, _, _), c in zip(found, chosen, strict=True) if c)
    over = with_all_above(n.parent for n in page.nodes if n.path == path and n.tag not in INLINE and n in holding)
    nearest = page.below(lambda n, up: n if n in over else up)
    met: dict[int, list[tuple[int, Node]]] = defaultdict(list)
    for k, (n, _, _) in enumerate(found):
        if not chosen[k] and (meet := nearest[n]) is not None:
            met[meet.depth].append((k, meet))
    out, refused, whole = list(chosen), [], False
    refused_links = refused_size = 0
    for depth in sorted(met, reverse=True):
        new = [k for k, _ in met[depth]]
        links, size = sum(found[k][2] for k in new), sum(len(found[k][1]) for k in new)
        more = None
        if not whole and met[depth][0][1].tag not in ("root", "html", "body") and 2 * (refused_links + links) <= refused_size + size:
            more = refused + new
        else:
            own = [k for k, meet in met[depth] if ((c := container_of(found[k][0])).listed or c) is meet]
            if own and 2 * sum(found[k][2] for k in own) <= sum(len(found[k][1]) for k in own):
                more = own
        if more is None:
            if not whole:
                refused += new
                refused_links, refused_size = refused_links + links, refused_size + size
            continue
        whole = True
        for k in more:
            out[k] = True
    return out


def text_under(page: Page, path: int) -> str:
    """Blocks below elements of a path and around them, in page order, joined by newlines."""
    if path < 0:
        return ""
    under = page.below(lambda n, up: bool(up) or n.path == path)
    chosen = [bool(under[n]) for n, _, _ in page.blocks]
    if not all(chosen):
        chosen = around(page, path, chosen)
    return "\n".join(t for (_, t, _), c in zip(page.blocks, chosen, strict=True) if c)


def main_text(page: Page, path: str | None) -> str:
    """A page's text by its host's path, or by its own best container if that path holds too little of the page."""
    votes = best_paths(page)
    own, at = best_path(page, votes), page.path_id(path)
    if own >= 0 and votes.get(at, 0.0) < LEAST_SHARE * votes[own]:
        at = own
    return text_under(page, at)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def page_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): each page has one vote, for the path of its best container."""

    def make():
        def work(batch):
            sums: dict[tuple[str, str], int] = defaultdict(int)
            for url, page in zip(strings(batch, "url"), strings(batch, "html"), strict=True):
                found = score(page or "")
                best = best_path(found)
                if best >= 0 and found.lengths[best] <= LONGEST_PATH:
                    sums[host_of(url), found.path_text(best)] += 1
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([sums[k] for k in keys], pa.int64())], names=["host", "path", "votes"])

        return work

    return map_batches(pages.select("url", "html"), make, "host string, path string, votes long")


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path, pages): per host the path with most votes and all votes; ties go to the shorter, then the smaller path."""
    summed = page_votes(pages).groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    won = summed.groupBy("host").agg(F.min(F.struct(-F.col("votes"), F.length("path"), "path")).alias("w"), F.sum("votes").alias("pages"))
    return won.select("host", F.col("w.path").alias("path"), "pages")


def with_paths(pages: DataFrame, winners: DataFrame, broadcast_hosts: int) -> DataFrame:
    """Pages (with their host) and their host's path. Winners are broadcast while there are few hosts; of more, only those of
    hosts with over one in MOST_HOT of all pages, of which there are MOST_HOT at most, and the other hosts are shuffled."""
    sizes = winners.agg(F.count("*").alias("hosts"), F.sum("pages").alias("pages")).first()
    paths = winners.select("host", "path")
    if sizes.hosts <= broadcast_hosts:
        return pages.join(F.broadcast(paths), "host", "left")
    is_hot = F.col("pages") > (sizes.pages or 0) / MOST_HOT
    hot, cold = winners.filter(is_hot).select("host", "path"), winners.filter(~is_hot).select("host", "path")
    met = pages.join(F.broadcast(hot), "host")
    return met.unionByName(pages.join(F.broadcast(hot.select("host")), "host", "left_anti").join(cold, "host", "left"))


def extract(pages: DataFrame, broadcast_hosts: int = MOST_HOT) -> DataFrame:
    """Main text of every page (columns page_id, url, html; others, whatever their names, play no part).

    A null or empty page gives an empty text; a null or strange url counts as the host "". Repeated rows each give a row,
    an empty table gives none. Votes that tie go to the shorter, then the smaller path. A page of any length and nesting is
    read whole, in time and memory that grow with its length.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    winners = stash(winning_paths(pages), "paths")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    joined = with_paths(pages.withColumn("host", host), winners, broadcast_hosts).select("page_id", "url", "html", "path")

    def make():
        def work(batch):
            texts = []
            for page, path in zip(strings(batch, "html"), strings(batch, "path"), strict=True):
                texts.append(main_text(score(page or ""), path))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return work

    return map_batches(joined, make, SCHEMA)
