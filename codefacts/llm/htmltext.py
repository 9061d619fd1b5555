"""Main text of web pages by consensus host paths.

A page is read once into blocks of text, each under the path of its containers (tag and class names, digits
generalised), leaving out what is not content by its tag, role or class: menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments. A class or id counts as a whole: it is a listed name, or a compound
of nothing but listed names and words that go with them (site-header, widget-area, but not with-sidebar or comments-open); and
a name drops nothing that holds three quarters of the page's text, unless it is that of reader comments. Every page scores its containers (text that is not
link text, the parent of a block in full, each level above at two thirds less) and votes for the path of the article or
main element around the best one (with the element around it, if that holds nothing else but a heading and lead before it) or, without such, of the container that holds it and all other text that is not a list
of links (a branch beside the best container, more than half link text; first and second headings are no links).
Votes are counted for each host in Spark, and every page is then extracted again from its host's winning path;
a page without that path uses its own best container, and one without any container its whole body.

A container's text is that of its blocks in page order: character references decoded, white space turned into
one space, blocks joined by one space.

Tags are read as browsers read them: end tags may be left out (an item, cell, row or paragraph ends where the next one
begins), and a quote counts only after an equals sign. A tag that the page's end cuts off is read as text.

Edge cases: null and empty html give an empty text; markup may be cut off or unclosed; a page without a host
votes with those of no host; repeated rows return each; pages of one host that are a third of all rows only add
up in counts; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import durable

_START = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
#: a quoted value starts after an equals sign only; nothing is read twice, so a page takes time in proportion to its length
TOKEN = re.compile(_START + r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>|[^<]+|<""", re.S)
#: for what follows a tag that never ends: from there on tags end at the first >, in quotes or not
LOOSE = re.compile(_START + r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<", re.S)
OPENS = re.compile("</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: parts of a name, also of one written like siteHeader
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: HTML element names by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body div section article main td th tr table tbody center blockquote ul ol dl figure details fieldset".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address hr br caption figcaption summary hgroup thead tfoot".split())
DROPPED = frozenset("nav header footer aside form head menu dialog select button svg math canvas object audio video input".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
DROPPED_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners cookie cookies consent gdpr
    notice notices alert alerts menu menus nav navbar navigation navigate breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar
    comment comments disqus discussion respond reply replies social share sharing related recommended newsletter subscribe subscription signup
    popup modal overlay toolbar pagination pager widget widgets skip login copyright""".split()
)
COMMENT_NAMES = frozenset("comment comments disqus discussion respond reply replies".split())
#: what may stand before or after a listed name in a class or id of several parts; with any other part the name says nothing
BEFORE_NAMES = frozenset("site main global top bottom left right primary secondary mobile sticky fixed blog post article entry user reader google".split())
AFTER_NAMES = frozenset(
    """area container wrapper wrap box bar block blocks list lists section sections inner outer form links link item items button buttons icon icons
    slot unit zone panel text content message title toggle count posts articles stories row column col""".split()
)
#: a name drops no element that holds so much of a page's text that is not link text, and so many characters of it
SPARED_SHARE, SPARED_CHARS = 0.75, 250
INSIDE = ("article", "main")
#: Element names by the rules for end tags that pages leave out.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = BLOCKS | DROPPED | frozenset("applet marquee search listing dir colgroup optgroup option".split()) - frozenset("svg math canvas audio video".split())
SCOPES = frozenset("applet caption html table td th marquee object button".split())
ENDS_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption br".split()) | frozenset("nav header footer aside form menu dialog search listing dir".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROWS = ("tbody", "thead", "tfoot")
HEADINGS = ("h1", "h2")
WORD = re.compile(r"\w\w")


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


@lru_cache(maxsize=1 << 16)
def _dropping(token: str) -> str:
    """The listed name that a class or id stands for: itself, or the first in a compound of parts that all are known, as in site-header or widget-area; else empty."""
    parts = PART.findall(token)
    parts = [p.lower() for p in parts]
    at = next((i for i, p in enumerate(parts) if p in DROPPED_NAMES), -1)
    if at < 0 or not set(parts[:at]) <= BEFORE_NAMES or not set(parts[at + 1 :]) <= DROPPED_NAMES | AFTER_NAMES:
        return ""
    if parts[at] == "header" and not {"post", "article", "entry", "blog"}.isdisjoint(parts[:at]):
        return ""  # the head of a story
    return parts[at]


def _names(attrs: dict[str, str]) -> set[str]:
    """The listed names in a class and an id."""
    return {name for token in (*attrs.get("class", "").split(), attrs.get("id", "")) if (name := _dropping(token))}


def _label(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted(re.sub(r"\d+", "#", c).replace("/", ":") for c in attrs.get("class", "").lower().split())
    return ".".join([tag, *dict.fromkeys(classes)])


class Tree:
    """The containers of a page that differ in path; 0 is the page itself, and a parent comes before its children."""

    def __init__(self) -> None:
        self.parent, self.label, self.depth = [0], [""], [0]
        self.child: dict[tuple[int, str], int] = {}

    def below(self, node: int, label: str) -> int:
        at = self.child.get((node, label))
        if at is None:
            at = self.child[node, label] = len(self.parent)
            self.parent.append(node)
            self.label.append(label)
            self.depth.append(self.depth[node] + 1)
        return at

    def way(self, node: int) -> list[int]:
        """The containers from the outermost to the node."""
        out = []
        while node:
            out.append(node)
            node = self.parent[node]
        return out[::-1]

    def path(self, node: int) -> str:
        return "/".join(self.label[i] for i in self.way(node))

    def find(self, path: str) -> int:
        """The container with this path; 0 if there is none."""
        node = 0
        for label in path.split("/"):
            node = self.child.get((node, label), -1)
            if node < 0:
                return 0
        return node


class _Open:
    """The elements that are open, and where the last of each name, of special ones and of limits of end tags stand."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.bad: list[bool] = []
        self.before: list[int] = []  # the container around it
        self.where: dict[str, list[int]] = {}
        self.special: list[int] = []
        self.stops: list[int] = []  # special ones that an item's implied end does not cross
        self.scopes: list[int] = []
        self.drop = 0
        #: where in the page an element begins that is dropped by its name alone (else -1), and the weight of text before it
        self.named: list[tuple[int, int]] = []
        self.soft = self.weight = 0
        self.sizes: list[tuple[int, int]] = []

    def last(self, tag: str) -> int:
        at = self.where.get(tag)
        return at[-1] if at else -1

    def push(self, tag: str, bad: bool, here: int, named: int = -1) -> None:
        at = len(self.tags)
        self.named.append((named, self.weight))
        self.soft += named >= 0
        self.tags.append(tag)
        self.bad.append(bad)
        self.before.append(here)
        self.where.setdefault(tag, []).append(at)
        self.drop += bad
        if tag in SPECIAL:
            self.special.append(at)
            if tag not in ("address", "div", "p"):
                self.stops.append(at)
            if tag in SCOPES:
                self.scopes.append(at)

    def pop_to(self, at: int) -> int:
        """Ends the element at this place and all inside it; the container that is left."""
        here = self.before[at]
        while len(self.tags) > at:
            tag = self.tags.pop()
            self.drop -= self.bad.pop()
            self.before.pop()
            self._size(*self.named.pop())
            n = len(self.tags)
            if tag:
                self.where[tag].pop()
            for places in (self.special, self.stops, self.scopes):
                if places and places[-1] == n:
                    places.pop()
        return here

    def remove(self, at: int) -> None:
        """Ends a formatting element, but nothing inside it."""
        self.where[self.tags[at]].pop()
        self.drop -= self.bad[at]
        self._size(*self.named[at])
        self.tags[at], self.bad[at], self.named[at] = "", False, (-1, 0)

    def _size(self, named: int, before: int) -> None:
        if named >= 0:
            self.soft -= 1
            self.sizes.append((named, self.weight - before))

    def ended_by(self, tag: str) -> int:
        """Where the outermost element stands that the start of this tag ends without an end tag; -1 for none."""
        scope = self.scopes[-1] if self.scopes else -1
        found = -1
        if tag == "li" or tag == "dt" or tag == "dd":
            mine = ("li",) if tag == "li" else ("dt", "dd")
            if self.stops and self.tags[self.stops[-1]] in mine:
                found = self.stops[-1]
        elif tag in ("tr", "td", "th", *ROWS):
            table = self.last("table")
            if tag in ("td", "th"):
                table = max(table, self.last("tr"))
            ends = ("td", "th") if tag in ("td", "th") else ("td", "th", "tr") if tag == "tr" else ("td", "th", "tr", *ROWS)
            return min((at for t in ends if (at := self.last(t)) > table), default=-1)
        elif tag in ("option", "optgroup"):
            return self.last("option") if self.last("option") > self.last("select") else -1
        elif tag in HEADS and self.special and self.tags[self.special[-1]] in HEADS:
            found = self.special[-1]
        if tag in ENDS_P and (p := self.last("p")) > scope:
            found = p if found < 0 else min(found, p)
        return found


def blocks(page: str, spared: frozenset[int] | None = None) -> tuple[Tree, list[tuple[int, str, int]]]:
    """The containers of a page, and its blocks in order: (container, text, characters of link text).

    Where an element that its name drops holds most of the page's text, the page is read once more without dropping it.
    """
    tree, open_ = Tree(), _Open()
    out: list[tuple[int, str, int]] = []
    here = 0
    text: list[str] = []
    linked, heading = 0, False

    def close_block() -> None:
        nonlocal linked
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                out.append((here, words, min(linked, len(words))))
            text.clear()
        linked = 0

    token = TOKEN
    at, size = 0, len(page)
    while at < size:
        m = token.match(page, at)
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece == "<" and OPENS.match(page, at):  # a tag that never ends
                if token is LOOSE:
                    if not open_.drop:
                        text.append(page[at:])
                    break
                token = LOOSE
                continue
            at = m.end()
            if open_.drop == open_.soft and not piece.startswith(("<!", "<?", "</")):
                link = not heading and bool(open_.where.get("a"))
                open_.weight += 0 if link else len(piece.strip())
                if not open_.drop:
                    text.append(piece)
                    linked += len(piece) if link else 0
            continue
        at = m.end()
        tag = tag.lower()
        if m[1]:
            if tag in SPECIAL:
                heading = False
                if not open_.drop:
                    close_block()
            if tag in ("html", "body"):
                continue
            place = max(open_.last(h) for h in HEADS) if tag in HEADS else open_.last(tag)
            if place < 0:
                continue
            if tag in SPECIAL:
                inside = tag in ("table", "tr", "td", "th", "caption", *ROWS)
                limit = max(open_.last("table"), open_.last("ul") if tag == "li" else -1, open_.last("ol") if tag == "li" else -1) if inside or tag == "li" else open_.scopes[-1] if open_.scopes else -1
                ends = place > limit or (tag in SCOPES and place == limit)
            else:
                ends = not open_.special or place > open_.special[-1]
                if not ends and tag in FORMATTING:
                    open_.remove(place)
                    continue
            if ends:
                here = open_.pop_to(place)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = stop + 1 if stop >= 0 else size
            continue
        if tag in SPECIAL:
            if tag not in VOID:
                heading = tag in HEADINGS
            if not open_.drop:
                close_block()
            while (ended := open_.ended_by(tag)) >= 0:
                here = open_.pop_to(ended)
        if tag in VOID:
            continue
        if tag == "a" and (earlier := open_.last("a")) >= 0:
            open_.remove(earlier)
        attrs = attributes(m[3])
        names = _names(attrs) if tag not in ("html", "body", *INSIDE) else set()
        inside = bool(open_.where.get("article") or open_.where.get("main"))
        if inside:
            names -= {"header"}  # an article's own head belongs to it
        hard = (
            (tag in DROPPED and not (tag == "header" and inside))
            or attrs.get("role", "").lower() in DROPPED_ROLES
            or "hidden" in attrs
            or attrs.get("aria-hidden", "").lower() == "true"
            or not names.isdisjoint(COMMENT_NAMES)
        )
        bad = hard or bool(names) and not (spared and m.start() in spared)
        if bad and not open_.drop:
            close_block()
        open_.push(tag, bad, here, m.start() if bad and not hard else -1)
        if tag in CONTAINERS and not open_.drop:
            close_block()
            here = tree.below(here, _label(tag, attrs))
    if not open_.drop:
        close_block()
    if open_.tags:
        open_.pop_to(0)
    large = frozenset(p for p, n in open_.sizes if n >= SPARED_CHARS and n > SPARED_SHARE * open_.weight)
    return blocks(page, large) if large and spared is None else (tree, out)


def _core(tree: Tree, found: list[tuple[int, str, int]]) -> int:
    """The container with most text of its own; 0 without text in containers."""
    score: dict[int, float] = {}
    for node, text, linked in found:
        value = (len(text) - linked) * (1 - linked / len(text)) + 20 * text.count(", ")
        share = 1.0
        while node and share > 0.01:
            score[node] = score.get(node, 0.0) + value * share
            node, share = tree.parent[node], share / 3
    return max(score, key=lambda n: (score[n], -tree.depth[n], -n), default=0)


def _article(tree: Tree, node: int) -> int:
    """The whole article that a container lies in, if one is marked; else 0."""
    way = tree.way(node)
    for tag in INSIDE:
        for n in way:
            if tree.label[n].split(".")[0] == tag:
                return n
    return 0


def _branches(tree: Tree, found: list[tuple[int, str, int]], core: int) -> list[int | None]:
    """Of each container the branch in which it leaves the way to core; None in core itself and in branches that are lists of links."""
    way = {0, *tree.way(core)}
    branch: list[int | None] = []
    for node, parent in enumerate(tree.parent):
        if node == core or (node and branch[parent] is None):
            branch.append(None)
        else:
            branch.append(node if node in way or parent in way else branch[parent])
    size: dict[int, list[int]] = {}
    for node, text, linked in found:
        if (b := branch[node]) is not None:
            total = size.setdefault(b, [0, 0])
            total[0] += len(text)
            total[1] += linked
    return [None if b is None or b in size and 2 * size[b][1] > size[b][0] else b for b in branch]


def _has_lead(tree: Tree, found: list[tuple[int, str, int]], article: int, around: int) -> bool:
    """Whether the element around an article holds the heading and lead: text of its own that is no link text, first before the article, and no other container with text."""
    if tree.label[around].split(".")[0] in ("html", "body"):
        return False
    inner, outer = _under(tree, article), _under(tree, around)
    region = [(node, text, linked) for node, text, linked in found if outer[node]]
    own = [(node, text, linked) for node, text, linked in region if not inner[node]]
    return bool(own) and region[0][0] == around and all(node == around and 2 * linked <= len(text) for node, text, linked in own)


def best_container(tree: Tree, found: list[tuple[int, str, int]]) -> int:
    """The container of all of the page's own main text; 0 without text, and if no container holds all."""
    core = _core(tree, found)
    if article := _article(tree, core):
        around = tree.parent[article]
        return around if around and _has_lead(tree, found, article, around) else article
    branch, way = _branches(tree, found, core), tree.way(core)
    on_way = set(way)
    depth = len(way)
    for node, text, _ in found:
        if (b := branch[node]) is not None and WORD.search(text):
            depth = min(depth, tree.depth[b] - (b != 0 and b not in on_way))
    return way[depth - 1] if depth else 0


def best_path(tree: Tree, found: list[tuple[int, str, int]]) -> str:
    return tree.path(best_container(tree, found))


def _main_blocks(tree: Tree, found: list[tuple[int, str, int]]) -> str:
    """The text of these blocks without lists of links beside the container with most text; of a marked article all."""
    core = _core(tree, found)
    if _article(tree, core):
        return " ".join(text for _, text, _ in found)
    branch = _branches(tree, found, core)
    in_core = _under(tree, core)
    return " ".join(text for node, text, _ in found if branch[node] is not None or in_core[node])


def _under(tree: Tree, top: int) -> list[bool]:
    """Whether each container is the given one or lies in it."""
    out = [top == 0]
    for node in range(1, len(tree.parent)):
        out.append(node == top or out[tree.parent[node]])
    return out


def extract(page: str | None, winner: str | None) -> str:
    """The text under the winning path, or under the page's own best container where it has no such path."""
    if not page:
        return ""
    tree, found = blocks(page)
    for wanted in (lambda: tree.find(winner) if winner else 0, lambda: best_container(tree, found)):
        if top := wanted():
            under = _under(tree, top)
            if some := [b for b in found if under[b[0]]]:
                return _main_blocks(tree, some)
    return _main_blocks(tree, found)


def votes(pages: DataFrame) -> DataFrame:
    """host, path: each page's vote."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([best_path(*blocks(h)) if h else "" for h in part.column(1).to_pylist()], pa.string())], ["host", "path"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string")


def main_text(pages: DataFrame, most_hosts: int = 100_000) -> DataFrame:
    """page_id, url, host, path (the host's winner), text.

    The winners of hosts with one in most_hosts of the votes or more are broadcast (so there are no more than most_hosts);
    only pages of smaller hosts, if there are any, are shuffled by host.
    """
    with_host = pages.select("page_id", "url", "html", F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")).alias("host"))
    count = votes(with_host).filter("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    winners = durable(count.groupBy("host").agg(F.max_by("path", F.struct("n", F.col("path"))).alias("path"), F.sum("n").alias("n")), "winners")
    size = winners.agg(F.count("*").alias("hosts"), F.sum("n").alias("votes")).first()
    if size["hosts"] <= most_hosts:
        joined = with_host.join(F.broadcast(winners.drop("n")), "host", "left")
    else:
        large = winners.withColumn("large", F.col("n") >= size["votes"] / most_hosts)
        known = with_host.join(F.broadcast(large.filter("large").select("host", "path")), "host", "left")
        small = known.filter("path IS NULL").drop("path").join(large.filter("NOT large").select("host", "path"), "host", "left")
        joined = known.filter("path IS NOT NULL").unionByName(small)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = [extract(h, w) for h, w in zip(part.column(2).to_pylist(), part.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), part.column(4), pa.array(text, pa.string())], ["page_id", "url", "host", "path", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "host", "path").mapInArrow(run, f"page_id {kind}, url string, host string, path string, text string")


def op9_consensus_path_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
