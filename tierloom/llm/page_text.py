"""Main text of web pages by consensus of a host's pages.

Each page's containers are scored by how much prose they hold outside links and page furniture, and the
best one votes, per host, for its generalised path of tags and classes. Votes are counted in Spark and
every page is extracted again from the container that the host's winning path names; a page without
it keeps its own best container.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import extended, slices, stored
from tierloom.llm.url_rules import host_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")

# Groups of elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select".split())
FURNITURE = frozenset("nav header footer aside form button dialog menu head".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Starting one of these ends an open paragraph.
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary"}
#: Parts of class, id and role names that mark page furniture.
MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
                  "feedback footer form gdpr menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted "
                  "related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
#: Words that turn a mark beside them into a statement about the page: "no-sidebar", "comments-enabled".
STATES = frozenset("no not non has have with without is hide enabled disabled ready open closed on off".split())
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A marked element that holds more than this share of the page's prose is a wrapper, not furniture.
WRAPPER = 0.8


@dataclass(eq=False, slots=True)
class Node:
    """An element. ``step`` is its part of the path and ``code`` a hash of the path to it, so that deep pages do not
    hold a long path per element; ``marked`` tells a class or name of furniture, ``dropped`` what is left out."""

    tag: str
    step: str
    code: int
    inside: Node | None
    dropped: bool
    marked: bool
    linked: bool
    begin: int
    text: int = 0
    links: int = 0
    end: int = -1
    headline: bool = False

    @property
    def path(self) -> str:
        steps, up = [], self
        while up is not None:
            if up.step:
                steps.append(up.step)
            up = up.inside
        return "".join(f">{s}" for s in reversed(steps))


def path_code(path: str, before: int = 0) -> int:
    """Hash of a path; that of a longer path follows from the hash of its beginning."""
    data = path.encode("utf-8", "surrogatepass")
    return zlib.crc32(data, before >> 32) << 32 | zlib.adler32(data, before & 0xFFFFFFFF or 1)


@dataclass
class Piece:
    """A run of text and the node it lies in; ``breaks`` starts a new block before it."""

    text: str
    node: Node
    breaks: bool


def _left_out(tag: str, attributes: str) -> bool:
    """Elements that never hold the article: furniture by tag, and hidden ones."""
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() == "aria-hidden" and (a or b or c).lower() == "true":
            return True
    return re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes) is not None


def _marked(tag: str, attributes: str) -> bool:
    """Elements whose class, id, role or label names page furniture; a name that only states something does not count."""
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "aria-label"):
            for token in (a or b or c).split():
                words = {w.lower() for w in NAMES.findall(token)}
                if words & MARKS and not words & STATES:
                    return True
    return False


def _unwrap(pieces: list[Piece], nodes: list[Node]) -> None:
    """Settle ``dropped``: marked elements fall, but for those around nearly all of the page's prose.

    Such a wrapper must hold the page's main headline if there is one, so that long comments below a short
    article stay out. ``nodes`` are all elements in page order, so one that lies in another comes after it.
    """
    prose = dict.fromkeys((n for n in nodes if n.marked), 0)
    total = 0
    if prose:
        for p in pieces:
            size = len(p.text.strip())
            if not size or p.node.dropped or p.node.linked:
                continue
            total += size
            up: Node | None = p.node
            while up is not None:
                if up.marked:
                    prose[up] += size
                up = up.inside
    headline = any(n.tag == "h1" and not n.dropped for n in nodes)
    if headline and prose:
        for n in nodes:
            up = n if n.tag == "h1" and not n.dropped else None
            while up is not None:
                up.headline = True
                up = up.inside
    for n in nodes:
        wrapper = n.marked and prose[n] > WRAPPER * total and (n.headline or not headline)
        n.dropped = n.dropped or (n.marked and not wrapper) or (n.inside is not None and n.inside.dropped)


def _step(tag: str, attributes: str) -> str:
    """A path step: the tag and its classes, digits generalised."""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        if name.lower() == "class":
            classes = sorted({DIGITS.sub("N", x) for x in (a or b or c).split()})
            return ".".join([tag, *classes])
    return tag


def parse(page: str) -> tuple[list[Piece], list[Node]]:
    """Text runs in page order and the containers. Unclosed elements end with the element around them."""
    root = Node("#", "", path_code(""), None, False, False, False, 0)
    stack, pieces, nodes, every = [root], [], [root], [root]
    at, breaks, raw = 0, True, ""
    n = len(page)

    def put(upto: int) -> None:
        nonlocal breaks
        if upto > at:
            pieces.append(Piece(page[at:upto], stack[-1], breaks))
            breaks = False

    while at < n:
        if raw:
            close = re.compile(rf"</{raw}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else n
            raw = ""
            continue
        m = TOKEN.search(page, at)
        if not m:
            put(n)
            break
        put(m.start())
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if tag in BLOCKS:
                breaks = True
            if depth and not (tag not in BLOCKS and any(x.tag in BLOCKS and x.tag != "p" for x in stack[depth + 1:])):
                for node in stack[depth:]:
                    node.end = len(pieces)
                del stack[depth:]
            continue
        attributes = m.group(3) or ""
        if tag == "br":
            pieces.append(Piece(" ", stack[-1], breaks))
            breaks = False
            continue
        if tag in BLOCKS:
            breaks = True
        if tag in VOID:
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                raw = tag
            continue
        if tag in ENDS_P:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in CONTAINERS), 0)
            if depth and stack[depth].tag == "p":
                for node in stack[depth:]:
                    node.end = len(pieces)
                del stack[depth:]
        if tag == "li":
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("li", "ul", "ol", *CONTAINERS)), 0)
            if depth and stack[depth].tag == "li":
                for node in stack[depth:]:
                    node.end = len(pieces)
                del stack[depth:]
        above = stack[-1]
        step = _step(tag, attributes) if tag in BLOCKS else ""
        node = Node(tag, step, path_code(f">{step}", above.code) if step else above.code, above, above.dropped or _left_out(tag, attributes),
                    _marked(tag, attributes), above.linked or tag == "a", len(pieces))
        stack.append(node)
        every.append(node)
        if tag in CONTAINERS:
            nodes.append(node)
    for node in stack:
        if node.end < 0:
            node.end = len(pieces)
    root.end = len(pieces)
    _unwrap(pieces, every)
    return pieces, nodes


def best_container(pieces: list[Piece], nodes: list[Node]) -> Node:
    """The deepest container that holds nearly all the prose of its surroundings.

    Prose counts characters of kept text outside links, links count against. An ``article`` or
    ``main`` is favoured over plain containers.
    """
    for p in pieces:
        size = len(p.text.strip())
        if not size or p.node.dropped:
            continue
        up: Node | None = p.node
        while up is not None:
            if p.node.linked:
                up.links += size
            else:
                up.text += size
            up = up.inside
    best, best_score = nodes[0], -1.0
    for node in nodes:
        if node.dropped or not node.text:
            continue
        share = node.text / max(nodes[0].text, 1)
        density = node.text / (node.text + 2 * node.links)
        favour = 1.0 if node.tag in ("article", "main") else 0.4 if node.tag == "blockquote" else 0.6
        score = share * density + 0.3 * favour
        # Nodes come outer ones first: a deeper one wins a tie, so depth alone never leaves prose outside.
        if score >= best_score:
            best, best_score = node, score
    return best


def chosen_containers(own: Node, named: list[Node]) -> list[Node]:
    """What to extract: the containers on the winning path that lie in the page's own choice or around it, else all of them.

    Where the ones inside do not hold all the prose of the own choice, it stays whole. Nodes of one path
    never lie in each other.
    """
    inside = [x for x in named if _lies_in(x, own)]
    if inside:
        return inside if sum(x.text for x in inside) == own.text else [own]
    return [x for x in named if _lies_in(own, x)] or named or [own]


def _lies_in(node: Node, outer: Node) -> bool:
    up: Node | None = node
    while up is not None and up is not outer:
        up = up.inside
    return up is outer


def text_of(pieces: list[Piece], node: Node) -> str:
    """Blocks of the kept text of a container, in page order."""
    blocks: list[str] = []
    run: list[str] = []
    fresh = False
    for p in pieces[node.begin:node.end]:
        fresh = fresh or p.breaks
        if p.node.dropped:
            fresh = True
            continue
        if fresh and run:
            blocks.append("".join(run))
            run = []
        fresh = False
        run.append(p.text)
    blocks.append("".join(run))
    tidy = (SPACE.sub(" ", html.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in tidy if b)


def _votes(pages: DataFrame, page: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            paths, weights = [], []
            for text in batch.column("_html").to_pylist():
                pieces, nodes = parse(text or "")
                node = best_container(pieces, nodes)
                paths.append(node.path)
                weights.append(node.text)
            yield pa.RecordBatch.from_arrays([batch.column("_host"), pa.array(paths, pa.string()), pa.array(weights, pa.int64())],
                                             names=["_host", "path", "weight"])

    return pages.select("_host", F.col(page).alias("_html")).mapInArrow(run, "_host string, path string, weight long")


def winning_paths(pages: DataFrame, host: Column, page: str = "html") -> DataFrame:
    """``_host`` and its ``_path`` with most pages, then most text, then the smallest path."""
    counted = _votes(pages.select(host.alias("_host"), F.col(page).alias("_page")).filter("_page <> ''"), "_page").groupBy("_host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return counted.filter("path <> '' and weight > 0").groupBy("_host").agg(
        F.min_by("path", F.struct(-F.col("n"), -F.col("weight"), "path")).alias("_path"))


def extract(pages: DataFrame, keep: list[str] | None = None, url: str = "url", page: str = "html") -> DataFrame:
    """Add ``text`` (empty if none) and ``n_chars`` (code points) to pages.

    Null html counts as empty; pages with a null url, or one without host, vote together. Pages are judged row by row,
    so repeated rows stay. Columns named like the added ones are replaced. ``keep`` names the
    columns carried along (all but the html by default). An empty table stays empty.
    """
    carried = [c for c in (keep or [c for c in pages.columns if c != page]) if c not in ("text", "n_chars")]
    won = stored(winning_paths(pages, host_of(F.col(url)), page), "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            out = []
            for source, path in zip(batch.column("_html").to_pylist(), batch.column("_path").to_pylist()):
                pieces, nodes = parse(source or "")
                own = best_container(pieces, nodes)
                code = path_code(path or "")
                named = [x for x in nodes if x.code == code and not x.dropped and x.text and x.path == path]
                chosen = chosen_containers(own, named)
                out.append("\n".join(t for t in (text_of(pieces, x) for x in chosen if not x.dropped) if t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["_row", "text", "n_chars"])

    # The row is packed, so that no column of the table clashes with one of the job's own.
    rows = pages.select(F.struct(*carried).alias("_row"), F.col(page).alias("_html"), host_of(F.col(url)).alias("_host"))
    schema = extended(rows.select("_row").schema, "text string, n_chars long")
    return rows.join(won, "_host", "left").mapInArrow(run, schema).select("_row.*", "text", "n_chars")
