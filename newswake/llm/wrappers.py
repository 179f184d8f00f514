"""Main text of web pages by wrapper induction: pages of one host are aligned, what stays the same is template, what varies is content."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswake.llm.common import table
from newswake.operators.joins import salted_join
from newswake.session import written

MIN_PAGES = 5  # different pages of a host from which a template is learnt
CONSTANT = 0.8  # of a host's different pages that hold a text at the same node: then it is template
MIN_SUPPORT = 0.02  # of the pages behind a merged tree that have a node: rarer nodes stand for no slot
MERGED = 32  # trees that one task merges at a time
MAX_DEPTH = 48  # of a tree to be aligned; what is deeper hangs on the node at this depth
LINKED = 0.9  # of the characters of a block that are links: then it is a menu, on pages that mark no article

# ---- Fixed values: HTML elements and the usual names of what is no article. ----
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe noembed noframes script style textarea title xmp".split())
SKIPPED_TAGS = frozenset("aside dialog footer form head menu nav search".split())
SKIPPED_INLINE = frozenset("audio button canvas noscript object select svg template video".split())
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
SKIPPED_NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup "
    "promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "toolbar widget widgets".split())
MASTHEADS = frozenset("global header page site top".split())  # first parts of names of a page's header: "site-header"
UNSAID = frozenset("has no not with without".split())  # first parts of names that only speak of such a thing: "no-sidebar"
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
          "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"),
          "thead": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tfoot", "tr", "td", "th"), "body": ("head",)}
HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": (), "optgroup": (), "tr": ("table",), "td": ("table",),
         "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "body": ()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BARRIERS = frozenset("table td th caption".split())  # which only tags of tables close
TABLE_TAGS = frozenset("table caption tbody td tfoot th thead tr body html".split())
# ---------------------------------------------------------------------------------

MARKUP = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""",
    re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW_TAGS}
PART = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=1 << 14)
def _element(tag: str, attributes: str) -> tuple[str, str, bool, bool]:
    """Kind of an element (its tag, or ``header`` by its names), its label in a tree, and whether it is no article by its tag or role, or by its names."""
    given = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = [n for key in ("class", "id") for n in given.get(key, "").split()]
    label = ".".join([tag, *sorted(re.sub(r"[^a-z#-]+", "", re.sub(r"\d+", "#", n.lower())) for n in names)])
    if len(label) > 60:
        label = f"{tag}.{zlib.crc32(label.encode()):08x}"
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    out = hidden or tag in SKIPPED_TAGS or given.get("role", "").lower() in SKIPPED_ROLES

    told = [parts for n in names if (parts := PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", n).lower())) and parts[0] not in UNSAID]
    if tag in ("html", "body", "article", "main"):  # these often name what else the page holds: only a whole name counts
        return tag, label, out, any(len(parts) == 1 and parts[0] in SKIPPED_NAMES for parts in told)
    kind = "header" if any("header" in parts and parts[0] in MASTHEADS for parts in told) else tag
    return kind, label, out, any(not SKIPPED_NAMES.isdisjoint(parts) for parts in told)


@dataclass
class Page:
    """A page as a tree of its block elements; node 0 is the page. ``blocks`` are (node, text, linked characters) in page order."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    labels: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    out: list[bool] = field(default_factory=lambda: [False])
    named: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def open(self, parent: int, tag: str, label: str, out: bool, named: bool) -> int:
        for values, value in ((self.tags, tag), (self.labels, label), (self.parents, parent), (self.out, out), (self.named, named)):
            values.append(value)
        self.depths.append(self.depths[parent] + 1)
        return len(self.tags) - 1

    def under(self, own: list[bool]) -> list[bool]:
        """For each node whether it or a node above it is marked."""
        marks = list(own)
        for k in range(1, len(marks)):
            marks[k] = marks[k] or marks[self.parents[k]]
        return marks

    def article(self) -> list[tuple[int, str]]:
        """The (node, text) of the blocks that may be article.

        Without menus, forms and the like, by tag, role or name; a ``header``
        is left out unless it stands in an article. If the page marks an
        ``article`` or else a ``main``, only what is in it; otherwise blocks
        that are all link are left out as menus.
        """
        inside = self.under([t in ("article", "main") for t in self.tags])
        hard = self.under([o or t == "header" and not i for o, t, i in zip(self.out, self.tags, inside, strict=True)])
        skipped = self.under([h or n for h, n in zip(hard, self.named, strict=True)])

        def within(left_out: list[bool]) -> list[tuple[int, str]] | None:
            for tag in ("article", "main"):
                tops = [t == tag and not s and not n for t, s, n in zip(self.tags, left_out, self.named, strict=True)]
                if any(tops):
                    area = self.under(tops)
                    named = self.under([n and a for n, a in zip(self.named, area, strict=True)])
                    return [(k, text) for k, text, _ in self.blocks if area[k] and not left_out[k] and not named[k]]
            return None

        found = within(skipped)
        if found is None:
            found = [(k, text) for k, text, linked in self.blocks if not skipped[k] and linked < LINKED * len(text)]
        return found or within(hard) or []  # the last: an article in an element whose name speaks of something else

    def places(self) -> tuple[str, list[int]]:
        """The shape of the page, and the place of every node in it.

        The shape is the tree with siblings of equal shape as one: the items
        of a list or the paragraphs of an article are one repeated node. It is
        written as ``label(child child)``, and places count its nodes in order.
        """
        n = len(self.tags)
        up = list(range(n))
        for k in range(1, n):
            up[k] = k if self.depths[k] <= MAX_DEPTH else up[self.parents[k]]
        children: list[dict[str, None]] = [{} for _ in range(n)]
        shapes = [""] * n
        for k in range(n - 1, -1, -1):
            if up[k] == k:
                below = " ".join(reversed(children[k]))
                shapes[k] = f"{self.labels[k]}({below})" if below else self.labels[k]
                if k:
                    siblings = children[self.parents[k]]
                    siblings.pop(shapes[k], None)  # the first of equal siblings stands for all, and is met last here
                    siblings[shapes[k]] = None
        known: dict[tuple[int, str], int] = {}
        place = [0] * n
        for k in range(1, n):
            place[k] = place[up[k]] if up[k] != k else known.setdefault((place[self.parents[k]], shapes[k]), len(known) + 1)
        return shapes[0], place


def parse(html: str) -> Page:
    """The blocks of a page: runs of text between the borders of block elements, character references decoded, white space as one blank.

    Elements that HTML lets authors leave open are closed by what follows;
    end tags without a beginning are passed over; comments, scripts and styles
    hold no text. A page that is cut short ends all that is open.
    """
    page = Page()
    stack: list[tuple[str, int, bool]] = [("#page", 0, False)]  # tag, node, an inline element that is passed over
    pieces: list[str] = []
    state = {"linked": 0, "link": False, "mute": 0}

    def text(raw: str) -> None:
        if raw and not state["mute"]:
            if stack[-1][0] == "head" and not raw.isspace():
                pop_to(len(stack) - 1)
            decoded = entities.unescape(raw) if "&" in raw else raw
            pieces.append(decoded)
            if state["link"]:
                state["linked"] += len("".join(decoded.split()))

    def flush() -> None:
        if pieces:
            whole = " ".join("".join(pieces).split())
            if whole:
                node = next(n for _, n, inline in reversed(stack) if not inline)
                share = min(1.0, state["linked"] / max(1, len(whole.replace(" ", ""))))
                page.blocks.append((node, whole, round(share * len(whole))))
            pieces.clear()
        state["linked"] = 0

    def pop_to(at: int) -> None:
        flush()
        for _, _, inline in stack[at:]:
            state["mute"] -= inline
        del stack[at:]
        state["link"] = False

    def implied_end(tag: str) -> None:
        """Ends what the start of a block ends: a paragraph, a heading, and elements of its own kind up to what holds them."""
        if stack[-1][0] in ("p", "head") or tag in HEADINGS and stack[-1][0] in HEADINGS:
            pop_to(len(stack) - 1)
        ends, holds = CLOSES.get(tag, ()), HOLDS.get(tag, ())
        found = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in holds:
                break
            if stack[k][0] in ends:
                found = k
        if found:
            pop_to(found)

    at = 0
    while m := MARKUP.search(html, at):
        text(html[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end
            if tag == "a":
                state["link"] = False
            elif tag == "p" or tag in BLOCK_TAGS or tag in SKIPPED_INLINE or stack[-1][2]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        if stack[k][2]:
                            state["mute"] -= sum(inline for _, _, inline in stack[k:])
                            del stack[k:]
                        else:
                            pop_to(k)
                        break
                    if stack[k][0] in BARRIERS and tag not in TABLE_TAGS:
                        break
            continue
        if tag in RAW_TAGS:
            end = RAW_ENDS[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "br":
            text("\n")
        elif tag == "a":
            state["link"] = True
        elif tag == "hr":
            flush()
        elif tag in VOID_TAGS:
            continue
        elif tag in BLOCK_TAGS:
            if tag == "html":
                continue
            flush()
            implied_end(tag)
            parent = next(n for _, n, inline in reversed(stack) if not inline)
            stack.append((tag, page.open(parent, *_element(tag, m[3] or "")), False))
        elif not (m[3] or "").endswith("/") and (
                tag in SKIPPED_INLINE or m[3] and ("hidden" in m[3] or "display" in m[3]) and _element(tag, m[3])[2]):
            stack.append((tag, -1, True))
            state["mute"] += 1
    text(html[at:])
    pop_to(1)
    return page


class Node:
    """A node of a tree to be aligned; ``weight`` counts the pages that have it."""

    __slots__ = ("label", "weight", "kids")

    def __init__(self, label: str, weight: int):
        self.label, self.weight, self.kids = label, weight, []


TOKEN = re.compile(r"([^\s()=]+)(?:=(\d+))?|([()])")


def read_tree(shape: str, weight: int = 1) -> Node:
    """The tree that a shape or a written template names; nodes without a weight of their own get the given one."""
    top, path = Node("", 0), []
    path.append(top)
    for m in TOKEN.finditer(shape):
        if m[1]:
            path[-1].kids.append(Node(m[1], int(m[2]) if m[2] else weight))
        elif m[3] == "(":
            path.append(path[-1].kids[-1])
        else:
            path.pop()
    return top.kids[0]


def write_tree(node: Node) -> str:
    below = " ".join(map(write_tree, node.kids))
    return f"{node.label}={node.weight}({below})" if below else f"{node.label}={node.weight}"


def preorder(node: Node) -> Iterator[Node]:
    yield node
    for kid in node.kids:
        yield from preorder(kid)


def _matching(a: Node, b: Node, memo: dict) -> tuple[int, list[list[int]]]:
    """Simple tree matching: the most nodes that two trees share in order, their roots matched, and the table of their children."""
    key = id(a), id(b)
    if key not in memo:
        best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids, 1):
            for j, y in enumerate(b.kids, 1):
                met = best[i - 1][j - 1] + _matching(x, y, memo)[0] if x.label == y.label else 0
                best[i][j] = max(met, best[i - 1][j], best[i][j - 1])
        memo[key] = best[-1][-1] + 1, best
    return memo[key]


def _pairs(a: Node, b: Node, memo: dict) -> list[tuple[int, int]]:
    """Places of the children that simple tree matching aligns."""
    best = _matching(a, b, memo)[1]
    i, j, found = len(a.kids), len(b.kids), []
    while i and j:
        x, y = a.kids[i - 1], b.kids[j - 1]
        if x.label == y.label and best[i][j] == best[i - 1][j - 1] + _matching(x, y, memo)[0]:
            found.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return found[::-1]


def merge(template: Node, tree: Node) -> None:
    """Adds a tree to the template: aligned nodes gain its weight, the others go in behind the aligned ones before them."""
    memo: dict = {}

    def add(a: Node, b: Node) -> None:
        a.weight += b.weight
        met, kids, last = dict((j, i) for i, j in _pairs(a, b, memo)), [], 0
        for j, y in enumerate(b.kids):
            if j in met:
                kids += a.kids[last:met[j]]
                add(a.kids[met[j]], y)
                kids.append(a.kids[met[j]])
                last = met[j] + 1
            else:
                kids.append(y)
        a.kids = kids + a.kids[last:]

    if template.label == tree.label:
        add(template, tree)


def merged(trees: list[tuple[int, str]]) -> str:
    """One template of the trees (weight, shape), the heaviest first, without the nodes that next to no page has."""
    trees = sorted(trees, key=lambda t: (-t[0], t[1]))
    template = read_tree(trees[0][1], trees[0][0])
    for weight, shape in trees[1:]:
        merge(template, read_tree(shape, weight))
    least = MIN_SUPPORT * template.weight

    def prune(node: Node) -> None:
        node.kids = [k for k in node.kids if k.weight >= least]
        for k in node.kids:
            prune(k)

    prune(template)
    return write_tree(template)


@lru_cache(maxsize=1 << 12)
def aligned(template: str, shape: str) -> tuple[int, ...]:
    """For each place of a shape the node of the template that it is aligned with, or -1."""
    a, b = read_tree(template), read_tree(shape)
    at = {id(n): k for k, n in enumerate(preorder(a))}
    found, memo = {id(b): 0}, {}

    def walk(x: Node, y: Node) -> None:
        for i, j in _pairs(x, y, memo):
            found[id(y.kids[j])] = at[id(x.kids[i])]
            walk(x.kids[i], y.kids[j])

    if a.label == b.label:
        walk(a, b)
    return tuple(found.get(id(n), -1) for n in preorder(b))


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)


def host(url: Column) -> Column:
    """Host of an address in lower case; of none the empty string."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.coalesce(found, F.lit(""))


SKELETON = "host string, shape string, blocks array<struct<place: int, text: bigint>>"


def skeletons(pages: DataFrame) -> DataFrame:
    """The different pages (host, html) of each host: their shape, and place and hash of each different block that may be article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.list_(pa.struct([("place", pa.int32()), ("text", pa.int64())]))]
        for batch in batches:
            rows = []
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(html or "")
                shape, place = page.places()
                seen = {(place[k], _hash(text)): None for k, text in page.article()}
                rows.append((name, shape, [{"place": p, "text": t} for p, t in seen]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), kinds, strict=True)], ["host", "shape", "blocks"])

    return pages.select("host", "html").mapInArrow(run, SKELETON).distinct()


def templates(shapes: DataFrame) -> DataFrame:
    """(host, template) from (host, shape, weight): the shapes of a host merged, ``MERGED`` at a time, until one tree is left.

    Which shapes meet is decided by their hash, so a host with very many
    shapes is merged by many tasks, round by round; the driver sees the
    largest number of trees of a host.
    """
    rows = written(shapes, "shapes")
    size = rows.groupBy("host").agg(F.count("*").alias("n"))
    most = size.agg(F.max("n")).first()[0] or 0
    first = True
    while most > 1 or first:
        # A host's rows differ, so pairs of host and bucket are no larger than about MERGED, and the counts are joined salted.
        placed = salted_join(rows, size, ["host"], ["shape"])
        bucket = F.pmod(F.xxhash64("shape"), F.ceil(F.col("n") / MERGED))
        groups = placed.groupBy("host", bucket.alias("bucket")).agg(
            F.sum("weight").alias("weight"), F.collect_list(F.struct("weight", "shape")).alias("trees"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                trees = [merged([(t["weight"], t["shape"]) for t in x]) for x in batch.column("trees").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string()), batch.column("weight")], ["host", "shape", "weight"])

        rows = written(groups.select("host", "weight", "trees").mapInArrow(run, "host string, shape string, weight bigint"), "merged")
        size = rows.groupBy("host").agg(F.count("*").alias("n"))
        most, first = size.agg(F.max("n")).first()[0] or 0, False
    return rows.select("host", F.col("shape").alias("template"))


def wrappers(pages: DataFrame, min_pages: int = MIN_PAGES, constant: float = CONSTANT) -> DataFrame:
    """(host, template, constants) of every host with enough different pages, from pages (host, html).

    The pages are aligned with the host's template. A text that stands at the
    same node of the template on a share ``constant`` of the different pages is
    template itself; what varies there is content. Pages of equal blocks and
    shape are one page, so copies make no text constant. A host's constants
    are at most 1 / ``constant`` times the blocks of a page.
    """
    seen = written(skeletons(pages), "skeletons")
    shapes = seen.groupBy("host", "shape").agg(F.count("*").alias("weight"))
    sizes = written(shapes.groupBy("host").agg(F.sum("weight").alias("pages")).filter(F.col("pages") >= min_pages), "sizes")
    known = written(templates(salted_join(shapes, sizes, ["host"], ["shape"]).select("host", "shape", "weight")), "templates")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(aligned(t, s)) for t, s in zip(batch.column("template").to_pylist(), batch.column("shape").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), pa.array(found, pa.list_(pa.int32()))], ["host", "shape", "nodes"])

    maps = salted_join(shapes.select("host", "shape"), known, ["host"], ["shape"]).select("host", "shape", "template").mapInArrow(
        align, "host string, shape string, nodes array<int>")
    blocks = seen.select("host", "shape", F.explode("blocks").alias("b")).select("host", "shape", "b.place", "b.text")
    placed = salted_join(blocks, written(maps, "maps"), ["host", "shape"], ["text"])
    at = placed.select("host", F.element_at("nodes", F.col("place") + 1).alias("node"), "text").filter("node >= 0")
    counts = at.groupBy("host", "node", "text").agg(F.count("*").alias("n"))
    constants = salted_join(counts, sizes, ["host"], ["text"]).filter(F.col("n") >= constant * F.col("pages")).groupBy("host").agg(
        F.collect_list(F.struct("node", "text")).alias("constants"))
    return known.join(constants, "host", "left")


def extracted(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text) of every row: the main text, its blocks in page order joined by an empty line.

    What the host's template holds is left out, and what tags, roles and names
    mark as no article. Hosts with few pages have no template, there the marks
    alone decide; pages without an address are pages of one host. A null page
    is empty; an empty page, or one that is all template, has an empty text.
    Repeated rows and ids are rows like others, and columns of other names are
    not read. No text is cut: only trees are made smaller to be aligned.
    """
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host(F.col(url)).alias("host"))
    known = written(wrappers(rows), "wrappers")
    joined = salted_join(rows, known, ["host"], ["id", "html"], how="left").select("id", "url", "html", "template", "constants")
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id, url))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, template, constants in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                page = parse(html or "")
                blocks = page.article()
                if constants:
                    shape, place = page.places()
                    nodes, fixed = aligned(template, shape), {(c["node"], c["text"]) for c in constants}
                    blocks = [(k, text) for k, text in blocks if (nodes[place[k]], _hash(text)) not in fixed]
                texts.append("\n\n".join(text for _, text in blocks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    return joined.mapInArrow(run, f"id {id_type}, url {url_type}, text string")


def op13_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    rows = extracted(table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars"))
