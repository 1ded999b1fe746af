"""Main text of web pages, with wrappers inferred from the pages of each host.

A wrapper is a union-free regular expression over the tokens of a host's pages: tags in order, groups
that are optional or repeated, and text slots. It is made by aligning page after page and wrapper after wrapper; the pages are
then aligned with it, and what a host's pages say at a node of it is counted. What all say there is template.
"""

from __future__ import annotations

import html
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenforge.llm.common import attach, bound_batches, filled, power_of, shuffle_width
from screenforge.llm.url_filter import host_and_path
from screenforge.operators.joins import is_small, lookup_join
from screenforge.session import materialize

# A text that stands in one place on so many pages of a host that differ in other text, without any other text there, is template.
TEMPLATE_PAGES = 3
# Nodes a wrapper may have: beyond, it gives up optional groups of few pages. Texts there are counted by their way from the
# last node that is left, so none is lost.
MOST_NODES = 3_000
# Elements within elements that a wrapper follows; deeper ones count as children of the last.
DEPTH = 200
# Rows of fixed places (8 bytes each) that may be broadcast, and bytes of all wrappers together.
MOST_BROADCAST = 200_000
MOST_WRAPPER_BYTES = 32 << 20
# Nodes of the wrappers that a task holds while it merges, and how many tasks' wrappers meet in a round.
HELD_NODES = 200_000
FAN = 16

RAW = re.compile(r"(script|style|noscript|template|svg|textarea|select|iframe|title)\b", re.IGNORECASE)
TAG = re.compile(r"""(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
# Quotes that never end are looked at so often in a page; from then on a tag ends at the next sign that can end it.
MOST_OPEN_QUOTES = 16
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set("nav footer aside form head button dialog menu".split())
MAIN_TAGS = ("article", "main")
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar".split())
# Whole class names and ids, with - for _. What has one of the first is no main text.
DROPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsbygoogle ad-banner ad-container ad-slot sponsor sponsored nav navbar "
    "breadcrumb breadcrumbs pagination pager cookie cookies cookie-notice cookie-banner cookie-bar cookie-consent gdpr "
    "newsletter-signup share-buttons social-share ad-box adbox ad-wrapper sidebar side-bar menu navigation notice notices consent "
    "popup modal overlay masthead site-header site-footer".split()
)
# Dropped outside of the main element; inside they may be its own head and foot.
EDGE_NAMES = set("header footer".split())
COMMENT_NAMES = set("comment comments comments-area comment-list comment-section disqus disqus-thread reviews user-reviews".split())
# What has one of these may be main text; it goes where most of it is template of the host.
DOUBTFUL_NAMES = set(
    "promo promotion banner rail footer header newsletter subscribe signup share sharing social related recommended related-posts "
    "discussion reply replies".split()
)
# Why a text may not count: a form around it (which may be the page's own), a doubtful name, a name, comments, a tag or role.
FORM, DOUBTFUL, NAMED, COMMENTS, GONE = 1, 2, 4, 8, 16
# Numbers of doubtful groups begin at this bit.
GROUP = 5
# What is in one of these names what follows it.
HEADINGS = set("h1 h2 h3 h4 h5 h6 th dt caption summary".split())
# An open element of the first kind ends where one of the second begins.
ENDS = {"p": BLOCKS - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

Tree = list  # [label, children, number of the text or -1]
Node = list  # [label, optional, repeated, pages, text hash or None for a slot, children]
LABEL, OPTIONAL, REPEATED, PAGES, TEXT, CHILDREN = range(6)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes) of a page: open, close and text. Comments, scripts, styles and the like are left out.

    In time that grows with the page: a sign that begins a tag which never ends is text, as is all behind the last
    sign that can end one.
    """
    done, at, last, quotes = 0, page.find("<"), page.rfind(">"), 0
    while at >= 0:
        tag, end, after = None, -1, page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
        elif at > last:
            break
        elif after in "!?" or (after == "/" and not page[at + 2 : at + 3].isalpha()):
            end = page.find(">", at) + 1
        elif after == "/" or ("a" <= after.lower() <= "z"):
            if quotes < MOST_OPEN_QUOTES:
                tag = TAG.match(page, at + 1)
                quotes += tag is None
            if tag is None:
                tag = TAG.match(re.sub("[\"']", " ", page[at + 1 : page.find(">", at) + 1]))
                end = page.find(">", at) + 1
            else:
                end = tag.end()
        if end <= at:
            at = page.find("<", at + 1)
            continue
        if at > done:
            yield "text", page[done:at], ""
        if tag and not tag[1] and (raw := RAW.fullmatch(tag[2])):
            close = re.compile(rf"</{raw[1]}\s*>", re.IGNORECASE).search(page, end)
            end = close.end() if close else len(page)
        elif tag:
            yield ("close" if tag[1] else "open"), tag[2].lower(), tag[3]
        done = end
        at = page.find("<", end)
    if done < len(page):
        yield "text", page[done:], ""


def named(attributes: str) -> tuple[set[str], set[str]]:
    """Class names and id, and the roles, in lower case."""
    names: set[str] = set()
    roles: set[str] = set()
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() in ("class", "id"):
                names.update(value.replace("_", "-").split())
            else:
                roles.update(value.split())
    return names, roles


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def walk(page: str) -> Iterator[tuple[str, str, int, bool, bool]]:
    """Every token in place: (kind, value, why it may not count, inside the main element, starts a new block).

    Elements that HTML ends by itself are ended; a closing tag without an open element is ignored. The reasons are bits,
    with the number of the outermost doubtful group above them. Names and forms around an ``article`` or ``main``
    don't reach into it, except that comments in the main
    element stay comments.
    """
    stack: list[tuple[str, int, bool]] = []
    groups = 0
    open_names: dict[str, int] = {}

    def leave() -> str:
        name = stack.pop()[0]
        open_names[name] -= 1
        return name

    for kind, value, attributes in tokens(page):
        dropped, main = stack[-1][1:] if stack else (0, False)
        if kind == "text":
            yield kind, value, dropped, main, False
        elif kind == "open":
            block = value in BLOCKS
            while stack and value in ENDS.get(stack[-1][0], ()):
                yield "close", leave(), dropped, main, True
            if block and open_names.get("p") and value in ENDS["p"]:  # a paragraph ends with the inline elements open in it
                while stack[-1][0] != "p" and stack[-1][0] not in BLOCKS:
                    yield "close", leave(), dropped, main, False
                if stack[-1][0] == "p":
                    yield "close", leave(), dropped, main, True
            dropped, main = stack[-1][1:] if stack else (0, False)
            names, roles = named(attributes)
            if value not in VOID:
                is_main = value in MAIN_TAGS or "main" in roles or "articlebody" in roles
                if is_main:
                    dropped &= GONE | (COMMENTS if main else 0)
                elif value == "form":
                    dropped |= FORM
                if (value in DROPPED and value != "form") or (value == "header" and not main) or not DROPPED_ROLES.isdisjoint(roles):
                    dropped |= GONE
                if not is_main and value not in ("html", "body"):
                    if not COMMENT_NAMES.isdisjoint(names):
                        dropped |= COMMENTS
                    elif not DROPPED_NAMES.isdisjoint(names) or not (main or EDGE_NAMES.isdisjoint(names)):
                        dropped |= NAMED
                    elif not DOUBTFUL_NAMES.isdisjoint(names) and not dropped & DOUBTFUL:
                        groups += 1
                        dropped |= DOUBTFUL | groups << GROUP
                stack.append((value, dropped, main or is_main))
                open_names[value] = open_names.get(value, 0) + 1
                dropped, main = stack[-1][1:]
            label = value
            if names and value not in ("html", "body", *MAIN_TAGS):  # their names, like those with digits, tell pages apart
                label += "".join(sorted("." + n for n in names if not any(map(str.isdigit, n))))
            yield "open" if value not in VOID else "void", label, dropped, main, block
        elif open_names.get(value):
            while True:
                name = leave()
                yield "close", name, dropped, main, name in BLOCKS
                if name == value:
                    break


def page_wrapper(page: str) -> Node:
    """The wrapper of one page: its tree, in which neighbouring groups of equal tags are one repeated group."""
    tree, found = read(page)
    return tree_wrapper(without_texts(tree, found))


def tree_wrapper(tree: Tree) -> Node:
    label, children, own = tree
    return [label, False, False, 1, own, folded([tree_wrapper(c) for c in children])]


def folded(children: list[Node]) -> list[Node]:
    """Groups of one to three neighbours that follow each other with equal labels become one repeated group."""
    out: list[Node] = []
    for child in children:
        out.append(child)
        for width in (1, 2, 3):
            if len(out) >= 2 * width and all(out[-width + k][LABEL] == out[-2 * width + k][LABEL] for k in range(width)):
                for k in range(width):
                    both = merged(out[-2 * width + k], out[-width + k], again=True)
                    out[-2 * width + k] = both
                del out[-width:]
                break
    return out


def merged(a: Node, b: Node, again: bool = False) -> Node:
    """One expression for what both stand for. ``again``: both are on the same page."""
    text = a[TEXT] if a[TEXT] == b[TEXT] and not again else None
    pages = max(a[PAGES], b[PAGES]) if again else a[PAGES] + b[PAGES]
    return [a[LABEL], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED] or again, pages, text, aligned(a[CHILDREN], b[CHILDREN], again)]


def aligned(a: list[Node], b: list[Node], again: bool = False) -> list[Node]:
    """Both token streams as one. At a mismatch the stream that comes back sooner skips the other's tokens, which
    thereby become optional."""
    out: list[Node] = []
    where_a: dict[str, list[int]] = {}
    where_b: dict[str, list[int]] = {}
    for where, nodes in ((where_a, a), (where_b, b)):
        for i in range(len(nodes) - 1, -1, -1):
            where.setdefault(nodes[i][LABEL], []).append(i)
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i][LABEL] == b[j][LABEL]:
            out.append(merged(a[i], b[j], again))
            i, j = i + 1, j + 1
            continue
        next_b = _next(where_b, a[i][LABEL], j)
        next_a = _next(where_a, b[j][LABEL], i)
        if next_b is None and next_a is None:
            out += [_optional(a[i]), _optional(b[j])]
            i, j = i + 1, j + 1
        elif next_a is None or (next_b is not None and next_b - j <= next_a - i):
            out += map(_optional, b[j:next_b])
            j = next_b
        else:
            out += map(_optional, a[i:next_a])
            i = next_a
    return out + [_optional(n) for n in (*a[i:], *b[j:])]


def _next(where: dict[str, list[int]], label: str, at: int) -> int | None:
    """The first place of ``label`` from ``at`` on; earlier places are used up."""
    places = where.get(label, [])
    while places and places[-1] < at:
        places.pop()
    return places[-1] if places else None


def _optional(node: Node) -> Node:
    return [node[LABEL], True, *node[REPEATED:]]


def size(node: Node) -> int:
    return 1 + sum(map(size, node[CHILDREN]))


def trimmed(node: Node, least: int = 2) -> Node:
    """The wrapper without optional groups of fewer than ``least`` pages, as long as it is too large."""
    while size(node) > MOST_NODES:
        stack = [node]
        while stack:
            own = stack.pop()
            own[CHILDREN] = [c for c in own[CHILDREN] if not c[OPTIONAL] or c[PAGES] >= least]
            stack += own[CHILDREN]
        least *= 2
        if least > 1 << 40:
            break
    return node


def template_texts(node: Node, pages: int = TEMPLATE_PAGES) -> set[int]:
    """Hashes of the texts that are the same on at least so many pages."""
    found, stack = set(), [node]
    while stack:
        own = stack.pop()
        if own[LABEL] == "#text" and own[TEXT] is not None and own[PAGES] >= pages:
            found.add(own[TEXT])
        stack += own[CHILDREN]
    return found


def place_of(place: int, label: str, nth: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{place} {label} {nth}") >> 1


def slots(labels: list[str]) -> list[tuple[str, list[int]]]:
    """Neighbours as groups: (label, positions). As in :func:`folded`, neighbouring groups of equal labels are one."""
    out: list[tuple[str, list[int]]] = []
    for i, label in enumerate(labels):
        out.append((label, [i]))
        for width in (1, 2, 3):
            if len(out) >= 2 * width and all(out[-width + k][0] == out[-2 * width + k][0] for k in range(width)):
                for k in range(width):
                    out[-2 * width + k][1].extend(out[-width + k][1])
                del out[-width:]
                break
    return out


class Piece(NamedTuple):
    """A text that may count: what it says, its hash, whether it is in the main element and in a form, the number of its
    doubtful group, and whether it is in a heading."""

    text: str
    hash: int
    main: bool
    form: bool
    group: int
    heading: bool


def read(page: str) -> tuple[Tree, list[Piece | None]]:
    """The tree of a page, whose leaves are its texts, and the texts that can be in the result, in order; None where a block ends.

    These are the texts in ``article`` or ``main``, or all if the page has neither, without what is in dropped
    elements or forms. A page without these two whose texts are all in forms is a page within a form. A leaf of
    the tree has the number of its text, or -1 if that can't be in the result.
    """
    root: Tree = ["#page", [], -1]
    path = [root]
    deep = headings = 0
    found: list[Piece | None] = []
    leaves: list[Tree] = []
    has_main = False
    for kind, value, dropped, main, block in walk(page):
        has_main |= main
        if block:
            found.append(None)
        if kind in ("open", "close") and value.partition(".")[0] in HEADINGS:
            headings += 1 if kind == "open" else -1
        if kind == "open":
            if len(path) > DEPTH:
                deep += 1
                continue
            node: Tree = [value, [], -1]
            path[-1][1].append(node)
            path.append(node)
        elif kind == "close":
            if deep:
                deep -= 1
            elif len(path) > 1:
                path.pop()
        elif (kind == "void" and value == "br") or (kind == "text" and not dropped & (NAMED | COMMENTS | GONE)):
            text = " " if kind == "void" else html.unescape(value)
            words = " ".join(text.split())
            found.append(Piece(text, text_hash(words) if words else 0, main, bool(dropped & FORM), dropped >> GROUP, headings > 0))
            if words:
                leaf: Tree = ["#text", [], len(found) - 1]
                path[-1][1].append(leaf)
                leaves.append(leaf)
    formed = not has_main and all(p.form for p in found if p and p.hash)
    kept = [i for i, p in enumerate(found) if p is None or (p.main == has_main and (formed or not p.form))]
    number = {i: n for n, i in enumerate(kept)}
    for leaf in leaves:
        leaf[2] = number.get(leaf[2], -1)
    return root, [found[i] for i in kept]


def without_texts(tree: Tree, found: list[Piece | None]) -> Tree:
    """A page's tree with the hashes of its texts instead of their numbers, None where a text can't be in the result."""
    label, children, own = tree
    return [label, [without_texts(c, found) for c in children], found[own].hash if own >= 0 else None]


def matched(labels: list[str], nodes: list[Node]) -> list[int]:
    """For each label of a page the node of the wrapper that stands for it, -1 if there is none. In order: a node is
    skipped where the page does not have it, and a label where the wrapper lacks it."""
    where: dict[str, list[int]] = {}
    for i in range(len(nodes) - 1, -1, -1):
        where.setdefault(nodes[i][LABEL], []).append(i)
    out, at = [], 0
    for label in labels:
        node = _next(where, label, at)
        out.append(-1 if node is None else node)
        at = at if node is None else node + 1
    return out


def places(tree: Tree, wrapper: Node, host: str, texts: int) -> list[int]:
    """The place of every text of a page: the node of the host's wrapper that it is aligned with. 0 where there is none.

    What the wrapper has given up gets a place by its labels, counted from the last node that is left.
    """
    found = [0] * texts
    stack: list[tuple[Tree, Node | None, int]] = [(tree, wrapper, place_of(1, host, 0))]
    while stack:
        (_, children, own), node, place = stack.pop()
        if own >= 0:
            found[own] = place
        groups = slots([c[0] for c in children])
        nodes = node[CHILDREN] if node else []
        nth: Counter = Counter()
        for (label, members), k in zip(groups, matched([g[0] for g in groups], nodes)):
            nth[label] += k < 0
            next_place = place_of(place, label, k) if k >= 0 else place_of(place, label, -nth[label])
            stack += [(children[i], nodes[k] if k >= 0 else None, next_place) for i in members]
    return found


def other_text(texts: list[Piece]) -> dict[int, int]:
    """For the hash of every different text of a page, a number for the set of the others."""
    different = {p.hash for p in texts}
    whole = sum(different)
    return {own: (whole - own) % (1 << 63) for own in different}


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, pieces, tree) of every page; both as bytes. The pages are read here, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read_pages = [read(page.as_py()) for page in batch.column("html")]
            columns = [batch.column(c) for c in ("page_id", "url", "host")]
            columns.append(pa.array([pickle.dumps([p and tuple(p) for p in found]) for _, found in read_pages], pa.binary()))
            columns.append(pa.array([pickle.dumps(tree) for tree, _ in read_pages], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "pieces", "tree"])

    return pages.mapInArrow(run, "page_id long, url string, host string, pieces binary, tree binary")


def _pieces(content: bytes) -> list[Piece | None]:
    return [p and Piece(*p) for p in pickle.loads(content)]


def _merging(batches: Iterator[pa.RecordBatch], wrapper_of) -> Iterator[pa.RecordBatch]:
    """(host, wrapper) of a task: the wrappers of its rows, those of a host merged, as many as it can hold at a time."""
    held: dict[str, Node] = {}
    nodes = 0

    def out() -> pa.RecordBatch:
        columns = [pa.array([*held], pa.string()), pa.array([pickle.dumps(w) for w in held.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["host", "wrapper"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            host, wrapper = row[0], wrapper_of(row)
            before = held.get(host)
            held[host] = trimmed(merged(before, wrapper) if before else wrapper)
            nodes += size(held[host]) - (size(before) if before else 0)
            if nodes > HELD_NODES:
                yield out()
                held.clear()
                nodes = 0
    if held:
        yield out()


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, wrapper): the wrapper of every host, from the rows of :func:`parsed`.

    A task aligns its pages of a host one after the other; then the tasks' wrappers are aligned in rounds of FAN, so that a host
    with a third of all pages has FAN wrappers to merge in one task.
    """

    def of_page(row: tuple) -> Node:
        return tree_wrapper(without_texts(pickle.loads(row[2]), _pieces(row[1])))

    def of_wrapper(row: tuple) -> Node:
        return pickle.loads(row[1])

    shape = "host string, wrapper binary"
    width = shuffle_width(rows.sparkSession)
    held = rows.select("host", "pieces", "tree").mapInArrow(lambda b: _merging(b, of_page), shape)
    held = materialize(held.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(width))), "page-wrappers")
    for _ in range(power_of(FAN, width)):
        held = held.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        dealt = held.repartition("host", "part").sortWithinPartitions("host", "part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _by_key(batches, of_wrapper)

        held = dealt.select("host", "wrapper", "part").mapInArrow(run, shape + ", part int")
    return held.select("host", "wrapper")


def _by_key(batches: Iterator[pa.RecordBatch], wrapper_of) -> Iterator[pa.RecordBatch]:
    """Rows that follow each other with the same host and part, merged."""
    key, wrapper = None, None
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if (row[0], row[2]) == key:
                wrapper = trimmed(merged(wrapper, wrapper_of(row)))
            else:
                if key:
                    out.append((*key, wrapper))
                key, wrapper = (row[0], row[2]), wrapper_of(row)
        yield _wrapper_rows(out)
    if key:
        yield _wrapper_rows([(*key, wrapper)])


def _wrapper_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([pickle.dumps(r[2]) for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["host", "wrapper", "part"])


def placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(row, places, texts, rests) of every page, aligned with its host's wrapper.

    ``places``: of each piece; ``texts``: its hash, null where the place has several texts on the page; ``rests``: a number for the page's other texts.
    """
    spark = rows.sparkSession
    shared = None
    if is_small(known, MOST_BROADCAST, MOST_WRAPPER_BYTES):
        shared = spark.sparkContext.broadcast({r.host: bytes(r.wrapper) for r in known.collect()})  # MOST_WRAPPER_BYTES at most
        rows = rows.withColumn("wrapper", F.lit(None).cast("binary"))
    else:
        rows = attach(rows, known, ["host"], F.pmod(F.xxhash64("row"), F.lit(shuffle_width(spark))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, Node] = {}
        for batch in batches:
            lists: list[list] = [[], [], []]
            for host, pieces, tree, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "pieces", "tree", "wrapper"))):
                if host not in opened:
                    if len(opened) > 1_000:
                        opened.clear()
                    opened[host] = pickle.loads(wrapper or shared.value[host])
                found = _pieces(pieces)
                own = places(pickle.loads(tree), opened[host], host, len(found))
                texts = [p for p in found if p and p.hash]
                rest = other_text(texts)
                times = Counter(own)
                lists[0].append(own)
                lists[1].append([p.hash if p and p.hash and times[at] == 1 else None for p, at in zip(found, own)])
                lists[2].append([rest[p.hash] if p and p.hash else 0 for p in found])
            columns = [batch.column("row"), *(pa.array(x, pa.list_(pa.int64())) for x in lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "places", "texts", "rests"])

    shape = "row long, places array<long>, texts array<long>, rests array<long>"
    return rows.select("row", "host", "pieces", "tree", "wrapper").mapInArrow(run, shape)


def fixed_places(rows: DataFrame) -> DataFrame:
    """(row, places, fixed) of every row of :func:`placed` on which a text is template, with the places of these texts.

    Every text of every page goes by its place into one aggregation, which is exact however many places a host has. A place
    whose text is the same on all pages that have it is template if these have ``TEMPLATE_PAGES`` different other
    texts at least; a place with several texts, on one page or on several, is a slot. Pages whose texts are the same
    count once, wherever they are read and however they differ in menus or scripts.
    """
    texts = rows.select(F.inline(F.arrays_zip("places", "texts", "rests"))).toDF("place", "text", "rest").filter("place != 0")
    by_rest = texts.groupBy("place", "rest").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.max(F.col("text").isNull()).alias("slot"))
    fixed = by_rest.groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("slot").alias("slot"), F.count(F.lit(1)).alias("pages"))
    fixed = fixed.filter(~F.col("slot") & (F.col("low") == F.col("high")) & (F.col("pages") >= TEMPLATE_PAGES)).select("place")
    met = lookup_join(rows.select("row", F.explode("places").alias("place")).filter("place != 0"), materialize(fixed, "fixed"), "place", "inner", MOST_BROADCAST)
    return met.groupBy("row").agg(F.collect_set("place").alias("fixed")).join(rows.select("row", "places"), "row")


def main_text(page: str, fixed: frozenset[int] = frozenset(), own: list[int] | None = None) -> str:
    """Blocks of the main text of one page; ``own``: the places of its texts, of which ``fixed`` are template."""
    return text_of(read(page)[1], fixed, own)


def text_of(found: list[Piece | None], fixed: frozenset[int] = frozenset(), own: list[int] | None = None) -> str:
    """Blocks of the main text joined by line breaks.

    Inside ``article`` or ``main`` everything counts that isn't dropped; a page without these counts whole. Of either,
    blocks go whose texts are all template of the host, and doubtful groups in which these are half or more. A block with
    other text stays whole, and in the main element so does a heading of template text before a block that stays, unless its group is doubtful.
    """
    own = own or [0] * len(found)
    template: Counter = Counter()
    for p, at in zip(found, own):
        if fixed and p and p.group:
            template[p.group] += len(p.text.strip()) * (1 if at in fixed else -1)
    gone = {group for group, more in template.items() if more >= 0}
    blocks: list[tuple[str, bool, bool]] = []  # text, all of it template, a heading of the main element
    block: list[tuple[Piece, int]] = []
    for p, at in zip([*found, None], [*own, 0]):
        if p is not None:
            if p.group not in gone:
                block.append((p, at))
        else:
            if text := " ".join("".join(q.text for q, _ in block).split()):
                says = [(q, place) for q, place in block if q.hash]
                blocks.append((text, all(place in fixed for _, place in says), all(q.heading and q.main and not q.group for q, _ in says)))
            block = []
    out: list[str] = []
    follows = False
    for text, same, heading in reversed(blocks):
        if not same or (heading and follows):
            out.append(text)
            follows = True
        else:
            follows = False
    return "\n".join(reversed(out))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    A null or empty html gives an empty text, as does a page without main text. Pages with a null url have
    the empty host in common. Repeated rows give equal rows; a null page_id stays null; other columns are
    not looked at; an empty table gives no rows. Pages of any length are read whole, broken markup too.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), filled("html").alias("html"))
    rows = rows.withColumn("host", F.coalesce(host_and_path(F.col("url"))[0], F.lit("")))
    rows = parsed(rows.select("page_id", "url", "host", "html")).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "parsed", compression="zstd")
    aligned_pages = materialize(placed(rows, materialize(wrappers(rows), "wrappers")), "placed", compression="zstd")
    known = materialize(fixed_places(aligned_pages), "fixed-places")
    # Only pages with template texts get their places back.
    rows = rows.select("row", "page_id", "url", "pieces")
    rows = rows.join(F.broadcast(known), "row", "left") if is_small(known, 10_000) else rows.join(known, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (batch.column(c).to_pylist() for c in ("pieces", "places", "fixed"))
            texts = [text_of(_pieces(pieces), frozenset(fixed or ()), own) for pieces, own, fixed in zip(*values)]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "pieces", "places", "fixed").mapInArrow(run, "page_id long, url string, text string, n_chars long")
