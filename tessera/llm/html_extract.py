"""Operator 10, HTML extraction by site template removal.

A page is parsed into a tree. Every element subtree gets a hash of its tags, classes and
texts; Spark counts on how many pages of a host each hash occurs. Subtrees that recur on
pages of their host are template and are deleted. Within the marked article only containers
can be template, never a paragraph, heading or list, whatever else repeats its words; and only
in a slot (an element's name and marks) most of whose contents on the host recur: a wrapper
that holds fresh text elsewhere is text. There equal articles count once, and an article most
of which recurs (a near copy) counts for nothing, so that copies of a text don't make it template.
What changes from page to page is told by element and class on every host: navigation,
headers, footers, asides, forms, adverts, notices, comments.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_limits, materialize

#: A subtree is template if it occurs on so many pages of its host.
MIN_PAGES = 5
#: Texts of fewer characters recur by chance, the more the larger the host: they need this share of its pages.
SHORT = 20
MIN_SHARE = 0.10
#: Low bits of a subtree's hash.
LONG, INSIDE = 1, 2
#: Share of what a slot within articles holds on a host that must recur.
SLOT_SHARE = 0.5
#: Template subtrees that may be sent to all tasks; beyond it pages and their subtrees are joined by shuffle.
BROADCAST_SUBTREES = 200_000

# HTML elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("nav header footer aside form button select dialog menu head".split())
# Words of class, id or role attributes that mark what isn't main text.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe signup login comment comments disqus reply replies share sharing social related recommended widget pagination pager complementary contentinfo search".split())
CONTENT = frozenset(("article", "main"))
# Elements that may be template within an article: boxes, not text.
BOXES = frozenset("center details div fieldset figure section".split())
_CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "dropped", "inside", "marks", "name", "parent")

    def __init__(self, name: str, marks: str, parent: Node | None) -> None:
        self.name, self.marks, self.parent, self.children = name, marks, parent, []
        self.inside = name in CONTENT or (parent is not None and parent.inside)
        self.dropped = name in DROPPED and not (name == "header" and self.inside) or bool(MARKS.intersection(_WORDS.findall(marks)))
        # The article itself isn't dropped for a word in its class.
        if name in CONTENT or name in ("html", "body"):
            self.dropped = False


def parse(page: str) -> Node:
    """The tree of a page: nodes and strings; comments and raw elements left out.

    Ends that HTML implies are made; an end tag without its start is passed over; what is
    open at the end of a cut-off page is closed.
    """
    top = node = Node("", "", None)
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = rest.rfind("<")  # a tag that the page's end cuts off
            node.children.append(rest if cut < 0 or not re.match(r"</?[a-zA-Z]", rest[cut:]) else rest[:cut])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        tag = m[0]
        if tag[1] in "!?":
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name == "br":
                node.children.append("\n")
            x = node
            while x is not top and x.name != name:
                x = x.parent
            if x is not top:
                node = x.parent
            elif name == "p":
                node.children.append(Node("p", "", node))
            continue
        if name == "br":
            node.children.append("\n")
            continue
        if name in VOID:
            if name == "hr":
                node.children.append(Node("hr", "", node))
            continue
        if name in RAW:
            if not tag.endswith("/>") or name not in ("svg", "math"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _CLOSES_P:
            x = node
            while x is not top and x.name != "p" and x.name not in ("td", "th", "button", "caption"):
                x = x.parent
            if x is not top and x.name == "p":
                node = x.parent
        if name in _IMPLIED:
            closed, scope = _IMPLIED[name]
            x, last = node, None
            while x is not top and x.name not in scope:
                if x.name in closed:
                    last = x
                x = x.parent
            if last is not None:
                node = last.parent
        marks = " ".join(next(filter(None, a[1:]), "") for a in _ATTRIBUTE.findall(tag)).lower() if "=" in tag else ""
        child = Node(name, marks, node)
        node.children.append(child)
        node = child
    return top


def blocks(page: str | None) -> tuple[list[tuple[str, list[int]]], list[int], list[int], list[int], int | None]:
    """The text blocks of a page in order, the hashes of the subtrees that hold them and their
    slots, the hashes of the subtrees beside an article, and a hash of the articles.

    A block is (text, places in the hashes of the subtrees that hold all of it). Blocks that
    an element or class marks as no main text are left out, and so are those outside the
    article if the page has an article with text. Within an article only boxes of the
    article count: what surrounds it would fall with each copy of it. The last hash is None
    without such an article. Without recursion, so that deep nesting is no trouble.
    """
    top = parse(page or "")
    found: list[list] = []
    state = {"open": False}

    def put(text: str, path: tuple[Node, ...], node: Node, dropped: bool) -> None:
        if state["open"]:
            found[-1][0].append(text)
            if text.strip():
                # A subtree that holds a part of the block alone can't delete it.
                held = found[-1][1]
                found[-1][1] = path if held is None else held[: next((i for i, (x, y) in enumerate(zip(held, path, strict=False)) if x is not y), min(len(held), len(path)))]
        else:
            found.append([[text], path if text.strip() else None, dropped, node.inside])
            state["open"] = True

    digests: dict[int, int] = {}
    slots: dict[int, int] = {}
    articles: list[str] = []
    stack: list = [(top, 0, (), False, [], [0])]
    while stack:
        node, k, path, dropped, parts, size = stack.pop()
        if k < len(node.children):
            stack.append((node, k + 1, path, dropped, parts, size))
            child = node.children[k]
            if isinstance(child, str):
                text = html.unescape(child)
                parts.append(text)
                size[0] += len(text.strip())
                put(text, path, node, dropped)
            else:
                if child.name in BLOCKS:
                    state["open"] = False
                stack.append((child, 0, (*path, child), dropped or child.dropped, [], [0]))
        else:
            if node.name in BLOCKS:
                state["open"] = False
            digest = xxhash.xxh64_intdigest("\x00".join([node.name, node.marks, *parts]).encode("utf-8", "surrogatepass"))
            flagged = digest & ~(LONG | INSIDE) | (LONG if size[0] >= SHORT else 0) | (INSIDE if node.inside else 0)
            digests[id(node)] = _signed(flagged)
            slots[digests[id(node)]] = _signed(xxhash.xxh64_intdigest(f"{node.name} {node.marks}".encode("utf-8", "surrogatepass")))
            if node.name in CONTENT and not node.parent.inside:
                articles.append(f"{digest}")
            if stack:
                stack[-1][4].append(f"\x01{digest}")
                stack[-1][5][0] += size[0]
    out = []
    for texts, path, dropped, inside in found:
        text = _SPACE.sub(" ", "".join(texts)).strip()
        if text:
            marks = [digests[id(n)] for n in path if n.inside == inside and n.name not in ("html", "body") and n.name not in CONTENT and (n.name in BOXES or not inside)]
            out.append((text, marks, dropped, inside))
    article = any(inside and not dropped for _, _, dropped, inside in out)
    places: dict[int, int] = {}
    beside: dict[int, None] = {}
    kept = []
    for text, marks, dropped, inside in out:
        if inside == article:
            at = [places.setdefault(m, len(places)) for m in marks]
            if not dropped:
                kept.append((text, at))
        elif article:
            beside.update(dict.fromkeys(marks))
    own = _signed(xxhash.xxh64_intdigest(" ".join([*articles, "", *map(str, places)]))) if article else None
    return kept, list(places), [slots[m] for m in places], list(beside), own


def _signed(digest: int) -> int:
    return digest - (digest >> 63 << 64)


def _recurring(rows: DataFrame, key: str, subtrees: DataFrame) -> DataFrame:
    """``rows`` (host, key, hashes, ...) with ``known``: those of the row's hashes that are in ``subtrees`` (host, hash).

    A small table goes to all tasks as sets by host, so that texts stay where they are.
    """
    if subtrees.count() <= BROADCAST_SUBTREES:
        of_host: dict[str, set[int]] = {}
        for host, found in subtrees.collect():
            of_host.setdefault(host, set()).add(found)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hosts, hashes = batch.column("host").to_pylist(), batch.column("hashes").to_pylist()
                known = [[h for h in own or () if h in of_host.get(host, ())] for host, own in zip(hosts, hashes, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known, pa.list_(pa.int64()))], names=[*batch.schema.names, "known"])

        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(each, f"{columns}, known array<long>")
    met = rows.select("host", key, F.explode("hashes").alias("hash")).join(subtrees, ["host", "hash"]).groupBy("host", key).agg(F.collect_set("hash").alias("known"))
    return rows.join(met, ["host", key], "left")


def _split(use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``use`` of a test whether a block lies in a subtree of ``known``; null if the row has none of them."""
    # Bound by a transform, as the overlap would else be made anew for each block.
    cut = F.filter(F.array(F.array_intersect("hashes", "known")), lambda c: F.size(c) > 0)
    return F.get(F.transform(cut, lambda c: use(lambda b: F.exists(b["marks"], lambda m: F.array_contains(c, F.get("hashes", m))))), F.lit(0))


def extract(pages: DataFrame, page_id: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row.

    Null and empty pages have an empty text. An article, or a page without one, keeps
    all blocks that neither recur on their host nor are marked as something else. Pages
    without a host in their url form one host. Copies of a page or article count once, so
    that an often copied one isn't taken for a template; rows that repeat give a row each.
    ``min_share`` holds for short texts, and tells outside articles what is template
    without regard to what else its pages show. Other columns aren't read.
    """
    arrow_limits(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(pages[url_col].cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    slim = pages.select(pages[page_id].alias("id"), pages[url_col].alias("url"), host.alias("host"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("text", pa.string()), ("marks", pa.list_(pa.int32()))]))
        for batch in batches:
            keys, rows, hashes, slots, others, articles = [], [], [], [], [], []
            for page in batch.column("html"):
                page = page.as_py()
                found, own, places, beside, article = blocks(page)
                keys.append(_signed(xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass"))))
                rows.append([{"text": t, "marks": m} for t, m in found])
                hashes.append(own)
                slots.append(places)
                others.append(beside)
                articles.append(article)
            arrays = [pa.array(keys, pa.int64()), pa.array(articles, pa.int64()), pa.array(rows, block), *(pa.array(x, pa.list_(pa.int64())) for x in (hashes, slots, others))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), batch.column("host"), *arrays], names=["id", "url", "host", "page", "article", "blocks", "hashes", "slots", "beside"])

    schema = f"id {kinds['id']}, url {kinds['url']}, host string, page long, article long, blocks array<struct<text:string,marks:array<int>>>, hashes array<long>, slots array<long>, beside array<long>"
    parsed = materialize(slim.mapInArrow(each, schema), "parsed")

    # Distinct pages and distinct articles of each host by subtree: copies are folded before counting.
    inside = F.col("hash").bitwiseAND(INSIDE) != 0
    shape = F.transform("blocks", lambda b: F.struct(F.length(b["text"]).alias("chars"), b["marks"].alias("marks")))
    main = F.struct(F.coalesce("article", "page").alias("key"), F.col("article").isNotNull().alias("inside"), "hashes", "slots", shape.alias("shape"))
    rest = F.when(F.col("article").isNotNull(), F.struct(F.col("page").alias("key"), F.lit(False).alias("inside"), F.col("beside").alias("hashes"), F.transform("beside", lambda _: F.lit(0).cast("long")).alias("slots"), F.slice(shape, 1, 0).alias("shape")))
    units = parsed.select("host", F.explode(F.filter(F.array(main, rest), lambda u: u.isNotNull())).alias("u")).select("host", "u.*")
    units = units.groupBy("host", "key", "inside").agg(F.first(F.struct("hashes", "slots", "shape")).alias("u")).select("host", "key", "inside", "u.*")
    units = materialize(units, "subtrees")
    size = units.where("not inside").groupBy("host").agg(F.count("*").alias("pages"))
    counts = units.select("host", F.explode(F.arrays_zip("hashes", "slots")).alias("h")).groupBy("host", F.col("h.hashes").alias("hash")).agg(F.count("*").alias("n"), F.min("h.slots").alias("slot"))
    counts = materialize(counts, "hashes")
    # Slots within articles whose contents recur more than not.
    recurs = F.sum(F.when(F.col("n") >= min_pages, F.col("n")).otherwise(0))
    fixed = counts.where(inside).groupBy("host", "slot").agg(recurs.alias("again"), F.sum("n").alias("all")).where(F.col("again") >= F.col("all") * SLOT_SHARE).select("host", "slot")
    counts = counts.where(F.col("n") >= min_pages)
    counts = counts.where(inside).join(fixed, ["host", "slot"], "left_semi").unionByName(counts.where(~inside)).join(size, "host")
    wide = F.col("n") >= F.col("pages") * min_share
    counts = counts.select("host", "hash", wide.alias("wide")).where(F.col("wide") | (F.col("hash").bitwiseAND(LONG) != 0))
    counts = materialize(counts.select("host", "hash", (F.col("wide") & ~inside).alias("sure")), "counts")
    open_ = counts.where("not sure").select("host", "hash")
    # A page of whose text more recurs in this way than not is a near copy, and no witness.
    fresh = _split(lambda is_cut: F.aggregate("shape", F.lit(0).cast("long"), lambda a, b: a + F.when(is_cut(b), -b["chars"]).otherwise(b["chars"])))
    seen = _recurring(units, "key", open_).where(fresh >= 0).select("host", F.explode(F.array_intersect("hashes", "known")).alias("hash"))
    borne = seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "hash")
    template = materialize(borne.union(counts.where("sure").select("host", "hash")), "template")
    joined = _recurring(parsed.select("id", "url", "host", "page", "blocks", "hashes"), "page", template)
    stays = F.coalesce(_split(lambda is_cut: F.filter("blocks", lambda b: ~is_cut(b))), "blocks")
    text = F.array_join(F.transform(stays, lambda b: b["text"]), "\n\n")
    return joined.select(F.col("id").alias(page_id), F.col("url").alias(url_col), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
