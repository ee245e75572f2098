"""Main text of web pages by wrapper induction.

Pages become trees of elements and texts. Pages of a host whose bodies have the same regions are of one layout. Every
page is aligned with one page of its layout (that with the least hash) by simple tree matching; text nodes that match at
the same place with the same text in all pages are constant: they are the layout's template, of whatever length. Nodes
that vary are slots. A layout whose pages all have one main text has no template. A page's main text is what stands in
slots, less the regions that are no article by their element or names (navigation, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, comments) and less lists of links. A page with an article or main element is read from
there; constants inside it are template where the layout's pages have `MAINS` different main texts at least, for what two
articles share may be theirs.

Character references are decoded; white space inside a block becomes one space; blocks are joined in page order by
one space. A null or empty page gives an empty text; broken markup is read as far as it goes, and text after the
last tag still counts. Layouts with one page have no template. Pages are judged row by row: repeated rows and null
page_ids have their own results. Ties: of the pages of a layout that have the least hash the first in order is the one
aligned with, of equal matchings the one that leaves later nodes out. Very long pages are read and matched whole; an
empty table gives no rows. Columns other than page_id, url and html are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Layouts whose first pages and templates are broadcast, and bytes of these; more are joined by a shuffle.
LAYOUTS_SENT, BYTES_SENT = 2_000, 32_000_000
#: Different main texts of a layout from which constants inside its articles are template.
MAINS = 3

_TOKEN = re.compile(r"<!--.*?(?:--!?>|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noframes svg math".split())
_SKIP = frozenset("script style noscript template iframe svg math head title nav footer header aside form button select textarea option label fieldset dialog menu object canvas audio video map".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label input button select".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Words in class, id or role that name regions other than the article.
_OTHER = frozenset(
    "nav navbar navigation menu menubar topbar toolbar breadcrumb breadcrumbs header masthead banner footer foot colophon copyright sidebar side aside complementary contentinfo widget widgets "
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted notice notices cookie cookies consent gdpr popup modal overlay "
    "comment comments commentlist reply replies disqus respond discussion share sharing social follow related recommended recommendations trending popular pagination pager paging newsletter subscribe subscription signup login search "
    "form skip tags tagcloud toc byline alert toast hidden sr".split()
)
#: Elements that are regions of a page even without class, id or role.
_REGIONS = frozenset("div nav header footer main article aside section form".split())
_WORDS = re.compile(r"[a-z]+")
_SPLIT = re.compile(r"([a-z])([A-Z])")


class Node:
    __slots__ = ("kids", "mark", "name", "other")

    def __init__(self, name: str, mark: str = "", other: bool = False):
        self.name, self.mark, self.other = name, mark, other
        self.kids: list[Node | str] = []


def _marks(attributes: str) -> tuple[str, bool]:
    """class and id, and whether they name a region other than the article."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return "", False
    mark, other = [], False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            mark.append(value)
            words = _WORDS.findall(_SPLIT.sub(r"\1 \2", value).lower())
            other |= any(w in _OTHER for w in words) and not any(w in ("article", "main", "content", "post", "entry", "body") for w in words) or "comments" in words or "sidebar" in words
        elif name == "style":
            other |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        else:
            other |= name == "hidden" or value.lower() == "true"
    return " ".join(mark), other


def parse(page: str) -> Node:
    """A tree of the page; raw elements have no kids."""
    root = Node("")
    stack = [root]
    at, end, size = 0, 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        m = _TOKEN.match(page, start)
        if m is None:  # a lone "<", or a tag that the page breaks off
            if re.match(r"</?[a-zA-Z!]", page[start : start + 3]) and page.find(">", start) < 0:
                size = start
                break
            at = start + 1
            continue
        if start > end:
            stack[-1].kids.append(page[end:start])
        at = end = m.end()
        if m[1] is not None:
            stack[-1].kids.append(m[1])
        if m[3] is None:
            continue
        name = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in ("article", "main", "body", "table", "td") and name in _INLINE | {"p", "li"}:
                    break
            continue
        if name in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name not in _INLINE:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name or {stack[k].name, name} == {"dt", "dd"}:
                    del stack[k:]
                    break
                if stack[k].name in ("ul", "ol", "dl", "table", "tr", "select"):
                    break
        node = Node(name, *_marks(m[4]))
        stack[-1].kids.append(node)
        if name in _VOID or m[4].endswith("/") and name not in _INLINE and name not in _CLOSES_P:
            continue
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, end)
            at = end = close.end() if close else size
            continue
        stack.append(node)
    if end < size:
        stack[-1].kids.append(page[end:size])
    return root


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _key(path: str, text: str) -> str:
    return hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _flat(node: Node, path: str, out: list[tuple[Node, str]]) -> None:
    todo = [(node, path)]
    while todo:
        node, path = todo.pop()
        out.append((node, path))
        todo += [(k, f"{path}/{k.name}.{k.mark}") for k in reversed(node.kids) if isinstance(k, Node)]


def layout(root: Node) -> str:
    """Key of the regions that the page's body has; numbers of three digits or more in their names do not count."""
    at = root
    for name in ("html", "body"):
        at = next((k for k in at.kids if isinstance(k, Node) and k.name == name), at)
    found = {f"{k.name}.{re.sub(r'[0-9]{3,}', '0', k.mark)}" for k in at.kids if isinstance(k, Node) and (k.mark or k.name in _REGIONS)}
    return _key("", "\n".join(sorted(found)))


def _shapes(root: Node, ids: dict) -> dict[int, int]:
    """For each node a number that it shares with the nodes of equal subtrees, texts aside."""
    nodes: list[tuple[Node, str]] = []
    _flat(root, "", nodes)
    out: dict[int, int] = {}
    for node, _ in reversed(nodes):
        shape = (node.name, node.mark, *(out[id(k)] for k in node.kids if isinstance(k, Node)))
        out[id(node)] = ids.setdefault(shape, len(ids))
    return out


def _aligned(xs: list[int], ys: list[int], part: dict[tuple[int, int], int]) -> tuple[int, list[tuple[int, int]]]:
    """The greatest sum of an order-preserving matching of two lists of shapes, and its pairs of places, last first.

    Only every `step`-th row of the table is kept; the rows between are made again on the way back.
    """
    if not xs or not ys:
        return 0, []
    kinds, at = np.unique(np.array(ys), return_inverse=True)
    worth = {x: np.array([part.get((x, y), 0) for y in kinds.tolist()], np.int64)[at] for x in set(xs)}

    def after(row: np.ndarray, x: int) -> np.ndarray:
        out = row.copy()
        np.maximum(row[1:], row[:-1] + worth[x], out=out[1:])
        return np.maximum.accumulate(out)

    step = max(8, int(len(xs) ** 0.5))
    row, kept = np.zeros(len(ys) + 1, np.int64), []
    for i, x in enumerate(xs):
        if i % step == 0:
            kept.append(row)
        row = after(row, x)
    total, pairs, j = int(row[-1]), [], len(ys)
    for block in range(len(kept) - 1, -1, -1):
        rows = [kept[block]]
        for x in xs[block * step : (block + 1) * step]:
            rows.append(after(rows[-1], x))
        i = len(rows) - 1
        while i and j:
            gain = worth[xs[block * step + i - 1]][j - 1]
            if gain and rows[i][j] == rows[i - 1][j - 1] + gain:
                i, j = i - 1, j - 1
                pairs.append((block * step + i, j))
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return total, pairs


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs of nodes of the greatest order-preserving matching from the roots down."""
    ids: dict = {}
    of = _shapes(a, ids) | _shapes(b, ids)
    shapes = list(ids)
    memo: dict[tuple[int, int], int] = {}
    ways: dict[tuple[int, int], list[tuple[int, int]]] = {}
    todo = [(of[id(a)], of[id(b)])]
    while todo:
        x, y = todo[-1]
        if (x, y) in memo:
            todo.pop()
        elif shapes[x][:2] != shapes[y][:2]:
            memo[todo.pop()] = 0
        else:
            xs, ys = shapes[x][2:], shapes[y][2:]
            other = set(ys)
            need = [(p, q) for p in set(xs) for q in other if (p, q) not in memo]
            if need:
                todo += need
                continue
            total, ways[x, y] = _aligned(xs, ys, memo)
            memo[todo.pop()] = total + 1
    out, pairs = [], [(a, b)] if memo[of[id(a)], of[id(b)]] else []
    while pairs:
        x, y = pairs.pop()
        out.append((x, y))
        xs, ys = ([k for k in n.kids if isinstance(k, Node)] for n in (x, y))
        pairs += [(xs[i], ys[j]) for i, j in ways[of[id(x)], of[id(y)]]]
    return out


def constants(first: Node, other: Node) -> set[str]:
    """Keys of the text nodes of first that other has at the matching place."""
    paths: list[tuple[Node, str]] = []
    _flat(first, "", paths)
    where = {id(n): p for n, p in paths}
    same = set()
    for x, y in match(first, other):
        theirs = {_clean(k) for k in y.kids if isinstance(k, str)}
        same |= {_key(where[id(x)], t) for k in x.kids if isinstance(k, str) and (t := _clean(k)) and t in theirs}
    return same


def _container(root: Node) -> Node | None:
    """The article or main element with most text, or None."""
    best, most = None, 0
    nodes: list[tuple[Node, str]] = []
    _flat(root, "", nodes)
    for node, _ in nodes:
        if node.name in ("article", "main") and not node.other:
            size, todo = 0, [node]
            while todo:
                for k in todo.pop().kids:
                    if isinstance(k, str):
                        size += len(k)
                    elif k.name not in _SKIP and not k.other:
                        todo.append(k)
            if size > most or (size == most and node.name == "article"):
                best, most = node, size
    return best


def extract(root: Node, template: frozenset[str], deep: bool = False) -> str:
    """The main text of a page, given the keys of its layout's constant text nodes, which count inside articles if `deep`."""
    container = _container(root)
    blocks: list[str] = []
    pending: list[str] = []
    linked = plain = 0

    def flush() -> None:
        nonlocal linked, plain
        text = " ".join("".join(pending).split())
        pending.clear()
        # outside of an article a block of links is a menu
        if text and (container is not None or linked == 0 or plain > linked):
            blocks.append(text)
        linked = plain = 0

    #: (node, path, inside the container, inside a link); a None node ends a block
    todo: list[tuple[Node | str | None, str, bool, bool]] = [(root, "", container is None, False)]
    while todo:
        node, path, inside, link = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                text = html.unescape(node) if "&" in node else node
                if template and (short := " ".join(text.split())) and (container is None or deep) and _key(path, short) in template:
                    continue
                pending.append(text)
                if link:
                    linked += len(text.strip())
                else:
                    plain += len(text.strip())
        else:
            inside = inside or node is container
            if node.name == "br" or node.name == "hr":
                pending.append(" ")
                continue
            if node is not container and (node.name in _SKIP or node.other) and not (node.name == "header" and _in_article(path) and not node.other):
                if node.name not in _INLINE and inside:
                    flush()
                if inside or container is None:
                    continue
                if node.name in ("head", "title") or node.name in _RAW:
                    continue
            block = node.name not in _INLINE
            link = link or node.name == "a"
            if block:
                if inside:
                    flush()
                todo.append((None, "", False, False))
            todo += [(k, path if isinstance(k, str) else f"{path}/{k.name}.{k.mark}", inside, link) for k in reversed(node.kids)]
    flush()
    return " ".join(blocks)


def _in_article(path: str) -> bool:
    return "/article." in path or "/main." in path


def _host(column: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(column), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _rows(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host of each row of pages."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host("url").alias("host"))


def _laid_out(rows: DataFrame) -> DataFrame:
    """The rows with layout, for joins with more layouts than are sent to the tasks."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [layout(parse(page or "")) for page in batch.column("html").to_pylist()]
        return C.record(**{c: batch.column(c) for c in batch.schema.names}, layout=kinds)

    return C.arrow_map(rows, work, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, layout string", "html")


def _texts(tree: Node) -> set[tuple[str, str]]:
    """Path and text of each text node."""
    paths: list[tuple[Node, str]] = []
    _flat(tree, "", paths)
    return {(p, t) for n, p in paths for k in n.kids if isinstance(k, str) and (t := _clean(k))}


class Aligned:
    """What all pages of one layout that a task has met share with the layout's first page."""

    def __init__(self, first: str):
        self.tree, self.seen = parse(first), 0
        self.alive = _texts(self.tree)

    def add(self, page: str, tree: Node | None = None) -> None:
        """A node that one page lacks is no template, whatever comes; without any node left no page need be aligned."""
        self.seen += 1
        if self.alive:
            tree = tree or parse(page)
            self.alive &= _texts(tree)
        if self.alive:
            same = constants(self.tree, tree)
            self.alive = {x for x in self.alive if _key(*x) in same}


def wrappers(rows: DataFrame) -> DataFrame:
    """host, layout, deep and template (keys of constant nodes) of the layouts that have one."""
    scratch = C.Scratch(rows.sparkSession, "wrappers")
    rows = rows.where("host <> '' AND html IS NOT NULL")
    hashed = rows.select("host", "html", F.xxhash64("html").alias("h"))

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        trees = [parse(page) for page in batch.column("html").to_pylist()]
        return C.record(host=batch.column("host"), h=batch.column("h"), layout=[layout(t) for t in trees], main=[_key("", extract(t, frozenset())) for t in trees])

    slim = scratch.save(C.arrow_map(hashed, read, "host string, h long, layout string, main string", "html"), "slim")
    mains = slim.select("host", "layout", "main").distinct().groupBy("host", "layout").agg(F.count("*").alias("mains")).where("mains > 1")
    least = slim.groupBy("host", "layout").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    chosen = scratch.save(least.join(mains, ["host", "layout"]).select("host", "layout", "h", "n", (F.col("mains") >= MAINS).alias("deep")), "chosen")
    few = chosen.count() <= LAYOUTS_SENT
    firsts = hashed.join(F.broadcast(chosen) if few else chosen, ["host", "h"]).groupBy("host", "layout", "n", "deep").agg(F.min("html").alias("first"))
    firsts = scratch.save(firsts, "firsts")
    few = few and (firsts.agg(F.coalesce(F.sum(F.octet_length("first").cast("long")), F.lit(0))).first()[0]) <= BYTES_SENT

    def counted(met: dict[tuple[str, str, int], Aligned]) -> pa.RecordBatch | None:
        found = [(host, kind, n, _key(*x), a.seen) for (host, kind, n), a in met.items() for x in a.alive]
        if not found:
            return None
        host, kind, n, key, c = zip(*found, strict=True)
        return C.record(host=list(host), layout=list(kind), n=list(n), key=list(key), c=list(c))

    schema = "host string, layout string, n long, key string, c long"
    if few:  # one reading of each page
        shared = rows.sparkSession.sparkContext.broadcast({(r.host, r.layout): (r.n, r.first) for r in firsts.collect()})

        def run(batches):
            met: dict[tuple[str, str, int], Aligned] = {}
            for batch in batches:
                for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    tree = parse(page)
                    place = host, layout(tree)
                    if found := shared.value.get(place):
                        key = (*place, found[0])
                        if key not in met:
                            met[key] = Aligned(found[1])
                        met[key].add(page, tree)
            if (out := counted(met)) is not None:
                yield out

        found = rows.select("host", "html").mapInArrow(run, schema)
    else:  # pages come with their layout's first one; what a task knows of a layout is handed on with each batch

        def run(batches):
            for batch in batches:
                met: dict[tuple[str, str, int], Aligned] = {}
                for host, kind, n, first, page in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "n", "first", "html")), strict=True):
                    if (host, kind, n) not in met:
                        met[host, kind, n] = Aligned(first)
                    met[host, kind, n].add(page)
                if (out := counted(met)) is not None:
                    yield out

        pairs = _laid_out(rows.select("host", "html")).join(firsts, ["host", "layout"])
        found = pairs.select("host", "layout", "n", "first", "html").mapInArrow(run, schema)
    found = found.groupBy("host", "layout", "n", "key").agg(F.sum("c").alias("c")).where("c = n")
    keys = found.groupBy("host", "layout").agg(F.sort_array(F.collect_list("key")).alias("template"))
    return scratch.save(keys.join(firsts.select("host", "layout", "deep"), ["host", "layout"]), "wrappers")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    C.tuned(pages.sparkSession)
    rows = _rows(pages)
    found = wrappers(rows)
    size = found.agg(F.coalesce(F.sum(F.size("template").cast("long")), F.lit(0))).first()[0]
    few = found.count() <= LAYOUTS_SENT and 16 * size <= BYTES_SENT

    def result(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return C.record(page_id=batch.column("page_id"), url=batch.column("url"), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    schema = "page_id long, url string, text string, n_chars long"
    if few:
        shared = pages.sparkSession.sparkContext.broadcast({(r.host, r.layout): (frozenset(r.template), r.deep) for r in found.collect()})

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tree = parse(page or "")
                texts.append(extract(tree, *(shared.value.get((host, layout(tree))) or (frozenset(),))) if page else "")
            return result(batch, texts)

        return C.arrow_map(rows, work, schema, "html")

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = zip(batch.column("html").to_pylist(), batch.column("template"), batch.column("deep").to_pylist(), strict=True)
        return result(batch, [extract(parse(page), frozenset(template.as_py() or ()), bool(deep)) if page else "" for page, template, deep in each])

    rows = _laid_out(rows).join(found, ["host", "layout"], "left").select("page_id", "url", "html", "template", "deep")
    return C.arrow_map(rows, joined, schema, "html")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(C.table(spark, sf_dir, "pages"))
