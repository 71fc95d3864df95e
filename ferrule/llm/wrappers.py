"""Operator 7: main text of web pages by wrappers inferred per host.

A page is a stream of tag and text tokens, nested as its elements nest. A wrapper is a union-free regular expression over such tokens: elements,
text slots (a constant while all pages agree, else a field), optional groups and repeated groups. A page is a wrapper whose repeats
are folded: a stretch of up to ``PERIOD`` nodes that repeats the one before it becomes a repeated group. Aligning a wrapper with a further page
resolves each mismatch: differing texts make a field, what one side lacks becomes an optional group, a group meets its single
occurrence. Two wrappers align alike, so partial wrappers of any number of slices of a host merge into one: no host is gathered in
one task, and all pages take part.

The wrapper says where a host's text is: from the body down, the article or main element, else the container that holds most of the text of fields;
it stops at a heading or where the text spreads; hosts that spread it over the body have no region. It also says what is template outside the region:
constants that pages of ``OUTSIDE`` different contents have at a place that is neither optional nor repeated, or ``INSIDE`` at an optional one.
What pages share inside the region (headings such as Abstract) is the article's.
Extraction walks a page along its host's wrapper and keeps the texts of the region; hosts without one lose the template. A page that has nothing in the
region keeps all but the template; one that is template throughout keeps all. Elements that are boilerplate by their name, class or role are left
out before, and weigh nothing.

Defined results: null and empty html give an empty text; null urls are one host; broken, unclosed or truncated markup ends with the page; elements
nested deeper than ``DEPTH`` belong to the element at that depth, with all their text; copies of a page count once as support, so
repeated rows give equal rows and lose nothing; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, join_unique, table

#: Wrappers of up to so many characters together are broadcast; more are joined by a shuffle.
BROADCAST_CHARS = 16_000_000

# Fixed values of HTML: elements without an end tag, raw-text elements, blocks, and elements that are never article text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "video", "audio", "canvas", "select"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
DROPPED = {"aside", "button", "dialog", "footer", "form", "head", "header", "menu", "nav", "title"}
# Words of class names and ids. A name is boilerplate if all its words are in the two lists and one is in the first.
NOISE = set(
    "ad ads advert advertisement advertisements advertising adverts banner banners breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices popup promo promos promoted promotion related replies reply respond share sharing sidebar signup social sponsor "
    "sponsored sponsors subscribe toolbar widget widgets".split()
)
NEUTRAL = set(
    "area article articles bar block body bottom box btn button buttons container content email entry foot form global group head icon icons inner item items label left link links list main media "
    "message mobile outer page panel policy post posts primary right row secondary section site slot sticky stories story text this thread title top unit us wrap wrapper".split()
)
#: What heads an article is its own.
HEADS = {"header", "masthead"}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*+)))?", re.I)
#: Raw-text elements whose content ends at the first end tag of the name; others end at the one that closes them. Of those, some may end at once.
RAW_TEXT, CLOSED_AT_ONCE = {"script", "style", "noscript", "textarea", "iframe"}, {"svg", "math"}
#: Nodes that a repeat may have; nesting that is kept; pages of different content that make a constant template at a sure and at an optional place;
#: shares of field text that a container needs to be entered, and an article or main to be chosen.
PERIOD, DEPTH, OUTSIDE, INSIDE = 6, 150, 2, 5
ENTER, MARKED = 0.7, 0.25
#: Containers that the search for the region enters.
CONTAINERS = {"body", "center", "div", "html", "main", "article", "section", "table", "tbody", "td", "tr"}
SPACES = re.compile(r"\s+")
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot"}


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is open, close or text. Comments, doctypes and the content of raw-text elements are passed over."""
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                yield "text", "", m[0]
            continue
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3] or ""
        if name in RAW:
            if name not in CLOSED_AT_ONCE or not (m[3] or "").endswith("/"):
                at = raw_end(page, name, at)
            yield "close", name, ""


def raw_end(page: str, name: str, at: int) -> int:
    """Where the content of an element that is passed over ends: behind its end tag, or with the page."""
    depth = 1
    for m in re.compile(rf"<(/?){name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif name not in RAW_TEXT and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    return len(page)


def attribute_values(attributes: str) -> Iterator[tuple[str, str]]:
    return ((m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes))


def noisy(name: str, attributes: str, headed: Callable[[], bool] = lambda: False) -> bool:
    """Whether an element is boilerplate by its name, class, id or role; ``headed`` says whether it is in an article, whose header is its own."""
    if name in RAW or (name in DROPPED and not (name in HEADS and headed())):
        return True
    for key, value in attribute_values(attributes):
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"):
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            for token in value.lower().split():
                words = {w.strip("0123456789") for w in re.split("[-_]", token)} - {""}
                found = words & NOISE
                if found and words <= NOISE | NEUTRAL and not (found <= HEADS and headed()):
                    return True
    return False


def class_of(attributes: str) -> str:
    """An element's class without digits, which number pages and posts."""
    return next((re.sub(r"\d+", "", value) for key, value in attribute_values(attributes) if key == "class"), "")


def page_tree(page: str) -> list:
    """A page as nested [key, children]; children are nodes and strings, the blocks of text. A key is name.class, with ! where it is boilerplate.

    A block of text ends where a block element opens or closes; unclosed elements end with their parent.
    """
    root: list = ["", []]
    stack: list[tuple[str, list]] = [("", root)]
    held: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            stack[-1][1][1].append(text)

    for kind, name, rest in tokens(page):
        if kind == "text":
            held.append(rest)
        elif name in ("br", "wbr"):
            held.append(" " if name == "br" else "")
        elif kind == "open":
            if name in BLOCKS:
                flush()
                if name in CLOSES_P and any(n == "p" for n, _ in stack):
                    while stack[-1][0] != "p" and stack[-1][0] not in BLOCKS:
                        stack.pop()
                    if stack[-1][0] == "p":
                        stack.pop()
                elif name in ("li", "dd", "dt", "tr", "td", "th", "option") and stack[-1][0] == name:
                    stack.pop()
            elif name in RAW:
                held.append(" ")
            if name not in VOID and name not in RAW:
                noise = noisy(name, rest, lambda: any(n in ("article", "main") for n, _ in stack))
                node = stack[-1][1]
                if (name in BLOCKS or noise) and len(stack) < DEPTH:
                    flush()
                    node = [f"{name}.{class_of(rest)}{'!' if noise else ''}", []]
                    stack[-1][1][1].append(node)
                stack.append((name, node))
        elif any(n == name for n, _ in stack[1:]):
            at = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)
            if name in BLOCKS or stack[at][1] is not stack[at - 1][1]:
                flush()
            del stack[at:]
        elif name in BLOCKS:
            flush()
    flush()
    return root[1]


# A wrapper is a list of nodes: ["t", text, pages, chars] a slot, text null for a field, pages some digests of page contents that have it;
# ["e", key, nodes] an element; ["?", nodes] an optional group; ["+", nodes] a repeated group.


def core(node: list) -> list:
    """A node without the marks that say how often it comes; groups of several nodes are their own."""
    while node[0] in "?+" and len(node[1]) == 1:
        node = node[1][0]
    return node


def key(node: list) -> str:
    node = core(node)
    return "t" if node[0] == "t" else node[1] if node[0] == "e" else f"({','.join(map(key, node[1]))})"


def inner_keys(node: list) -> list[str]:
    """The keys of a group's nodes; of another node, its own."""
    node = core(node)
    return list(map(key, node[1])) if node[0] in "?+" else [key(node)]


def marks(node: list) -> set[str]:
    out = set()
    while node[0] in "?+":
        out.add(node[0])
        node = node[1][0] if len(node[1]) == 1 else ["t"]
    return out


def marked(node: list, names: set[str]) -> list:
    """A bare node, or the group that ``core`` gave, under marks."""
    inner = node[1] if node[0] in "?+" else [node]
    for m in ("+", "?"):
        if m in names:
            inner = [[m, inner]]
    return inner[0]


def join_nodes(a: list, b: list) -> list:
    """One node that matches what either matches; the two have equal keys."""
    x, y, names = core(a), core(b), marks(a) | marks(b)
    if x[0] == "t":
        same = x[1] is not None and x[1] == y[1]
        return marked(["t", x[1] if same else None, sorted({*x[2], *y[2]})[:INSIDE] if same else [], x[3] + y[3]], names)
    if x[0] == "e":
        return marked(["e", x[1], align(x[2], y[2])], names)
    return marked(["+", [join_nodes(p, q) for p, q in zip(x[1], y[1], strict=True)]], names)


def fold(nodes: list) -> list:
    """Collapses a stretch of nodes that repeats the one before it into a repeated group, shorter stretches first."""
    for size in range(1, PERIOD + 1):
        out, i = [], 0
        names = list(map(key, nodes))
        if len(set(names)) == len(names) and not any(n[0] == "(" for n in names):
            break
        while i < len(nodes):
            here = names[i : i + size]
            if len(here) == size and out and "+" in marks(out[-1]) and inner_keys(out[-1]) == here:
                group = core(out[-1])
                before = group[1] if group[0] == "+" else [group]
                out[-1] = marked(["+", [join_nodes(p, q) for p, q in zip(before, nodes[i : i + size], strict=True)]], marks(out[-1]))
                i += size
            elif len(here) == size and names[i + size : i + 2 * size] == here and not (size == 1 and here == ["t"]):
                out.append(["+", [join_nodes(p, q) for p, q in zip(nodes[i : i + size], nodes[i + size : i + 2 * size], strict=True)]])
                i += 2 * size
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def optional(node: list) -> list:
    return node if node[0] == "?" else ["?", [node]]


def align(a: list, b: list) -> list:
    """A wrapper that matches what a and b match. Nodes pair in order, a group with its single occurrence; what only one side has becomes optional."""
    if len(a) == len(b) == 1 and key(a[0]) == key(b[0]):
        return [join_nodes(a[0], b[0])]
    out, i, j = [], 0, 0
    a_keys, b_keys = list(map(key, a)), list(map(key, b))
    places: dict[str, list[int]] = {}
    for k, name in enumerate(b_keys):
        places.setdefault(name, []).append(k)

    def group(node: list, others: list, names: list[str], at: int) -> list | None:
        """A group of several nodes joined with one occurrence of them on the other side."""
        held = core(node)
        if held[0] in "?+" and len(held[1]) > 1 and names[at : at + len(held[1])] == inner_keys(held):
            return marked(["+", [join_nodes(p, q) for p, q in zip(held[1], others[at : at + len(held[1])], strict=True)]], marks(node))
        return None

    while i < len(a) and j < len(b):
        if a_keys[i] == b_keys[j]:
            out.append(join_nodes(a[i], b[j]))
            i, j = i + 1, j + 1
        elif found := group(a[i], b, b_keys, j):
            out.append(found)
            i, j = i + 1, j + len(inner_keys(a[i]))
        elif found := group(b[j], a, a_keys, i):
            out.append(found)
            i, j = i + len(inner_keys(b[j])), j + 1
        else:
            ahead = next((k for k in places.get(a_keys[i], ()) if k >= j), None)
            if ahead is None:
                out.append(optional(a[i]))
                i += 1
            else:
                out += map(optional, b[j:ahead])
                j = ahead
    return fold([*out, *map(optional, a[i:]), *map(optional, b[j:])])


def texts_of(nodes: list) -> Iterator[str]:
    """The texts of a page's tree without its boilerplate elements."""
    for x in nodes:
        if isinstance(x, str):
            yield x
        elif not x[0].endswith("!"):
            yield from texts_of(x[1])


def page_wrapper(page: str) -> list:
    """The wrapper that matches one page. Boilerplate elements stay as tags without text."""
    tree = page_tree(page)
    content = hashlib.blake2b("\n".join(texts_of(tree)).encode("utf-8", "replace"), digest_size=6).hexdigest()

    def of(nodes: list) -> list:
        return fold([["t", x, [content], len(x)] if isinstance(x, str) else ["e", x[0], [] if x[0].endswith("!") else of(x[1])] for x in nodes])

    return of(tree)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper): one wrapper per host from all its pages. Tasks fold their pages; partial wrappers merge per host."""
    schema = "host string, pages long, wrapper string"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fresh = page_wrapper(page or "")
                now = held.get(host)
                held[host] = [1, fresh] if now is None else [now[0] + 1, align(now[1], fresh)]
            if len(held) > 10_000:
                yield rows(held)
                held = {}
        yield rows(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, wrapper = None, 0, []
        for batch in batches:
            for host, count, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = json.loads(text)
                if n and host == now:
                    n, wrapper = n + count, align(wrapper, other)
                else:
                    if n:
                        yield rows({now: [n, wrapper]})
                    now, n, wrapper = host, count, other
        if n:
            yield rows({now: [n, wrapper]})

    def rows(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(list(held), pa.string()), pa.array([x[0] for x in held.values()], pa.int64()),
            pa.array([json.dumps(x[1], ensure_ascii=False) for x in held.values()], pa.string())], ["host", "pages", "wrapper"])

    parts = pages.select("host", "html").mapInArrow(partial, schema)
    return parts.repartition("host").sortWithinPartitions("host", "pages", "wrapper").mapInArrow(merge, schema)


class Template:
    """A host's wrapper made ready for extraction: its nodes in a line per element, with the region and the template slots marked."""

    def __init__(self, wrapper: list):
        self.weights: dict[int, float] = {}
        for node in wrapper:
            self._weigh(node)
        self.regions = {id(x) for x in self._region(wrapper) if x[1].partition(".")[0] not in ("html", "body")}
        self.lines: dict[int, list] = {}
        self.top = self._line(wrapper)

    def _weigh(self, node: list) -> float:
        """Characters of fields below each node; a constant weighs like a field while few pages back it."""
        if node[0] == "t":
            w = node[3] if node[1] is None or len(node[2]) < OUTSIDE else 0
        elif node[0] == "e":
            w = 0 if node[1].endswith("!") else sum(map(self._weigh, node[2]))
        else:
            w = sum(map(self._weigh, node[1]))
        self.weights[id(node)] = w
        return w

    @staticmethod
    def _elements(nodes: list, repeated: bool = False) -> Iterator[tuple[list, bool]]:
        for x in nodes:
            if x[0] == "e":
                yield x, repeated
            elif x[0] in "?+":
                yield from Template._elements(x[1], repeated or x[0] == "+")

    def _region(self, nodes: list) -> list:
        """The elements that hold the host's text: from the top down into the heaviest container, till it is marked or parts."""
        found: list = []
        while True:
            inside = list(self._elements(nodes))
            total = sum(self.weights[id(n)] for n in nodes)
            name = lambda e: e[1].partition(".")[0]
            chosen = [e for e, _ in inside if name(e) in ("article", "main") and not e[1].endswith("!")]
            if chosen and total and sum(self.weights[id(e)] for e in chosen) >= MARKED * total:
                return chosen
            if found and any(name(e) in ("h1", "h2") for e, _ in inside):
                return found
            heavy = [e for e, repeated in inside if not repeated and name(e) in CONTAINERS and total and self.weights[id(e)] >= ENTER * total]
            if not heavy:
                return found
            found, nodes = heavy[:1], heavy[0][2]

    def _line(self, nodes: list, often: str = "") -> list:
        """(key, node, place where the repeated group around it begins, how often) of each node, groups opened out."""
        out: list = []

        def put(items: list, loop: int | None, how: str) -> None:
            for x in items:
                if x[0] in "?+":
                    put(x[1], len(out) if x[0] == "+" else loop, how + x[0])
                else:
                    out.append(("t" if x[0] == "t" else x[1], x, loop, how))

        put(nodes, None, often)
        return out

    def line(self, node: list, how: str) -> list:
        if id(node) not in self.lines:
            self.lines[id(node)] = self._line(node[2], how)
        return self.lines[id(node)]

    def walk(self, nodes: list, line: list, inside: bool, out: list) -> None:
        """Puts (in the region, template, text) of a page's texts, matched in order with a line of the wrapper."""
        at = 0
        for x in nodes:
            name = "t" if isinstance(x, str) else x[0]
            found = next((k for k in range(at, len(line)) if line[k][0] == name), None)
            if found is None:  # another round of the repeated group last met
                begin = next((line[k][2] for k in range(min(at, len(line) - 1), -1, -1) if line[k][2] is not None), None)
                found = next((k for k in range(begin, len(line)) if line[k][0] == name), None) if begin is not None else None
            _, node, loop, how = line[found] if found is not None else (None, None, None, "")
            if found is not None:
                at = found if loop is not None else found + 1
            if isinstance(x, str):
                pages = len(node[2]) if node is not None and node[1] == x else 0
                fixed = not (inside and self.regions) and (pages >= INSIDE and "+" not in how or pages >= OUTSIDE and not how)
                out.append((inside, fixed, x))
            elif not name.endswith("!"):
                self.walk(x[1], self.line(node, how) if node is not None else [], inside or (node is not None and id(node) in self.regions), out)

    def extract(self, page: str) -> str:
        """The texts of the region without the template; without any, all but the template; without any, all."""
        seen: list = []
        self.walk(page_tree(page), self.top, not self.regions, seen)
        for keep in (lambda inside, fixed: inside and not fixed, lambda inside, fixed: not fixed, lambda inside, fixed: True):
            if texts := [text for inside, fixed, text in seen if keep(inside, fixed)]:
                return "\n".join(texts)
        return ""


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def main_texts(pages: DataFrame, kept: Kept) -> DataFrame:
    """page_id, url and text of every page."""
    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    wrappers = kept.put(infer_wrappers(given))
    if (wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0) <= BROADCAST_CHARS:
        joined = given.join(F.broadcast(wrappers.drop("pages")), "host")
    else:
        joined = join_unique(given, wrappers, "host", "pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in batches:
            out = []
            for page, host, wrapper in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = Template(json.loads(wrapper))
                out.append(known[host].extract(page or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, "page_id long, url string, text string")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"), Kept(spark, "wrappers")).withColumn("n_chars", F.length("text").cast("long"))
