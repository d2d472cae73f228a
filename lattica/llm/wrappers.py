"""HTML main-text extraction by union-free wrappers inferred per host.

A page becomes a stream of boxes (structural elements), marks (elements that begin a block)
and text. Adjacent groups of equal shape fold into one repeated group and text into slots,
which gives the page a union-free regular expression, its pattern. The patterns of a host
are aligned one after another: what matches is merged, what does not becomes optional, text
that differs is a slot and text that never does is template. Evidence is kept by slot
(blocks, characters, characters in links, whether constant), summed by (host, pattern)
before anything is shuffled; a host's patterns are merged GROUP at a time, so no task ever
holds the pages of a host.

The wrapper then says which slots are the article: inside the box that holds the main text,
without boxes and marks of navigation, headers, footers, sidebars, notices, adverts, forms
and reader comments, without link lists and without template text. Every page of the host
is read with its wrapper.

Template text that stands inside a repeated group of article blocks, with no mark of its own,
is part of that group and stays.

Null and empty pages, and pages without text, give "". A null url is the host "". Copies of
a page are one piece of evidence. Pages of any length are read whole; boxes nested deeper than
DEPTH belong to the box that is so deep.
"""

from __future__ import annotations

import html as entities
import json
import re
from difflib import SequenceMatcher
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, sliced, table
from .redirects import host_of

# A quote begins a value only right after "=".
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)(?:>|\Z)"""
    r"|(?P<text>[^<]+)|(?P<odd><)",
    re.S,
)
ATTRS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
# Elements whose content is no text of the page; those of the first kind end with the page if nothing ends them.
RAW = frozenset("script style".split())
SKIPPED = RAW | frozenset("noscript template svg iframe textarea select title object math".split())
# HTML elements by what they do to the text around them.
BOXES = frozenset("html body div section article main nav header footer aside form ul ol dl table figure fieldset blockquote details dialog menu button label".split())
MARKS = frozenset("p h1 h2 h3 h4 h5 h6 li br tr td th dt dd pre hr figcaption caption summary address center thead tbody tfoot legend option".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog button label fieldset".split())
ROLES = re.compile(
    r"(?:^|[-_\s])(?:nav\w*|menu\w*|header|masthead|footer|sidebar|side|aside|cookies?|consent|notices?|notification|alert|banner|ads?|advert\w*|sponsor\w*|promo\w*"
    r"|share|sharing|social|comments?|replies|reply|respond|disqus|related|recommend\w*|breadcrumbs?|login|signup|subscribe|newsletter|popup|modal|overlay|widget|pagination|pager|search|toolbar|skip|copyright|legal|complementary|contentinfo|navigation|tags?|rating)(?:$|[-_\s\d])",
    re.I,
)
MAIN = re.compile(r"(?:^|[-_\s])(?:article|main|content|post|entry|story|body|text)(?:$|[-_\s])", re.I)
DEPTH = 120
GROUP = 256  # patterns or wrappers that one task merges
SURE = 8  # different pages that must agree before constant text is template


class Unit:
    __slots__ = ("key", "parts", "linked", "text")

    def __init__(self, key: str):
        self.key, self.parts, self.linked, self.text = key, [], 0, ""


class Box:
    __slots__ = ("key", "kids")

    def __init__(self, key: str):
        self.key, self.kids = key, []


def _key(tag: str, attrs: str) -> str:
    if not attrs:
        return tag
    label = " ".join(sorted({v for m in ATTRS.finditer(attrs) for v in re.sub(r"\d+", "", m[2] or m[3] or m[4] or "").split()}))
    return f"{tag}.{label}" if label else tag


def parse(page: str | None) -> Box:
    """The boxes and blocks of a page; elements that are not closed end with what holds them."""
    stack, unit, links = [Box("html")], None, 0

    def flush():
        nonlocal unit
        if unit is not None:
            unit.text = " ".join(entities.unescape("".join(unit.parts)).split())
            unit.parts = []
            if unit.text:
                stack[-1].kids.append(unit)
            unit = None

    page, at, open_ended = page or "", 0, set()
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        kind = m.lastgroup
        if kind in ("text", "odd"):
            if unit is None:
                unit = Unit("#")
            unit.parts.append(m[0])
            if links:
                unit.linked += len(m[0].strip())
        elif m["tag"]:
            tag = m["tag"].lower()
            if tag in SKIPPED:
                if not m["end"] and not m["attrs"].endswith("/") and tag not in open_ended:
                    stop = _END[tag].search(page, at)
                    if stop:
                        at = stop.end()
                    elif tag in RAW:
                        at = len(page)
                    else:
                        open_ended.add(tag)  # nothing ends it: its tags alone are skipped
            elif tag in BOXES:
                flush()
                if not m["end"]:
                    if not m["attrs"].endswith("/"):
                        if len(stack) < DEPTH:
                            box = Box(_key(tag, m["attrs"]))
                            stack[-1].kids.append(box)
                        else:
                            box = Box(tag)
                            box.kids = stack[-1].kids
                        stack.append(box)
                else:
                    i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].key.partition(".")[0] == tag), 0)
                    if i:
                        del stack[i:]
                links = 0 if tag not in ("label", "button") else links
            elif tag in MARKS:
                before = unit.key if unit is not None and tag == "br" else None
                flush()
                if not m["end"]:
                    unit = Unit(_key(tag, m["attrs"]) if before in (None, "#") else before)  # a line break doesn't end the block's mark
            elif tag == "a":
                links = 0 if m["end"] else 1
    flush()
    return stack[0]


_END = {tag: re.compile(rf"</{tag}\s*+(?:>|\Z)", re.I) for tag in SKIPPED}


# A pattern is a list of items [key, kids or None, units]; a repeated group is one item.


def fold(kids: list) -> list:
    items = []
    for kid in kids:
        if isinstance(kid, Unit):
            items.append([kid.key, None, [kid]])
        elif inner := fold(kid.kids):
            items.append([kid.key, inner, []])
    for period in (1, 2, 3):
        shapes, out, kept = [_shape([i]) for i in items], [], []
        for item, shape in zip(items, shapes, strict=True):
            out.append(item)
            kept.append(shape)
            if len(kept) >= 2 * period and kept[-period:] == kept[-2 * period : -period]:
                for a, b in zip(out[-2 * period : -period], out[-period:], strict=True):
                    _absorb(a, b)
                del out[-period:], kept[-period:]
        items = out
    return items


def _absorb(a: list, b: list) -> None:
    a[2] += b[2]
    for x, y in zip(a[1] or [], b[1] or [], strict=True):
        _absorb(x, y)


def _shape(items: list) -> str:
    return ",".join(k if kids is None else f"{k}({_shape(kids)})" for k, kids, *_ in items)


def slots(items: list):
    """Leaves in page order of the pattern."""
    for item in items:
        if item[1] is None:
            yield item
        else:
            yield from slots(item[1])


# A wrapper is a list of nodes [key, kids or None, pages, blocks, chars, linked, same, optional];
# pages: hashes of different pages that have it, the SURE least; same: CRC of the text while it never differs, else -1.


def as_wrapper(shape: list, evidence: list, pages: list[int]) -> list:
    left = iter(evidence)

    def build(items):
        return [[k, None, pages, *next(left), False] if kids is None else [k, build(kids), pages, 0, 0, 0, -1, False] for k, kids in items]

    return build(shape)


def _aligned(a: list, b: list):
    return SequenceMatcher(None, [_name(x) for x in a], [_name(x) for x in b], autojunk=False).get_opcodes()


def _name(node: list) -> str:
    if node[1] is None or "." in node[0] or node[0] in OUTSIDE or node[0] in ("body", "article", "main"):
        return node[0] if node[1] is None else f"[{node[0]}]"
    return f"[{node[0]}:{node[1][0][0] if node[1] else ''}]"  # plain boxes go by what they begin with


def _least(a: list[int], b: list[int]) -> list[int]:
    return a if a == b else sorted({*a, *b})[:SURE]


def merge(a: list, b: list) -> list:
    """One wrapper for both: mismatches become optional."""
    out = []
    for what, i, j, k, m in _aligned(a, b):
        if what == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                both = [x[0], None if x[1] is None else merge(x[1], y[1]), _least(x[2], y[2]), *(p + q for p, q in zip(x[3:6], y[3:6], strict=True))]
                out.append([*both, x[6] if x[6] == y[6] else -1, x[7] or y[7]])
        else:
            out += [[*x[:7], True] for x in (*a[i:j], *b[k:m])]
    return out


def _outside(key: str, inside: bool) -> bool:
    tag, _, label = key.partition(".")
    if tag in OUTSIDE and not (inside and tag == "header"):
        return True
    return bool(label and ROLES.search(label)) and not (tag in ("body", "html", "article", "main"))


def article(wrapper: list) -> set[int]:
    """ids of the leaf nodes that belong to the article."""
    mass: dict[int, float] = {}

    def weigh(nodes, inside):
        total = 0.0
        for n in nodes:
            if _outside(n[0], inside):
                mass[id(n)] = 0.0
            elif n[1] is None:
                mass[id(n)] = max(0, n[4] - 2 * n[5])
            else:
                mass[id(n)] = weigh(n[1], inside or n[0].partition(".")[0] in ("article", "main"))
            total += mass[id(n)]
        return total

    total = weigh(wrapper, False)
    if not total:
        return set()

    def boxes(nodes, inside):
        for n in nodes:
            if n[1] is not None and mass[id(n)] > 0:
                yield n
                yield from boxes(n[1], inside)

    named = [n for n in boxes(wrapper, False) if n[0].partition(".")[0] in ("article", "main")]
    named = named or [n for n in boxes(wrapper, False) if n[0] not in ("html", "body") and MAIN.search(n[0].partition(".")[2])]
    best = max((mass[id(n)] for n in named), default=0)
    if best >= 0.25 * total:
        roots = [n for n in named if mass[id(n)] >= 0.1 * best]
    else:
        roots, level = wrapper, wrapper
        while True:
            inner = max((n for n in level if n[1] is not None), key=lambda n: mass[id(n)], default=None)
            if inner is None or mass[id(inner)] < 0.6 * total:
                break
            roots, level = inner[1], inner[1]
    kept: set[int] = set()
    # where nothing varies the pages are copies of one another, and their text is no template
    varies = any(n[6] == -1 for n in leaves(roots))

    def walk(nodes, inside):
        for n in nodes:
            if mass.get(id(n), 0) <= 0 and n[1] is not None or _outside(n[0], inside):
                continue
            if n[1] is not None:
                walk(n[1], True)
            elif not (n[5] > 0.6 * n[4] or varies and n[6] != -1 and len(n[2]) >= SURE):
                kept.add(id(n))

    walk(roots, True)
    return kept


def leaves(nodes: list):
    for n in nodes:
        if n[1] is None:
            yield n
        else:
            yield from leaves(n[1])


def keeps(pattern: list, wrapper: list, kept: set[int]) -> list[bool]:
    """For each slot of a pattern whether the wrapper keeps it; a slot the wrapper lacks goes by the nearest one of the smallest box around both."""
    out: list[bool | None] = []
    boxes: list[tuple[int, ...]] = []

    def walk(items, nodes, box):
        names = [[i[0], i[1]] for i in items]
        for what, i, j, k, m in _aligned(names, nodes):
            for place, x, y in zip(range(i, j), items[i:j], nodes[k:m] if what == "equal" else [None] * (j - i), strict=True):
                if x[1] is not None:
                    walk(x[1], y[1] if y is not None else [], (*box, place))
                else:
                    out.append(None if y is None else id(y) in kept)
                    boxes.append(box)

    walk(pattern, wrapper, ())
    known = [i for i, x in enumerate(out) if x is not None]

    def near(i):
        for depth in range(len(boxes[i]), -1, -1):
            own = [j for j in known if boxes[j][:depth] == boxes[i][:depth]]
            if own:
                return out[min(own, key=lambda j: (abs(i - j), j))]
        return False

    return [near(i) if x is None else x for i, x in enumerate(out)]


def _read(host: str, page: str | None):
    root = parse(page)
    items = fold(root.kids)
    shape = _shape(items)
    return root, items, xxhash.xxh64_intdigest(f"{host}\n{shape}".encode("utf-8", "surrogatepass")) >> 1


def _units(box: Box):
    for kid in box.kids:
        if isinstance(kid, Unit):
            yield kid
        else:
            yield from _units(kid)


def _bare(items: list) -> list:
    return [[k, None if kids is None else _bare(kids)] for k, kids, _ in items]


EVIDENCE = "host string, sig long, rows long, pages string, pattern string, evidence string"


@lean
def _evidence(batches):
    for batch in sliced(batches, 2000):
        found: dict[int, list] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root, items, sig = _read(host, page)
            now = [[len(x[2]), sum(len(u.text) for u in x[2]), sum(min(u.linked, len(u.text)) for u in x[2]), crc32(x[2][0].text.encode("utf-8", "surrogatepass")) if len({u.text for u in x[2]}) == 1 else -1] for x in slots(items)]
            if not now:
                continue
            print_ = xxhash.xxh64_intdigest("\n".join(u.text for u in _units(root)).encode("utf-8", "surrogatepass"))
            if sig not in found:
                found[sig] = [host, 1, [print_], json.dumps(_bare(items)), now]
            else:
                found[sig][1] += 1
                found[sig][2] = _least(found[sig][2], [print_])
                found[sig][4] = _added(found[sig][4], now)
        rows = [(host, sig, n, json.dumps(pages), pattern, json.dumps(evidence)) for sig, (host, n, pages, pattern, evidence) in found.items()]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=[c.split()[0] for c in EVIDENCE.split(", ")])


def _added(a: list, b: list) -> list:
    return [[x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] if x[3] == y[3] else -1] for x, y in zip(a, b, strict=True)]


@lean
def _summed(batches):
    """Rows sorted by pattern: one for each, its evidence added."""
    now, names = None, ["host", "sig", "rows", "pages", "pattern", "evidence"]

    def out(rows):
        columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [json.dumps(r[3]) for r in rows], [r[4] for r in rows], [json.dumps(r[5]) for r in rows]]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3], strict=True)], names=names)

    for batch in sliced(batches):
        done = []
        for host, sig, n, pages, pattern, evidence in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            pages, evidence = json.loads(pages), json.loads(evidence)
            if now is not None and now[1] == sig:
                now[2] += n
                now[3], now[5] = _least(now[3], pages), _added(now[5], evidence)
            else:
                if now is not None:
                    done.append(now)
                now = [host, sig, n, pages, pattern, evidence]
        yield out(done)
    if now is not None:
        yield out([now])


def _wrapped(key, group):
    """One wrapper of a group of patterns, most frequent first."""
    import pandas as pd

    wrapper: list = []
    for _, _, pages, pattern, evidence in sorted(zip(-group["rows"], group["sig"], group["pages"], group["pattern"], group["evidence"], strict=True)):
        own = as_wrapper(json.loads(pattern), json.loads(evidence), json.loads(pages))
        wrapper = merge(wrapper, own) if wrapper else own
    return pd.DataFrame({"host": [key[0]], "part": [int(key[1])], "wrapper": [json.dumps(wrapper)]})


def _joined(key, group):
    import pandas as pd

    wrapper: list = []
    for text in sorted(group["wrapper"], key=lambda t: (-len(t), t)):
        wrapper = merge(wrapper, json.loads(text)) if wrapper else json.loads(text)
    return pd.DataFrame({"host": [key[0]], "part": [int(key[1])], "wrapper": [json.dumps(wrapper)]})


@lean
def _chosen(batches):
    known: dict[str, tuple] = {}
    for batch in batches:
        rows = []
        for sig, pattern, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if text not in known:
                if len(known) > 50:
                    known.clear()
                wrapper = json.loads(text)
                known[text] = (wrapper, article(wrapper))
            rows.append((sig, keeps(json.loads(pattern), *known[text])))
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.bool_()))], names=["sig", "keep"])


@lean
def _blocks(batches):
    """Every block of a page in page order, with its slot."""
    for batch in sliced(batches):
        sigs, slot, block = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root, items, sig = _read(host, page)
            place = {id(u): k for k, x in enumerate(slots(items)) for u in x[2]}
            units = list(_units(root))
            sigs.append(sig)
            slot.append([place[id(u)] for u in units])
            block.append([u.text for u in units])
        columns = [batch.column(2), batch.column(3), pa.array(sigs, pa.int64()), pa.array(slot, pa.list_(pa.int32())), pa.array(block, pa.list_(pa.string()))]
        yield pa.record_batch(columns, names=["page_id", "url", "sig", "slot", "block"])


PART = "host string, part long, wrapper string"


def wrappers(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, wrapper) and (sig, keep): the wrapper of each host, and what it keeps of each pattern."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    evidence = rows.mapInArrow(_evidence, EVIDENCE)
    # sig holds the host, so a host's patterns are dealt to all tasks
    patterns = materialize(evidence.repartition("sig").sortWithinPartitions("sig").mapInArrow(_summed, EVIDENCE), "patterns")
    parts = patterns.groupBy("host").agg(F.ceil(F.count("*") / GROUP).alias("parts"))
    dealt = patterns.join(parts, "host").withColumn("part", F.pmod("sig", "parts"))
    whole = materialize(dealt.groupBy("host", "part").applyInPandas(_wrapped, PART), "wrappers")
    while whole.agg(F.max("part")).first()[0]:  # hosts of many patterns: GROUP wrappers become one, until one is left
        merged = whole.withColumn("part", F.floor(F.col("part") / GROUP)).groupBy("host", "part").applyInPandas(_joined, PART)
        whole = materialize(merged, "wrappers")
    whole = whole.select("host", "wrapper")
    patterns = patterns.select("host", "sig", "pattern")
    keep = patterns.join(whole, "host").select("sig", "pattern", "wrapper").mapInArrow(_chosen, "sig long, keep array<boolean>")
    return whole, keep


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    _, keep = wrappers(pages)
    keep = materialize(keep, "keep")
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"), "page_id", F.col("url").cast("string").alias("url"))
    kind = pages.schema["page_id"].dataType.simpleString()
    found = rows.mapInArrow(_blocks, f"page_id {kind}, url string, sig long, slot array<int>, block array<string>").join(keep, "sig", "left")
    mine = F.filter("block", lambda _, i: F.coalesce(F.element_at("keep", F.element_at("slot", i + 1) + 1), F.lit(False)))
    text = F.coalesce(F.array_join(mine, "\n"), F.lit(""))
    return found.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op1_wrappers(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
