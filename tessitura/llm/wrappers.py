"""Main text of web pages by wrappers inferred for each host.

A page becomes a stream of block tags and texts. Its wrapper is a union-free
regular expression over that stream, held as a tree of (label, times,
children): times is ``1``, ``?``, ``+`` or ``*``, ``#`` is a text slot and
``=`` with a number is a text of the template.
Adjacent equal groups of up to four siblings fold into a repeated group. Two
wrappers of a host are aligned child by child; what only one of them has
becomes optional, what is repeated in either becomes a repeated group, texts
become slots. Aligning goes on until one wrapper stands for the host.

A text is of the template if it stands word for word under the same path on all
distinct pages of the host, or (in a group that is then optional) on at least
three of them and half of all. Two pages alone count as template and content
only if they differ in half of their text or more, else as copies. Template
texts are found by counting before pages are folded, so a notice between two
paragraphs keeps its own token; all others are slots.

Pages of a host that fold to the same expression are counted first, distinct
expressions are aligned in salted groups of some ``_GROUP`` each, in a tree with
as many levels as their number needs, so the pages of a hot host never meet in
one task. What a slot holds (characters, and those inside links) is summed by
path with partial aggregation.

The main text is looked for in what the wrapper's slots hold: it is the
``article`` with most text that is free of navigation, else ``main``, else the
block that the text is in. From it template texts are left out, and by tag
names and class words (a mark that nothing but a container word follows) the slots in menus, headers, footers, sidebars, notices,
adverts, forms, scripts and reader comments; classes such as ``has-sidebar``
mark nothing, headings in an ``article`` stay, and words of layouts mark no
element that holds most of the text. A page without text in its host's
place is read by its own wrapper, without a template.

Null html counts as empty and has an empty text; a null url is a host of its
own; tags that are never closed end with their parent; wrappers end at the depth
``_DEPTH``, while marks of deeper elements still count; broken tags are text; an empty table stays
empty; repeated pages get equal results; other columns pass through.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

_DEPTH = 48
_GROUP = 64
_BROADCAST_BYTES = 32 << 20

#: Element names.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav object ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul button textarea canvas svg video audio noscript head title".split())
RAW = set("script style template noscript iframe svg canvas object video audio textarea head title select".split())
LEFT_OUT = set("nav aside footer form button fieldset menu dialog header select".split())
EMPTY = set("br hr img input meta link area base col embed source track wbr param".split())
ENDS_P = BLOCKS - {"button", "object", "svg", "video", "audio", "noscript", "option", "optgroup", "canvas", "iframe", "template"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts of class, id and role that mark what is not the main text.
MARKS = set("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments respond disqus replies widget pagination pager toolbar search searchbox skip copyright complementary contentinfo".split())

#: Marks that also name layouts around the main text, and the prefixes that make a class no mark.
LAYOUT = set("sidebar aside nav navbar navigation menu header footer masthead banner toolbar widget search".split())
_NO_MARK = re.compile(r"^(?:has|no|not|with|without)[-_]", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARKED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none", re.I)
#: What may follow a mark within one class word, as in related-posts or sidebar__inner.
CONTAINERS = set("post posts article articles link links list box bar block section area wrapper wrap container inner outer body content contents left right top bottom main button buttons icon icons item items news story stories reading topics form field message messages panel row col column columns group slot unit zone text title heading id no small large mobile desktop sticky fixed primary secondary".split())
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _marks_of(word: str) -> set[str]:
    """The marks of a class word; none if something that is no container follows (related-work)."""
    parts = [p.lower() for p in _PARTS.findall(word)]
    first = next((k for k, p in enumerate(parts) if p in MARKS), None)
    if first is None or any(p not in MARKS and p not in CONTAINERS for p in parts[first:]):
        return set()
    return {p for p in parts if p in MARKS}


@lru_cache(maxsize=20_000)
def _label(name: str, attributes: str) -> str:
    if name in ("html", "body", "article", "main"):
        return name
    words = [w for m in _MARKED.finditer(attributes) for w in next(filter(None, m.groups()), "").split() if not _NO_MARK.match(w)]
    marks = set().union(*map(_marks_of, words)) if words else set()
    if _HIDDEN.search(attributes) or marks - LAYOUT:
        return f"{name}!"
    return f"{name}!{'header' if marks <= {'header', 'masthead'} else 'layout'}" if marks else name


def _key(path: tuple[str, ...], text: str) -> int:
    """A text under its path, as a number."""
    return int.from_bytes(hashlib.blake2b(f"{'/'.join(path)}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def blocks(page: str | None):
    """(path, text, link characters) of each text block, and the events (open label, close, or key of a text) between them."""
    page = page or ""
    stack: list[tuple[str, str]] = []  # (name, label)
    events: list = []
    found: list[tuple[tuple[str, ...], str, int]] = []
    text: list[str] = []
    links = [0, 0]  # open links, characters inside
    at, closing, low = 0, None, ""

    def end_block():
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            deep = next((label for _, label in stack[_DEPTH:] if "!" in label or label in LEFT_OUT), None)
            found.append((tuple(label for _, label in stack[:_DEPTH]) + ((deep,) if deep else ()), whole, min(links[1], len(whole))))
            if len(stack) <= _DEPTH:
                events.append(_key(*found[-1][:2]))
        text.clear()
        links[1] = 0

    def close(k: int):
        while len(stack) > k:
            if len(stack) <= _DEPTH:
                events.append(None)
            stack.pop()

    def say(part: str):
        text.append(part)
        if links[0]:
            links[1] += len(part)

    while at < len(page):
        if closing:
            low = low or page.lower()
            k = low.find(f"</{closing}", at)
            at, closing = (len(page) if k < 0 else k), None
            continue
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, ends = m[2].lower(), bool(m[1])
        if name == "a":
            links[0] = 0 if ends else 1
        if name in RAW and not ends:
            if not m[3].endswith("/"):
                closing = name
            if name in BLOCKS:
                end_block()
            continue
        if name not in BLOCKS:
            if name == "br":
                text.append(" ")
            continue
        end_block()
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in EMPTY:
            continue
        if name in ENDS_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
            if stack[k][0] in ENDED_BY.get(name, ()):
                close(k)
                break
            if stack[k][0] in ("ul", "ol", "dl", "table"):
                break
        if name in ("html", "body") and any(x == name for x, _ in stack):
            continue
        stack.append((name, _label(name, m[3])))
        if len(stack) <= _DEPTH:
            events.append(stack[-1][1])
    end_block()
    close(0)
    return found, events


def _both(a: str, b: str) -> str:
    """How often, if ``a`` or ``b`` holds."""
    return {(False, False): "1", (True, False): "?", (False, True): "+", (True, True): "*"}[a in "?*" or b in "?*", a in "+*" or b in "+*"]


def _sign(node: list) -> str:
    """What two nodes must have in common to be one: the label and the template texts directly below it."""
    return " ".join([node[0], *(c[0] for c in node[2] if c[0][:1] == "=")])


def _fold(children: list) -> list:
    """Adjacent equal groups of up to four siblings as one repeated group."""
    done = False
    while not done:
        done = True
        for size in (1, 2, 3, 4):
            out, i = [], 0
            while i < len(children):
                group = children[i : i + size]
                n = 1
                while len(group) == size and [_sign(c) for c in children[i + n * size : i + (n + 1) * size]] == [_sign(c) for c in group] and not any(c[0] == "()" for c in group):
                    group = [_align(x, y) for x, y in zip(group, children[i + n * size : i + (n + 1) * size], strict=True)]
                    n += 1
                if n > 1:
                    out += [[group[0][0], _both(group[0][1], "+"), group[0][2]]] if size == 1 else [["()", "+", group]]
                    i += n * size
                    done = size == 1 and done
                else:
                    out.append(children[i])
                    i += 1
            children = out
    return children


def _align(a: list, b: list) -> list:
    """The wrapper of everything that ``a`` or ``b`` (equal labels) stands for."""
    if a == b:
        return a
    x, y, out = a[2], b[2], []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, [_sign(c) for c in x], [_sign(c) for c in y], autojunk=False).get_opcodes():
        if tag == "equal":
            out += [_align(p, q) for p, q in zip(x[i1:i2], y[j1:j2], strict=True)]
        else:
            out += [[c[0], _both(c[1], "?"), c[2]] for c in [*x[i1:i2], *y[j1:j2]]]
    return [a[0], _both(a[1], b[1]), _fold(out)]


def expression(events: list, template=frozenset()) -> list:
    """The wrapper of one page, given the keys of the texts of its host's template."""
    root = ["", "1", []]
    open_ = [root]
    for e in events:
        if e is None:
            node = open_.pop()
            node[2] = _fold(node[2])
        elif isinstance(e, int):
            open_[-1][2].append([f"={e & (1 << 64) - 1:016x}" if e in template else "#", "1", []])
        else:
            node = [e, "1", []]
            open_[-1][2].append(node)
            open_.append(node)
    root[2] = _fold(root[2])
    return root


def written(node: list) -> str:
    """A wrapper as text, e.g. ``article(h1(#) p(#)+)``."""
    name = "" if node[0] == "()" else node[0]
    inner = " ".join(map(written, node[2]))
    return f"{name}{f'({inner})' if inner or node[0] == '()' else ''}{node[1].replace('1', '')}"


def _paths(node: list, above=()) -> set[tuple[str, ...]]:
    """The paths of all text slots of a wrapper."""
    own = above if node[0] in ("", "()") else (*above, node[0])
    if node[0] == "#":
        return {above}
    return set().union(*(_paths(c, own) for c in node[2])) if node[2] else set()


def _clean(path, around: int = 0) -> bool:
    """Whether no label of ``path`` tells that it is not main text; marks of layouts count after the first ``around`` labels only."""
    inside = False
    for k, label in enumerate(path):
        if label in ("article", "main"):
            inside = True
        elif label.endswith(("!header", "!layout")) and k < around:
            continue
        elif "!" in label and not (label.endswith("!header") and inside) or label in LEFT_OUT and not (label == "header" and inside):
            return False
    return True


def _around(held: dict[tuple[str, ...], tuple[int, int]]) -> tuple[str, ...]:
    """The longest path, if any, of an element marked as a layout that holds more than half of the text."""
    below: dict[tuple[str, ...], int] = {}
    total = 0
    for path, (chars, links) in held.items():
        n = max(0, chars - links)
        total += n
        for k, label in enumerate(path):
            if label.endswith(("!header", "!layout")):
                below[path[: k + 1]] = below.get(path[: k + 1], 0) + n
    return max((p for p, n in below.items() if 2 * n > total), key=len, default=())


def main_place(held: dict[tuple[str, ...], tuple[int, int]]) -> tuple[str, ...]:
    """Where the main text stands, given (characters, link characters) by path."""
    around = _around(held)
    own: dict[tuple[str, ...], int] = {}
    for path, (chars, links) in held.items():
        if _clean(path, len(around) if path[: len(around)] == around else 0):
            own[path] = own.get(path, 0) + max(0, chars - links)
    for name in ("article", "main"):
        totals: dict[tuple[str, ...], int] = {}
        for path, n in own.items():
            if name in path:
                place = path[: path.index(name) + 1]
                totals[place] = totals.get(place, 0) + n
        if totals:
            return max(sorted(totals), key=totals.get)
    place: tuple[str, ...] = ()
    while True:
        below: dict[tuple[str, ...], int] = {}
        for path, n in own.items():
            if len(path) > len(place) and path[: len(place)] == place and path[len(place)].split("!")[0] in ("html", "body", "div", "section", "table", "tbody", "tr", "td", "center"):
                child = path[: len(place) + 1]
                below[child] = below.get(child, 0) + n
        total = sum(n for path, n in own.items() if path[: len(place)] == place)
        best = max(sorted(below), key=below.get, default=None)
        if best is None or below[best] * 10 < total * 7:
            return place
        place = best


def _held(found) -> dict:
    held: dict = {}
    for path, text, links in found:
        n, k = held.get(path, (0, 0))
        held[path] = n + len(text), k + links
    return held


def main_text(page: str | None, place: tuple[str, ...] | None, template=frozenset()) -> str:
    found, _ = blocks(page)

    around = _around(_held(found))

    def inside(place, template=frozenset()):
        cut_at = len(place) - (place[-1:] in (("article",), ("main",)))
        free = lambda path: len(around) - cut_at if path[: len(around)] == around else 0
        return [text for path, text, _ in found if path[: len(place)] == place and _clean(path[cut_at:], free(path)) and not (template and _key(path, text) in template)]

    kept = inside(place, template) if place is not None else []
    return "\n\n".join(kept or inside(main_place(_held(found))))


_FEATURES = pa.struct([("expression", pa.string()), ("slots", pa.list_(pa.struct([("path", pa.string()), ("chars", pa.int64()), ("links", pa.int64())])))])


def _features(page: str | None, template: frozenset) -> dict:
    found, events = blocks(page)
    free = [x for x in found if _key(*x[:2]) not in template] if template else found
    return {"expression": json.dumps(expression(events, template)), "slots": [{"path": "/".join(p), "chars": n, "links": k} for p, (n, k) in _held(free).items()]}


def _texts(page: str | None) -> list[dict]:
    """The distinct texts of a page, with their characters where they could be main text."""
    found = {_key(path, text): len(text) if _clean(path) else 0 for path, text, _ in blocks(page)[0]}
    return [{"key": k, "chars": n} for k, n in found.items()]


def templates(pages: DataFrame) -> DataFrame:
    """For each host of pages (host, html) that has any: template, the keys of the texts that its pages share."""
    kind = pa.list_(pa.struct([("key", pa.int64()), ("chars", pa.int64())]))

    @F.arrow_udf("array<struct<key:bigint,chars:bigint>>")
    def texts(html_: pa.Array) -> pa.Array:
        return pa.array([_texts(x) for x in html_.to_pylist()], kind)

    # Equal pages count once; what is kept and shuffled are numbers.
    own = cut(pages.select("host", F.xxhash64("html").alias("page"), texts("html").alias("texts")).where(F.size("texts") > 0))
    held = cut(own.select("host", "page", F.explode("texts").alias("t")).groupBy("host", "t.key").agg(F.count_distinct("page").alias("n"), F.max("t.chars").alias("chars")).where("n > 1"))
    totals = cut(own.select("host", "page", F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + t["chars"]).alias("chars")).distinct().groupBy("host").agg(F.count("*").alias("pages"), F.sum("chars").alias("all_chars")))
    shared = held.join(totals, "host").where("n = pages or (n >= 3 and 2 * n >= pages)")
    whole = shared.groupBy("host").agg(F.collect_list("key").alias("template"), F.first("pages").alias("pages"), F.first("all_chars").alias("all_chars"), F.sum(F.col("n") * F.col("chars")).alias("chars"))
    return whole.where("pages > 2 or 2 * chars <= all_chars").select("host", "template")


def _merge(key, table):
    """Aligns the expressions of one group."""
    whole = None
    for text in sorted(table.column("expression").to_pylist()):
        new = json.loads(text)
        whole = new if whole is None else _align(whole, new)
    return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "expression": pa.array([json.dumps(whole)])})


def _joined(pages: DataFrame, known: DataFrame, host: str, size) -> DataFrame:
    """``pages`` with what is ``known`` of their hosts, broadcast if ``size`` (bytes a host) adds up to little."""
    total = known.agg(F.sum(size)).head()[0] or 0
    return pages.join(F.broadcast(known) if total <= _BROADCAST_BYTES else known, host, "left")


def wrappers(pages: DataFrame) -> DataFrame:
    """For each host of pages (host, html): wrapper (as text), place (the path of the main text) and template (keys of its texts)."""

    @F.arrow_udf("struct<expression:string,slots:array<struct<path:string,chars:bigint,links:bigint>>>")
    def features(html_: pa.Array, template: pa.Array) -> pa.Array:
        return pa.array([_features(x, _template(t)) for x, t in zip(html_.to_pylist(), template, strict=True)], _FEATURES)

    @F.arrow_udf("struct<wrapper:string,place:string>")
    def decided(expressions: pa.Array, slots: pa.Array) -> pa.Array:
        out = []
        for e, s in zip(expressions.to_pylist(), slots.to_pylist(), strict=True):
            wrapper = json.loads(e)
            known = _paths(wrapper)
            held = {tuple(x["path"].split("/")) if x["path"] else (): (x["chars"], x["links"]) for x in s or []}
            place = main_place({p: v for p, v in held.items() if p in known} or held)
            out.append({"wrapper": written(wrapper), "place": "/".join(place)})
        return pa.array(out, pa.struct([("wrapper", pa.string()), ("place", pa.string())]))

    shared = cut(templates(pages))
    full = _joined(pages, shared, "host", F.octet_length("host") + 8 * F.size("template") + 64)
    seen = cut(full.select("host", features("html", "template").alias("f")).select("host", "f.expression", F.explode_outer("f.slots").alias("s")).groupBy("host", "expression", "s.path").agg(F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links")))
    merged = cut(seen.select("host", "expression").distinct())
    most = merged.groupBy("host").count().agg(F.max("count")).head()[0] or 0
    while True:
        groups = -(-most // _GROUP)
        merged = merged.groupBy("host", F.pmod(F.xxhash64("expression"), F.lit(max(1, groups)))).applyInArrow(_merge, "host string, expression string")
        if groups <= 1:
            break
        merged, most = cut(merged), groups
    slots = seen.where("path is not null").groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")).groupBy("host").agg(F.collect_list(F.struct("path", "chars", "links")).alias("slots"))
    return merged.join(slots, "host", "left").select("host", decided("expression", "slots").alias("d")).join(shared, "host", "left").select("host", "d.wrapper", "d.place", "template")


def _template(keys) -> frozenset:
    return frozenset(keys.as_py() or ())


def extract(pages: DataFrame, url: str = "url", page: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each page in ``into``."""
    if into in pages.columns:
        raise ValueError(f"the table already has a column {into!r}; name another")

    @F.arrow_udf("string")
    def text(htmls: pa.Array, places: pa.Array, templates: pa.Array) -> pa.Array:
        return pa.array([main_text(h, None if p is None else tuple(p.split("/")) if p else (), _template(t)) for h, p, t in zip(htmls.to_pylist(), places.to_pylist(), templates, strict=True)], pa.string())

    host, place, template = (free_name([*pages.columns, into], x) for x in ("host", "place", "template"))
    found = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    hosted = pages.withColumn(host, found)
    known = cut(wrappers(hosted.select(F.col(host).alias("host"), F.col(f"`{page}`").alias("html"))).select(F.col("host").alias(host), F.col("place").alias(place), F.col("template").alias(template)))
    joined = _joined(hosted, known, host, F.octet_length(host) + F.octet_length(place) + 8 * F.coalesce(F.size(template), F.lit(0)) + 64)
    return joined.withColumn(into, text(F.col(f"`{page}`"), F.col(place), F.col(template))).select(*[F.col(f"`{c}`") for c in pages.columns], into)


def op8_main_text(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
