"""Main text of web pages by template deduction from equivalence classes.

A page is a sequence of tokens: the tags of its block elements, each known by the path of elements around
it, and its runs of text. Tokens of one host that occur equally often on each of its pages share an
occurrence vector and form an equivalence class. A class of several tokens that is on most of a host's pages
is valid if its tokens come in the same order on every page and if it nests: between its first and last token
no other class begins without ending, and it always lies in the same gap of the same class. The valid classes
of a host are its template; what stands between two consecutive tokens of a class is a slot.

The article is read off the slots. Of each slot it is known, over all pages of the host, how much text it
holds, how much of that is template itself and how much stands in links, and which template elements are
around it. The innermost template element around the slot with most text is the main element; it grows to the
element around it (short of the body) while what that adds is not links, or few of them. Other elements outside it with nearly
as much text that is not links belong to the article too; elements inside it that hold mostly links do not,
nor, where the body itself is the main element, do small ones. Blocks of the main elements are the result,
but for those whose whole text is template. Names only check: an element that calls itself a menu, header, footer, sidebar,
notice, advert, form or comments, by its own tag or class, is no main slot and is left out of one.

Occurrence vectors are compared by a 64-bit sum of hashes of (page, count), which Spark adds up on the map
side, so that a host of any size costs a row for each token and task. Evidence for or against a class and the
slots' sums are added up the same way. Pages with the same content count as one.

Defined results: a null or empty page has an empty text. Where over half of the text in a page's main elements
is template, the page is one of many that carry the same article, and all of it is kept. Pages of hosts with
fewer than `MIN_PAGES` distinct pages, pages that lack their host's main element and pages whose main element
is empty are judged by names alone. Formulas, objects and canvases are read as inline text. Elements may be
nested to any depth. Repeated rows are judged alike. A null URL belongs to the host of all pages without one.
An empty table gives an empty result. Other columns are kept under their names, whatever these are, but for
one named like the result, which is replaced.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frees, saved
from .url_filters import url_host

#: A class is template if it is on this share of a host's distinct pages, and on so many at least.
MIN_SHARE = 0.6
MIN_PAGES = 5
#: Tokens that a class must have.
MIN_TOKENS = 2
#: An element of which so much is links is a menu; what an element adds must have fewer to belong to the article.
MENU_LINKS = 0.5
MOST_LINKS = 0.3
#: Links that an element may add in any case, such as an article's tags: this share of the text it adds to.
FEW_LINKS = 0.05
#: Share of the main element's text that another element must have to belong to the article.
NEARLY_AS_MUCH = 0.25
#: Share of a host's text that must not be template, or else its pages are copies and template counts as text.
LEAST_VARIED = 0.2
#: The templates of all hosts are broadcast while they have at most so many tokens.
BROADCAST_TOKENS = 200_000
#: Hosts whose templates a task keeps at hand.
HOSTS_AT_HAND = 256

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea select svg iframe title".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr canvas object "
    "math maction annotation annotation-xml menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts "
    "mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
_DROPPED = frozenset("nav footer aside form script style noscript template textarea select button svg iframe head dialog menu".split())
_CLOSES = {
    "p": frozenset({"p"}),
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}),
    "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
_P_ENDS = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
_SCOPES = frozenset("ul ol table div article main section body td th aside nav footer header form".split())
#: Parts of an element's class, id or role that say what it is for, and those that undo what follows them.
_PURPOSES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead banner footer sidebar side aside rail notice notices "
    "cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup promo ad ads "
    "advert adverts advertisement advertising sponsor sponsored comment comments commentlist reply replies disqus "
    "responses respond related recommended share sharing social toolbar pagination pager search login form widget "
    "complementary contentinfo dialog skip hidden".split()
)
_HEADERS = frozenset({"header", "topbar"})
_COMMENTS = frozenset({"comment", "comments", "commentlist", "reply", "replies"})
_UNDONE = frozenset("has no with without is not".split())
_OF_ARTICLE = frozenset("article post entry story".split())
_HEAD = frozenset("title meta link script style base noscript template".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SIGN = 1 << 63


@functools.lru_cache(maxsize=4096)
def _signature(name: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """How a start tag is known in paths, and whether its attributes give it a purpose besides the article."""
    if not attributes.strip():
        return name, False
    found = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    purpose = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    purpose |= bool(re.search(r"display\s*:\s*none", found.get("style", "")))
    for label in " ".join(found.get(k, "") for k in ("class", "id", "role")).split():
        parts = {x.lower() for x in _PART.findall(label)}
        if parts & _UNDONE:
            continue
        purpose |= bool(parts & (_COMMENTS if name == "article" else _PURPOSES))
        purpose |= bool(parts & _HEADERS) and not in_article and not parts & _OF_ARTICLE
    return f"{name}.{found.get('class', '')}#{found.get('id', '')}", purpose


@functools.lru_cache(maxsize=16384)
def _below(path: int, label: str) -> int:
    """The path of an element below another, as a number: a page may nest to any depth."""
    return xxhash.xxh64_intdigest(f"{path}/{label}".encode("utf-8", "replace"))


def _key(path: int, kind: str) -> int:
    """The token of an element's start ("o") or end ("c"), or of a text (kind "t" and the text)."""
    return xxhash.xxh64_intdigest(kind.encode("utf-8", "replace"), path) - _SIGN


class _Element:
    """An open element: what holds for the text in it."""

    __slots__ = ("name", "path", "block", "dropped", "article", "link", "marks")

    def __init__(self, name: str, path: int, block: int, dropped: bool, article: bool, link: bool, marks: object):
        self.name, self.path, self.block, self.dropped, self.article, self.link, self.marks = name, path, block, dropped, article, link, marks


def page_tokens(
    html: str | None, enter: Callable[[int, str, object], object] | None = None, marks: object = None
) -> Iterator[tuple[str, str, int, _Element]]:
    """Tokens of a page: (kind, name or text, path, element around it). Kinds: open, close, inline, text.

    `enter` gets the path and name of a block element and the marks of the one around it, and gives its marks
    (`marks` outside all elements); marks that are True make it part of the article. Unclosed elements end where HTML says, or with
    the element that holds them.
    """
    html = html or ""
    root = _Element("", 0, 0, False, False, False, marks)
    stack: list[_Element] = [root]
    opened: dict[str, int] = defaultdict(int)
    at, n = 0, len(html)

    def cut(depth: int) -> None:
        for element in stack[depth:]:
            opened[element.name] -= 1
        del stack[depth:]

    def end_of(names: frozenset[str]) -> None:
        if any(opened[x] for x in names):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in names:
                    return cut(i)
                if stack[i].name in _SCOPES:
                    return None
        return None

    while at < n:
        found = _TOKEN.search(html, at)
        start = found.start() if found else n
        if start > at:
            yield "text", html[at:start], stack[-1].path, stack[-1]
        if not found:
            break
        at = found.end()
        if html.startswith("<![CDATA[", start):
            yield "text", found[0][9:].removesuffix("]]>"), stack[-1].path, stack[-1]
        name = found[2]
        if not name:
            continue
        name = name.lower()
        if found[1]:
            if opened[name]:
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                blocks = any(x.name not in _INLINE for x in stack[depth:])
                path = stack[depth].path
                cut(depth)
                yield "close" if blocks else "inline", name, path, stack[-1]
            continue
        if opened["p"] and name in _P_ENDS:
            end_of(_CLOSES["p"])
        if name in _CLOSES and name != "p":
            end_of(_CLOSES[name])
        if stack[-1].name == "head" and name not in _HEAD:
            cut(len(stack) - 1)
        around = stack[-1]
        attributes = found[3]
        label, purpose = _signature(name, attributes, around.article or around.marks is True) if attributes else (name, False)
        # Inline elements and paragraphs that a malformed page leaves open don't lengthen the path.
        path, inline = _below(around.block, label), name in _INLINE
        yield "inline" if inline else "open", name, path, around
        if name in _VOID or found[3] and found[3].rstrip().endswith("/") and name not in _RAW:
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        dropped = name in _DROPPED or purpose and name not in ("html", "body", "main")
        dropped |= name == "header" and not around.article and around.marks is not True
        now = around.marks if inline or enter is None else enter(path, name, around.marks)
        opened[name] += 1
        stack.append(
            _Element(
                name, path, around.block if inline else path, dropped or around.dropped,
                around.article or name in ("article", "main"), around.link or name == "a", now,
            )
        )


def _clean(text: str) -> str:
    """White space of any kind (as `str.isspace` has it) as one blank, none at the ends."""
    return " ".join(text.split())


def _template_tokens(html: str | None, enter: Callable | None = None, marks: object = None) -> Iterator[tuple[int, str, str, _Element]]:
    """(token, kind, name or cleaned text, element around it) of what can be template: block tags and texts."""
    for kind, name, path, around in page_tokens(html, enter, marks):
        if kind == "text":
            if name := _clean(name):
                yield _key(path, "t" + name), kind, name, around
        elif kind != "inline":
            yield _key(path, kind[0]), kind, name, around


def token_counts(html: str | None) -> dict[int, int]:
    """How often each token is on a page."""
    counts: dict[int, int] = {}
    for token, *_ in _template_tokens(html):
        counts[token] = counts.get(token, 0) + 1
    return counts


def _occurrences(pages: DataFrame) -> DataFrame:
    """A row for each distinct token of each page: host, page hash, token, count."""

    @frees
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, content, keys, counts = [], [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                html = html.as_py()
                if not html:
                    continue
                page = xxhash.xxh64_intdigest(html.encode("utf-8", "replace")) - _SIGN
                found = token_counts(html)
                hosts += [host] * (len(found) + 1)
                content += [page] * (len(found) + 1)
                keys += [0, *found]  # the token 0 stands for the page itself
                counts += [1, *found.values()]
            yield pa.RecordBatch.from_pydict(
                {"host": hosts, "page": pa.array(content, pa.int64()), "token": pa.array(keys, pa.int64()), "n": pa.array(counts, pa.int64())}
            )

    return pages.mapInArrow(tokens, "host string, page long, token long, n long")


def _candidate_classes(pages: DataFrame) -> DataFrame:
    """Tokens of classes that are large and frequent enough: host, token, class, support, once (never twice on a page)."""
    distinct = _occurrences(pages).groupBy("host", "page", "token").agg(F.max("n").alias("n"))
    # The sum of hashes of (page, count) stands for the occurrence vector; decimals do not overflow.
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(38,0)"))
    tokens = distinct.groupBy("host", "token").agg(vector.alias("vector"), F.count(F.lit(1)).alias("support"), (F.max("n") == 1).alias("once"))
    tokens = saved(tokens.where(F.col("support") >= MIN_PAGES), "html-tokens")
    hosts = tokens.where("token = 0").select(F.col("host").alias("h"), F.col("support").alias("n_pages"))
    frequent = tokens.where("token <> 0").join(hosts, F.col("host") == F.col("h"))
    frequent = frequent.where(F.col("support") >= F.col("n_pages") * MIN_SHARE).withColumn("class", F.xxhash64("vector", "support"))
    large = F.count(F.lit(1)).over(Window.partitionBy("host", "class"))
    return frequent.withColumn("size", large).where(F.col("size") >= MIN_TOKENS).select("host", "token", "class", "support", "once", "size")


class _Nesting:
    """What one page says about the candidate classes of its host: their order, where they nest, their slots.

    `classes` has (class, class size, once) by token, `rank` the order in which crossing classes give way.
    """

    def __init__(self, classes: dict[int, tuple[int, int, bool]], rank: dict[int, tuple]):
        self.classes, self.rank = classes, rank
        self.order: dict[int, tuple] = {}
        self.parent: dict[int, tuple] = {}
        self.bad: set[int] = set()
        self.slots: dict[tuple, list[int]] = {}

    def enter(self, path: int, name: str, around: tuple) -> tuple:
        token = _key(path, "o")
        known = self.classes.get(token)
        return (*around, (token, known[0], name in ("body", "html"))) if known and known[2] else around

    def read(self, html: str) -> None:
        seen: dict[int, list[int]] = defaultdict(list)  # tokens of each open class since it began
        stack: list[int] = []
        for token, kind, text, around in _template_tokens(html, self.enter, ()):
            known = self.classes.get(token)
            if known:
                own, size, _ = known
                if own not in stack:
                    place = (stack[-1], len(seen[stack[-1]])) if stack else (0, 0)
                    if self.parent.setdefault(own, place) != place:
                        self.bad.add(own)
                    stack.append(own)
                while stack[-1] != own:  # classes that began inside and haven't ended, or hold what isn't theirs
                    crossing = stack[-1] if self.rank[stack[-1]] < self.rank[own] else own
                    self.bad.add(crossing)
                    if crossing == own:
                        break
                    seen.pop(stack.pop(), None)
                seen[own].append(token)
                if len(seen[own]) >= size:
                    order = tuple(seen.pop(own))
                    stack.remove(own)
                    if self.order.setdefault(own, order) != order or len(set(order)) < size:
                        self.bad.add(own)
            if kind == "text" and not around.dropped:
                chain = tuple((c, len(seen[c])) for c in stack)
                sums = self.slots.setdefault((chain, around.marks), [0, 0, 0])
                sums[0] += len(text)
                sums[1] += len(text) * bool(known)
                sums[2] += len(text) * around.link
        self.bad.update(stack)  # never ended


class _AtHand:
    """The last hosts' templates, made from their rows once."""

    def __init__(self, make: Callable):
        self.make, self.kept = make, {}

    def of(self, host: str, rows: pa.Scalar) -> object:
        if host not in self.kept:
            if len(self.kept) >= HOSTS_AT_HAND:
                self.kept.pop(next(iter(self.kept)))
            self.kept[host] = self.make(rows.as_py()) if rows.is_valid else None
        return self.kept[host]


_EVIDENCE = "host string, class long, order_lo long, order_hi long, parent_lo long, parent_hi long, bad boolean, slots array<struct<class:long,gap:int>>, elements array<struct<token:long,class:long,top:boolean>>, chars long, fixed long, links long"
_SLOT_ARROW = pa.list_(pa.struct([("class", pa.int64()), ("gap", pa.int32())]))
_ELEMENT_ARROW = pa.list_(pa.struct([("token", pa.int64()), ("class", pa.int64()), ("top", pa.bool_())]))
_EVIDENCE_ARROW = pa.schema(
    [("host", pa.string())]
    + [(x, pa.int64()) for x in ("class", "order_lo", "order_hi", "parent_lo", "parent_hi")]
    + [("bad", pa.bool_()), ("slots", _SLOT_ARROW), ("elements", _ELEMENT_ARROW)]
    + [(x, pa.int64()) for x in ("chars", "fixed", "links")]
)


def _hash(x: tuple) -> int:
    return xxhash.xxh64_intdigest(repr(x).encode()) - _SIGN


def _evidence(rows: DataFrame) -> DataFrame:
    """For each host, what its pages say of the candidate classes and of their slots, added up in each batch.

    `rows`: host, html, classes (array of token, class, size, once, support).
    """

    def make(rows: list[dict]) -> tuple[dict, dict]:
        classes = {r["token"]: (r["class"], r["size"], r["once"]) for r in rows}
        return classes, {r["class"]: (r["support"], r["size"], r["class"]) for r in rows}

    @frees
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_hand = _AtHand(make)
        for batch in batches:
            classes: dict[tuple, list] = {}
            slots: dict[tuple, list[int]] = {}
            for host, html, known in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                template = at_hand.of(host, known)
                if template is None or not html.is_valid:
                    continue
                page = _Nesting(*template)
                page.read(html.as_py())
                for c, place in page.parent.items():
                    order, parent = _hash(page.order.get(c, ())), _hash(place)
                    now = classes.setdefault((host, c), [order, order, parent, parent, False])
                    now[:] = min(now[0], order), max(now[1], order), min(now[2], parent), max(now[3], parent), now[4] or c in page.bad
                for (chain, elements), sums in page.slots.items():
                    now = slots.setdefault((host, chain, elements), [0, 0, 0])
                    now[:] = now[0] + sums[0], now[1] + sums[1], now[2] + sums[2]
            out = [(h, c, *x, None, None, None, None, None) for (h, c), x in classes.items()]
            out += [
                (h, None, None, None, None, None, None, [{"class": c, "gap": g} for c, g in chain],
                 [{"token": t, "class": c, "top": top} for t, c, top in elements], *sums)
                for (h, chain, elements), sums in slots.items()
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_EVIDENCE_ARROW)], schema=_EVIDENCE_ARROW)

    return rows.mapInArrow(judge, _EVIDENCE)


def _with_templates(pages: DataFrame, templates: DataFrame, size: Column) -> DataFrame:
    """Pages (host, ...) with their host's row of `templates` (host, ...), broadcast while these are small."""
    templates = templates.withColumnRenamed("host", "__h")
    if (templates.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_TOKENS:
        templates = F.broadcast(templates)
    return pages.join(templates, F.col("host") == F.col("__h"), "left").drop("__h")


def _chosen_elements(slots: DataFrame) -> DataFrame:
    """Of each host its main elements and those that are none: host, main, other (start tokens).

    `slots`: host, elements (outermost first), chars, fixed (of them template), links; one row for each slot.
    """
    per_host = slots.groupBy("host").agg(F.sum("chars").alias("all_chars"), F.sum("fixed").alias("all_fixed"))
    slots = slots.join(per_host, "host")
    varied = F.col("all_chars") - F.col("all_fixed") >= F.col("all_chars") * LEAST_VARIED
    slots = slots.withColumn("weight", F.when(varied, F.col("chars") - F.col("fixed")).otherwise(F.col("chars"))).drop("all_chars", "all_fixed")
    prose = slots.where((F.col("links") < F.col("chars") * MENU_LINKS) & (F.col("weight") > 0) & (F.size("elements") > 0))
    richest = prose.groupBy("host").agg(F.max_by("elements", F.struct("weight", F.expr("reverse(transform(elements, x -> x.token))"))).alias("around"))
    # The text of every template element, with what stands in the elements inside it.
    totals = (
        slots.select("host", F.explode("elements").alias("e"), "weight", "chars", "links")
        .groupBy("host", F.col("e.token").alias("token"), F.col("e.top").alias("top"))
        .agg(F.sum("weight").alias("weight"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    )
    path = richest.select("host", F.posexplode("around").alias("depth", "e")).select("host", "depth", F.col("e.token").alias("token"))
    path = path.join(totals, ["host", "token"])
    inner = Window.partitionBy("host").orderBy(F.desc("depth"))
    added = path.withColumns({"more": F.col("chars") - F.lag("chars", 1, 0).over(inner), "more_links": F.col("links") - F.lag("links", 1, 0).over(inner), "first": F.row_number().over(inner) == 1})
    few = F.greatest(F.col("more") * MOST_LINKS, (F.col("chars") - F.col("more")) * FEW_LINKS)
    grows = F.col("first") | ~F.col("top") & (F.col("more_links") <= few)
    taken = added.withColumn("taken", F.min(grows).over(inner)).where("taken")
    main = taken.groupBy("host").agg(F.min_by(F.struct("token", "weight", "top"), "depth").alias("m"))
    around = path.groupBy("host").agg(F.collect_set("token").alias("path"))
    judged = totals.join(main, "host").join(around, "host")
    enough = F.col("weight") >= F.col("m.weight") * NEARLY_AS_MUCH
    is_main = F.col("token") == F.col("m.token")
    is_main |= ~F.array_contains("path", F.col("token")) & ~F.col("top") & enough & (F.col("links") < F.col("chars") * MOST_LINKS)
    menu = (F.col("links") >= F.col("chars") * MENU_LINKS) | F.col("m.top") & ~enough
    is_other = ~is_main & ~F.array_contains("path", F.col("token")) & (F.col("chars") > 0) & menu
    return judged.groupBy("host").agg(
        F.collect_list(F.when(is_main, F.col("token"))).alias("main"), F.collect_list(F.when(is_other, F.col("token"))).alias("other")
    )


def host_templates(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """The template of each host: host, tokens of its valid classes, main and other elements' start tokens."""
    rows = pages.select(url_host(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").alias("html"))
    # A token in a template is on most of a host's pages, so a template is about as long as a page at most.
    candidates = saved(_candidate_classes(rows).groupBy("host").agg(F.collect_list(F.struct("token", "class", "size", "once", "support")).alias("classes")), "html-classes")
    evidence = saved(_evidence(_with_templates(rows, candidates, F.size("classes"))), "html-evidence")
    seen = evidence.where("class IS NOT NULL").groupBy("host", "class").agg(
        F.min("order_lo").alias("a"), F.max("order_hi").alias("b"), F.min("parent_lo").alias("c"), F.max("parent_hi").alias("d"), F.max("bad").alias("bad")
    )
    valid = seen.where("a = b AND c = d AND NOT bad").groupBy("host").agg(F.collect_list("class").alias("valid"))
    tokens = candidates.join(valid, "host").select("host", F.expr("transform(filter(classes, x -> array_contains(valid, x.class)), x -> x.token)").alias("tokens"))
    slots = evidence.where("slots IS NOT NULL").join(valid, "host").select(
        "host", F.expr("filter(slots, x -> array_contains(valid, x.class))").alias("slots"),
        F.expr("filter(elements, x -> array_contains(valid, x.class))").alias("elements"), "chars", "fixed", "links",
    )
    slots = slots.groupBy("host", "slots", "elements").agg(*[F.sum(c).alias(c) for c in ("chars", "fixed", "links")])
    return tokens.join(_chosen_elements(saved(slots, "html-slots")), "host", "left")


class Template:
    """A host's template as extraction needs it."""

    def __init__(self, tokens: list[int], main: list[int], other: list[int]):
        self.tokens, self.main, self.other = frozenset(tokens), frozenset(main), frozenset(other)

    def enter(self, path: int, name: str, around: bool | None) -> bool:
        token = _key(path, "o")
        return token in self.main or (bool(around) and token not in self.other)


def main_text(html: str | None, template: Template | None = None) -> str:
    """The article's blocks, decoded, joined by blank lines: by the host's template, else by names."""
    if template is not None and template.main:
        if found := _blocks(html, template):
            return "\n\n".join(found)
    return "\n\n".join(_blocks(html, None))


def _blocks(html: str | None, template: Template | None) -> list[str]:
    """Blocks of the main elements that are not template, or of all elements that names don't tell from the article."""
    runs: list[list[tuple[str, bool]]] = [[]]
    inside = None
    fixed = varied = 0
    for kind, name, path, around in page_tokens(html, template.enter if template else None, False if template else None):
        if kind == "text":
            if around.dropped or template and not around.marks:
                continue
            if not template and around.article != inside:
                runs.append([])
                inside = around.article
            known = False
            if template and (text := _clean(name)):
                known = _key(path, "t" + text) in template.tokens
                fixed += len(text) * known
                varied += len(text) * (not known)
            runs[-1].append((name, known))
        elif kind == "inline":
            if name == "br":
                runs[-1].append((" ", False))
        elif runs[-1]:
            runs.append([])
    if fixed <= varied:
        runs = [run for run in runs if not all(known for text, known in run if text.strip())]
    blocks = (_clean(entities.unescape("".join(text for text, _ in run))) for run in runs)
    return [b for b in blocks if b]


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Add the main text to each page; an input column of that name is replaced."""
    templates = saved(host_templates(pages, url_col, html_col), "html-templates")
    kept = [F.col(f"`{c}`") for c in pages.columns if c != out_col]
    rows = pages.select(F.struct(*kept).alias("__page"), F.col(f"`{html_col}`").alias("html"), url_host(F.col(f"`{url_col}`")).alias("host"))
    joined = _with_templates(rows, templates.select("host", F.struct("tokens", "main", "other").alias("template")), F.size("template.tokens"))

    @F.arrow_udf("string")
    @frees
    def text_of(htmls: pa.Array, hosts: pa.Array, templates: pa.Array) -> pa.Array:
        at_hand = _AtHand(lambda x: Template(x["tokens"] or (), x["main"] or (), x["other"] or ()))
        return pa.array([main_text(html.as_py(), at_hand.of(host, x)) for html, host, x in zip(htmls, hosts.to_pylist(), templates, strict=True)], pa.string())

    return joined.select(*[F.col(f"__page.`{c}`") for c in pages.columns if c != out_col], text_of("html", "host", "template").alias(out_col))


def text_length(text: Column) -> Column:
    """Code points of a text; 0 for null."""
    return F.coalesce(F.length(text), F.lit(0)).cast("long")
