"""Main text of web pages by a site style tree.

The pages of one host are merged into one tree of style paths (tags with their classes and ids from the root
down).  Two entropies over the host's pages say how much a node matters: of the texts that stand in it (a
text on c of the m pages that have the node repeats with log_m c; the mean over the node's distinct texts is
its content redundancy) and of the forms its elements take (the sequence of their children).  Both are
composed over the whole branch below a node: the texts of all its leaves, the forms of all its elements.  A
branch's redundancy is the product of the two, its importance what is left to 1; a uniform layout alone
condemns nothing.

The host's own distribution draws the line.  From the root down runs the chain of nodes that hold over half
of the host's information (letters weighed by how little their text repeats).  At the first level where a
branch beside the chain is over BESIDE_TIMES as redundant as the chain's own node, that node is the main
branch, and this multiple of its redundancy is the host's line: every branch outside the main one above the
line goes.  Inside it, or where no level shows such a contrast, only branches whose texts mostly repeat
(LOW_SHARE, less where few pages tell) go.  Headings go by the second test only.

What the tree leaves then meets the rules of HTML: elements that are no part of an article by their tag or
role go, as do hidden ones; where a page marks its article or main element, only that is kept.  Last, and
only for what neither has told, elements whose class or id names such a part go (adverts, comments).

Statistics are grouped sums of (node, value) pairs, so a host with a third of all pages is summed up before
it meets in one place; branches are composed by pointer doubling over the merged trees, in rounds that grow
with the logarithm of the depth.

Defined results: null and empty pages have the empty text; a page without a host only meets the rules, as
does a host all of whose texts are on all its pages; repeated rows are extracted each and count each; ties
of the chain cannot be (two nodes with over half are nested); unclosed and stray tags are closed where HTML
closes them, at the latest at the end of the page; text outside any tag is text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from math import ceil, log2
from types import MappingProxyType
from urllib.parse import urlsplit

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.shared import stored

#: A branch beside the main one goes at this multiple of its redundancy; one inside it where this share of its content repeats.
BESIDE_TIMES, LOW_SHARE = 2.0, 0.5
#: What a host's tree decides of a node: it is the main branch, goes anywhere, goes outside the main branch.
MAIN, LOW, BESIDE = 1, 2, 3
#: Decided nodes that go to every task; more are joined by host.
BROADCAST_KEYS = 500_000

# fixed values: elements by their part in a page
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "td", "th"}
NO_TEXT = {"script", "style", "head", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "svg", "canvas", "object", "embed", "audio", "video", "map"}
NO_ARTICLE = {"nav", "footer", "aside", "form", "menu", "button", "select", "input", "textarea", "fieldset", "dialog", "datalist", "header"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "submenu", "topbar", "toolbar", "breadcrumb", "breadcrumbs", "pagination", "pager", "header", "masthead", "footer", "sidebar", "aside", "widget", "widgets",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "signin", "register", "search", "paywall",
    "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "share", "sharing", "social", "related", "recommended", "recommendations", "skip", "copyright", "disclaimer", "legal",
}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>",
    re.S,
)
#: A tag with an odd quote ends at the next bracket.
_LOOSE = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)>(?P<cdata>(?!))?")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = " \t\n\r\f\v"


@dataclass(slots=True)
class Block:
    text: str
    key: int
    template: bool  # in a branch that the style tree removes
    no_article: bool
    in_article: bool


@dataclass(slots=True)
class _Element:
    tag: str
    key: int
    depth: int
    hidden: bool  # its text is no text at all
    template: bool
    main: bool
    no_article: bool
    in_article: bool
    children: list[str] = field(default_factory=list)


def _hash(*parts: str | int) -> int:
    h = xxhash.xxh64_intdigest("\x00".join(map(str, parts)))
    return h - (1 << 64) if h >> 63 else h


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def _named_away(a: dict[str, str]) -> bool:
    names = f"{a.get('class', '')} {a.get('id', '')}"
    return any(w.lower() in WORDS for w in _PARTS.findall(names))


def _is_hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def _signature(a: dict[str, str]) -> str:
    """An element's classes and id; digits in an id do not tell elements apart."""
    classes = "".join(sorted(f".{c}" for c in a.get("class", "").split()))
    return classes + (f"#{re.sub('[0-9]+', '0', a['id'])}" if a.get("id") else "")


@dataclass
class Page:
    """A page's blocks in order, its tree (element -> element around it, depth) and the forms of its elements."""

    blocks: list[Block] = field(default_factory=list)
    tree: dict[int, tuple[int, int]] = field(default_factory=dict)
    forms: list[tuple[int, int]] = field(default_factory=list)


class _Stack:
    """The open elements, with the places of each tag and of the elements that are not inline, so that nothing searches the stack."""

    def __init__(self, root: _Element):
        self.items, self.places, self.blocks = [root], defaultdict(list), [0]

    def push(self, e: _Element) -> None:
        self.places[e.tag].append(len(self.items))
        if e.tag not in INLINE:
            self.blocks.append(len(self.items))
        self.items.append(e)

    def pop(self) -> _Element:
        e = self.items.pop()
        self.places[e.tag].pop()
        if e.tag not in INLINE:
            self.blocks.pop()
        return e

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def parse(page: str | None, host: str = "", decided: Mapping[int, int] = MappingProxyType({}), rules: bool = True) -> Page:
    """The page under the decisions of its host's style tree; `rules` off leaves tags, roles and names out of account."""
    page = page or ""
    out, top = Page(), _hash("host", host)
    root = _Element("", top, 0, False, False, decided.get(top) == MAIN, False, False)
    open_, text = _Stack(root), []
    stack, blocks = open_.items, out.blocks
    at, size, last, lower = 0, len(page), page.rfind(">"), None
    unescape, keys = entities.unescape, {}
    out.tree[top] = (0, 0)

    def flush() -> None:
        got = " ".join("".join(text).split())
        text.clear()
        if got:
            e = stack[-1]
            blocks.append(Block(got, e.key, e.template, e.no_article, e.in_article))

    def close(to: int) -> None:
        while len(stack) > to:
            if stack[-1].tag not in INLINE:
                flush()
            e = open_.pop()
            if e.children:
                out.forms.append((e.key, _hash(*e.children)))

    while at < size:
        lt = page.find("<", at)
        m = (_TAG.match(page, lt) or _LOOSE.match(page, lt)) if 0 <= lt < last else None
        if m is None:
            # no tag here: the bracket is text, but an unfinished tag at the end of the page is none
            unfinished = lt >= 0 and lt > last and re.match(r"</?[a-zA-Z]", page[lt : lt + 3])
            stop = size if lt < 0 else lt if unfinished else lt + 1
            if not stack[-1].hidden:
                text.append(unescape(page[at:stop]))
            if lt < 0 or unfinished:
                break
            at = stop
            continue
        if lt > at and not stack[-1].hidden:
            text.append(unescape(page[at:lt]))
        at = m.end()
        if m["cdata"] is not None and not stack[-1].hidden:
            text.append(m["cdata"])
        if (name := m["name"]) is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                text.append(" ")
            k = open_.last(name)
            # an inline end tag does not close the blocks around it
            if k and (name not in INLINE or open_.blocks[-1] < k):
                close(k)
            if name in ("td", "th"):
                text.append(" ")
            continue
        if name in CLOSES_P and stack[open_.blocks[-1]].tag == "p":
            close(open_.blocks[-1])
        if name in SIBLINGS:
            same, border = SIBLINGS[name]
            k = open_.last(*same)
            if k > open_.last(*border):
                close(k)
        if name in ("td", "th"):
            text.append(" ")
        if name == "body" and (k := open_.last("head")):
            close(k)
        if name == "head" and open_.last("head", "body"):
            continue
        if name not in INLINE:
            flush()
        a = _attributes(m["attrs"]) if m["attrs"] else {}
        label = name + _signature(a) if a else name
        up = stack[-1]
        if name not in INLINE:
            shown = stack[open_.blocks[-1]].children
            if not shown or shown[-1] != label:
                shown.append(label)
        if name in ("br", "wbr", "hr"):
            text.append("" if name == "wbr" else " ")
        if name in VOID or m["attrs"].endswith("/") and name in ("svg", "path", "g"):
            continue
        hidden = up.hidden or name in NO_TEXT or bool(a) and _is_hidden(a)
        role = a.get("role", "").lower() if a else ""
        article = rules and (name in ("article", "main") or role in ("article", "main"))
        inside = up.in_article or article and not up.no_article
        header = name == "header" and up.in_article
        away = rules and (up.no_article or name in NO_ARTICLE and not header or role in ROLES)
        if a and rules and not away and name not in ("html", "body") and not (article and not up.in_article):
            away = _named_away(a)
        if name in INLINE:
            e = _Element(name, up.key, up.depth, hidden, up.template, up.main, away, inside and not away)
        else:
            if (key := keys.get((up.key, label))) is None:
                key = keys[up.key, label] = _hash(up.key, label)
                out.tree[key] = (up.key, up.depth + 1)
            told = decided.get(key)
            e = _Element(name, key, up.depth + 1, hidden, up.template or told == LOW or told == BESIDE and not up.main and name not in HEADINGS, up.main or told == MAIN, away, inside and not away)
        open_.push(e)
        if name in RAW:
            lower = lower if lower is not None else page.lower() if len(page.lower()) == size else page
            end = lower.find(f"</{name}", at)
            at = size if end < 0 else end
    close(1)
    flush()
    if root.children:
        out.forms.append((top, _hash(*root.children)))
    return out


def main_text(page: Page) -> str:
    """The blocks that tree and rules leave, joined by blank lines: those of the article if the page marks one."""
    kept = [b for b in page.blocks if not b.template and not b.no_article]
    return "\n\n".join(b.text for b in [b for b in kept if b.in_article] or kept)


CONTENT, STYLE, HELD = 0, 1, 2
SEEN = T.StructType([T.StructField("host", T.LongType()), T.StructField("key", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("value", T.LongType()), T.StructField("size", T.LongType()), T.StructField("n", T.LongType())])


def observed(url: str | None, page: str | None) -> set[tuple[int, int, int, int, int]]:
    """What a page adds to its host's tree, each once: (host, node, kind, value, size) of texts with their letters, forms, and the node with its parent and depth."""
    if not (host := host_of(url)):
        return set()
    read, at = parse(page, host), _hash("host", host)
    out = {(at, b.key, CONTENT, _hash(b.text), len(b.text)) for b in read.blocks}
    out.update((at, k, STYLE, v, 0) for k, v in read.forms)
    out.update((at, k, HELD, up, depth) for k, (up, depth) in read.tree.items())
    return out


def site_nodes(pages: DataFrame) -> DataFrame:
    """The merged trees: (host, key, up, depth, pages) and each node's own texts, repeats, info, shapes and same.

    repeats sums log_m c over the node's distinct texts; info is their letters, each weighed by 1 - log_m c;
    same is 1 less the entropy of the forms of its elements, shapes 1 where it has any.
    """

    def see(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for url, page in zip(batch["url"], batch["html"], strict=True):
                found.update(observed(url, page))
            out = pd.DataFrame(list(found), columns=SEEN.names[:-1])
            out["n"] = list(found.values())
            yield out

    counted = pages.select("url", "html").mapInPandas(see, SEEN).groupBy("host", "key", "kind", "value").agg(F.sum("n").alias("c"), F.max("size").alias("size"))

    def over(kind: int, what: Column | str) -> Column:
        return F.when(F.col("kind") == kind, F.expr(what) if isinstance(what, str) else what)

    per = counted.groupBy("host", "key").agg(
        F.max(over(HELD, "value")).alias("up"),
        F.max(over(HELD, "size")).alias("depth"),
        F.sum(over(HELD, "c")).alias("pages"),
        F.coalesce(F.sum(over(CONTENT, "1")), F.lit(0)).alias("texts"),
        F.coalesce(F.sum(over(CONTENT, "log(c)")), F.lit(0.0)).alias("text_logs"),
        F.coalesce(F.sum(over(CONTENT, "size")), F.lit(0)).alias("letters"),
        F.coalesce(F.sum(over(CONTENT, "size * log(c)")), F.lit(0.0)).alias("letter_logs"),
        F.sum(over(STYLE, "c")).alias("shown"),
        F.sum(over(STYLE, "c * log(c)")).alias("form_logs"),
    )
    base = F.when(F.col("pages") > 1, F.log("pages"))
    spread = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log("shown") - F.col("form_logs") / F.col("shown")) / base))
    return per.select(
        "host", "key", "up", "depth", "pages", "texts",
        F.coalesce(F.col("text_logs") / base, F.lit(0.0)).alias("repeats"),
        (F.col("letters") - F.coalesce(F.col("letter_logs") / base, F.lit(0.0))).alias("info"),
        F.when(F.col("shown") > 0, 1).otherwise(0).alias("shapes"),
        F.when(F.col("shown") > 0, 1 - F.coalesce(spread, F.lit(1.0))).otherwise(0.0).alias("same"),
    )


SUMS = ("texts", "repeats", "info", "shapes", "same")


def branches(nodes: DataFrame) -> DataFrame:
    """nodes with their sums over the whole branch below, and the branch's redundancy.

    Pointer doubling: after k rounds a node's sums reach 2**k levels down and `jump` is its ancestor 2**k levels up.
    """
    now = stored(nodes.withColumn("jump", F.col("up")), "style-nodes")
    deepest = now.agg(F.max("depth")).first()[0] or 0
    for _ in range(ceil(log2(deepest + 1))):
        gained = now.filter("jump <> 0").groupBy("host", F.col("jump").alias("key")).agg(*[F.sum(c).alias(f"{c}_below") for c in SUMS])
        further = now.select("host", F.col("key").alias("jump"), F.col("jump").alias("further"))
        grown = now.join(gained, ["host", "key"], "left").join(further, ["host", "jump"], "left")
        sums = [(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in SUMS]
        now = stored(grown.select("host", "key", "up", "depth", "pages", *sums, F.coalesce("further", F.lit(0)).alias("jump")), "style-branches")
    layout = F.when(F.col("shapes") > 0, F.col("same") / F.col("shapes")).otherwise(1.0)
    return now.drop("jump").withColumn("redundancy", F.when(F.col("texts") > 0, F.col("repeats") / F.col("texts") * layout).otherwise(0.0))


def decisions(pages: DataFrame, times: float = BESIDE_TIMES, share: float = LOW_SHARE) -> DataFrame:
    """(host, key, told): the main branch of each host, and the branches of low importance."""
    tree = stored(branches(site_nodes(pages)), "style-tree")
    whole = tree.groupBy("host").agg(F.max("info").alias("whole"))
    tree = tree.join(whole, "host").withColumn("chain", (F.col("whole") > 0) & (2 * F.col("info") > F.col("whole")))
    chain = tree.filter("chain")
    around = chain.select("host", F.col("key").alias("up"), (F.col("depth") + 1).alias("depth"))
    inner = chain.select("host", "depth", F.col("key").alias("main"), F.col("redundancy").alias("own"))
    contrast = tree.filter("not chain and texts > 0").join(around, ["host", "up", "depth"]).join(inner, ["host", "depth"]).filter(F.col("redundancy") > times * F.col("own"))
    line = contrast.groupBy("host").agg(F.min_by(F.struct("main", (times * F.col("own")).alias("line")), "depth").alias("m")).select("host", "m.main", "m.line")
    sure = F.col("redundancy") * (F.col("pages") - 1) / (F.col("pages") + 1)
    told = F.when(F.col("key") == F.col("main"), MAIN).when(F.col("chain") | (F.col("whole") <= 0), None).when(sure >= share, LOW).when(F.col("redundancy") > F.col("line"), BESIDE)
    return tree.join(line, "host", "left").select("host", "key", told.alias("told")).filter("told is not null")


_TEXT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def _texts(rows: Iterator[tuple[str | None, str | None, Mapping[int, int]]], rules: bool) -> pd.DataFrame:
    texts = [main_text(parse(page, host_of(url), told, rules)) for url, page, told in rows]
    return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, rules: bool = True) -> DataFrame:
    """pages with `text` and `n_chars` (columns of these names are replaced); the html is dropped.  Without `rules` the tree alone decides."""
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("text", "n_chars", "html")]
    told = stored(decisions(pages), "style-decisions")
    few = told.select("key", "told").limit(BROADCAST_KEYS + 1).toPandas()
    if len(few) <= BROADCAST_KEYS:
        shared = spark.sparkContext.broadcast(dict(zip(few["key"].tolist(), few["told"].tolist(), strict=True)))

        @F.pandas_udf(_TEXT)
        def read(url: pd.Series, page: pd.Series) -> pd.DataFrame:
            return _texts(((u, p, shared.value) for u, p in zip(url, page, strict=True)), rules)

        return pages.withColumn("__t", read("url", "html")).select(*kept, "__t.text", "__t.n_chars")

    # too many for every task: each host's decisions meet its pages in a join, which adaptive execution may split for a large host
    @F.pandas_udf(T.LongType())
    def host(url: pd.Series) -> pd.Series:
        return url.map(lambda u: _hash("host", host_of(u)))

    @F.pandas_udf(_TEXT)
    def read_by_host(url: pd.Series, page: pd.Series, keys: pd.Series, says: pd.Series) -> pd.DataFrame:
        rows = zip(url, page, keys, says, strict=True)
        return _texts(((u, p, dict(zip(k, s, strict=True)) if k is not None else {}) for u, p, k, s in rows), rules)

    own = told.groupBy(F.col("host").alias("__host")).agg(F.collect_list(F.struct("key", "told")).alias("__own"))
    marked = pages.withColumn("__host", host("url")).join(own, "__host", "left")
    return marked.withColumn("__t", read_by_host("url", "html", "__own.key", "__own.told")).select(*kept, "__t.text", "__t.n_chars")
