"""Operator 10: main text of web pages by a site style tree.

The element trees of one host's pages are merged: a node of the merged tree is
a path of tags with their class and id. Its importance is the mean, over its
texts, of 1 - log(pages with that text) / log(pages with that node): near 0
where all pages say the same, near 1 where each says something else. Nodes
of low importance lose their own texts on each page of the host, never those of
nodes below them, unless they are the
host's main body of text or plain content: headings, paragraphs and lists
without a class or id below the article, which copies of an article share.
Outside of articles nodes with and without a class are judged alike, and a node
that stays loses the single texts of low importance.
Copies of one page count once; for headings, paragraphs and lists in an
article, so do all pages with the article's first heading. Elements whose tag,
role, class or id names a menu, header, footer, sidebar, notice, advert, form
or reader comments are removed with all that they hold, but a branch with more
than half of a page's text is never removed for its class or id. Where article
and main elements hold at least half of the text that is left, it is taken from
them. Digits in classes and ids count as one sign, so that numbered posts are
one node of the tree.

Defined results: null html counts as empty and gives an empty text; a null url
belongs to the empty host; unclosed and stray tags, comments and scripts are
read as browsers do in the common cases; very long or broken pages take time in
proportion to their length; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigree.llm.frames import map_batches, materialise, table

#: Importance below which a branch goes, and the distinct pages that must show it.
LOW, PAGES = 0.2, 8
#: Removed branches are broadcast up to this many rows (a few MB), and joined beyond.
BROADCAST_ROWS = 50_000

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile("[>\"']")
#: Elements whose content is no markup, with the tags that end them.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title")}
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_READ = frozenset("class id role hidden style".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_SHORT = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_NOISE_TAGS = frozenset("nav footer aside form button select dialog menu".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NOISE_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer foot masthead topbar banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist reply replies respond disqus related recommended pagination pager toolbar search widget skip".split()
)
#: Parts of a class or id that say what sort of box it is; the word before them counts.
_BOX_WORDS = frozenset("area bar block body box bottom button buttons container content form icons inner item items left link links list panel right section thread top wrap wrapper".split())
#: Parts that turn a word around: a box beside a sidebar, without one, or a heading of it.
_TURNS = frozenset("no not with without has have hide is of beside main".split())
_MAIN = ("article", "main")
#: Within an article, the copies of one article (the same first heading) count as one page for these.
_PLAIN = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre figcaption td th".split())
_HEADING = re.compile(r"(?:^|/)h[1-6](?:[.#][^/]*)?$")


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _noise_name(value: str) -> bool:
    """One of the names is a noise word, or a compound that ends in one, boxes aside: site-nav, comment-list, but not no-sidebar or search-engine-history."""
    for name in value.lower().split():
        parts = [x for x in re.split("[-_]+", name) if x]
        while len(parts) > 1 and (parts[-1] in _BOX_WORDS or parts[-1].isdigit()):
            parts.pop()
        two = "".join(parts[-2:])
        if parts and _TURNS.isdisjoint(parts) and (parts[-1] in _NOISE_WORDS or two in ("sidebar", "topbar", "signup", "siteheader", "pageheader")):
            return True
    return False


def _noise(tag: str, attrs: str, inside_main: bool) -> tuple[int, str]:
    """(2 where the element is no part of the main text, 1 where only its class or id says so; its name in the style tree)."""
    hard = tag in _NOISE_TAGS or (tag == "header" and not inside_main)
    if not attrs.strip():
        return 2 * hard, tag
    name, soft = tag, False
    seen: set[str] = set()
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        if key not in _READ or key in seen:
            continue
        seen.add(key)
        value = next((x for x in m.groups()[1:] if x is not None), "")
        if key == "role":
            hard |= value.strip().lower() in _NOISE_ROLES
        elif key == "hidden":
            hard = True
        elif key == "style":
            hard |= "display:none" in value.replace(" ", "").lower()
        else:
            soft |= tag not in ("html", "body", *_MAIN) and _noise_name(value)
            hard |= tag == "article" and bool(re.search(r"comment|reply|advert", value, re.I))
            # Numbers of posts and the like do not make nodes of their own.
            name += ("." if key == "class" else "#") + ".".join(re.sub(r"\d+", "0", value).split())
    return 2 if hard else int(soft), name if len(name) <= 120 else f"{tag}.~{zlib.crc32(name.encode()):08x}{len(name)}"


def _tags(page: str):
    """(start, end, closing, tag, attributes) of markup; tag is None for comments and the like. Time grows with the page, broken or not."""
    at, size = 0, len(page)
    unclosed: set[str] = set()
    while (lt := page.find("<", at)) >= 0:
        mark = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            yield lt, at, False, None, ""
            continue
        if mark in ("!", "?"):
            end = page.find(">", lt)
            if end < 0:
                return
            at = end + 1
            yield lt, at, False, None, ""
            continue
        name = _NAME.match(page, lt + 1 + (mark == "/"))
        if not name:
            at = lt + 1
            continue
        pos = begin = name.end()
        while True:
            stop = _STOP.search(page, pos)
            if stop is None:
                return  # no tag ends beyond this place
            k = stop.start()
            if page[k] == ">":
                break
            close = -1
            if page[k] not in unclosed and page[pos:k].rstrip().endswith("="):
                close = page.find(page[k], k + 1)
                if close < 0:
                    unclosed.add(page[k])
            pos = max(k, close) + 1
        at, tag = k + 1, name[0].lower()
        if mark != "/" and tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else size
            yield lt, at, False, None, ""
            continue
        yield lt, at, mark == "/", tag, page[begin:k]


def blocks(page: str | None) -> list[tuple[str, bool, str]]:
    """(path in the style tree, inside an article or main element, text) of the blocks, noise left out.

    A branch that only its class or id calls noise stays if it holds more than
    half of the text.
    """
    page = page or ""
    stack: list[tuple[str, str, int, bool]] = []  # tag, path, noise, inside
    opened: Counter[str] = Counter()
    soft: list[int] = []  # branches called noise by name that are open
    branches = 0
    out: list[tuple[str, bool, str, tuple[int, ...]]] = []
    held: list[str] = []
    noisy = 0
    where: tuple[str, bool, tuple[int, ...]] | None = None

    def flush():
        nonlocal where
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text and where is not None:
                out.append((where[0], where[1], text, where[2]))
            held.clear()
        where = None

    def pop():
        nonlocal noisy
        tag, _, noise, _ = stack.pop()
        opened[tag] -= 1
        noisy -= noise == 2
        if noise == 1:
            soft.pop()

    def say(a: int, b: int):
        nonlocal where
        if a < b and not noisy:
            if where is None:
                where = (stack[-1][1], stack[-1][3], tuple(soft)) if stack else ("", False, ())
            held.append(page[a:b])

    at = 0
    for start, end, closing, tag, attrs in _tags(page):
        say(at, start)
        at = end
        if tag is None:
            continue
        if closing:
            if tag == "br" or tag in _VOID:
                held.append(" ") if held else None
                continue
            if tag not in _INLINE:
                flush()
            if opened[tag] > 0:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif held:
                held.append(" " if tag == "br" else "")
            continue
        if tag not in _INLINE:
            flush()
            if tag in _CLOSES_P or tag in _SHORT:
                ends = _SHORT.get(tag, {"p"})
                k = len(stack) - 1
                if any(opened[t] > 0 for t in ends):
                    while k >= 0 and (stack[k][0] in _INLINE or stack[k][0] in ends):
                        k -= 1
                    if any(t in ends for t, *_ in stack[k + 1 :]):
                        while len(stack) > k + 1:
                            pop()
        path, inside = (stack[-1][1], stack[-1][3]) if stack else ("", False)
        noise, name = _noise(tag, attrs, inside)
        if attrs.rstrip().endswith("/") and tag in _INLINE:
            continue
        inside |= tag in _MAIN
        if tag not in _INLINE:
            path = f"{path}/{name}" if path else name
            if len(path) > 600:  # so that paths of deep trees stay short; the digest stands for the nodes above
                path = f"{'article/' if inside else ''}~{hashlib.md5(path.encode()).hexdigest()}"
        noise = 0 if noise == 1 and len(soft) >= 16 else noise
        stack.append((tag, path, noise, inside))
        opened[tag] += 1
        noisy += noise == 2
        if noise == 1:
            branches += 1
            soft.append(branches)
    say(at, len(page))
    flush()
    below = Counter()
    for *_, text, named in out:
        for branch in named:
            below[branch] += len(text)
    total = sum(len(text) for *_, text, _ in out)
    return [(p, inside, text) for p, inside, text, named in out if all(2 * below[b] > total for b in named)]


def main_blocks(page: str | None) -> list[tuple[str, bool, str]]:
    """The blocks of the page's article or main elements, where they hold at least as much text as the rest."""
    found = blocks(page)
    inside = sum(len(t) for _, i, t in found if i)
    return [b for b in found if b[1]] if inside and 2 * inside >= sum(len(t) for *_, t in found) else found


def extract(page: str | None, removed: frozenset[str] = frozenset()) -> str:
    """Main text of one page, without the removed branches of its host's style tree."""
    found = main_blocks(page)
    return "\n\n".join(t for p, _, t in found if not removed or (p not in removed and _text_key(p, _hash(t)) not in removed))


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) << 20 | len(text) & 0xFFFFF


def _text_key(path: str, content: int) -> str:
    """A removed text of a node that keeps its others; no path has a line end."""
    return f"{path}\n{content}"


def _plain(path: str) -> bool:
    return re.split(r"[.#]", path.rsplit("/", 1)[-1], maxsplit=1)[0] in _PLAIN


def style_tree(pages: DataFrame, low: float = LOW, least_pages: int = PAGES) -> DataFrame:
    """(host, path, pages, chars, importance, common) of the merged trees' text nodes; see ``_PLAIN`` for ``pages``.

    ``common`` has the texts whose own importance is low, at most about
    pages ** low times the node's blocks a page.
    """

    def run(batch: pa.RecordBatch):
        rows = []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            which, host, found = _hash(page or ""), host_of(url), main_blocks(page)
            title = next((_hash(t) for p, inside, t in found if inside and _HEADING.search(p)), which)
            rows += {(host, p, _hash(t), title if inside and _plain(p) else which, which, len(t)) for p, inside, t in found}
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "path", "content", "page", "copy", "chars"])

    seen = map_batches(pages.select("url", "html"), run, "host string, path string, content long, page long, copy long, chars long").distinct()
    seen = materialise(seen.groupBy("host", "path", "content", "page").agg(F.sum("chars").alias("chars")), "style-nodes")
    texts = seen.groupBy("host", "path", "content").agg(F.count("*").alias("c"), F.sum("chars").alias("chars"))
    # pages with the node: at least those of its most frequent text, at most the sum over texts; counted apart.
    nodes = seen.select("host", "path", "page").distinct().groupBy("host", "path").agg(F.count("*").alias("pages"))
    t = texts.join(nodes, ["host", "path"])
    imp = F.lit(1.0) - F.log(F.col("c").cast("double")) / F.greatest(F.log(F.col("pages").cast("double")), F.lit(1e-9))
    common = F.collect_list(F.when((F.col("pages") >= least_pages) & (imp < low), F.col("content")))
    return t.groupBy("host", "path").agg(F.first("pages").alias("pages"), F.sum("chars").alias("chars"), (F.sum(F.col("c") * imp) / F.sum("c")).alias("importance"), common.alias("common"))


def _judged(pages: DataFrame, low: float, least_pages: int) -> DataFrame:
    """(host, path, noisy, common) of the nodes that lose all of their texts or some.

    In an article or main element, only nodes marked by a class or id; elsewhere
    all, and of those that stay also the single texts that the pages share.
    """
    inside = F.col("path").rlike(r"(?:^|/)(?:article|main)(?:[.#/]|$)")
    below = F.regexp_replace("path", r"^(?:.*/)?(?:article|main)(?:[.#][^/]*)?(?=/|$)", "")
    tree = style_tree(pages, low, least_pages).withColumn("most", F.max("chars").over(Window.partitionBy("host")))
    noisy = (F.col("pages") >= least_pages) & (F.col("importance") < low) & (F.col("chars") < F.col("most")) & (~inside | below.rlike("[.#]"))
    some = F.when(inside | noisy, F.array().cast("array<bigint>")).otherwise(F.col("common"))
    return tree.select("host", "path", noisy.alias("noisy"), some.alias("common")).where("noisy or size(common) > 0")


def removed_branches(pages: DataFrame, low: float = LOW, least_pages: int = PAGES) -> DataFrame:
    """(host, path) of the nodes to remove: low importance, not the host's main body of text, nor plain content of an article."""
    return _judged(pages, low, least_pages).where("noisy").select("host", "path")


def main_text(pages: DataFrame, low: float = LOW, least_pages: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    pages = pages.select("page_id", "url", "html")
    texts = F.transform("common", lambda c: F.concat("path", F.lit("\n"), c.cast("string")))
    gone = materialise(_judged(pages, low, least_pages).select("host", F.explode(F.when(F.col("noisy"), F.array("path")).otherwise(texts)).alias("path")), "style-tree")
    by_host = gone.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("gone"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))
    side = F.broadcast(by_host) if gone.count() <= BROADCAST_ROWS else by_host
    joined = pages.withColumn("host", host).join(side, "host", "left").select("page_id", "url", "html", "gone")

    def run(batch: pa.RecordBatch):
        held: dict[tuple[str, ...], frozenset[str]] = {}
        texts = []
        for page, gone in zip(batch.column(2), batch.column(3), strict=True):
            key = tuple(gone.as_py() or ())
            texts.append(extract(page.as_py(), held.setdefault(key, frozenset(key))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(joined, run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
