"""HTML extraction with a site style tree.

The pages of a host are merged into one tree: its nodes are tag paths with their classes (the
presentation), each with the texts that pages show there (the content). A node's importance is the
entropy of its contents over the host's pages, as a share of the most it could be: what is the same
on every page tells nothing of a page. Branches below ``LOW`` that at least ``MIN_PAGES`` pages
have are removed from each page of the host. The tree is an aggregate of (host, path, digest of the
branch's text), a few short rows a page that combine before the shuffle, so that a host with a
third of all pages is no group in one task.

Nodes that say what they are (``nav``, ``footer``, a class ``ad``, a form ...) have no importance.
Text in ``article`` or, failing that, ``main`` is taken to be the page's text, and the tree corrects
that both ways. Inside, the blocks also are nodes by their place from the start and from the end,
and importance is the entropy of a node's contents as a share of that of the whole articles around
it, so that what articles share goes but copies of an article stay; where under ``LEAST`` of an
article would be left, it is a near copy of others and stays whole. Outside, text is added whose
node at least ``MIN_PAGES`` pages have, with an importance of ``HIGH`` or more.

Character references are decoded; white space ``[\\x20\\x09-\\x0D]`` inside a block becomes one
space; blocks are trimmed and joined by one space. Null or empty html gives an empty text, and a
null URL counts as the empty host. Repeated rows are each extracted; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm import blocks as B
from corvid.llm.shared import sized, written
from corvid.llm.url_filter import host

LOW, HIGH, LEAST, MIN_PAGES = 0.25, 0.75, 0.25, 4
_SPACE, _STRIP = re.compile(r"[\x20\x09-\x0D]+"), " \t\n\r\x0b\x0c"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol
optgroup option p pre section select summary table tbody td template textarea tfoot th thead title tr ul video""".split())
NOISE_TAGS = frozenset("""head title script style noscript template nav footer aside form button select textarea input iframe object svg
canvas audio video dialog menu""".split())
NOISE_WORDS = frozenset("""ad ads adbox adslot advert adverts advertisement advertising banner banners sponsor sponsored promo promos promotion menu
menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars masthead footer cookie cookies consent gdpr notice notices
notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations
comment comments discussion disqus reply replies responses widget widgets toolbar copyright legal pagination pager sidenav topbar
offcanvas search""".split())
ARTICLE_NOISE = frozenset("ad ads advert adverts advertisement sponsored promo comment comments reply related teaser".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}}
_ENDS_P = BLOCK - {"br", "button", "body", "html", "head", "title", "iframe", "object", "noscript", "template", "video", "select", "option", "textarea", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "col", "colgroup"}
_P, _P_STOPS = frozenset(["p"]), frozenset("table td th caption button object template".split())
_CELLS, _TABLE_ENDS = frozenset("table td th template".split()), frozenset("table tr td th tbody thead tfoot template body html article main".split())
_EMPTY = frozenset("svg path use circle rect line polygon g".split())
#: Their content is no markup, and no text of a page either.
_RAW = {t: re.compile(rf"</{t}(?:[\s/][^>]*)?>", re.I) for t in ("script", "style", "title", "textarea", "noembed", "noframes", "xmp")}
MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>|<[a-zA-Z/][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_ROOT: tuple[str, bool, int, tuple[int, ...]] = ("", False, 0, ())
_tags: dict[tuple[str, str], tuple[str, dict[str, str], int, bool]] = {}
_paths: dict[tuple[int, str], int] = {}


def path_id(parent: int, label: str) -> int:
    key = (parent, label)
    if key not in _paths:
        if len(_paths) > 200_000:
            _paths.clear()
        _paths[key] = int.from_bytes(blake2b(f"{parent}/{label}".encode(), digest_size=8).digest(), "big", signed=True)
    return _paths[key]


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())


def noisy(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not in_article) or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    if tag in ("html", "body", "main"):
        return False
    if not attrs:
        return False
    says = {*_words(attrs.get("class", "")), *_words(attrs.get("id", "")), *_words(attrs.get("role", ""))}
    if tag == "article":
        return bool(says & ARTICLE_NOISE)
    return bool(says & NOISE_WORDS) or ("header" in says and not in_article) or "contentinfo" in says or "complementary" in says


def _tag(tag: str, raw: str) -> tuple[str, dict[str, str], int, bool]:
    """(label, attributes, zone, self-closing) of a start tag, from its name and the rest."""
    key = (tag, raw)
    if (got := _tags.get(key)) is None:
        attrs: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(raw):
            attrs.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        label = ".".join([tag, *sorted(set(attrs.get("class", "").split()))[:3]])
        zone = 2 if tag == "article" else 1 if tag == "main" or attrs.get("role") == "main" else 0
        got = label, attrs, zone, raw.rstrip().endswith("/")
        if len(_tags) > 50_000:
            _tags.clear()
        if len(raw) < 300:
            _tags[key] = got
    return got


def read(html: str | None) -> list[tuple[str | None, bool, int, tuple[int, ...]]]:
    """The pieces of text of a page, each with its place: noise, zone (2 in an article, 1 in main, 0 else), and the path nodes above it. None parts blocks."""
    html = html or ""
    out: list[tuple[str | None, bool, int, tuple[int, ...]]] = []
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []
    brk: tuple = (None, False, 0, ())

    def pop_to(k: int) -> None:
        out.append(brk)
        del stack[k:]

    def close(names: frozenset | set, stops: frozenset | set) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                pop_to(k)
                return
            if stack[k][0] in stops:
                return

    at = 0
    while True:
        m = MARKUP.search(html, at)
        if (stop := m.start() if m else len(html)) > at:
            _, noise, zone, path = stack[-1] if stack else _ROOT
            text = html[at:stop]
            out.append((unescape(text) if "&" in text else text, noise, zone, path))
        if not m:
            return _placed(out)
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(x[0] in BLOCK for x in stack[k:]):
                        out.append(brk)
                    del stack[k:]
                    break
                if stack[k][0] in _CELLS and tag not in _TABLE_ENDS:
                    break
            else:
                if tag in BLOCK:
                    out.append(brk)
            continue
        if tag in BLOCK:
            out.append(brk)
        if tag in _ENDS_P:
            close(_P, _P_STOPS)
        if tag in _CLOSES:
            close(_CLOSES[tag], _HOLDS[tag])
        if tag in VOID:
            continue
        label, attrs, own, closed = _tag(tag, m[3])
        _, noise, zone, path = stack[-1] if stack else _ROOT
        noise = noise or noisy(tag, attrs, zone == 2)
        if closed and tag in _EMPTY:
            continue
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            out.append(brk)
            continue
        stack.append((tag, noise, zone if noise else max(zone, own), (*path, path_id(path[-1] if path else 0, label))))


def _placed(pieces: list) -> list:
    """Text in articles and main gets paths of its own, that end with the places of its block from the start and the end."""
    found: list[list[int]] = [[]]
    for i, (text, noise, zone, _) in enumerate(pieces):
        if text is None:
            if found[-1]:
                found.append([])
        elif zone and not noise and text.strip(_STRIP):
            found[-1].append(i)
    n = len(found) - (not found[-1])
    for k, block in enumerate(found[:n]):
        places = path_id(0, f"^{k}"), path_id(0, f"${n - k}")
        for i in block:
            text, noise, zone, path = pieces[i]
            pieces[i] = text, noise, zone, (*(*path, 0, 0)[:2], *(~x for x in path[2:]), *places)
    return pieces


def _digest(parts: list[str]) -> int:
    text = _SPACE.sub(" ", "".join(parts)).strip(_STRIP)
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def nodes(pieces: list) -> Iterator[tuple[int, int, int | None]]:
    """(path, digest of the text there, digest of all text in articles and main) of the nodes; the last is None for nodes outside those."""
    texts: dict[int, list[str]] = {}
    inner: dict[int, list[str]] = {}
    whole: list[str] = []
    for text, noise, zone, path in pieces:
        if text is None or (zone and (noise or not text.strip(_STRIP))):
            continue
        if zone:
            whole.append(text)
        for node in path[2:]:  # below html and body
            (inner if zone else texts).setdefault(node, []).append(text)
    for node, parts in texts.items():
        yield node, _digest(parts), None
    if inner:
        article = _digest(whole)
        for node, parts in inner.items():
            yield node, _digest(parts), article


def _joined(pieces: list, keep: Callable[[int, tuple[int, ...]], bool]) -> str:
    blocks, now = [], []
    for text, noise, zone, path in [*pieces, (None, False, 0, ())]:
        if text is None:
            if now and (block := _SPACE.sub(" ", "".join(now)).strip(_STRIP)):
                blocks.append(block)
            now = []
        elif not noise and keep(zone, path):
            now.append(text)
    return " ".join(blocks)


def main_text(pieces: list, low: frozenset[int] = frozenset(), high: frozenset[int] = frozenset()) -> str:
    for least in (2, 1):
        if whole := _joined(pieces, lambda zone, _: zone >= least):  # noqa: B023
            if not low and not high:
                return whole
            inside = _joined(pieces, lambda zone, path: zone >= least and low.isdisjoint(path))  # noqa: B023
            gone = low if len(inside) >= LEAST * len(whole) else frozenset()

            def keep(zone: int, path: tuple[int, ...]) -> bool:
                if zone >= least:  # noqa: B023
                    return gone.isdisjoint(path)  # noqa: B023
                own = path[:-2] if zone else path
                return bool(own) and own[-1] in high and low.isdisjoint(path)

            return _joined(pieces, keep)
    return _joined(pieces, lambda _, path: low.isdisjoint(path))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, pages, importance of each node that pages of the host share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.blocks(batches, "html"):
            hosts, paths, digests, wholes = [], [], [], []
            for h, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                for path, digest, whole in nodes(read(page)):
                    hosts.append(h)
                    paths.append(path)
                    digests.append(digest)
                    wholes.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64()), pa.array(digests, pa.int64()), pa.array(wholes, pa.int64())], names=["host", "path", "digest", "whole"])

    rows = pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(run, "host string, path long, digest long, whole long")
    each = rows.groupBy("host", "path", "digest", "whole").agg(F.count("*").alias("w"))
    each = each.groupBy("host", "path", "digest").agg(F.sum("w").alias("c"), F.sum(F.col("w") * F.log("w")).alias("l"), F.count("whole").alias("inner"))
    n = F.sum("c")
    entropy = F.log(n) - F.sum(F.col("c") * F.log("c")) / n
    most = F.when(F.sum("inner") > 0, F.log(n) - F.sum("l") / n).otherwise(F.log(n))
    return each.groupBy("host", "path").agg(n.alias("pages"), F.when(most > 1e-9, entropy / most).otherwise(1.0).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars."""
    tree = style_tree(pages, url, html).where((F.col("pages") >= MIN_PAGES) & ((F.col("importance") < LOW) | (F.col("importance") >= HIGH)))
    sets = [F.collect_set(F.when(F.col("importance") < LOW, F.col("path"))).alias("low"), F.collect_set(F.when(F.col("importance") >= HIGH, F.col("path"))).alias("high")]
    low = written(tree.groupBy("host").agg(*sets), "style-tree")
    size = low.agg(F.coalesce(F.sum((F.size("low") + F.size("high")) * 8 + 64), F.lit(0)).alias("s")).first()["s"]
    low = sized(low, -(-size // max(low.count(), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.blocks(batches, "html"):
            sets = zip(part.column("html").to_pylist(), part.column("low").to_pylist(), part.column("high").to_pylist(), strict=True)
            texts = [main_text(read(page), frozenset(x or ()), frozenset(y or ())).encode("utf-8", "replace").decode() for page, x, y in sets]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host(F.col(url)).alias("host")).join(low, "host", "left").select("id", "url", "html", "low", "high")
    return rows.mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")
