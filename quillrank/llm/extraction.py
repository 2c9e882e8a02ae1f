"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged into one tree: a presentation node is a block element by its path of tags, classes and ids, whatever
page it stands on, inner elements included. Of each, two entropies are taken over the pages that have it, normalised by that of as many
different pages: of the sequences of child elements, which is how the node is presented, and of the texts below it. Together they are its
importance; the branch of a node that is on many of the host's pages with little of either is removed from each. Pages of a host with
equal texts count once, so a group of copies says nothing about what its host repeats; a node that holds most of the text of the pages
it stands on is never removed, and neither is a heading, so near copies keep their text too. Statistics are sums over (host, node,
sequence, text) and so never gather a host in one task; what they find meets the pages by host and a salt, so no host is hot.

What the markup itself declares is decided before: scripts, styles, menus, headers, footers, sidebars, forms, adverts, notices and
reader comments go, by element, role, and class or id words, as contents of one page alone tell nothing of its host; and where a page
has an article or main element, the tree is that of what it holds. Class and id words and form elements say nothing against an element that holds the page's article or most of its text; inside an
article, words that prose is classed by too (more, side, legal) count only where most of the element's text is links.

A null or empty page gives an empty text; a page whose url has no host belongs to the host ''; repeated rows each
give their text; blocks with equal texts on one page all stay; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, rows_of, staged, table
from .htmltree import BLOCK, Node, scan

MIN_PAGES, MIN_SHARE, IMPORTANCE, PRESENTATION, SALT = 5, 0.3, 0.3, 0.1, 16
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_DROP = set("script style noscript template nav footer aside form button select textarea iframe object svg canvas title head menu dialog noembed noframes datalist audio video map input label fieldset search".split())
_WORD = r"(?:^|[-_\s])(?:%s)(?:$|[-_\s])"
_BOILER = re.compile(
    _WORD % "ads?|advert(?:s|isements?|ising)?|adsense|adslot|adbox|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri(?:be|ption)|signup|paywall|nav(?:bar|igation)?|menus?|breadcrumbs?|pagination|pager|header|masthead|topbar|toolbar|footer|foot|copyright|legal|disclaimer|sidebar|side|widgets?|rail|related|recommend(?:ed|ations?)?|trending|popular|more|share|sharing|social|follow|comments?|commentlist|disqus|respond|replies|reply|discussion|login|search|form|tags?|toc|skip|hidden|print",
    re.I,
)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_MAIN_ROLES = {"main", "article"}
_FORMS = {"form", "fieldset", "label"}
#: Of the words above, those by which prose is not classed.
_CLEAR = re.compile(
    _WORD % "ads?|advert(?:s|isements?|ising)?|adsense|adslot|adbox|sponsor(?:ed|s)?|promo(?:tion|s)?|cookies?|consent|gdpr|popup|newsletter|subscri(?:be|ption)|signup|paywall|nav(?:bar|igation)?|menus?|breadcrumbs?|pagination|pager|topbar|toolbar|footer|sidebar|related|recommend(?:ed|ations?)?|comments?|commentlist|disqus|respond|login|hidden",
    re.I,
)
_READERS = re.compile(_WORD % "comments?|commentlist|disqus|respond", re.I)
#: Words of states, which tell what stands elsewhere; attribute values; the attribute hidden.
_STATE = re.compile(r"(?<!\S)(?:with|has|without)[-_]\S+", re.I)
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
_NUMBERS = re.compile(r"\d+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)


@lru_cache(maxsize=8192)
def _kind(name: str, attrs: str) -> tuple[bool, bool, bool, bool, bool]:
    """What one element declares: (goes in any case, goes by form or words, by a word that prose is not classed by, reader comments, is an article or main)."""
    node = Node(name, attrs, None)
    role = node.get("role").lower() if attrs else ""
    is_main = name in ("article", "main") or role in _MAIN_ROLES
    if name in _DROP - _FORMS:
        return True, False, False, False, is_main
    form = name in _FORMS
    if not attrs or name in ("html", "body"):
        return False, form, form, False, is_main
    form = form or role == "form"
    sure = role in _ROLES - {"form"} or node.get("aria-hidden").lower() == "true" or bool(_HIDDEN.search(_VALUE.sub(" ", attrs)))
    if sure or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs):
        return True, False, False, False, is_main
    kind = f"{node.get('class')} {node.get('id')} {node.get('itemprop') if 'comment' in attrs else ''}"
    kind = _STATE.sub(" ", kind)
    if not kind.strip():
        return False, form, form, False, is_main
    named = name in ("article", "section", "main") and bool(re.search(r"comment|repl(?:y|ies)|advert|sponsor|promo|related", kind, re.I))
    words = named or name not in ("article", "main") and bool(_BOILER.search(kind))
    return False, form or words, form or named or words and bool(_CLEAR.search(kind)), words and bool(_READERS.search(kind)), is_main


def _dropped(events: list[tuple[str, Node | None, str]]) -> set[int]:
    """The ids of the nodes that go by what they declare; what they hold goes with them."""
    nodes: list[int] = []
    kinds: list[tuple[bool, bool, bool, bool, bool]] = []
    headers: list[bool] = []
    up: list[int] = []  # the parent's place
    end: list[int] = []  # elements from k to before end[k] stand in k
    text: list[int] = []
    links: list[int] = []
    own: list[int] = []  # text outside of inner articles
    sure: list[bool] = []
    open_: list[int] = []
    total = mains = soft = 0
    for kind, node, words in events:
        if kind == "text":
            n = len(words.strip())
            if open_:
                text[open_[-1]] += n
                own[open_[-1]] += n
            else:
                total += n
        elif kind == "open":
            found = _kind(node.name, node.attrs)
            header = node.name == "header" and not mains
            above = open_[-1] if open_ else -1
            open_.append(len(nodes))
            nodes.append(id(node))
            kinds.append(found)
            headers.append(header)
            up.append(above)
            end.append(0)
            text.append(0)
            links.append(0)
            own.append(0)
            sure.append(found[0] or header or above >= 0 and sure[above])
            mains += found[4]
            soft += found[1]
        elif kind == "close":
            k = open_.pop()
            end[k] = len(nodes)
            mains -= kinds[k][4]
            if node.name in ("a", "button"):
                links[k] = text[k]
            if kinds[k][0] or headers[k]:
                continue
            if (above := up[k]) >= 0:
                text[above] += text[k]
                links[above] += links[k]
                own[above] += 0 if kinds[k][4] else own[k]
            else:
                total += text[k]
    if not soft:
        return {nodes[k] for k, found in enumerate(kinds) if found[0] or headers[k]}
    articles = [k for k, found in enumerate(kinds) if found[4] and not sure[k] and (not found[1] or 2 * text[k] > total)]
    first = max(articles, key=own.__getitem__, default=-1)
    gone, within, out = [], [], set()
    for k, (always, by_words, clear, readers, is_main) in enumerate(kinds):
        inside = up[k] >= 0 and within[up[k]]
        drop = always or headers[k]
        if by_words and not drop:
            if inside and readers:
                drop = True
            elif 2 * text[k] > total or k <= first < end[k] or not clear and any(k <= x < end[k] for x in articles):
                drop = False
            elif inside and not clear:
                drop = 2 * links[k] > text[k]
            else:
                drop = True
        if drop:
            out.add(nodes[k])
        gone.append(drop or up[k] >= 0 and gone[up[k]])
        within.append(not gone[k] and (is_main or inside))
    return out


def blocks(page: str | None) -> tuple[list[tuple[str, tuple[int, ...], bool]], dict[int, list[str]]]:
    """What markup leaves: text blocks (text, presentation nodes from the outermost, whether an article or main element holds it), and of each node its sequences of children."""
    out: list[tuple[str, tuple[int, ...], bool]] = []
    styles: dict[int, list[str]] = {}
    parts: list[str] = []
    dropped = 0
    main = 0
    events = list(scan(page or ""))
    goes = _dropped(events)
    state: dict[int, tuple[bool, bool, bool]] = {}
    path: list[str] = []
    chain: list[int] = []
    children: list[list[str]] = [[]]

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((text, tuple(chain), main > 0))

    for kind, node, text in events:
        if kind == "text":
            if not dropped:
                parts.append(text)
        elif kind == "void":
            if not dropped:
                if node.name in BLOCK:
                    flush()
                elif node.name in ("br", "wbr"):
                    parts.append(" " if node.name == "br" else "")
        elif kind == "open":
            is_main = _kind(node.name, node.attrs)[4]
            drop = dropped > 0 or id(node) in goes
            if node.name in BLOCK or drop and not dropped:
                flush()
            counts = not drop and node.name in BLOCK and node.name not in ("html", "body") and not (_HEADINGS & {node.name})
            state[id(node)] = (drop, is_main and not drop, counts)
            dropped += drop
            if not drop:
                main += is_main
                own = f"{node.name}.{node.get('class')}#{_NUMBERS.sub('0', node.get('id'))}" if node.attrs else node.name
                if children[-1][-1:] != [own]:  # a run of like elements is one
                    children[-1].append(own)
                path.append(own)
                children.append([])
                if counts:
                    chain.append(xxhash.xxh64_intdigest("/".join(path)) >> 1)
        else:
            drop, is_main, counts = state.pop(id(node))
            if node.name in BLOCK and not dropped:
                flush()
            dropped -= drop
            if not drop:
                main -= is_main
                path.pop()
                own = children.pop()
                if counts:
                    styles.setdefault(chain.pop(), []).append(" ".join(own))
    flush()
    if any(m for _, _, m in out):
        out = [x for x in out if x[2]]
    return out, styles


def host_of(url: str = "url") -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def style_tree(spark: SparkSession, pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, importance: float = IMPORTANCE) -> DataFrame:
    """(host, low): the unimportant presentation nodes of each host."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            names = ("host", "whole", "node", "style", "content", "chars", "total")
            rows: dict[str, list] = {k: [] for k in names}
            for host, page in zip(rows_of(batch, "host"), rows_of(batch, "html"), strict=True):
                found, styles = blocks(page)
                whole = xxhash.xxh64_intdigest("\n".join(text for text, _, _ in found)) >> 1
                total = sum(len(text) for text, _, _ in found)
                own: dict[int, list[str]] = {}
                for text, chain, _ in found:
                    for node in dict.fromkeys(chain):
                        own.setdefault(node, []).append(text)
                for node, texts in [(0, []), *own.items()]:  # node 0 counts the host's pages
                    style = xxhash.xxh64_intdigest("\n".join(dict.fromkeys(styles.get(node, ())))) >> 1
                    for k, v in zip(names, (host, whole, node, style, xxhash.xxh64_intdigest("\n".join(texts)) >> 1, sum(map(len, texts)), total), strict=True):
                        rows[k].append(v)
            return rows

        return run

    found = map_batches(pages.select(host_of().alias("host"), "html"), make, "host string, whole long, node long, style long, content long, chars long, total long")
    once = found.groupBy("host", "whole", "node").agg(F.min("style").alias("style"), F.min("content").alias("content"), F.min("chars").alias("chars"), F.min("total").alias("total"))
    seen = staged(spark, once.groupBy("host", "node", "style", "content").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("total").alias("total")), "sst-seen")
    spread = lambda by: seen.groupBy("host", "node", by).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("total").alias("total"))
    surprise = F.sum(F.col("n") * F.log2("n"))
    nodes = spread("content").groupBy("host", "node").agg(F.sum("n").alias("pages"), surprise.alias("s"), F.sum("chars").alias("chars"), F.sum("total").alias("total"))
    nodes = nodes.join(spread("style").groupBy("host", "node").agg(surprise.alias("t")), ["host", "node"])
    nodes = staged(spark, nodes, "sst-nodes")
    per_host = nodes.filter("node = 0").select("host", F.col("pages").alias("host_pages"))
    # entropy of the contents, normalised by that of as many different pages
    entropy = lambda s: (F.log2("pages") - F.col(s) / F.col("pages")) / F.log2("pages")
    low = (
        nodes.filter((F.col("node") != 0) & (F.col("pages") >= min_pages))
        .join(per_host, "host")
        .filter(2 * F.col("chars") <= F.col("total"))
        .filter((F.col("pages") >= min_share * F.col("host_pages")) & (PRESENTATION * entropy("t") + (1 - PRESENTATION) * entropy("s") < importance))
    )
    return staged(spark, low.groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("low")), "sst-low")


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    low = style_tree(spark, pages)
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).alias("salt")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of().alias("host"), salt)

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            texts = []
            for page, rules in zip(rows_of(batch, "html"), rows_of(batch, "low"), strict=True):
                found, _ = blocks(page)
                bad = set(rules or ())
                texts.append("\n".join(x[0] for x in found if bad.isdisjoint(x[1])))
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": np.array(list(map(len, texts)), np.int64)}

        return run

    rules = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    joined = base.join(rules, ["host", "salt"], "left").select("page_id", "url", "html", "low")
    return map_batches(joined, make, "page_id long, url string, text string, n_chars long")


def op5_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages"))
