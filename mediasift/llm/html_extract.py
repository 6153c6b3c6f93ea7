"""Main text of web pages: boosted trees over DOM-node features and a consistent choice of subtrees."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from mediasift.llm.boosting import BoostedTrees, fit_trees
from mediasift.llm.common import few_by_hash

# Element kinds of the HTML standard, and tokens common in class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas textarea select title head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
ENDS_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
GROUPS = ("article main", "p", "h1 h2 h3 h4 h5 h6", "nav menu", "header", "footer", "aside", "form fieldset button legend dialog", "ul ol li dl dt dd", "table tbody thead tr td th", "div section", "body html", "blockquote pre figure figcaption")
GOOD = "article content main body post entry story text page blog read paragraph prose".split()
BAD = "nav navbar navigation menu sidebar side footer header masthead banner ad ads advert advertisement sponsor sponsored promo cookie consent gdpr notice alert popup modal overlay newsletter subscribe signup login search form share social related recommend breadcrumb breadcrumbs comment comments disqus reply respond widget tags meta pagination skip toolbar copyright legal".split()
BUCKETS = 8

_GROUP = {t: k for k, g in enumerate(GROUPS) for t in g.split()}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Block elements in page order (parents first) and the texts between block borders."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    attrs: list[list[str]] = field(default_factory=list)
    texts: list[tuple[int, str, int, int]] = field(default_factory=list)  # node, text, characters in links, inline tags


def parse(source: str | None) -> Page:
    """Read HTML as browsers do where it matters here: implied ends, stray ends and cut-off pages.

    Time is linear in the page: places of open elements are kept by name, open inline tags are counted, and a search
    for an end tag that isn't there is made once per name. Text of formulas stands in the line.
    """
    s, page = source or "", Page(["html"], [-1], [[]])
    stack, buf = [0], []
    places: dict[str, list[int]] = {"html": [0]}  # places in the stack of the open elements of each name
    inline: Counter = Counter()
    endless: set[str] = set()
    link_chars = tags = 0
    body = False

    def flush():
        nonlocal link_chars, tags
        t = " ".join("".join(buf).split())
        if t:
            page.texts.append((stack[-1], t, link_chars, tags))
        buf.clear()
        link_chars = tags = 0

    def text(part: str):
        nonlocal link_chars
        if part:
            part = html.unescape(part)
            buf.append(part)
            if inline["a"]:
                link_chars += len(part.strip())

    def last(names) -> int:
        return max((at[-1] for n in names if (at := places.get(n))), default=-1)

    def close(names, stop=()):
        k = last(names)
        if k > max(0, last(stop)):
            flush()
            while len(stack) > k:
                places[page.tag[stack.pop()]].pop()

    def search(name: str, pattern: str, at: int):
        """The next match, looked for once if there is none."""
        found = None if name in endless else re.compile(pattern, re.I).search(s, at)
        if found is None:
            endless.add(name)
        return found

    at = 0
    while (m := _TOKEN.search(s, at)) is not None:
        text(s[at : m.start()])
        at = m.end()
        name = (m[2] or m[6] or "").lower()
        if not name:
            continue
        if (m[4] if m[2] else m[8]) != ">":
            break  # cut off inside a tag
        end, rest = (m[1] or m[5]) == "/", m[3] if m[2] else m[7]
        if name == "br":
            buf.append(" ")
        elif name in RAW:
            if not end and not rest.endswith("/"):
                if name != "head":  # what is in it is never text; the head only if it ends
                    stop = search(name, rf"</{name}[\s/>]", at)
                    at = len(s) if stop is None and name in ("script", "style", "textarea", "title") else at if stop is None else s.find(">", stop.start()) + 1 or len(s)
                elif (stop := search(name, r"</head\s*>|<body[\s>]", at)) is not None:
                    at = stop.end() if stop[0][1] == "/" else stop.start()
        elif name in INLINE or name in MATH:
            tags += 1
            if not end:
                inline[name] += 1
            elif inline[name]:
                inline[name] -= 1
        elif name in ("html", "hr") or (end and name in VOID):
            flush()
        elif name in VOID:
            tags += 1
        elif end:
            close((name,), ("table",) if name not in ("table", "body") and name not in ENDS_P else ())
        else:
            flush()
            if name in ENDS_P:
                close(("p",), ("table", "td", "th", "button"))
            if name == "li":
                close(("li",), ("ul", "ol", "menu"))
            elif name in ("dt", "dd"):
                close(("dt", "dd"), ("dl",))
            elif name in ("td", "th"):
                close(("td", "th"), ("tr", "table"))
            elif name == "tr":
                close(("tr",), ("table",))
            elif name == "body":
                if body:
                    continue
                body = True
            if name in ENDS_P:
                inline["a"] = 0
            page.tag.append(name)
            page.parent.append(stack[-1])
            page.attrs.append([p.lower() for a in _ATTR.findall(rest) for p in _PARTS.findall(a[1] or a[2] or a[3])] if "=" in rest else [])
            if not rest.endswith("/"):
                places.setdefault(name, []).append(len(stack))
                stack.append(len(page.tag) - 1)
    else:
        text(s[at:])
    flush()
    return page


def features(p: Page) -> np.ndarray:
    """One row per block element: tag, attribute tokens, depth, subtree density, siblings and what stands above."""
    n = len(p.tag)
    parent = np.array(p.parent)
    own, links, commas, words, runs, inl, first = (np.zeros(n) for _ in range(7))
    first += np.inf
    total = 0
    for node, t, k, tags in p.texts:
        own[node] += len(t)
        links[node] += k
        commas[node] += t.count(",") + t.count(". ") + t.endswith(".")
        words[node] += t.count(" ") + 1
        runs[node] += 1
        inl[node] += tags
        first[node] = min(first[node], total)
        total += len(t)
    sub = np.stack([own, links, commas, words, runs, inl, np.ones(n)])
    depth, kids, place = np.zeros(n), np.zeros(n), np.zeros(n)
    group = np.array([_GROUP.get(t, len(GROUPS)) for t in p.tag])
    good = np.array([sum(x in GOOD for x in a) for a in p.attrs], float)
    bad = np.array([sum(x in BAD for x in a) for a in p.attrs], float)
    above_good, above_bad, above = np.zeros(n), np.zeros(n), np.zeros((n, len(GROUPS) + 1))
    for i in range(1, n):
        q = parent[i]
        depth[i], place[i] = depth[q] + 1, kids[q]
        kids[q] += 1
        above_good[i], above_bad[i] = above_good[q] + good[q], above_bad[q] + bad[q]
        above[i] = above[q]
        above[i, group[q]] = 1
    for i in range(n - 1, 0, -1):
        sub[:, parent[i]] += sub[:, i]
        first[parent[i]] = min(first[parent[i]], first[i])
    chars = np.maximum(sub[0], 1)
    sibs = np.maximum(kids[parent], 1)
    up = np.maximum(parent, 0)
    beside = np.bincount(up, sub[0], n) - np.bincount([0], [sub[0][0]], n)
    beside_links = np.bincount(up, sub[1], n) - np.bincount([0], [sub[1][0]], n)
    tokens = np.zeros((n, BUCKETS))
    for i, a in enumerate(p.attrs):
        for x in a:
            tokens[i, zlib.crc32(x.encode()) % BUCKETS] += 1
    one = np.zeros((n, len(GROUPS) + 1))
    one[np.arange(n), group] = 1
    scalar = np.stack([
        depth, kids, sibs, place / sibs, np.log1p(own), np.log1p(sub[0]), sub[0] / max(1, total), sub[1] / chars, sub[2] / chars * 100, sub[3] / np.maximum(1, sub[4]),
        chars / (sub[5] + sub[6]), np.log1p(sub[6]), np.where(np.isfinite(first), first, total) / max(1, total), np.log1p(beside[up] / sibs), beside_links[up] / np.maximum(1, beside[up]),
        sub[0] / np.maximum(1, beside[up]), good, bad, above_good, above_bad], axis=1)
    return np.concatenate([scalar, one, above, tokens], axis=1).astype(np.float32)


def choose(p: Page, logit: np.ndarray) -> np.ndarray:
    """Elements to keep: a subtree that goes takes all below it, so no kept element is under a dropped one.

    The choice has the largest sum of logits over kept elements, each weighted by the root of its own text
    (a container without text weighs by a part of its subtree); found in one pass from the leaves up.
    """
    n = len(p.tag)
    own, sub = np.zeros(n), np.zeros(n)
    for node, t, *_ in p.texts:
        own[node] += len(t)
    sub += own
    for i in range(n - 1, 0, -1):
        sub[p.parent[i]] += sub[i]
    gain = logit * np.where(own > 0, np.sqrt(own), 0.3 * np.sqrt(sub))
    gain[0] = logit[0] * np.sqrt(own[0])
    for i in range(n - 1, 0, -1):
        if gain[i] > 0:
            gain[p.parent[i]] += gain[i]
    keep = gain > 0
    keep[0] = True  # the root has no own verdict; its own text is judged below
    for i in range(1, n):
        keep[i] &= keep[p.parent[i]]
    if logit[0] <= 0:
        own_root = np.zeros(n, bool)
        own_root[0] = True
        return keep & ~own_root
    return keep


@dataclass
class Extractor:
    trees: BoostedTrees

    def texts(self, sources: list[str | None], nodes: int = 20_000) -> Iterator[str]:
        """Main text of each page; pages are scored together, about ``nodes`` elements at a time."""
        held, n = [], 0
        for s in sources:
            held.append(parse(s))
            n += len(held[-1].tag)
            if n >= nodes:
                yield from self._score(held)
                held, n = [], 0
        yield from self._score(held)

    def _score(self, pages: list[Page]) -> Iterator[str]:
        if not pages:
            return
        z = self.trees.logit(np.concatenate([features(p) for p in pages]))
        at = 0
        for p in pages:
            keep = choose(p, z[at : at + len(p.tag)])
            at += len(p.tag)
            yield "\n".join(t for node, t, *_ in p.texts if keep[node])


# Forms in which the training pages wrap their parts.
MAIN = ("<article>{}</article>", "<main>{}</main>", '<main><article class="post">{}</article></main>', '<div class="content">{}</div>', '<div id="main-content"><div class="inner">{}</div></div>', '<div class="post-body">{}</div>', '<section class="entry">{}</section>', '<div class="story-text">{}</div>', "<div>{}</div>", '<table><tr><td class="article">{}</td></tr></table>')
MENU = ("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="topnav">{}</ul>', '<header><ul>{}</ul></header>', '<div class="breadcrumbs"><ul>{}</ul></div>', '<div class="related"><ul>{}</ul></div>', '<ul class="share-buttons">{}</ul>')
NOISE = ('<div class="ad">{}</div>', '<div class="advert-banner"><p>{}</p></div>', '<aside>{}</aside>', '<aside class="promo"><p>{}</p></aside>', '<div class="sidebar"><p>{}</p></div>', '<div class="cookie-notice"><p>{}</p><button>OK</button></div>', '<div id="gdpr-consent">{}</div>', '<div role="dialog" class="popup"><p>{}</p></div>', '<form action="/s"><p>{}</p><input name="q"></form>', '<div class="newsletter-form"><form><p>{}</p></form></div>', '<header><p>{}</p></header>', '<div class="site-header">{}</div>', '<div class="notice">{}</div>')
AFTER = ('<section class="comments"><h2>{0}</h2><div class="comment"><p>{1}</p></div><div class="comment"><p>{2}</p></div></section>', '<div id="comments"><ol class="comment-list"><li><p>{1}</p></li><li><p>{2}</p></li></ol></div>', '<div id="disqus_thread"><p>{1}</p><p>{2}</p></div>', "<footer>&copy; {0} {1}</footer>", "<footer>{1}</footer>", '<div id="footer"><p>{1}</p></div>', '<footer class="site-footer"><p>{1}</p><p>{0}</p></footer>')


def training_page(rng: np.random.Generator, long: list[str], short: list[str]) -> tuple[str, str]:
    """A page made of given texts and random layouts, and where its main part is marked by U+E000 and U+E001."""
    pick = lambda pool: html.escape(pool[int(rng.integers(len(pool)))])
    menu = lambda: MENU[int(rng.integers(len(MENU)))].format("".join(f'<li><a href="/{k}">{pick(short)}</a></li>' for k in range(int(rng.integers(2, 9)))))
    noise = lambda: NOISE[int(rng.integers(len(NOISE)))].format(pick(long if rng.random() < 0.5 else short))
    after = lambda: AFTER[int(rng.integers(len(AFTER)))].format(pick(short), pick(long), pick(long))
    body = [f"<h1>{pick(short)}</h1>"] if rng.random() < 0.8 else []
    for _ in range(int(rng.integers(1, 8))):
        r = rng.random()
        body.append(f"<p>{pick(long)}</p>" if r < 0.8 else f"<h2>{pick(short)}</h2>" if r < 0.88 else f"<ul><li>{pick(long)}</li><li>{pick(short)}</li></ul>" if r < 0.94 else f"<blockquote>{pick(long)}</blockquote>")
    marked = ["\ue000" + x + "\ue001" for x in body]
    if rng.random() < 0.3:
        marked.insert(int(rng.integers(len(marked) + 1)), noise())
    parts = [menu() for _ in range(int(rng.integers(0, 3)))] + [noise() for _ in range(int(rng.integers(0, 3)))]
    parts.append(MAIN[int(rng.integers(len(MAIN)))].format("".join(marked)))
    parts += [x() for x in ([noise, menu] if rng.random() < 0.4 else [])] + [after() for _ in range(int(rng.integers(0, 4)))]
    page = "<html><head><title>t</title></head><body>" + ('<div id="page">' + "".join(parts) + "</div>" if rng.random() < 0.4 else "".join(parts)) + "</body></html>"
    return page


def _labelled(source: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, share of main text and weight of each element of a marked page."""
    inside, spans = False, []
    clean = []
    for part in re.split("([\ue000\ue001])", source):
        if part in ("\ue000", "\ue001"):
            inside = part == "\ue000"
            continue
        clean.append(part)
        spans.append((part, inside))
    p = parse("".join(clean))
    main = [" ".join(t.split()) for part, i in spans if i for _, t, *_ in parse(part).texts]
    x = features(p)
    share, total = np.zeros(len(p.tag)), np.zeros(len(p.tag))
    left = list(main)
    for node, t, *_ in p.texts:
        hit = t in left
        if hit:
            left.remove(t)
        share[node] += len(t) * hit
        total[node] += len(t)
    for i in range(len(p.tag) - 1, 0, -1):
        share[p.parent[i]] += share[i]
        total[p.parent[i]] += total[i]
    return x, share / np.maximum(total, 1), (total > 0) * (0.3 / len(total) + np.sqrt(total) / max(1.0, np.sqrt(total).sum()))


def train(pages: DataFrame, ident: str = "page_id", source: str = "html", max_pages: int = 300, max_chars: int = 100_000, variants: int = 4, seed: int = 5) -> Extractor:
    """Fit on a bounded sample: texts of ``max_pages`` pages (by id hash) in known layouts.

    No page has labels, so training pages are built: texts of the sample, split into long and
    short ones, are put into varied layouts whose main part is known, semantic or by class names.
    """
    known = pages.filter(F.length(source) <= max_chars).select(F.col(source).alias("s"), F.xxhash64(F.col(ident).cast("string"), F.lit("dom")).alias("h"))
    rows = few_by_hash(known, "h", max_pages, pages.count()).orderBy("h", "s").limit(max_pages).collect()
    found = [t for r in rows for _, t, *_ in parse(r.s).texts]
    long = [t for t in found if len(t) >= 80] or ["A longer text of several words, as it stands in a paragraph of an article."]
    short = [t[:60] for t in found if len(t) < 80] or ["short text"]
    rng = np.random.default_rng(seed)
    got = [_labelled(training_page(rng, long, short)) for _ in range(max(60, len(rows) * variants))]
    x, y, w = (np.concatenate(c) for c in zip(*got))
    return Extractor(fit_trees(x, y, w * len(w) / w.sum()))


def extract(pages: DataFrame, model: Extractor, source: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with a column ``into``: the main text of the whole page, its blocks joined by one line break.

    Character references are decoded; white space inside a block becomes one space. Null and
    empty pages and pages without main text give an empty text; pages that break off are read to
    their end, and very long, deep or never closed ones in time linear in their length; repeated rows give
    equal texts; an existing column ``into`` is replaced; an empty table stays empty.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in parts:
            yield pd.Series(list(m.texts([x if isinstance(x, str) else None for x in s])), dtype=object)

    return pages.withColumn(into, run.asNondeterministic()(F.col(source)))
