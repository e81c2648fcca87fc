"""Main text of web pages by the maximum-scoring run of tokens.

A page is read as a list of tokens, words and tags. A word scores the share of
words in its kind of element that labelled pages have inside their article; a
tag costs what the labelled pages show about that tag: little if it stands
mostly inside articles, much if outside. One linear scan finds the contiguous
run of tokens with the highest sum; its blocks are the main text.

Labelled pages are those that mark their article themselves (``article``,
``main`` or ``itemprop=articleBody``). The marks only teach the weights: the
scan treats these tags like any other, so pages without them work too. What
never is main text by its element (menus, forms, scripts, page headers ...) or
its class (adverts, comments, notices ...) counts as one tag and gives no text.
A class only tells about the layout where its word is negated or part of a
layout name (``no-comments``, ``post-header``), or where the element holds most
of the page's words; then the element is read like any other.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollspark.llm.common import table

#: Elements and class words that hold no main text.
UNREAD = frozenset("script style noscript template svg math iframe object embed canvas audio video head title textarea select".split())
APART = frozenset("nav aside footer form button dialog menu fieldset label".split()) | UNREAD
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login paywall sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments respond reply replies disqus share sharing social related recommended pagination pager widget toolbar "
    "skip hidden".split())
TALK = frozenset("comment comments respond reply replies disqus".split())  # may be longer than the article
NEGATED = frozenset("no not non without has have with hide hides open layout".split())
LAYOUT = frozenset([("overflow", "hidden"), ("related", "work"), ("related", "works"),
                    *((x, "header") for x in "post entry article story chapter section content title".split())])
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(("article", "main"))

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|\Z)|[^>]*+(?:>|\Z))", re.S)
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for x in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
TELLING = re.compile("class|id|role|hidden|style", re.I)
ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
LEAST, MOST = 0.05, 6.0  # costs of a tag that is always, and never, inside articles
MOST_GONE = 0.5  # cost of a whole element without main text that is never inside articles
UNSEEN_WORD, UNSEEN_TAG = 0.8, 0.3


def attributes(attrs: str) -> dict[str, str]:
    """An opening tag's attributes by lower-case name; of repeated ones the first."""
    out: dict[str, str] = {}
    for m in ATTR.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def is_body(attrs: str) -> bool:
    return "articlebody" in attrs.lower() and "articlebody" in attributes(attrs).get("itemprop", "").lower().split()


def apart(name: str, attrs: str, in_article: bool) -> str:
    """How it shows that an element holds no main text: ``sure`` by its name, role or state, ``class`` or ``talk`` by a word of its class or id; empty if not."""
    if name in APART or (name == "header" and not in_article):
        return "sure"
    if name in ("body", "html", "article", "main") or len(attrs) < 5 or not TELLING.search(attrs):
        return ""
    has = attributes(attrs)
    if has.get("role", "").lower() in APART_ROLES or "hidden" in has or has.get("aria-hidden", "").lower() == "true":
        return "sure"
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", has.get("style", ""), re.I):
        return "sure"
    found = ""
    for token in f"{has.get('class', '')} {has.get('id', '')}".split():
        words = NAME.findall(CAMEL.sub(" ", token).lower())
        if APART_WORDS.isdisjoint(words) or not NEGATED.isdisjoint(words) or not LAYOUT.isdisjoint(zip(words, words[1:], strict=False)):
            continue
        if not TALK.isdisjoint(words):
            return "talk"
        found = "class"
    return found


def extents(page: str) -> tuple[dict[int, tuple[int, bool]], int]:
    """For the place after each opening tag, the words in the element and whether it holds an h1 or an article; and the page's words."""
    out: dict[int, tuple[int, bool]] = {}
    opened: dict[str, list[tuple[int, int, int]]] = {}
    words = leads = at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        words += len(page[at:m.start() if m else len(page)].split())
        if not m:
            break
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if opened.get(name):
                place, before, led = opened[name].pop()
                out[place] = (words - before, leads > led)
        elif name in RAW_END:
            e = RAW_END[name].search(page, at)
            at = e.end() if e else len(page)
        else:
            if name not in VOID and not m["attrs"].endswith("/>"):
                opened.setdefault(name, []).append((at, words, leads))
            leads += name in ARTICLE or name == "h1" or is_body(m["attrs"])
    return out, words


def read(page: str) -> list[tuple[str, str, str, bool]]:
    """(kind, name, text, labelled) of the page's tokens in order.

    ``tag`` is an opening or closing tag by name, ``gone`` an element without
    main text as a whole, ``text`` a run of characters with the name of the
    block element round it. ``labelled`` tells whether it stands in an article.
    """
    out: list[tuple[str, str, str, bool]] = []
    closing: dict[str, list[int]] = {}  # places of the closing tags, to tell unclosed elements
    for m in re.finditer(r"</([a-zA-Z][^\s/>]*)", page):
        closing.setdefault(m[1].lower(), []).append(m.start())
    blocks: list[str] = []
    depth_in_article, skip, depth, at = 0, "", 0, 0
    body, body_depth = "", 0  # the element with itemprop=articleBody that is open
    held = None
    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        inside = depth_in_article > 0 or body_depth > 0
        text = page[at:m.start() if m else size]
        if text and not skip:
            out.append(("text", blocks[-1] if blocks else "", text, inside))
        if not m:
            break
        at = m.end()
        if m["name"] is None:
            continue
        name, ends = m["name"].lower(), bool(m["end"])
        if m["attrs"][-1:] != ">" and at == size:
            break  # a tag that the page's end cuts off
        if skip:
            if name == skip and name not in VOID:
                depth += -1 if ends else 0 if m["attrs"].endswith("/>") else 1
                if depth == 0:
                    skip = ""
            continue
        if not ends:
            gone = apart(name, m["attrs"], inside)
            if gone in ("class", "talk"):
                held = held or extents(page)
                words, leads = held[0].get(at, (0, False))
                if 2 * words > held[1] and (leads or gone == "class"):
                    gone = ""
            if name in RAW_END:
                e = RAW_END[name].search(page, at)
                at = e.end() if e else size
                out.append(("gone", name, "", inside))
                continue
            if gone:
                out.append(("gone", name, "", inside))
                if name not in VOID and not m["attrs"].endswith("/>") and closing.get(name, [-1])[-1] > at:
                    skip, depth = name, 1
                continue
            out.append(("tag", name, "", inside))
            depth_in_article += name in ARTICLE
            if name not in ARTICLE and name not in VOID and not m["attrs"].endswith("/>"):
                if body_depth:
                    body_depth += name == body
                elif is_body(m["attrs"]) and closing.get(name, [-1])[-1] > at:
                    body, body_depth = name, 1
            if name not in INLINE and name not in VOID:
                if blocks and blocks[-1] == "p":
                    blocks.pop()  # a paragraph ends where another block begins
                blocks.append(name)
        else:
            if name in ARTICLE and depth_in_article:
                depth_in_article -= 1
            if body_depth:
                body_depth -= name == body
            out.append(("tag", name, "", depth_in_article > 0 or body_depth > 0))
            if name in blocks:
                while blocks.pop() != name:
                    pass
    return out


def learn_weights(pages: DataFrame, html: str = "html", max_names: int = 1000) -> dict[str, dict[str, float]]:
    """Score of a word by its block element, and cost of a tag by its name.

    Counted over all pages that mark an article: Spark adds up what tasks count.
    The ``max_names`` most frequent element names are kept (others take the
    general weight), so the result is small whatever the pages hold.
    """
    def count(batches):
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for x in batch.column(0).to_pylist():
                for kind, name, text, inside in read(x):
                    n = len(text.split()) if kind == "text" else 1
                    if n:
                        seen.setdefault((kind, name[:32]), [0, 0])[inside] += n
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.string()), pa.array([n for _, n in keys], pa.string()),
                 pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())],
                ["kind", "name", "outside", "inside"])

    rows = (pages.select(F.col(html).alias("html")).where(F.lower("html").rlike(r"<(article|main)[\s>]|articlebody"))
            .mapInArrow(count, "kind string, name string, outside long, inside long")
            .groupBy("kind", "name").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
            .orderBy(F.desc(F.col("outside") + F.col("inside")), "kind", "name").limit(max_names).collect())
    out: dict[str, dict[str, float]] = {"text": {}, "tag": {}, "gone": {}}
    for r in rows:
        share = (r["inside"] + 1) / (r["inside"] + r["outside"] + 2)
        most = MOST if r["kind"] == "tag" else MOST_GONE
        out[r["kind"]][r["name"]] = share if r["kind"] == "text" else LEAST + (most - LEAST) * (1 - share) ** 2
    return out


def main_text(page: str | None, weights: dict[str, dict[str, float]]) -> str:
    """The blocks of the best run, white space made single, joined by line feeds."""
    if not page:
        return ""
    words = weights["text"]
    tokens = read(page)
    best, low, low_at, total = 0.0, 0.0, 0, 0.0
    span = (0, 0)
    for i, (kind, name, text, _) in enumerate(tokens):
        if kind == "text":
            n = len(text.split())
            total += n * words.get(name[:32], UNSEEN_WORD)
            if n and total - low > best:
                best, span = total - low, (low_at, i + 1)
        else:
            total -= weights[kind].get(name[:32], UNSEEN_TAG)
        if total < low:
            low, low_at = total, i + 1
    blocks, current = [], []

    def close():
        text = " ".join(entities.unescape("".join(current)).split())
        if text:
            blocks.append(text)
        current.clear()

    for kind, name, text, _ in tokens[slice(*span)]:
        if kind == "text":
            current.append(text)
        elif name == "br":
            current.append(" ")
        elif name not in INLINE and kind == "tag":
            close()
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame, weights: dict[str, dict[str, float]], html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns of every row with ``text`` and ``n_chars`` (its code points).

    Null and empty pages, and pages without words, give an empty text. Whole
    pages are read, one at a time; repeated rows stay; other columns are not read.
    """
    src = pages.select(*keep, F.col(html).alias("__html"))
    schema = src.drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema.names)

    return src.mapInArrow(run, schema)


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn_weights(pages))
