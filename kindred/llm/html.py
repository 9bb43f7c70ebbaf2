"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative, with
weights learned from labelled pages, that is pages that mark their article: a tag's
penalty is the log odds that it lies outside of the article, and a word scores the share
of words that lie inside. Both are taken by the context, the innermost boilerplate or
classed element around. The contiguous run of tokens with the highest sum, found in one
linear scan, is the content region, whatever marks the page has; its ends are extended
to the blocks they lie in. From the region boilerplate elements (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments: by tag, role and
class) are left out, and their words score nothing. What is left is joined block by block.

How Spark runs it: weights are fitted on at most ``sample_pages`` labelled pages
and are a small dictionary; each page is then extracted alone, without a shuffle, in time
that is linear in its length.

Defined cases: null html and pages without words that score give an empty text; repeated rows
are extracted each; ties go to the earliest run; an empty table gives no rows; without labelled
pages each word scores 1 and each tag has the default penalty; tags that are never closed end
with their parent; a tag whose quotes are never closed ends at the next '>'; a page of any
length is read whole; other columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re

from pyspark.sql import DataFrame, functions as F

from .rows import map_texts

NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
PLAIN = re.compile(r"[^>\"']*")
RAW = frozenset("script style noscript template textarea title svg iframe select".split())
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset(["body", "html", "head"])
BOILER_TAGS = frozenset("head nav header footer aside form script style noscript template button select textarea iframe svg dialog menu".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
BOILER_WORDS = frozenset("menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay comment comments reply replies disqus discussion share sharing social related newsletter subscribe subscription signup login toolbar pagination".split())
#: The elements that label a page's article.
HOLDERS = frozenset(["article", "main"])
#: Elements that no class or id makes boilerplate, and the containers that an id can; elsewhere an id is an anchor.
UNJUDGED = HOLDERS | frozenset("html body h1 h2 h3 h4 h5 h6".split())
JUDGED_BY_ID = frozenset("div ul ol dl table".split())
#: Elements that end the search for an open item of a list or table.
ITEMS = frozenset("li dd dt tr td th option".split())
ITEM_BARRIERS = frozenset("ul ol dl table menu div article main section nav".split())
P_BARRIERS = frozenset("button td th object".split())
WORD = re.compile(r"[^\W_]+")
SPACE = re.compile(r"[ \t\n\r\f\v]+")


def attributes_of(given: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in ATTRIBUTE.finditer(given)] if "=" in given else []


def is_boiler(tag: str, attributes: list[tuple[str, str]]) -> bool:
    if tag in BOILER_TAGS:
        return True
    for kind, value in attributes:
        if kind == "role":
            if value in BOILER_ROLES:
                return True
        elif tag not in UNJUDGED and (kind == "class" or tag in JUDGED_BY_ID):
            if any(BOILER_WORDS.issuperset(words) for name in value.split() if (words := WORD.findall(name))):
                return True
    return False


class Markup:
    """Finds the ends of tags; remembers what is not there any more, so that no part of a page is searched twice in vain."""

    def __init__(self, page: str) -> None:
        self.page, self.missing = page, {}

    def find(self, what: str, at: int) -> int:
        if at >= self.missing.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def end_of_tag(self, at: int) -> int:
        """The place behind the '>' that closes a tag whose attributes begin here, or -1; a quote after '=' hides what it encloses."""
        page, i = self.page, at
        if "" not in self.missing:
            while (i := PLAIN.match(page, i).end()) < len(page):
                if page[i] == ">":
                    return i + 1
                before = i - 1
                while before > at and page[before].isspace():
                    before -= 1
                close = self.find(page[i], i + 1) if before >= at and page[before] == "=" else i
                i = (close if close >= 0 else i) + 1
            self.missing[""] = at  # quotes of this page do not match: from here on they hide nothing
        return self.find(">", at) + 1 or -1


class Open:
    """The elements that are open, with the places of each tag among them."""

    def __init__(self) -> None:
        self.stack, self.places, self.blocks = [], {}, []
        self.hidden = self.holders = 0
        self.context = ""

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def push(self, tag: str, boiler: bool, holder: bool, context: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, boiler, holder, self.context))
        self.hidden += boiler
        self.holders += holder
        self.context = context

    def pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            tag, boiler, holder, self.context = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.hidden -= boiler
            self.holders -= holder

    def close(self, tag: str) -> None:
        """An end tag: not for an inline element outside of the innermost block."""
        places = self.places.get(tag)
        if places and (tag in BLOCKS or not self.blocks or self.blocks[-1] <= places[-1]):
            self.pop_to(places[-1])

    def imply(self, tag: str) -> None:
        """The ends that a start tag implies."""
        if tag in CLOSES_P and (p := self.places.get("p")) and self.last(P_BARRIERS) < p[-1]:
            self.pop_to(p[-1])
        if tag in ITEMS and (p := self.places.get(tag)) and self.last(ITEM_BARRIERS) < p[-1]:
            self.pop_to(p[-1])


def tokens(page: str) -> list[tuple]:
    """(text or None, key of its weight, boilerplate, inside an article, tag) in page order."""
    out, at, text_from, n = [], 0, 0, len(page)
    markup, now = Markup(page), Open()

    def text(a: int, b: int) -> None:
        if a < b:
            out.append((page[a:b], f"{now.context} #", now.hidden > 0, now.holders > 0, ""))

    def tag_token(tag: str, context: str, boiler: bool) -> None:
        out.append((None, f"{context} {tag}" if context else tag, boiler, now.holders > 0, tag))

    while (lt := page.find("<", at)) >= 0:
        sign = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = markup.find("-->", lt + 4)
            end = n if end < 0 else end + 3
        elif sign in ("!", "?"):
            end = markup.find(">", lt) + 1
        elif name := NAME.match(page, lt + 1 + (sign == "/")):
            end = markup.end_of_tag(name.end())
        else:
            end = 0
        if end <= 0:
            at = lt + 1
            continue
        text(text_from, lt)
        at = text_from = end
        if sign in ("!", "?"):
            continue
        tag = name[0].lower()
        if sign == "/":
            tag_token("/" + tag, now.context, now.hidden > 0)
            now.close(tag)
            continue
        given = page[name.end() : end - 1]
        now.imply(tag)
        attributes = attributes_of(given)
        boiler, holder = is_boiler(tag, attributes), tag in HOLDERS or ("role", "main") in attributes
        classes = " ".join(v for k, v in attributes if k == "class")
        context = "" if holder or tag in UNJUDGED else f"{tag}.{'.'.join(classes.split())}" if classes else tag if tag in BOILER_TAGS else now.context
        tag_token(tag, context, now.hidden > 0 or boiler)
        if tag in VOID or given.endswith("/"):
            continue
        if tag in RAW:
            closing = RAW_END[tag].search(page, at)
            at = text_from = closing.end() if closing else n
            continue
        now.push(tag, boiler, holder and not boiler and not now.hidden, context)
    text(text_from, n)
    return out


def label_counts(pages: list[str]) -> dict[str, tuple[int, int]]:
    """Of labelled pages, how many tags or words of each key lie inside and outside of the article."""
    found: dict[str, list[int]] = {}
    for page in pages:
        for text, key, boiler, holder, _ in tokens(page):
            if n := 1 if text is None else len(text.split()):
                found.setdefault(key, [0, 0])[0 if holder and not boiler else 1] += n
    return {k: (a, b) for k, (a, b) in found.items()}


def weights(counts: dict[str, tuple[int, int]], least: float = 0.05, most: float = 8.0) -> dict[str, float]:
    """By key, the penalty of a tag: log odds of lying outside, between two bounds; or the score of a word: the share that lies inside."""
    return {k: (a + 1) / (a + b + 1) if k.endswith("#") else min(most, max(least, math.log((b + 1) / (a + 1)))) for k, (a, b) in counts.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the earliest contiguous run with the highest positive sum; (0, 0) if there is none."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, found = run, (start, i + 1)
    return found


def main_text(page: str, weight: dict[str, float], default: float = 0.05) -> str:
    """weight: as ``weights`` gives it; tags that it lacks cost ``default``, words that it lacks score 1."""
    found = tokens(page)
    scores = [
        (0.0 if boiler else weight.get(key, 1.0) * len(text.split())) if text is not None else -weight.get(key, default)
        for text, key, boiler, _, _ in found
    ]
    a, b = best_run(scores)
    if a == b:
        return ""
    divides = lambda t: t[0] is None and t[4].lstrip("/") in BLOCKS
    while a and not divides(found[a - 1]):
        a -= 1
    while b < len(found) and not divides(found[b]):
        b += 1
    blocks, now = [], []
    for token in found[a:b]:
        text, _, boiler, _, tag = token
        if text is not None and not boiler:
            now.append(text)
        elif tag == "br":
            now.append(" ")
        elif divides(token):
            blocks.append("".join(now))
            now = []
    blocks.append("".join(now))
    clean = (SPACE.sub(" ", references.unescape(x)).strip(" ") for x in blocks)
    return "\n\n".join(x for x in clean if x)


def fitted_weights(pages: DataFrame, sample_pages: int = 500) -> dict[str, float]:
    """Weights from about ``sample_pages`` labelled pages: those whose page_id hashes lowest, with equal ones.
    Only hashes and counts by key come to the driver."""
    labelled = pages.where(F.lower("html").contains("<article") | F.lower("html").contains("<main")).withColumn("by", F.xxhash64("page_id"))
    last = labelled.select("by").orderBy("by").limit(sample_pages).agg(F.max("by")).first()[0]
    if last is None:
        return {}

    def count(texts: list[str]) -> dict:
        return {"keys": [[{"key": k, "inside": a, "outside": b} for k, (a, b) in label_counts([page]).items()] for page in texts]}

    found = map_texts(labelled.where(F.col("by") <= last), count, "keys array<struct<key: string, inside: long, outside: long>>", key="page_id", text="html")
    sums = found.select(F.explode("keys").alias("k")).groupBy("k.key").agg(F.sum("k.inside"), F.sum("k.outside")).collect()
    return weights({key: (a, b) for key, a, b in sums})


def extract_main_text(pages: DataFrame, sample_pages: int = 500, weight: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page, with the given weights or those of its labelled pages."""
    weight = fitted_weights(pages, sample_pages) if weight is None else weight
    key = F.struct("page_id", "url").alias("page")
    rows = pages.select(key, "html")

    def extract(texts: list[str]) -> dict:
        return {"main": [main_text(t, weight) for t in texts]}

    found = map_texts(rows, extract, "main string", key="page", text="html")
    return found.select("page.page_id", "page.url", F.col("main").alias("text"), F.length("main").cast("long").alias("n_chars"))
