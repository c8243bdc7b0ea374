"""Main text of web pages by scoring the tree of a page's elements.

A page is cut into tags and text once, and a light tree is kept: for each block element its parent, and for each paragraph its text, its commas and how
much of it stands in links. Every paragraph passes points for its length and commas to its parent, half of them to the parent's parent, a third to the
next, and so on; a container's points are discounted by the share of its text that stands in links. The container with the most points, or the ``article`` or
``main`` element that it stands in, is kept with those siblings that score well, stand between such or are paragraphs like its own. Menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts and styles are left out by element, role and class word, wherever they stand; nothing else of the container is.

Edge cases: a null or empty page gives an empty text; tags that are never closed end where HTML says or with their parent; every end tag closes its
element, whichever it is; a page without a container takes its whole body; malformed markup is text or is skipped, but nothing fails; the time for very long and very deep pages
grows with their length, without recursion; repeated rows each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, small_batches, table, text_or_empty

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: One attribute, or what else stands before a tag's end. A quote opens a value only behind "=", as HTML has it.
ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Elements without content, those whose content is no markup, and inline ones whose content isn't shown or belongs to a form.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
UNSHOWN = frozenset("button select datalist noscript template svg object canvas audio video annotation".split())
APART = frozenset("nav header footer aside dialog menu search".split())
FORMS = frozenset("form fieldset".split())
BLOCKS = APART | FORMS | frozenset(
    "address article blockquote body caption center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p pre blockquote li td dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th caption".split())
ROWS = frozenset("tr tbody thead tfoot".split())
ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
#: Blocks that an item's implied end looks through.
SOFT = frozenset("address div p li dd dt".split())
#: Class and id words of what is no article. The second list counts even where the same names speak of an article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent disqus footer gdpr header masthead menu menus modal nav navbar navigation notice notices outbrain pagination pager popup social subscribe subscription taboola toolbar widget widgets skip signup login legal copyright alert".split()
)
STRONG_WORDS = frozenset("comment comments cookie cookies newsletter promo promos promotion related replies respond share sharing sidebar sidebars sponsor sponsored sponsors".split())
ARTICLE_WORDS = frozenset("article articles body content entry hentry main page post story text".split())
#: Words that make a name that ends in them one of reader comments, and those before a header that is the article's own.
COMMENT_ENDS = frozenset("discussion discussions reviews reply response responses feedback".split())
OWN_HEADERS = frozenset("entry post article story hentry".split())
#: "has-sidebar" says what else a page has.
ABOUT_OTHERS = ("has-", "has_", "with-", "with_", "no-", "no_", "without-", "without_")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
ROLES_APART = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
START = {"article": 25, "main": 20, "section": 5, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ol": -3, "ul": -3, "dl": -3}
SPACE = re.compile(r"\s+")
#: Why an element is apart: itself, by class, as a form, by a strong class word.
ITSELF, BY_CLASS, AS_FORM, STRONGLY = 1, 2, 4, 8


def words_of(names: str) -> set[str]:
    return {w.lower() for name in names.split() if not name.lower().startswith(ABOUT_OTHERS) for w in WORD.findall(name)}


def roles_of(names: str) -> tuple[bool, bool]:
    """Whether a name says that its element is apart though it may have an article's word too, as the last of several words does ("main-menu"), and whether it says so of comments."""
    apart = comments = False
    for name in names.split():
        if name.lower().startswith(ABOUT_OTHERS):
            continue
        words = [w.lower() for w in WORD.findall(name)]
        comments |= bool(words) and words[-1] in COMMENT_ENDS or any(w.startswith("comment") and not w.startswith("commentar") for w in words)
        apart |= len(words) > 1 and words[-1] in ASIDE_WORDS and not (words[-1] == "header" and words[-2] in OWN_HEADERS)
    return apart, comments


class Page:
    """The tree of one page: block elements as parallel lists, and blocks of text in page order."""

    def __init__(self, source: str):
        self.source = source
        self.parent, self.tag, self.score, self.own, self.like_article = [-1], ["#page"], [0.0], [0], [False]
        self.within = [False]
        #: of each block: its element, its text, characters in links
        self.blocks: list[tuple[int, str, int]] = []
        # open elements: name, tree number (-1: inline) and whether unseen; by name and by sort, their places in this list
        self.stack: list[tuple[str, int, bool]] = [("#page", 0, False)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.block_places, self.hard_places, self.cell_places, self.unseen = [0], [0], [0], 0
        self.parts: list[str] = []
        self.linked = 0
        self.read()
        self.apart = self.set_apart()

    def flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.blocks.append((self.stack[self.block_places[-1]][1], text, min(self.linked, len(text))))
            self.parts.clear()
        self.linked = 0

    def add_text(self, text: str) -> None:
        if not self.unseen:
            self.parts.append(text)
            if self.places["a"]:
                self.linked += len(SPACE.sub(" ", text))

    def close(self, depth: int) -> None:
        """Ends open elements until ``depth`` are left; text in between ends with a block."""
        while len(self.stack) > depth:
            name, number, unseen = self.stack[-1]
            if number >= 0:
                self.flush()
                self.block_places.pop()
                if self.hard_places[-1] == len(self.stack) - 1:
                    self.hard_places.pop()
                if self.cell_places[-1] == len(self.stack) - 1:
                    self.cell_places.pop()
            self.unseen -= unseen
            self.places[name].pop()
            self.stack.pop()

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=-1)

    def end(self, name: str) -> None:
        at = self.last(name)
        if name in BLOCKS:
            # a cell's inside doesn't end what is outside
            least = self.last("table") - 1 if name in CELLS or name in ROWS or name == "table" else self.cell_places[-1]
            if at > least:
                self.close(at)
        elif at > self.block_places[-1]:
            self.close(at)

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name not in BLOCKS:
            unseen = name in UNSHOWN or "hidden" in attributes or "style" in attributes and bool(UNSEEN.search(attributes["style"]))
            if name == "a":
                if "href" not in attributes:
                    name = "a-place"  # a place that links lead to is no link
                elif self.last("a") > self.block_places[-1]:
                    self.close(self.last("a"))
            self.unseen += unseen
            self.places[name].append(len(self.stack))
            self.stack.append((name, -1, unseen))
            return
        self.flush()
        if self.last("p") > self.cell_places[-1]:
            self.close(self.last("p"))
        hard, table = self.hard_places[-1], self.last("table")
        if name in ITEMS and self.last(*ITEMS[name]) > hard:
            self.close(self.last(*ITEMS[name]))
        elif name in CELLS and self.last("td", "th") > max(table, self.last("tr")):
            self.close(self.last("td", "th"))
        elif name in ROWS:
            least = min((p for p in (self.last(n) for n in (("tr",) if name == "tr" else ROWS)) if p > table), default=-1)
            if least > 0:
                self.close(least)
        elif name in HEADINGS and self.stack[self.block_places[-1]][0] in HEADINGS:
            self.close(self.block_places[-1])
        self.open_block(name, attributes)

    def open_block(self, name: str, attributes: dict[str, str]) -> None:
        up = self.stack[self.block_places[-1]][1]
        own, score, like_article = 0, float(START.get(name, 0)), False
        if name in APART and not (name == "header" and self.within[up]):  # an article's own header, with its heading, is part of it
            own |= ITSELF
        if name in FORMS:
            own |= AS_FORM
        if attributes:
            if attributes.get("role", "").lower() in ROLES_APART or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or UNSEEN.search(attributes.get("style", "")):
                own |= ITSELF
            names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
            words, (ends_apart, comments) = words_of(names), roles_of(names)
            like_article = not words.isdisjoint(ARTICLE_WORDS) and (name == "article" or not ends_apart)
            if name not in ("body", "html", "main"):
                if (comments or not words.isdisjoint(STRONG_WORDS)) and (name != "article" or not like_article):
                    own |= BY_CLASS | STRONGLY
                elif name != "article" and not like_article and not words.isdisjoint(ASIDE_WORDS):
                    own |= BY_CLASS
            if like_article:
                score += 25
        if self.unseen:
            own |= ITSELF
        self.parent.append(up)
        self.tag.append(name)
        self.score.append(score)
        self.own.append(own)
        self.like_article.append(like_article)
        self.within.append(self.within[up] or name in ("article", "main"))
        place = len(self.stack)
        self.stack.append((name, len(self.tag) - 1, False))
        self.places[name].append(place)
        self.block_places.append(place)
        if name not in SOFT:
            self.hard_places.append(place)
        if name in CELLS or name == "table":
            self.cell_places.append(place)

    def attributes(self, at: int) -> tuple[dict[str, str], bool, int]:
        """Attributes from ``at``, whether the tag closes itself, and the place behind it; a place of -1 if it never ends."""
        source, found, slash = self.source, {}, False
        while True:
            if at < len(source) and source[at] == ">":
                return found, slash, at + 1
            m = ATTRIBUTE.match(source, at)
            if not m:  # white space and slashes alone, up to the tag's end
                end = source.find(">", at)
                return found, source[at:end].rstrip().endswith("/"), end + 1 if end >= 0 else -1
            found.setdefault(m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or ""))
            slash, at = False, m.end()

    def read(self) -> None:
        source, n, at = self.source, len(self.source), 0
        last, unended = source.rfind(">"), set()
        while at < n:
            tag = source.find("<", at)
            if tag < 0 or tag > last:  # no tag ends from here on
                self.add_text(source[at:])
                break
            if tag > at:
                self.add_text(source[at:tag])
            at = tag
            m = NAME.match(source, at)
            if not m:
                if source.startswith("<!--", at):
                    end = source.find("-->", at + 2)
                    at = end + 3 if end >= 0 else n
                elif source[at + 1] in "!?" or source.startswith("</", at) and source[at + 2 : at + 3] != "":
                    at = source.find(">", at) + 1
                else:
                    self.add_text("<")
                    at += 1
                continue
            name, (found, slash, behind) = m.group(1).lower(), self.attributes(m.end())
            if behind < 0:  # a tag that never ends
                self.add_text("<")
                at += 1
                continue
            at = behind
            if source[tag + 1] == "/":
                self.end(name)
            elif name in VOID:
                if name == "br":
                    self.add_text(" ")
                elif name == "hr":
                    self.flush()
            elif name in RAW:
                end = None if name in unended else re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
                if end:
                    at = end.end()
                elif name in ("script", "style"):  # what is never closed is all script
                    break
                else:
                    unended.add(name)
            elif not slash or name in BLOCKS:
                self.start(name, found)
        self.close(1)
        self.flush()

    def set_apart(self) -> list[bool]:
        """Whether each element is apart. What is so by a class word or as a form isn't if the article's element stands in it."""
        seen = set()
        for e, tag in enumerate(self.tag):
            if tag in ("article", "main") and not self.own[e]:
                up = self.parent[e]
                while up > 0 and up not in seen and not self.own[up] & (ITSELF | STRONGLY):
                    seen.add(up)
                    self.own[up] = 0
                    up = self.parent[up]
        apart = [False] * len(self.tag)
        for e in range(1, len(self.tag)):  # a parent comes before its children
            apart[e] = bool(self.own[e]) or apart[self.parent[e]]
        return apart

    def main_text(self) -> str:
        kept = [(e, t, link) for e, t, link in self.blocks if not self.apart[e]]
        if not kept:
            return ""
        size, n = len(self.tag), [0] * len(self.tag)
        chars, links, points = n[:], n[:], self.score[:]
        touched = set()
        for e, text, link in kept:
            chars[e] += len(text)
            links[e] += link
            gain = (1 + text.count(",") + min(len(text) // 100, 3)) if len(text) >= 25 else 0.25
            # text that stands in a container itself counts for the container, as if it were a paragraph
            k, level = (self.parent[e] if self.tag[e] in PARAGRAPHS else e), 1
            while k > 0 and level <= 5:
                points[k] += gain / level
                touched.add(k)
                k, level = self.parent[k], level + 1
        for k in range(size - 1, 0, -1):
            chars[self.parent[k]] += chars[k]
            links[self.parent[k]] += links[k]
        density = [links[k] / chars[k] if chars[k] else 0.0 for k in range(size)]
        places = [k for k in touched if self.tag[k] not in ("html", "#page")]
        if not places:
            return "\n".join(t for _, t, _ in kept)
        final = {k: (points[k] if points[k] > 0 else 0.01) * (1 - density[k]) for k in places}
        best = max(places, key=lambda k: (final[k], -k))
        for name in ("article", "main"):  # the whole article, of which the best container may be a section
            around = [k for k in self.up_from(best) if self.tag[k] == name]
            if around:
                best = around[-1]
                break
        keep = self.with_siblings(best, final, chars, density)
        inside = [False] * size
        for k in range(1, size):
            inside[k] = k in keep or inside[self.parent[k]]
        up = self.parent[best]
        # text that stands in the parent itself, between kept siblings, is the article's as well
        out = [(e, t) for e, t, link in kept if inside[e] or e == up and link < 0.25 * len(t) and len(t) > 80]
        if not (self.within[best] or self.like_article[best]):
            # where no element says that this is the article, link lists before and behind its text are menus
            listed = [False] * size
            for k in range(1, size):
                listed[k] = k != best and (listed[self.parent[k]] or self.tag[k] in ("ul", "ol") and density[k] > 0.5)
            body = [n for n, (e, _) in enumerate(out) if not listed[e]]
            out = out[body[0] : body[-1] + 1] if body else []
        return "\n".join(t for _, t in out)

    def up_from(self, k: int) -> Iterator[int]:
        while k > 0:
            yield k
            k = self.parent[k]

    def with_siblings(self, best: int, final: dict[int, float], chars: list[int], density: list[float]) -> set[int]:
        keep, up = {best}, self.parent[best]
        siblings = [k for k in range(1, len(self.tag)) if self.parent[k] == up and not self.apart[k]]
        least = max(10.0, 0.2 * final.get(best, 0.0))
        if self.within[best]:  # beside an article: others like it, and the heading over it
            return keep | {k for k in siblings if self.tag[k] == "article" and final.get(k, 0.0) >= least or self.tag[k] in ("h1", "h2") and self.within[up] and k < best}
        for k in siblings:
            paragraph = self.tag[k] in ("p", "pre", "blockquote") and (chars[k] > 80 and density[k] < 0.25 or 0 < chars[k] <= 80 and density[k] == 0)
            heading = self.tag[k] in ("h1", "h2") and chars[k] and density[k] < 0.5
            if paragraph or heading or final.get(k, 0.0) >= least and self.tag[k] not in ("ul", "ol"):
                keep.add(k)
        first, last = min(keep), max(keep)
        return keep | {k for k in siblings if first < k < last and density[k] < 0.5}


def main_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page. A scan and a map: nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [main_text(x) for x in batch.pop("html").tolist()]
            batch["n_chars"] = np.fromiter(map(len, batch["text"]), dtype=np.int64, count=len(batch))
            yield batch

    given = small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    return map_rows(given, run, "text string, n_chars long", ids=("page_id", "url"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
