"""HTML extraction by tag-path ratios.

A page becomes leaf blocks in page order, each with its path from the root. Text length and punctuation are summed for each
path, smoothed over the page, fused, and paths over a share of the mean are content. Regions that never hold the article
(menus, forms, adverts, comments ...) are left out before; the page's own mark of its article multiplies the scores of the paths
under it by PRIOR, no more, so the ratios decide there, too. Outside the mark the text of links does not count, and in a page without
a mark the share of the mean is higher. A heading is fused with the content after it, a table or list of terms with the article around it.

Null or empty html: empty text. Unclosed and stray tags: a block tag ends the paragraph that is open, or the head; stray end tags
are ignored; an open comment, tag or quoted value goes on to the end of the page. Very long pages: whole, in linear time. Repeated
rows: each is read. Paths of equal score: all stay or all go. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

# A tag ends at the first > outside a quoted value, and quotes open a value after = only; what never ends goes on to the end of the
# page, so each character is read once. Elements whose content is no markup go with it.
TAG_END = r"""(?>[^>=]|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+(?:>|\Z)"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe)(?=[\s/>]){TAG_END}.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|</?[a-zA-Z]{TAG_END}|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
# Elements by their part in HTML.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CELLS = frozenset("table dl".split())
OUTSIDE = frozenset("head nav header footer aside form button select dialog menu".split())
PARAGRAPH_ENDS = frozenset("p div article section ul ol li table h1 h2 h3 h4 h5 h6 blockquote pre nav header footer aside form main dl figure hr".split())
BAD = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|gdpr|newsletter|subscribe|comments?|replies|disqus|sidebar|side|widget|menu|nav\w*|breadcrumbs?|footer|header|masthead|share(?![_-]?holder)|social|related|recommended|popup|modal|navigation|contentinfo|complementary)(?:$|[\s_-])", re.I)
GOOD = frozenset(["article", "main"])
# An article element of its own for a comment or an advert: a class that ends in such a word.
NO_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|sponsored|promo|comments?|reply|replies|related|recommended)(?:$|\s)", re.I)
# Inside the article, a class of a header marks the block of its title.
TITLE = re.compile(r"(?:^|(?<=[\s_-]))(?:header|masthead)(?=$|[\s_-])", re.I)
IN_HEAD = frozenset("title base link meta script style noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PRIOR = 2.0


class Block(NamedTuple):
    path: int  # a number for each path from the root
    leaf: str
    text: str
    never: bool  # inside a region that never is content
    article: bool  # inside the marked article
    cell: bool  # inside a table or list of terms of the article
    links: int  # characters in links


def blocks(page: str) -> list[Block]:
    """The leaf blocks in page order."""
    paths: dict[tuple[int, str], int] = {}
    out, parts = [], []
    stack = [Block(0, "", "", False, False, False, 0)]  # the open elements, under the root
    in_link, linked = False, 0
    open_tags: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(stack[-1]._replace(text=text, links=linked))
        linked = 0

    def pop() -> str:
        tag = stack.pop().leaf
        open_tags[tag] -= 1
        return tag

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += in_link and m.start() - at
        at = m.end()
        name = NAME.match(m[0])
        if m[1] or not name:
            continue
        tag, top = name[2].lower(), stack[-1]
        if tag in INLINE:
            if tag == "a":
                in_link = not name[1]
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if name[1]:
            if open_tags[tag]:
                while pop() != tag:
                    pass
            continue
        if top.leaf == "head" and tag not in IN_HEAD or top.leaf == "p" and tag in PARAGRAPH_ENDS:  # end tags that may be left out
            pop()
            top = stack[-1]
        if tag in VOID:
            continue
        mark = " ".join(x for g in MARK.findall(m[0]) for x in g if x)
        if top.article:
            mark = TITLE.sub("", mark)
        if tag in GOOD:
            bad = tag == "article" and NO_ARTICLE.search(mark)
        else:
            bad = tag not in ("html", "body") and BAD.search(mark)
        path = paths.setdefault((top.path, tag), len(paths) + 1)
        outside = tag in OUTSIDE and not (top.article and tag == "header")  # a header in the article holds its title
        stack.append(Block(path, tag, "", top.never or outside or bool(bad), top.article or tag in GOOD and not bad, top.cell or top.article and tag in CELLS, 0))
        open_tags[tag] += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def extract(page: str | None, share: float = 0.1, unmarked: float = 0.25) -> str:
    """The blocks of paths over a share of the mean, one a line; `unmarked` is the share in pages without a marked article."""
    if not page:
        return ""
    inside = [b for b in blocks(page) if not b.never]
    size: dict[int, list[float]] = {}
    for b in inside:
        s = size.setdefault(b.path, [0.0, 0.0, 0.0])
        s[0] += len(b.text) if b.article else max(len(b.text) - b.links, 0)
        s[1] += sum(b.text.count(c) for c in ".,;:!?")
        s[2] += 1
    ratio = {p: (n / k) * (1 + c / k) for p, (n, c, k) in size.items()}
    each = [ratio[b.path] for b in inside]
    smooth = [sum(w) / len(w) for w in (each[max(0, i - 1) : i + 2] for i in range(len(each)))]
    fused: dict[int, list[float]] = {}
    for b, x, y in zip(inside, each, smooth):
        fused.setdefault(b.path, []).append((x * y) ** 0.5)
    score = {p: sum(v) / len(v) for p, v in fused.items()}
    least = (share if any(b.article for b in inside) else unmarked) * sum(score.values()) / max(len(score), 1)
    value = [score[b.path] * (PRIOR if b.article else 1) for b in inside]
    best = max((v for b, v in zip(inside, value) if b.article), default=0.0)
    for i in range(len(inside) - 1, -1, -1):  # from the end, as a heading may stand over another
        if inside[i].cell:
            value[i] = max(value[i], (value[i] + best) / 2)
        elif inside[i].leaf in HEADINGS and i + 1 < len(inside) and inside[i].article == inside[i + 1].article and value[i + 1] >= least:
            value[i] = max(value[i], (value[i] + value[i + 1]) / 2)
    return "\n".join(b.text for b, v in zip(inside, value) if v >= least)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
