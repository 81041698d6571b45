"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page is read once into a sequence of words and tags.  Words score above zero and tags below; the
contiguous run with the largest sum, found in one scan, is the content region.  Weights come from labelled
pages: a structured perceptron raises what the labelled region holds and lowers what only the wrongly
chosen region holds, keeping words above zero and tags below.  Labelled pages are a bounded sample
(``TRAIN_PAGES``) of the pages that mark their own content with one <article> or <main>, and the small
``EXAMPLES`` for other layouts.  Elements that are never running text (menus, forms, asides, reader comments,
notices, adverts ...) are left out of the region's text.

Cases: null or empty html, or html without words, gives '' and 0; unclosed elements, comments and tags are
read to the end of the page; repeated rows repeat; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled pages that weights are fitted on, and the passes over them.
TRAIN_PAGES = 400
EPOCHS = 12

SCHEMA = "page_id long, url string, text string, n_chars long"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
HINT = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# Fixed values of HTML: elements whose content isn't markup, that make no block, and that have no content.
RAW = frozenset("script style template noscript textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no running text of an article.
ASIDE = frozenset("nav header footer aside form menu button select option svg canvas object audio video dialog head".split())
#: Words in class, id or role that name the same.
ASIDE_HINTS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer footer header login menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
CONTENT = frozenset(("article", "main"))


def hints(attributes: str) -> set[str]:
    found = set()
    for m in HINT.finditer(attributes):
        found.update(re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()))
    return found


class Page:
    """Words and tags of a page.

    ``items``: (feature, number of words, text or None, block break, within an aside) in page order.
    """

    def __init__(self, source: str):
        self.items: list[tuple[str, int, str | None, bool, bool]] = []
        self.marked: list[tuple[int, int]] = []
        open_aside: list[str] = []  # the outermost aside and what is open of its own kind within it
        open_content: list[int] = []
        links = at = 0
        while at < len(source):
            m = TOKEN.search(source, at)
            end = m.start() if m else len(source)
            if end > at:
                text = source[at:end]
                n = len(text.split())
                self.items.append(("aside word" if open_aside else "link word" if links else "word", n, text, False, bool(open_aside)))
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self.items.append(("word", len(m[0][9:].split()), entities.escape(m[0][9:].removesuffix("]]>")), False, bool(open_aside)))
                continue
            name = name.lower()
            closing = bool(m[1])
            if name in RAW and not closing:
                close = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(source, at)
                at = close.end() if close else len(source)
                self.items.append((f"<{name}>", 0, None, name not in INLINE, bool(open_aside)))
                continue
            marks = ASIDE_HINTS & hints(m[3]) if not closing and m[3] else ()
            feature = f"</{name}>" if closing else f"<{name} aside>" if marks else f"<{name}>"
            if closing:
                if name == "a":
                    links = 0
                if name in CONTENT and open_content:
                    self.marked.append((open_content.pop(), len(self.items)))
                if open_aside and name == open_aside[0]:
                    open_aside.pop()
            else:
                if name == "a":
                    links = 1
                if name in CONTENT:
                    open_content.append(len(self.items) + 1)
                if open_aside:
                    if name == open_aside[0] and name not in VOID:
                        open_aside.append(name)
                elif (name in ASIDE or marks) and name not in VOID and name not in ("body", "html", "article", "main"):
                    open_aside.append(name)
            self.items.append((feature, 0, None, name not in INLINE, bool(open_aside)))
        self.marked += [(s, len(self.items)) for s in open_content]

    def best(self, weights: dict[str, float], gold: tuple[int, int] | None = None) -> tuple[int, int]:
        """Bounds of the contiguous items with the largest sum; empty when no word is there.

        With ``gold``, items within it are handicapped by MARGIN and others favoured by it: training for a margin.
        """
        top = total = 0.0
        start = first = last = 0
        for i, (feature, n, _, _, _) in enumerate(self.items):
            total += n * weights.get(feature, WORD) if feature[0] != "<" else weights.get(feature, TAG)
            if gold:
                total += -MARGIN if gold[0] <= i < gold[1] else MARGIN
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > top:
                top, first, last = total, start, i + 1
        return first, last

    def text(self, first: int, last: int) -> str:
        """Blocks of the region, one a line."""
        blocks, held = [], []
        for _, _, text, breaks, aside in self.items[first:last]:
            if breaks:
                if held and (line := " ".join(entities.unescape("".join(held)).split())):
                    blocks.append(line)
                held = []
            elif aside:
                continue
            elif text is None:
                held.append(" ")
            else:
                held.append(text)
        if held and (line := " ".join(entities.unescape("".join(held)).split())):
            blocks.append(line)
        return "\n".join(blocks)


#: Where training starts, and the weight of what training pages never showed.
WORD, TAG = 1.0, -1.0
LEAST_WORD, MOST_TAG, MARGIN = 0.02, -0.01, 0.25

#: Labelled layouts without <article>, so that weights for them exist: region between the two marks.
EXAMPLES = [
    '<html><body><div class="header"><a href="/">Home</a> <a href="/b">About us</a></div><div class="sidebar"><ul><li><a href="/1">One more</a></li><li><a href="/2">Two more</a></li></ul></div><div><!--[--><h1>A long day by the river</h1><p>We walked along the river for most of the day and met nobody.</p><p>In the evening the rain came down and we turned back to the town.</p><!--]--></div><div class="comments"><p>Nice one</p><p>Thanks for this</p></div><div class="footer">All rights reserved</div></body></html>',
    '<body><nav><a href="/">Start</a><a href="/x">News</a></nav><div class="notice">We use cookies</div><table><tr><td><!--[--><h2>Bread at home</h2><p>Mix the flour with water and leave it to rest for an hour or two before you bake it.</p><ul><li>Flour and water</li><li>Salt and time</li></ul><p>Bake it until the crust is brown and it sounds hollow.</p><!--]--></td></tr></table><form><input name="q"><button>Search</button></form><footer>Imprint and contact</footer></body>',
]


def trimmed(page: Page, first: int, last: int) -> tuple[int, int]:
    """The bounds without the tags at their rims, which a best run never holds."""
    while first < last and page.items[first][1] == 0:
        first += 1
    while last > first and page.items[last - 1][1] == 0:
        last -= 1
    return first, last


def example(source: str) -> tuple[Page, tuple[int, int]]:
    before, inside = source.split("<!--[-->")
    inside, after = inside.split("<!--]-->")
    first = len(Page(before).items)
    page = Page(before + inside + after)
    return page, trimmed(page, first, first + len(Page(inside).items))


def _sums(page: Page, first: int, last: int) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for feature, n, _, _, _ in page.items[first:last]:
        out[feature] += 1 if feature[0] == "<" else n
    return out


def fit(labelled: list[tuple[Page, tuple[int, int]]], epochs: int = EPOCHS) -> dict[str, float]:
    """Averaged structured-perceptron weights: words above zero, tags below."""
    seen = {f for page, _ in labelled for f, *_ in page.items}
    w = {f: TAG if f[0] == "<" else WORD for f in sorted(seen)}
    totals: dict[str, float] = defaultdict(float)
    for _ in range(epochs):
        for page, gold in labelled:
            guess = page.best(w, gold)
            if guess != gold:
                right, wrong = _sums(page, *gold), _sums(page, *guess)
                size = sum(abs(right.get(f, 0) - wrong.get(f, 0)) for f in {*right, *wrong}) or 1
                for f in {*right, *wrong}:
                    step = (right.get(f, 0) - wrong.get(f, 0)) / size * 4
                    w[f] = min(w[f] + step, MOST_TAG) if f[0] == "<" else max(w[f] + step, LEAST_WORD)
            for f, x in w.items():
                totals[f] += x
    n = max(1, epochs * len(labelled))
    return {f: totals[f] / n for f in w}


def labelled_region(page: Page) -> tuple[int, int] | None:
    """The one marked element of a page."""
    if len(page.marked) != 1:
        return None
    first, last = trimmed(page, *page.marked[0])
    return (first, last) if first < last else None


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", bound: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights from at most ``bound`` pages that mark their content, chosen by a hash of id and html, and EXAMPLES.

    The least hashes are found first, alone; then their pages are read, one of each hash.
    """
    marked = pages.where(F.col(html_col).rlike("(?i)<(?:article|main)[\\s>]")).select(F.xxhash64(F.col(id_col).cast("string"), html_col).alias("h"), F.col(html_col).alias("html"))
    least = marked.select("h").distinct().orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    chosen = [] if least is None else sorted(marked.where(F.col("h") <= least).groupBy("h").agg(F.min("html").alias("html")).collect())
    labelled = [example(e) for e in EXAMPLES]
    for row in chosen:
        page = Page(row.html)
        if (gold := labelled_region(page)) is not None:
            labelled.append((page, gold))
    return fit(labelled)


def main_text(source: str | None, weights: dict[str, float]) -> str:
    page = Page(source or "")
    return page.text(*page.best(weights))


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Main text of every page; ``weights`` are fitted on the pages themselves unless given."""
    if weights is None:
        weights = train(pages)

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").alias("html")).mapInArrow(run, SCHEMA)
