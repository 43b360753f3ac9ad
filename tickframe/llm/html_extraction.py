"""Main text of web pages: flat text blocks, told from boilerplate by a decision tree.

A page is cut into flat blocks at block-level tags. A block is described by its
number of words and its link density, by the same two of the blocks before and
after it, and by what encloses it: an article, a part that pages use for
menus, notices, forms or comments, a heading, a hidden element. A decision tree
over these, trained on the labelled table below, says which blocks are main
text. Scripts, styles, comments, titles and form controls are never text.

Character references are decoded, white space inside a block becomes one space,
and the blocks are joined in page order by an empty line. Nothing else is
dropped or cut. Null and empty pages, and pages without a main block, have an
empty text. Unclosed and misplaced tags close where an outer one does. Repeated
rows give equal rows; an empty table gives an empty table; very long pages are
read whole. A column named like the result is replaced, others stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm import arrays

# HTML's block-level elements, elements whose content is no text, and elements without content.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "caption tbody td tfoot th thead tr ul".split()
)
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "select", "option", "button")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements, and names of a class, id or role, that mark a part as something other than the article.
APART = frozenset("nav header footer aside form dialog menu fieldset".split())
APART_WORDS = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|rail|widgets?|header|masthead|"
    r"footer|foot|copyright|legal|cookies?|consent|gdpr|notices?|alert|disclaimer|popup|modal|overlay|newsletter|subscri\w+|signup|"
    r"login|search|form|share|sharing|social|related|recommend\w*|trending|teasers?|tags?|pagination|pager|comments?|replies|reply|"
    r"respond|discussion|disqus|feedback|toolbar|skip|hidden|contentinfo|complementary|navigation)"
)
#: What a name may say besides such a word: where it stands or what it holds. Others (no-sidebar, tag-news) say something about the page.
PLACES = frozenset(
    "site page top bottom left right primary secondary main post entry article list box bar area section container wrapper wrap inner "
    "block group buttons button links link posts items item content text title".split()
)
#: Elements that hold the article whatever they are called.
WHOLE = frozenset("html body main article".split())
#: Whole names that say an element holds the article.
HOLDS = frozenset("content main-content page-content article article-body article-content entry-content post-content post-body story story-body".split())
INSIDE = frozenset(("article", "main"))
INSIDE_WORDS = re.compile(
    r"(?:^|[^a-z])(?:article|article-?body|post|post-?(?:body|content|text)|entry|entry-?content|content|main|main-?content|story|story-?body|text|body-?text)(?:$|[^a-z])"
)
PHRASES = re.compile(
    r"\b(?:we use cookies|this (?:web)?site uses cookies|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|all rights reserved|"
    r"subscribe to|sign up|log ?in|read more|leave a (?:comment|reply)|share (?:this|on)|advertisement|sponsored)\b|©",
    re.IGNORECASE,
)

# Every alternative reads forward only: attributes take each character one way, and what is not closed ends with the page.
_TOKEN = re.compile(
    r"<!--(?:(?!-->).)*+(?:-->|$)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rest>[^>]*+)>(?:(?!</(?P=raw)\b).)*+(?:</(?P=raw)[^>]*+(?:>|$)|$)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|$)"
    r"|<[!?/][^>]*+(?:>|$)"
    r"|(?P<text>[^<]++|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

FEATURES = ("words", "link_density", "words_before", "links_before", "words_after", "links_after", "inside", "apart", "heading", "phrase")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    apart: bool
    heading: bool

    @property
    def link_density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _is_apart(name: str) -> bool:
    """Whether a whole name is a word that marks a part, or such words and places joined; tag-... names a page's subject."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    marks = [bool(APART_WORDS.fullmatch(x)) for x in parts]
    if len(parts) > 1 and parts[0] in ("tag", "tags"):
        return False
    return any(marks) and all(m or x in PLACES for m, x in zip(marks, parts))


def _role(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element holds an article, and whether it stands apart from it."""
    names, hidden = "", False
    if attrs and not attrs.isspace():
        for key, value in _ATTRIBUTE.findall(attrs):
            key = key.lower()
            value = value.strip("\"'").lower()
            if key in ("class", "id", "role", "aria-label", "itemprop"):
                names += f" {value} "
            hidden |= key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None)
    named, names = names.split(), re.sub(r"[_\s]+", " ", names)
    # A name that says content outweighs one that says banner or tags.
    apart = hidden or tag in APART or (tag not in WHOLE and any(map(_is_apart, named)) and HOLDS.isdisjoint(named))
    return (tag in INSIDE or bool(INSIDE_WORDS.search(names))) and not apart, apart


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page that hold any text, in page order."""
    out: list[Block] = []
    #: Open elements, each with whether it or one around it holds an article, and stands apart.
    stack: list[tuple[str, bool, bool]] = []
    n_open: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    #: Whether a link is open, and how many elements were when it was opened.
    link, depth = False, 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
        if text:
            linked = sum(len(html.unescape(t).split()) for t, inside_link in pieces if inside_link)
            # What stands apart inside an article does so; an article inside a part that stands apart belongs to that.
            _, inside, apart = stack[-1] if stack else ("", False, False)
            words = len(text.split())
            heading = any(tag in ("h1", "h2", "h3", "h4", "h5", "h6") for tag, _, _ in stack[-2:])
            out.append(Block(text, words, min(linked, words), inside, apart, heading))
        pieces.clear()

    def close(k: int) -> None:
        n_open.subtract(tag for tag, _, _ in stack[k:])
        del stack[k:]

    for token in _TOKEN.finditer(page):
        if token["text"] is not None:
            pieces.append((token["text"], link))
        elif token["tag"] is not None:
            tag = token["tag"].lower()
            if tag in BLOCKS:
                flush()
                if token["close"]:
                    if n_open[tag]:
                        close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
                else:
                    if stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                        close(len(stack) - 1)
                    if tag in ("li", "dd", "dt", "tr", "td", "th") and stack and stack[-1][0] == tag:
                        close(len(stack) - 1)
                    if tag not in VOID:
                        # A link goes on inside the blocks it holds, and ends with the one that holds it.
                        link &= len(stack) >= depth
                        inside, apart = _role(tag, token["attrs"] or "")
                        above = stack[-1] if stack else ("", False, False)
                        stack.append((tag, inside or above[1], apart or above[2]))
                        n_open[tag] += 1
                link &= len(stack) >= depth
            elif tag == "a":
                link, depth = not token["close"], len(stack)
            elif tag == "br":
                pieces.append((" ", link))
    flush()
    return out


def features(own: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block."""
    rows = np.zeros((len(own), len(FEATURES)))
    for k, b in enumerate(own):
        before = own[k - 1] if k else None
        after = own[k + 1] if k + 1 < len(own) else None
        rows[k] = (
            b.words, b.link_density,
            before.words if before else 0, before.link_density if before else 0,
            after.words if after else 0, after.link_density if after else 0,
            b.inside, b.apart, b.heading, bool(PHRASES.search(b.text)) and b.words < 40,
        )
    return rows


# The labelled table. A page to a line; a block is written as words/linked words, then i (in an article), a (apart),
# h (heading), p (phrase of notices), and + for main text. Blocks of one sketch are each other's neighbours.
LABELLED = """
6/6a 3/3a 1/1a 8ih+ 40i+ 55i+ 12i+ 90i+ 14ap
1/1a 1/1a 1/1a 9a 10ih+ 25i+ 3i+ 60i+ 1i+ 9ap
1/1a 1/1a 8a 7ih+ 120i+ 5a 30i+ 20a 18a 16a
5h+ 35+ 42/2+ 4h+ 60/3+ 3/3 4/4 2/2 11p
2/2 2/2 2/2 6h+ 80+ 75/1+ 66+ 12/10 8/8 9p
4/4a 12ih+ 70i+ 2ih+ 33/4i+ 18/18a 6/6a 25a 22a
20p 7h+ 50+ 45+ 5/5 5/5 5/5 7/1p
3/3a 30ap 6ih+ 14i+ 16i+ 11i+ 10i+ 8ap
12/12 10/9 9h+ 110+ 95/6+ 14/14 6/3p
1ih+ 2i+ 4i+ 1i+ 3i+ 6a 10a
2/2a 4i+ 12p 6ap 10a
15a 16a 40a 38a 5h+ 22+ 28+ 9/9 7p
6ih+ 45/45i 50i+ 44i+ 10/10i 3/3i 4/4i
5i+ 8i+ 30/5i+ 6/6a 6/6a 6/6a 2a
9ih+ 200i+ 150/10i+ 25ip+ 12p 4/4 3/3 60a 55a 70a 2ah
3/3 3/3 3/3 2 1 4 6p 3/2 2/2 1/1
7h+ 18+ 24+ 31+ 17+ 26/2+ 5p
10/10 11/11 9/9 12/12 10/10 8/8
4/4a 9ih+ 15ip+ 38i+ 12/2i+ 41i+ 20ap 3a
6h+ 12+ 15+ 9+ 14+ 2/2 3p
8 40+ 36+ 50+ 6/6 3/3
3a 4ah 20a 6i+ 25i+ 8a 30a 25a 28a 40a
2ih+ 60/8i+ 55/20i+ 9/9i 1/1i 12ip+
2/2 3h+ 18+ 15+ 2 1/1 6p
1/1 2/2 3/3 2h+ 60+ 44+ 1 2/2 2
3/3 3/3 25+ 30+ 28+ 3/3 12p
2 1 3 2h+ 22+ 12+ 3h+ 19+ 2 3 1
2/2 3 1 33+ 2h+ 14+ 16+ 3 2 2/2
4/4a 2 3ih+ 1i+ 20i+ 2i+ 5ip+ 9p
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table's blocks."""
    rows, labels = [], []
    for line in LABELLED.split("\n"):
        own = []
        for word in line.split():
            words, linked, marks = re.fullmatch(r"(\d+)(?:/(\d+))?([iahp]*)\+?", word).groups()
            block = Block("©" if "p" in marks else "", int(words), int(linked or 0), "i" in marks, "a" in marks, "h" in marks)
            own.append(block)
            labels.append(word.endswith("+"))
        if own:
            rows.append(features(own))
    return np.concatenate(rows), np.array(labels)


@dataclass(frozen=True)
class Node:
    """A test of one feature against a bound, or the label of a leaf."""

    feature: int = -1
    bound: float = 0.0
    below: Node | None = None
    above: Node | None = None
    label: bool = False


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 7, least: int = 2) -> Node:
    """A tree by the Gini criterion; the first feature and the lowest bound win ties."""
    share = labels.mean()
    if depth == 0 or len(labels) < 2 * least or share in (0.0, 1.0):
        return Node(label=bool(share >= 0.5))
    best = (share * (1 - share) - 1e-9, None, None)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            below = rows[:, f] <= bound
            n = int(below.sum())
            if least <= n <= len(labels) - least:
                p, q = labels[below].mean(), labels[~below].mean()
                impurity = (n * p * (1 - p) + (len(labels) - n) * q * (1 - q)) / len(labels)
                if impurity < best[0]:
                    best = (impurity, f, bound)
    _, f, bound = best
    if f is None:
        return Node(label=bool(share >= 0.5))
    below = rows[:, f] <= bound
    return Node(f, float(bound), grow(rows[below], labels[below], depth - 1, least), grow(rows[~below], labels[~below], depth - 1, least))


def classify(tree: Node, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), bool)
    for k, row in enumerate(rows):
        node = tree
        while node.feature >= 0:
            node = node.below if row[node.feature] <= node.bound else node.above
        out[k] = node.label
    return out


def main_text(page: str, tree: Node) -> str:
    own = blocks(page)
    return "\n\n".join(b.text for b, main in zip(own, classify(tree, features(own))) if main)


def extracted(page: Column) -> Column:
    """The main text of a page; an empty string for null."""
    tree = grow(*labelled())

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pages], ["html"])
        texts = [main_text(p or "", tree) for part in arrays.slices(batch, "html") for p in part.column(0).to_pylist()]
        return pa.array(texts, pa.string())

    return extract(page)


def extract_text(df: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """``df`` with the main text of each page."""
    return arrays.bounded_batches(df).withColumn(into, extracted(F.col(page)))
