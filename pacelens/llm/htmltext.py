"""Main text of HTML pages by a maximum-scoring subsequence of tokens.

A page is read as a sequence of words and tags.  Words score +1, tags score below
zero, and what lies in an element that will be left out scores zero; the contiguous run with the greatest sum is the content region, found in one
linear scan.  Tag scores come from labelled pages: those that declare their content
by an ``article`` or ``main`` element.  For every kind of element (its name, or its
name with a telling class or id) the share of its words that lie in declared content
is counted; a kind with a low share has costly tags, and elements whose kind is
hardly ever content (menus, adverts, forms, ...) are left out of the region, except
where one turns out to be a frame around the content (``Weights.left_out``).  Kinds
that no labelled page shows start from a few pseudo-counts.

Learning reads a hash sample of at most ``most_pages`` pages; every page is
extracted from its whole source.

Defined cases: null html is empty; a page without words has empty text; unclosed
elements end with their parent, stray end tags are ignored, an unfinished tag is
text; from the first tag whose quotes never close, quotes are ignored; reading is
linear in a page's length, however deep it nests; scripts, styles, comments, titles and templates never are; ties between
regions go to the first; repeated rows repeat; further columns are left alone.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelens.llm.common import Shared, map_batches, table

START = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
ATTRIBUTES = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SKIPPED = {"script", "style", "title", "template", "noscript", "textarea", "iframe", "svg", "math", "object", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr td th caption ul".split()
)
DECLARED = {"article", "main"}
#: Element names and class words that page authors use for what is not content.
ASIDE_NAMES = set("nav header footer aside form menu dialog button select fieldset label input".split())
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments reply replies respond disqus discussion "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget toolbar pagination pager skip".split()
)
#: Class words that, beside a word above, name the frame of a page rather than the part itself.
FRAME_WORDS = set("has have with no without page layout wrapper wrap container content contents main body site full grid outer inner".split())
#: Aside elements that may also wrap a whole page.
WRAPPERS = {"form", "header", "fieldset"}
LINKS = {"a", "button", "select", "option", "label"}
PROSE_NAMES = set("article main p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong span section li ul ol dl dt dd td th tr tbody table figure figcaption br a u s code sub sup small q cite mark".split())


def kind_of(name: str, attributes: str) -> str:
    """An element's kind: its name, ``name.word`` with a telling word of its class, id or role, or ``name.word~``
    where the same class name also holds a word for a page's frame."""
    if attributes:
        for found in HINT.finditer(attributes):
            for label in (found[1] or found[2] or found[3] or "").lower().split():
                words = re.split(r"[^a-z]+", label)
                for word in words:
                    if word in ASIDE_WORDS or (word.endswith("s") and word[:-1] in ASIDE_WORDS):
                        return f"{name}.{word}" + "~" * any(w in FRAME_WORDS for w in words)
    return name


def prior(kind: str) -> tuple[float, float]:
    """Pseudo-counts of (content words, other words) of a kind."""
    name, _, word = kind.partition(".")
    if word or name in ASIDE_NAMES:
        return 0.0, 20.0
    return (200.0, 1.0) if name in PROSE_NAMES else (20.0, 1.0)


def events(page: str):
    """('text', text, None), ('open', name, kind) and ('close', name, None) events of a page, in linear time.

    From the first tag whose quotes never close, quotes are ignored and a tag ends at the next ``>``."""
    at, text, last, quotes = 0, 0, page.rfind(">"), True
    while at <= last and (found := START.search(page, at, last + 1)):
        begin, name = found.start(), (found[2] or "").lower()
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            end = len(page) if end < 0 else end + 3
        elif name and quotes and (whole := ATTRIBUTES.match(page, found.end())):
            end = whole.end()
        else:
            quotes = quotes and not name
            end = page.find(">", found.end()) + 1
            if not end:
                at = found.end()
                continue
        if begin > text:
            yield "text", page[text:begin], None
        at = text = end
        if not name:
            continue
        attributes = page[found.end() : end - 1]
        if found[1]:
            yield "close", name, None
        elif name in SKIPPED:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, end)
                over = page.find(">", close.end()) if close else -1
                at = text = over + 1 or len(page)
        else:
            yield "open", name, kind_of(name, attributes)
    if text < len(page):
        yield "text", page[text:], None


class Tree:
    """A page's events, the innermost open element after each, and its elements in opening order; element 0 is the page."""

    def __init__(self, page: str):
        self.events, self.after = [], []
        self.parent, self.name, self.kind, self.first = [-1], [""], [""], [True]
        at, names, kinds = 0, {}, {}
        for event in events(page):
            what, value, kind = event
            if what == "open" and value not in VOID:
                self.parent.append(at)
                self.name.append(value)
                self.kind.append(kind)
                self.first.append(not kinds.get(kind))  # the outermost open element of its kind
                at, names[value], kinds[kind] = len(self.name) - 1, names.get(value, 0) + 1, kinds.get(kind, 0) + 1
            elif what == "close" and names.get(value):
                while True:
                    name = self.name[at]
                    names[name] -= 1
                    kinds[self.kind[at]] -= 1
                    at = self.parent[at]
                    if name == value:
                        break
            self.events.append(event)
            self.after.append(at)

    def inherited(self, own) -> list[bool]:
        """Per element whether ``own`` holds for it or an element around it."""
        found = [False]
        for e in range(1, len(self.name)):
            found.append(found[self.parent[e]] or own(e))
        return found

    def words(self) -> list[int]:
        """Words directly in each element."""
        found = [0] * len(self.name)
        for (what, value, _), at in zip(self.events, self.after):
            if what == "text":
                found[at] += len(value.split())
        return found


class Weights:
    """Content share per kind of element, from counts of words inside and outside declared content."""

    def __init__(self, counts: dict[str, tuple[float, float]]):
        self.share, self.counts = {}, counts

    def of(self, kind: str) -> float:
        if kind not in self.share:
            if len(self.share) > 100_000:
                self.share.clear()
            (a, b), (c, d) = prior(kind), self.counts.get(kind, (0.0, 0.0))
            self.share[kind] = (a + c) / (a + b + c + d)
        return self.share[kind]

    def tag(self, kind: str) -> float:
        return -0.02 - 3.0 * (1.0 - self.of(kind))

    def left_out(self, tree: Tree) -> list[bool]:
        """Per element whether it lies in one that is hardly ever content.

        A heading group inside declared content is content.  An element around the
        page's largest declared content, or one that only looks like an aside (a frame,
        or a kind that no labelled page shows) and holds four times the words around
        it and most of what the frame around it holds, is a frame: its tags score low, and what it holds is judged for itself.
        Words of links do not count for a frame."""
        size, parent, name, kind = len(tree.name), tree.parent, tree.name, tree.kind
        declared = tree.inherited(lambda e: name[e] in DECLARED)
        low = [False] + [
            name[e] not in DECLARED and name[e] not in ("html", "body") and self.of(kind[e]) < 0.2 and not (kind[e] == "header" and declared[parent[e]])
            for e in range(1, size)
        ]
        linked = tree.inherited(lambda e: name[e] in LINKS)
        plain = [0 if linked[e] else n for e, n in enumerate(tree.words())]
        most, held = [0] * size, plain[:]  # the largest single context inside, all words inside
        for e in range(size - 1, 0, -1):
            most[e] = max(most[e], plain[e])
            held[parent[e]] += held[e]
            most[parent[e]] = max(most[parent[e]], most[e])
            if not low[e]:
                plain[parent[e]] += plain[e]
        content = max((e for e in range(1, size) if name[e] in DECLARED), key=lambda e: held[e], default=0)
        around = set()
        if content and held[content] > plain[0]:
            while content:
                around.add(content)
                content = parent[content]
        out, context, largest = [False], [plain[0]], [max(most[0], plain[0])]
        for e in range(1, size):
            up = parent[e]
            frame = low[e] and not out[up] and (
                e in around or ((kind[e].endswith("~") or kind[e] not in self.counts) and (name[e] not in ASIDE_NAMES or name[e] in WRAPPERS) and most[e] > 4 * context[up] and 2 * most[e] > largest[up])
            )
            out.append(out[up] or (low[e] and not frame))
            context.append(plain[e] if frame else context[up])
            largest.append(most[e] if frame else largest[up])
        return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and one past the last index of the first maximum-scoring contiguous run; (0, 0) if none is positive."""
    best, run, start, out = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, out = run, (start, i + 1)
    return out


def extract(page: str | None, weights: Weights) -> str:
    """The main text: blocks of the content region joined by newlines."""
    tree = Tree(page or "")
    left_out, out = weights.left_out(tree), False
    scores, pieces = [], []  # a piece: text to keep, "" for none, None for a block's end
    for (what, value, kind), at in zip(tree.events, tree.after):
        if what == "text":
            scores.append(0.0 if out else float(len(value.split())))
            pieces.append("" if out else entities.unescape(value))
        else:
            inside, out = out, left_out[at]
            scores.append(0.0 if out or (what == "close" and inside) else weights.tag(kind or value))
            pieces.append(None if value in BLOCKS else (" " if value == "br" else ""))
    start, end = best_run(scores)
    blocks, current = [], []
    for piece in [*pieces[start:end], None]:
        if piece is None:
            block = " ".join("".join(current).split())
            if block:
                blocks.append(block)
            current = []
        else:
            current.append(piece)
    return "\n".join(blocks)


def kind_counts(page: str | None) -> dict[str, list[float]]:
    """Words per kind of element inside and outside declared content; nothing for pages without a declaration."""
    counts: dict[str, list[float]] = {}
    tree = Tree(page or "")
    size, parent, name, kind = len(tree.name), tree.parent, tree.name, tree.kind
    declared = tree.inherited(lambda e: name[e] in DECLARED)
    # words in an element that is an aside by its name say nothing about the elements inside it
    aside = tree.inherited(lambda e: name[e] not in DECLARED and not prior(kind[e])[0])
    sums = [[0, 0] for _ in range(size)]
    for e, n in enumerate(tree.words()):
        sums[e][0 if declared[e] else 1] = n
    if not any(inside for inside, _ in sums):
        return {}
    for e in range(size - 1, 0, -1):
        inside, outside = sums[e]
        sums[parent[e]][0] += inside
        sums[parent[e]][1] += outside
        if name[e] not in DECLARED and tree.first[e] and not aside[parent[e]] and inside + outside:
            found = counts.setdefault(kind[e], [0.0, 0.0])
            found[0] += inside
            found[1] += outside
    return counts


def learn(pages: DataFrame, html: str = "html", identifier: str = "page_id", most_pages: int = 4000) -> Weights:
    """Weights from a hash sample of at most ``most_pages`` pages."""
    draw = F.xxhash64(identifier)
    last = pages.select(draw.alias("h")).orderBy("h").limit(most_pages).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return Weights({})

    def count(batches):
        for batch in batches:
            total: dict[str, list[float]] = {}
            for page in batch.column(0).to_pylist():
                for kind, (a, b) in kind_counts(page).items():
                    sums = total.setdefault(kind, [0.0, 0.0])
                    sums[0] += a
                    sums[1] += b
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *[pa.array([v[i] for v in total.values()], pa.float64()) for i in (0, 1)]], names=["kind", "a", "b"])

    sample = pages.where(draw <= last).select(F.col(html).cast("string").alias("html"))
    found = map_batches(sample, count, "kind string, a double, b double").groupBy("kind").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return Weights({r["kind"]: (r["a"], r["b"]) for r in found.orderBy(F.desc(F.col("a") + F.col("b")), "kind").limit(10_000).collect()})


def main_text(pages: DataFrame, weights: Weights, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and the text of every page."""
    shared = Shared(pages.sparkSession, weights)
    rows = pages.select(*[F.col(c) for c in keep], F.col(html).cast("string").alias("_html"))
    out = rows.drop("_html").schema.add("text", "string")

    def run_batches(batches):
        ready = shared.ready(lambda w: Weights(w.counts))
        for batch in batches:
            texts = [extract(p, ready) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return map_batches(rows, run_batches, out)


def run(spark, folder: str) -> DataFrame:
    """op9: the main text of every page."""
    pages = table(spark, folder, "pages")
    return main_text(pages, learn(pages)).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
