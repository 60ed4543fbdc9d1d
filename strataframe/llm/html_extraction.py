"""HTML extraction by minimum-cut labelling.

A page is a sequence of text blocks with their open elements. A classifier gives what it costs to call a block content or
boilerplate: the evidence of its open elements and of their names (fixed values, and what text the given pages hold under
each name), and the log-odds of its density (length, links, place), a logistic regression fitted on
all given pages. No name alone outweighs all that density can say. These costs are the block's capacities to the two
terminals. Smoothness edges join blocks that follow each other, weighted by their distance in the element tree, and blocks
that are next of one parent. The minimum cut is the cheapest labelling; the blocks on the content side are the text.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import drop_written, written

#: Elements that start and end a block, that never have content, and whose content is no text.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe select xmp noembed noframes".split())
#: What an element or a name of its class, id or role says of the text inside, before pages are seen.
AGAINST = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "menu": 6.0, "button": 6.0, "dialog": 6.0, "label": 3.0, "header": 4.0, "noscript": 4.0}
AGAINST_WORDS = re.compile(r"^(ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|foot|header|masthead|topbar|toolbar|cookies?|consent|gdpr|notice\w*|notif\w*|disclaimer|alert\w*|popup|modal|overlay|newsletter|subscri\w*|signup|login|share\w*|sharing|social\w*|related|recommend\w*|comments?|commentlist|disqus|replies|respond|widget\w*|pagination|pager|copyright|legal|complementary|contentinfo|navigation|search\w*|tags?|skip)$")
FOR = {"article": 3.0, "main": 2.5}
FOR_WORDS = re.compile(r"^(article\w*|main|content\w*|post|posts?body|entry|story\w*|body|text)$")
#: Words of a compound name that only say where or what kind of box it is, that turn it into a state of
#: the page, and that make it a term of a topic list.
LAYOUT_WORDS = re.compile(r"^(left|right|top|bottom|main|primary|secondary|site|page|lists?|links?|items?|box|area|wrap|wrapper|container|inner|outer|section|block|slot|bar|body|content|form|buttons?|group|row|col|text|title|thread|panel|unit|region|policy|info|\d+)$")
STATE_WORDS = re.compile(r"^(no|not|has|with|without|is|hide|show|js)$")
TERM_WORDS = re.compile(r"^(tag|category|type|format|status|topic)$")
#: What a name says: alone or all of a compound, its last word, another word of it; and a name for content.
NAME_WHOLE, NAME_LAST, NAME_PART, NAME_FOR = 6.0, 4.0, 2.0, 1.5
#: What an element farther out adds where one farther in has spoken against the text.
FARTHER = 0.5
#: Smoothness: the most an edge between neighbours can cost, and how fast it falls with their distance in the tree.
SMOOTH, SIBLINGS, DECAY = 2.0, 1.0, 0.5
#: The fit: from which evidence on a block is labelled content or boilerplate.
SURE_CONTENT, SURE_BOILERPLATE = 2.5, -4.0
#: What density can say at most, either way: no name alone says as much as lies between.
DENSITY_MOST = 5.0
#: What the density of text seen under a name can say at most; a name must be on so many pages and on one page in so many.
LEARNED_MOST, NAME_PAGES, NAME_SHARE = 2.0, 5, 400
#: So many pages the fixed values weigh in what is learned, of weights and of names.
PRIOR_PAGES, PRIOR_NAME_PAGES = 50.0, 20.0
DENSITY = ("log_words", "link_share", "heading", "in_paragraph", "linked_item", "sentence")
#: Bias and weights of DENSITY where the pages have not both kinds of blocks.
UNFITTED = (-1.5, 0.9, -4.0, 1.5, 0.8, -2.0, 0.0)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
#: A tag with a quote that is never closed.
_OPEN_QUOTE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Text that browsers do not show is none, whatever it says.
HIDDEN = 20.0
_HIDDEN = re.compile(r"""\bhidden\b(?!=)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


class Block:
    __slots__ = ("text", "path", "linked", "heading")

    def __init__(self, text: str, path: tuple, linked: int, heading: bool):
        self.text, self.path, self.linked, self.heading = text, path, linked, heading


def _name_weight(name: str) -> float:
    """What one name, in small letters, says of the text inside."""
    words = [w for w in re.split(r"[_-]+", name) if w]
    against = [bool(AGAINST_WORDS.match(w)) for w in words]
    if not words or STATE_WORDS.match(words[0]):
        return 0.0
    rest = [w for w, bad in zip(words, against, strict=True) if not bad]
    if any(against):
        if all(LAYOUT_WORDS.match(w) for w in rest) and not (len(words) > 1 and TERM_WORDS.match(words[0]) and all(against)):
            return -NAME_WHOLE
        return 0.0 if TERM_WORDS.match(words[0]) else -NAME_LAST if against[-1] else -NAME_PART
    return NAME_FOR if any(FOR_WORDS.match(w) for w in words) and not TERM_WORDS.match(words[0]) else 0.0


@lru_cache(maxsize=1 << 14)
def _element(tag: str, attributes: str) -> tuple[float, tuple[str, ...]]:
    """What one open element says of the text inside, and its names as they are looked up in what was learned."""
    value = FOR.get(tag, 0.0) - AGAINST.get(tag, 0.0)
    names = () if tag in ("p", "li") else (f"<{tag}>",)
    if attributes:
        given = {w for m in _NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}
        said = [_name_weight(w) for w in given]
        if tag not in ("body", "html", "main"):
            value += min(0.0, *said, 0.0)
        value += max(0.0, *said, 0.0)
        if _HIDDEN.search(attributes):
            value -= HIDDEN
        names += tuple(sorted({re.sub(r"\d+", "#", w) for w in given}))
    return value, names


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order. Unclosed, crossed and stray tags are taken as browsers mostly do."""
    out: list[Block] = []
    stack: list[tuple[str, float, int, tuple[str, ...]]] = []
    serial, parts, linked, in_link, at = 0, [], 0, 0, 0

    def end_block() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, tuple(stack), linked, any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t, *_ in stack)))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            m = _OPEN_QUOTE.match(m[0])
        if not m:
            continue
        closing, tag, attributes = bool(m[1]), m[2].lower(), m[3]
        if tag in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                if tag in BLOCK:
                    end_block()
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in ("br", "wbr"):
            parts.append(" " if tag == "br" else "")
        if tag not in BLOCK:
            continue
        end_block()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            in_link = 0
        elif tag not in VOID:
            if stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option") or (stack[-1][0], tag) in (("dt", "dd"), ("dd", "dt"), ("td", "th"), ("th", "td"), ("head", "body"))):
                stack.pop()
            serial += 1
            weight, names = _element(tag, attributes)
            stack.append((tag, weight, serial, names))
    end_block()
    return out


def evidence(block: Block) -> float:
    """What a block's open elements say for (above 0) or against it, from the inside out.

    The nearest element against the text counts whole, others farther out by FARTHER, as do those for it around one
    against it: an advert in an article is an advert. What wraps the main element says nothing of what is inside.
    """
    value, spoken = 0.0, False
    outside = [t for t, *_ in block.path]
    for k in range(len(block.path) - 1, -1, -1):
        tag, weight = block.path[k][:2]
        if tag == "header" and any(t in FOR for t in outside[:k]):
            weight += AGAINST[tag]  # the header of an article holds its title
        value += weight * (FARTHER if spoken and weight > -HIDDEN / 2 else 1.0)
        spoken = spoken or weight < 0
        if tag == "main":
            break
    return value


def learned_evidence(block: Block, learned: dict[str, float]) -> float:
    """What pages have taught of the names of a block's open elements: the most for it and the most against it."""
    said = [learned[n] for *_, names in block.path for n in names if n in learned]
    return max(0.0, *said, 0.0) + min(0.0, *said, 0.0)


def density(block: Block) -> list[float]:
    """The features DENSITY."""
    share = min(1.0, block.linked / max(1, len(block.text)))
    tags = {t for t, *_ in block.path}
    words = min(block.text.count(" ") + 1, 200)
    return [math.log1p(words), share, float(block.heading), float("p" in tags), float("li" in tags and share > 0.5), float(block.text[-1] in ".!?\u2026")]


def score(block: Block, weights: tuple[float, ...], learned: dict[str, float] | None = None) -> float:
    """Log-odds of content."""
    value = weights[0] + sum(w * x for w, x in zip(weights[1:], density(block), strict=True))
    named = evidence(block) + (learned_evidence(block, learned) if learned else 0.0)
    return max(-12.0, min(12.0, named + max(-DENSITY_MOST, min(DENSITY_MOST, value))))


def _apart(a: tuple, b: tuple) -> int:
    """Steps between two places of the element tree."""
    same = 0
    for x, y in zip(a, b, strict=False):
        if x[2] != y[2]:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def min_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling (True: content) that costs least: -score for the wrong side of a block, an edge's weight if cut.

    Blocks whose own cost outweighs all their edges keep their side in some minimum cut, so they are settled first; what
    is left is solved by shortest augmenting paths.
    """
    near: list[dict[int, float]] = [{} for _ in scores]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    own, label = list(scores), [None] * len(scores)
    todo = deque(range(len(scores)))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(own[i]) < sum(near[i].values()) - 1e-12:
            continue
        label[i] = own[i] > 0
        for j, w in near[i].items():
            own[j] += w if label[i] else -w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    rest = [i for i, x in enumerate(label) if x is None]
    if not rest:
        return label
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in rest:
        room[i] = dict(near[i])
        room[i][sink] = max(0.0, -own[i])
        room[sink][i] = 0.0
        room[source][i] = max(0.0, own[i])
        room[i][source] = 0.0
    while True:
        came, queue = {source: source}, deque([source])
        while queue and sink not in came:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-12 and v not in came:
                    came[v] = u
                    queue.append(v)
        if sink not in came:
            break
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        flow = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= flow
            room[v][u] = room[v].get(u, 0.0) + flow
    for i in rest:
        label[i] = i in came
    return label


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """The edges between neighbours in the page and next blocks of one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for n, b in enumerate(blocks):
        if n:
            edges[n - 1, n] = SMOOTH * math.exp(-DECAY * _apart(blocks[n - 1].path, b.path))
        parent = b.path[-2][2] if len(b.path) > 1 else 0
        if parent in last and last[parent] != n - 1:
            edges[last[parent], n] = SIBLINGS
        last[parent] = n
    return edges


def main_text(page: str | None, weights: tuple[float, ...] = UNFITTED, learned: dict[str, float] | None = None) -> str:
    """The content blocks of one page, joined by line feeds."""
    blocks = blocks_of(page or "")
    keep = min_cut([score(b, weights, learned) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


_SEEN = "page binary, x array<array<double>>, label array<double>, named array<array<int>>, names array<string>"


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page with blocks: its digest, the blocks' density, label where evidence decides it, and places of their names in names."""
    for batch in batches:
        rows = []
        for x in batch["_html"]:
            found = blocks_of(x.as_py())
            if found:
                paths = [{n for *_, names in b.path for n in names} for b in found]
                names = sorted(set().union(*paths))
                at = {n: k for k, n in enumerate(names)}
                sure = [evidence(b) for b in found]
                label = [1.0 if e >= SURE_CONTENT else 0.0 if e <= SURE_BOILERPLATE else None for e in sure]
                rows.append((hashlib.blake2b(x.as_py().encode("utf-8", "surrogatepass"), digest_size=16).digest(), [density(b) for b in found], label, [sorted(at[n] for n in p) for p in paths], names))
        kinds = (pa.binary(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["page", "x", "label", "named", "names"])


def _said(weights: tuple[float, ...]):
    """name, d, pages: over the pages of a batch with a name, the sum of the mean densities of a page's blocks under it; null: of all blocks."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str | None, list[float]] = {}
            for x, named, names in zip(*(batch[c].to_pylist() for c in ("x", "named", "names")), strict=True):
                d = [max(-DENSITY_MOST, min(DENSITY_MOST, weights[0] + sum(w * v for w, v in zip(weights[1:], f, strict=True)))) for f in x]
                under: dict[str | None, list[float]] = {None: d}
                for value, places in zip(d, named, strict=True):
                    for k in places:
                        under.setdefault(names[k], []).append(value)
                for name, values in under.items():
                    total = sums.setdefault(name, [0.0, 0])
                    total[0] += sum(values) / len(values)
                    total[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v[0] for v in sums.values()], pa.float64()), pa.array([v[1] for v in sums.values()], pa.int64())], ["name", "d", "pages"])

    return kernel


def fit_costs(pages: DataFrame) -> tuple[tuple[float, ...], dict[str, float]]:
    """Weights of DENSITY and what names say, from all pages (column _html); copies of a page count once.

    Two views teach each other: blocks that names decide train the density, and the density of all blocks under a name,
    against that of all blocks, is what the name has been seen to hold. A page counts once, however long it is, and the
    fixed values count as some pages more, so few pages change little. Blocks of equal features and label are one row of
    the regression, which weighs as many. A name that says something is on NAME_PAGES pages and on one in NAME_SHARE, so
    what the tasks get is bounded by the names of NAME_SHARE pages, however many pages there are.
    """
    seen = written(pages.select("_html").mapInArrow(_labelled, _SEEN).dropDuplicates(["page"]), "html-blocks")
    one = F.explode(F.arrays_zip("x", "label")).alias("b")
    sure = written(seen.select((1.0 / F.size("x")).alias("share"), one).filter("b.label IS NOT NULL").groupBy(F.col("b.x").alias("x"), F.col("b.label").alias("label")).agg(F.sum("share").alias("share")), "html-sure")
    weights = UNFITTED
    if sure.select("label").distinct().count() == 2:
        model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="share", regParam=0.01, maxIter=25).fit(sure.select(array_to_vector("x").alias("features"), "label", "share"))
        taught = seen.filter(F.exists("label", lambda v: v.isNotNull())).count()
        weights = tuple((taught * float(w) + PRIOR_PAGES * v) / (taught + PRIOR_PAGES) for w, v in zip((model.intercept, *model.coefficients), UNFITTED, strict=True))
    least = max(NAME_PAGES, -(-seen.count() // NAME_SHARE))
    said = seen.select("x", "named", "names").mapInArrow(_said(weights), "name string, d double, pages long").groupBy("name").agg(F.sum("d").alias("d"), F.sum("pages").alias("pages"))
    found = {r["name"]: r for r in said.filter(F.col("name").isNull() | (F.col("pages") >= least)).collect()}
    drop_written(seen)
    drop_written(sure)
    if None not in found:
        return weights, {}
    mean = found[None]["d"] / found[None]["pages"]
    value = lambda r: (r["d"] - mean * r["pages"]) / (r["pages"] + PRIOR_NAME_PAGES)
    return weights, {n: max(-LEARNED_MOST, min(LEARNED_MOST, value(r))) for n, r in found.items() if n is not None}


def _kernel(weights: tuple[float, ...], learned: dict[str, float]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x.as_py(), weights, learned) for x in batch["_html"]], pa.string())
            names = [n for n in batch.schema.names if n != "_html"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), text], [*names, "text"])

    return kernel


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The main text of every page.

    Returns pages' columns except html_col, with text and n_chars (its code points) in place of any of that name. Null or
    empty html, and pages without content, have an empty text. Repeated rows are extracted each. Long pages are read
    whole. An empty table gives an empty table. Where no page has a sure block of one kind, all are judged by the weights
    UNFITTED. Copies of a page count once in the fit.
    """
    rest = [c for c in pages.columns if c.lower() not in (html_col.lower(), "text", "n_chars")]
    given = pages.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name != "_html") + ", text string"
    return given.mapInArrow(_kernel(*fit_costs(given.select("_html"))), schema.removeprefix(", ")).withColumn("n_chars", F.length("text").cast("long"))
