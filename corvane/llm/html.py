"""Main-text extraction by the maximum-scoring run of a page's tokens.

A page is a sequence of tags and words. Tags score negative and words positive, by how often each was
met outside and inside the content of labelled pages. What a word scores also depends on where it
stands (link, list item, heading, ...) and on the elements around it: landmark elements (nav, aside,
...) and the words of class, id and role values are features with weights of their own, the log odds of
text under them to be content, so that words under a menu or an advert score negative. One linear scan
finds the contiguous run of greatest sum, which is the content region; a second one adds up its blocks, and
those that don't come out negative by what stands around them (an advert inside an article does) are the result.

Labelled pages are those whose author marked the content (an <article> or <main> element); the weights
are learned on `SAMPLE` of them, the first by a hash of the page id among all such. `PRIOR_NAMES`
are pseudo-counts, not rules: names that are known to mark boilerplate start as if met outside
`PRIOR_WORDS` times, and what is learned is added. Text under such a name inside a marked article is no evidence for content. Pages are then mapped
one by one; nothing is shuffled and only the weight table (bounded by what `SAMPLE` pages hold) is sent
out.

Defined results: null or empty html, or no text, gives an empty string; unclosed elements end where
their parent ends; an unclosed script or style runs to the end of the page; a comment, too; hidden
elements and those that hold no prose (scripts, styles, form controls, ...) give no text; repeated
rows give repeated results; without labelled pages the prior weights are used; further columns are
ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 256

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
_NAME = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)

_RAW = set("script style template textarea title noscript xmp iframe noembed noframes svg math select option datalist canvas audio video object".split())
_RAW_TEXT = set("script style textarea title xmp iframe noembed noframes".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Landmark elements whose kind says what they hold.
_ZONES = set("nav header footer aside form dialog menu button fieldset".split())
_CONTENT = {"article", "main"}
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Words in class, id or role that are taken to mark boilerplate before anything is learned.
PRIOR_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs comment comments commentlist respond disqus "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login promo promotion promoted "
    "sponsor sponsored sponsors related recommended recommendations share sharing social sidebar widget widgets menu menus nav navbar navigation "
    "navi topbar toolbar footer foot header masthead pagination pager paging tags taglist skip search searchform copyright legal disclaimer "
    "complementary contentinfo reactions replies reply".split()
)
#: Words that begin the name of a part of content (`post-ad`), or end that of a part of anything (`ad-content`), where they say nothing themselves.
_KEEP = set("article content main post entry story body text".split())
#: Of these, words that alone are taken to mark content before anything is learned, and the words that they then count as met inside it.
CONTENT_NAMES, CONTENT_WORDS = ("article", "content", "post", "entry", "story"), 120

Weights = dict[str, float]
#: Words that a prior name counts as met outside of content, and any name as met on either side; how far around zero a name's weight lies.
PRIOR_WORDS, EVEN_WORDS, MOST = 60, 4, 4.0
#: Text under an element of a lesser weight scores negative.
BAD = -1.0
#: What part of that weight each word of such text scores.
BESIDE = 0.3


def _log_odds(inside: float, outside: float) -> float:
    return max(-MOST, min(MOST, math.log((inside + EVEN_WORDS) / (outside + EVEN_WORDS))))


#: Scores before anything is learned.
PRIOR: Weights = {"word:text": 1.0, "word:head": 1.0, "word:item": 0.5, "word:link": -0.6, "tag": -0.3}
PRIOR |= {f"tag:{name}": -0.05 for name in "p br b i em strong span code sup sub h1 h2 h3".split()}
PRIOR |= {f"name:{x}": _log_odds(0, PRIOR_WORDS) for x in PRIOR_NAMES} | {f"element:{x}": _log_odds(0, PRIOR_WORDS) for x in _ZONES}
PRIOR |= {f"element:{x}": _log_odds(PRIOR_WORDS, 0) for x in _CONTENT} | {f"name:{x}": _log_odds(CONTENT_WORDS, 0) for x in CONTENT_NAMES}


def _features(name: str, attributes: str, in_content: bool) -> list[str]:
    """What an element is known by: its kind if that is a landmark (a header inside content is a kind of its own), and the words of its names."""
    out = []
    if name in _ZONES or name in _CONTENT:
        out.append(f"element:{name}" if not (name == "header" and in_content) else "element:header inside")
    for m in _NAME.finditer(attributes):
        for each in (m[1] or m[2] or m[3] or "").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", each).lower()) if w]
            if len(words) > 1:
                # a compound that begins as content does is what its last word says, one that ends so is what the others say
                words = words[-1:] if words[0] in _KEEP else [w for w in words if w not in _KEEP]
            out += [f"name:{w}" for w in words]
    return out


def _element_weight(features: list[str], weights: Weights) -> float:
    """The log odds of an element's names, added up; of its kind, if no name of it is known (`<article class="comment">` is a comment)."""
    names = [weights[f] for f in dict.fromkeys(features) if f.startswith("name:") and f in weights]
    each = names or [weights.get(f, 0.0) for f in features]
    return max(-MOST, min(MOST, sum(each)))


#: A tag or a run of text: ("tag", name) or ("word", place), in marked content?, weight of the elements around, block, features around, words.
Item = tuple[str, str, bool, float, int, tuple[str, ...], int]


def tokens(page: str, weights: Weights = PRIOR) -> tuple[list[Item], list[list[str]]]:
    """Items and blocks (pieces of text) of a page; text that is never shown gives no items."""
    items: list[Item] = []
    blocks: list[list[str]] = [[]]
    # name, weight of this and the elements around, marked content?, hidden?, features of this and those around
    stack: list[tuple[str, float, bool, bool, tuple[str, ...]]] = []
    top = ("", 0.0, False, False, ())
    at, n = 0, len(page)

    def pop_to(depth: int) -> None:
        nonlocal top
        was = top
        del stack[depth:]
        top = stack[-1] if stack else ("", 0.0, False, False, ())
        if (was[1] < BAD or was[3]) != (top[1] < BAD or top[3]):
            fresh()

    def fresh() -> None:
        if blocks[-1]:
            blocks.append([])

    def put(kind: str, name: str, words: int = 0) -> None:
        if not top[3]:
            items.append((kind, name, top[2], top[1], len(blocks) - 1, top[4], words))

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if (piece[0] == "<" and len(piece) > 1) or top[3]:
                continue
            piece = _html.unescape(piece)
            blocks[-1].append(piece)
            if not piece.isspace():
                near = [x[0] for x in stack[-3:]]
                place = "link" if any(x[0] == "a" for x in stack) else "head" if near and near[-1] in ("h1", "h2", "h3", "h4", "h5", "h6") else "item" if not {"li", "td", "dt", "dd"}.isdisjoint(near) else "text"
                put("word", place, len(piece.split()))
            continue
        name = name.lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                put("tag", name)
                pop_to(depth)
            if name in _BLOCKS:
                fresh()
            continue
        if name in _RAW_TEXT:
            end = re.compile(rf"</{name}[^>]*>", re.I).search(page, at)
            if not m[3].endswith("/") or name in ("script", "style"):
                at = end.end() if end else (n if name in ("script", "style", "title") else at)
            put("tag", name)
            continue
        if name == "br" and not top[3]:
            blocks[-1].append("\n")
        features = _features(name, m[3], top[2])
        own = _element_weight(features, weights)
        if name in _BLOCKS:
            if stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            if name in _CONTENT and own > 0 and not top[2]:
                depth = next((i for i, x in enumerate(stack) if x[1] < BAD), None)  # a region that was left open
                if depth is not None:
                    pop_to(depth)
            if name == "li" and any(x[0] == "li" for x in stack[-2:]):
                pop_to(max(i for i, x in enumerate(stack) if x[0] == "li"))
        if name in ("body", "html"):
            features, own = [], 0.0
        if name not in _VOID and not m[3].endswith("/"):
            around = min(own, top[1]) if min(own, top[1]) < BAD else max(own, top[1])
            hidden = top[3] or name in _RAW or bool(_HIDDEN.search(m[3]))
            changes = (around < BAD or hidden) != (top[1] < BAD or top[3])
            top = (name, around, top[2] or name in _CONTENT and around > 0, hidden, (*top[4], *features))
            stack.append(top)
            if changes:
                fresh()
        put("tag", name)
        if name in _BLOCKS:
            fresh()
    return items, blocks


def counts(page: str) -> Counter:
    """(feature, inside the marked content) -> times, for a labelled page; empty for others."""
    items, blocks = tokens(page)
    if not any(x[2] for x in items):
        return Counter()
    out: Counter = Counter()
    for kind, name, inside, around, _, features, words in items:
        if kind == "tag":
            out[f"tag:{name}", inside] += 1
            continue
        out[f"word:{name}", inside] += words
        if not (inside and around < BAD):
            for f in set(features):
                out[f, inside] += words
    return out


def weights_of(seen: Counter) -> Weights:
    """Log odds of standing in content: those of names and landmarks as they are, with their prior; tags negative and words positive (links may turn negative)."""
    weights = dict(PRIOR)
    for kind in ("word", "tag"):
        names = {f for f, _ in seen if f.startswith(kind + ":")}
        total_in = sum(seen[f, True] for f in names) or 1
        total_out = sum(seen[f, False] for f in names) or 1
        for f in names:
            odds = math.log(((seen[f, True] + 1) / (total_in + 2)) / ((seen[f, False] + 1) / (total_out + 2)))
            if kind == "tag":
                weights[f] = min(-0.05, PRIOR["tag"] + 0.25 * odds)
            elif f == "word:link":
                weights[f] = max(-1.0, min(1.0, PRIOR[f] + 0.1 * odds))
            else:
                weights[f] = max(0.05, min(3.0, PRIOR.get(f, 1.0) + 0.1 * odds))
    for f in {f for f, _ in seen if f.startswith(("name:", "element:"))}:
        prior = PRIOR.get(f, 0.0)
        taken = CONTENT_WORDS if f.startswith("name:") else PRIOR_WORDS
        weights[f] = _log_odds(seen[f, True] + taken * (prior > 0), seen[f, False] + PRIOR_WORDS * (prior < 0))
    return weights


def scores(page: str, weights: Weights = PRIOR) -> tuple[list[float], list[Item], dict[int, str]]:
    """The score of each item, the items, and the text of each block that has any."""
    items, blocks = tokens(page, weights)
    texts = {i: " ".join("".join(parts).split()) for i, parts in enumerate(blocks)}
    out = []
    for kind, name, inside, around, _, _, words in items:
        if around < BAD:  # what stands inside marked content doesn't bound it; elsewhere its words speak against the region
            out.append(BESIDE * around * words if kind == "word" and not inside else 0.0)
        elif kind == "tag":
            out.append(weights.get(f"tag:{name}", weights["tag"]))
        else:
            out.append((weights.get(f"word:{name}", weights["word:text"]) + max(0.0, min(1.0, around))) * words)
    return out, items, texts


def best_run(values: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous run of greatest sum; (0, -1) if no sum is positive."""
    best = now = 0.0
    start, span = 0, (0, -1)
    for i, v in enumerate(values):
        if now <= 0:
            now, start = 0.0, i
        now += v
        if now > best:
            best, span = now, (start, i)
    return span


def extract(page: str | None, weights: Weights = PRIOR) -> str:
    """The blocks of the best run, each with single spaces, joined by an empty line."""
    if not page:
        return ""
    values, items, texts = scores(page, weights)
    first, last = best_run(values)
    # the second scan, within the run: a block counts by its words' distance from where boilerplate begins
    inner: dict[int, float] = {}
    for kind, _, _, around, block, _, words in items[first : last + 1]:
        if kind == "word":
            inner[block] = inner.get(block, 0.0) + words * (around - BAD)
    return "\n\n".join(texts[b] for b, v in inner.items() if v >= 0 and texts[b])


def learn(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from `sample` pages with a mark (all, if there are fewer), the first by a hash of page_id among all such; of repeated ids the greatest html."""
    marked = pages.select("page_id", F.col("html").cast("string").alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)[\s/>]"))
    ids = marked.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = marked.join(F.broadcast(ids), "page_id", "left_semi").groupBy("page_id").agg(F.max("html").alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column("html").to_pylist():
                seen.update(counts(page))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())], ["feature", "inside", "n"]
        )

    found = rows.mapInArrow(count, "feature string, inside boolean, n bigint").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    return weights_of(Counter({(r["feature"], r["inside"]): r["n"] for r in found.collect()}))  # as many as `sample` pages hold


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of `pages` (page_id, url, html)."""
    weights = learn(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
