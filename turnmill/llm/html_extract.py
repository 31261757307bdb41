"""HTML extraction: consensus host paths.

1. Each page is read once by a tolerant tokenizer into its text blocks and the
   containers (article, main, section, div, td, body) around them. Boilerplate is
   left out with all in it: by element (nav, header, footer, aside, ...), by role,
   where it is hidden, or where a class or id names it. A name is read as a compound
   (``boilerplate``): "comment-list" and "main-nav" are, "has-sidebar", "no-ads" and
   "social-policy" are not. A form or a named wrapper around an article or main is a
   layout, and stays, where that holds more text than stands outside; so does a form
   without which the page has no text, if it holds a paragraph or main heading.
2. A container's score is its share of the page's letters (outside links and
   boilerplate), times three for article and main, 1.5 for names such as content. From the
   page down, the best container is reached while one below scores ``DESCEND``; an
   article or main ends the way.
3. Each page votes for its best container's generalised path (containers with their
   classes, digits as #). Votes are summed per host and path in Spark, with map-side
   combining; the path with most votes wins its host.
4. Text is cut from the blocks that step 1 wrote down, so no page is read twice: all
   containers on the host's path, and articles beside them. Where that has no text, or
   less than ``LEAST`` of the letters of the page's own best container and no article
   or main, the page's own best path is taken instead.

Most pages already vote for their host's path. What a page must learn is another
path: only (host, path) pairs that lost, with their winner, meet the pages. They are
broadcast up to ``BROADCAST_BYTES``; beyond that, pairs of ``1 / HOT_PAIRS`` of all pages or more
(so ``HOT_PAIRS`` at most) are broadcast and the others joined by a shuffle, in which
the pages that are done are dealt evenly: no host or layout gathers in one task.

Block elements end a block, white space within a block becomes one space, and
blocks are joined by one space in page order; <br> counts as white space.

Defined cases: null and empty html give an empty text, as do pages of boilerplate alone;
pages without a host in their url use their own best container; null ids stay null;
rows that repeat do so in the result; an empty table gives an empty result. Time and
memory are linear in a page's length, however its tags are nested or left open.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, read_table, slices

# Fixed values of HTML: elements without an end tag, and elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
HEAD = frozenset("title meta link base script style noscript template".split())
SKIP_TAGS = frozenset(
    "nav header footer aside script style noscript template iframe button select textarea input option menu "
    "dialog svg math canvas object audio video head title label fieldset datalist".split()
)
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Words that name boilerplate where a class or id ends with them.
SKIP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner nav navbar "
    "navigation menu menus breadcrumb breadcrumbs header footer masthead sidebar aside widget widgets comment comments "
    "commentlist disqus respond reply replies reactions cookie cookies consent gdpr notice notices notification alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations toolbar pagination pager copyright disclaimer skip hidden".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies reactions".split())
ARTICLE_SKIP = frozenset("ad ads advert promo related sponsored".split()) | COMMENT_NAMES
NO_NAMES: frozenset = frozenset()
#: Last words of a name that say nothing of what is in it: comment-list, related-posts, sidebar-left.
PLAIN_HEADS = frozenset(
    "list lists box block wrap wrapper container area section sections inner outer bar link links item items content "
    "contents panel group row col column left right top bottom primary secondary form body text title heading button "
    "buttons btn icon icons unit slot zone thread count holder region module post posts articles stories cards".split()
)
#: What follows these in a name says how a page is laid out: has-sidebar, post-with-comments, no-ads.
MODIFIERS = frozenset("has have no not non with without hide hides show shows toggle enable enabled use uses".split())
GOOD_NAMES = frozenset("article content post entry main body story text page".split())
#: Elements whose ids are anchors, made from their text.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p a span li dt dd td th tr b i em strong".split())
ROOTS = frozenset(("html", "body", "main"))
CONTAINERS = frozenset("article main section div td body".split())
#: Elements that end tags of inline and paragraph elements do not reach through.
FENCES = frozenset("article main section body td nav header footer aside form".split())
WIDE = CONTAINERS | FENCES
_SCOPES = frozenset("ul ol dl table select div article section main body".split())
_ENDED_BY = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4}

DESCEND = 0.75
LEAST = 0.25
HOT_PAIRS = 1000
BROADCAST_BYTES = 8 << 20
ROOT = "html"

_NAME = r"[A-Za-z][^\s/>]*+"
_SKIPPED = rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</\s*({_NAME})[^>]*+(?:>|\Z)"
#: An end tag, a start tag, a comment, a declaration; an open bracket of none is text.
_TAG = re.compile(rf"{_SKIPPED}|<({_NAME})((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<({_NAME})([^>]*+)(?:>|\Z)", re.S)
#: The same for the rest of a page in which a quote has turned out to be never closed.
_PLAIN_TAG = re.compile(rf"{_SKIPPED}|<({_NAME})([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_END = {name: re.compile(rf"</\s*{name}\b[^>]*+(?:>|\Z)", re.I) for name in RAW}
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=1 << 16)
def boilerplate(name: str, bad: frozenset = SKIP_NAMES) -> str:
    """The word by which a class or an id names boilerplate, or nothing.

    A compound is what its last word says, once plain heads are taken off; from a
    modifier on, it speaks of the page's layout.
    """
    words = [w.lower() for w in _WORDS.split(name) if w]
    for n, word in enumerate(words):
        if word in MODIFIERS:
            words = words[:n]
            break
    while len(words) > 1 and words[-1] in PLAIN_HEADS:
        words.pop()
    return words[-1] if words and words[-1] in bad else ""


def attributes(text: str) -> dict[str, str]:
    """Attributes of a start tag by name; of repeated ones the first."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        found.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
    return found


class Wrapper:
    """An element that looks like boilerplate, but may be the layout around the article."""

    __slots__ = ("comments", "form", "lifted", "outer", "prose")

    def __init__(self, outer: Wrapper | None, comments: bool, form: bool):
        self.outer, self.comments, self.form, self.lifted, self.prose = outer, comments, form, False, False


class Box:
    """A container: its step in a path, the one around it, the article or main it stands in, its place among those with text."""

    __slots__ = ("article", "named", "place", "step", "up", "weight", "wrapper")

    def __init__(self, step: str, up: Box | None, named: bool, weight: float, wrapper: Wrapper | None):
        self.step, self.up, self.named, self.weight, self.wrapper, self.place = step, up, named, weight, wrapper, -1
        self.article: Box | None = self if named else up.article if up is not None else None


class Element:
    """An element that stands open."""

    __slots__ = ("box", "drop", "ends", "link", "tag", "wrapper")

    def __init__(self, tag: str, box: Box, drop: bool, link: bool, wrapper: Wrapper | None, ends: tuple):
        self.tag, self.box, self.drop, self.link, self.wrapper, self.ends = tag, box, drop, link, wrapper, ends


def _ends(ends: tuple, tag: str, place: int) -> tuple:
    """Places on the stack of the open p, li, dt or dd, tr, and td or th that a tag to come would end."""
    if tag in _SCOPES:
        return (-1, -1, -1, -1, -1)
    if tag not in BLOCKS:
        return ends
    got = [-1, *ends[1:]]
    if tag == "p":
        got[0] = place
    elif tag in _ENDED_BY:
        at = _ENDED_BY[tag]
        got[at] = place
        if at == 3:
            got[4] = -1
        elif at == 4:
            got[1] = got[2] = -1
    return tuple(got)


def _opened(tag: str, attrs: str, top: Element, place: int) -> Element:
    """The element of a start tag below ``top``."""
    given = attributes(attrs) if attrs and not attrs.isspace() else {}
    classes = given.get("class", "").split()
    role = given.get("role", "").strip().lower()
    drop, wrapper = top.drop, top.wrapper
    if not drop and tag not in ROOTS:
        hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(given.get("style", ""))
        drop = tag in SKIP_TAGS or role in SKIP_ROLES or bool(hidden)
        bad = ARTICLE_SKIP if tag == "article" else SKIP_NAMES
        names = classes if tag in ANCHORED else [*classes, given.get("id", "")]
        words = [w for w in (boilerplate(n, bad) for n in names) if w]
        if words and tag not in BLOCKS:
            drop = True
        elif words or tag == "form":
            wrapper = Wrapper(wrapper, not COMMENT_NAMES.isdisjoint(words), not words)
        elif wrapper is not None and tag in ("p", "h1"):
            wrapper.prose = True
    box = top.box
    if tag in CONTAINERS:
        named = tag in ("article", "main") or role in ("article", "main")
        good = any(not GOOD_NAMES.isdisjoint(_WORDS.split(n.lower())) for n in (*classes, given.get("id", "")))
        step = tag + "".join("." + _DIGITS.sub("#", c) for c in sorted(set(classes)))
        box = Box(step, box, named, 3.0 if named else 1.5 if good else 1.0, wrapper)
    link = top.link or (tag == "a" and "href" in given)
    return Element(tag, box, drop, link, wrapper, _ends(top.ends, tag, place))


def _read(text: str) -> list[tuple[str, Box, int, Wrapper | None]]:
    """Blocks of a page outside boilerplate: text, container, letters in links, innermost wrapper."""
    stack = [Element(ROOT, Box(ROOT, None, False, 1.0, None), False, False, None, (-1,) * 5)]
    open_tags: Counter = Counter()
    within: list[Counter] = [Counter()]  # open tags inside each open fence
    blocks: list[tuple[str, Box, int, Wrapper | None]] = []
    parts: list[str] = []
    links, holder, pattern = 0, stack[0], _TAG

    def close_block() -> None:
        nonlocal links
        if parts:
            block = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            parts.clear()
            if block:
                blocks.append((block, holder.box, min(links, len(block)), holder.wrapper))
        links = 0

    def cut(place: int) -> None:
        while len(stack) > place:
            tag = stack.pop().tag
            open_tags[tag] -= 1
            if tag in FENCES:
                within.pop()
            else:
                within[-1][tag] -= 1

    at, end = 0, len(text)
    while at < end:
        m = pattern.search(text, at)
        stop = m.start() if m else end
        top = stack[-1]
        if stop > at and not top.drop:
            if not parts:
                holder = top
            parts.append(text[at:stop])
            if top.link:
                links += stop - at
        if not m:
            break
        at = m.end()
        name = m.group(1)
        if name:
            name = name.lower()
            if name in BLOCKS:
                close_block()
            # A stray end tag closes nothing; one of an inline element does not reach through a fence.
            if open_tags[name] if name in WIDE else within[-1][name]:
                while stack[-1].tag != name:
                    cut(len(stack) - 1)
                cut(len(stack) - 1)
            continue
        name, attrs = m.group(2), m.group(3)
        if name and pattern is _TAG and attrs is None:
            attrs = ""
        if not name and pattern is _TAG and m.group(4):
            name, attrs, pattern = m.group(4), m.group(5), _PLAIN_TAG
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS:
            close_block()
            if stack[-1].ends[0] >= 0:  # a block ends an open paragraph
                cut(stack[-1].ends[0])
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name in VOID or attrs.endswith("/") and name in ("svg", "path", "use", "rect", "circle"):
            continue
        if name == ROOT or name == "body" and open_tags["body"]:
            continue
        if name in RAW:
            close = _RAW_END[name].search(text, at)
            at = close.end() if close else end
            continue
        if open_tags["head"] and name not in HEAD:
            while open_tags["head"]:
                cut(len(stack) - 1)
        place = stack[-1].ends[_ENDED_BY[name]] if name in _ENDED_BY else -1
        if place >= 0:
            cut(place)
        stack.append(_opened(name, attrs, stack[-1], len(stack)))
        open_tags[name] += 1
        if name in FENCES:
            within.append(Counter())
        else:
            within[-1][name] += 1
    close_block()
    return blocks


def _lift(blocks) -> None:
    """Let pass wrappers of an article or main that outweighs what stands outside any, and forms around all there is."""
    outside, held = 0, Counter()
    for block, box, _, wrapper in blocks:
        if wrapper is None:
            outside += len(block)
            if box.article is not None:
                return
        elif box.article is not None:
            held[box.article] += len(block)
    for box in held:
        chain, wrapper = [], box.wrapper
        while wrapper is not None and not wrapper.lifted and not wrapper.comments:
            chain.append(wrapper)
            wrapper = wrapper.outer
        reached = wrapper is None or wrapper.lifted
        for w in chain:
            w.lifted, w.comments = reached and held.total() > outside, not reached
    if not held and not outside:
        for *_, w in blocks:
            w.lifted = w.form and w.prose


class Page:
    """A page's blocks in order, and its containers with those around them first."""

    def __init__(self, text: str | None):
        self.steps: list[str] = []
        self.ups: list[int] = []
        self.blocks: list[str] = []
        self.at: list[int] = []
        blocks = _read(text or "")
        if any(w is not None for *_, w in blocks):
            _lift(blocks)
        boxes: list[Box] = []
        plain: list[int] = []
        kept: dict[int, bool] = {}
        for block, box, links, wrapper in blocks:
            chain = []
            while wrapper is not None and id(wrapper) not in kept:
                chain.append(wrapper)
                wrapper = wrapper.outer
            good = wrapper is None or kept[id(wrapper)]
            for w in reversed(chain):
                good = kept[id(w)] = good and w.lifted
            if not good:
                continue
            way = []
            while box is not None and box.place < 0:
                way.append(box)
                box = box.up
            place = -1 if box is None else box.place
            for b in reversed(way):
                self.ups.append(place)
                self.steps.append(b.step)
                place = b.place = len(boxes)
                boxes.append(b)
                plain.append(0)
            plain[place] += len(block) - links
            self.blocks.append(block)
            self.at.append(place)
        self.path = self._best(boxes, plain)

    def _best(self, boxes: list[Box], letters: list[int]) -> str | None:
        """The generalised path of the best container."""
        if not boxes:
            return None
        inside: list[list[int]] = [[] for _ in boxes]
        for n in range(len(boxes) - 1, 0, -1):
            letters[self.ups[n]] += letters[n]
            inside[self.ups[n]].append(n)
        way = [0]
        while not boxes[way[-1]].named:
            share = [(letters[n] * boxes[n].weight, -n) for n in inside[way[-1]]]
            score, n = max(share, default=(0.0, 0))
            if not score or score < DESCEND * letters[0]:
                break
            way.append(-n)
        return " ".join(self.steps[n] for n in way)


def cut_text(blocks: list[str], at: list[int], steps: list[str], ups: list[int], path: str) -> str:
    """Blocks in page order that stand in a container on ``path``, or in an article beside one."""
    want = path.split(" ")
    depth: list[int] = []  # steps of the path that lead to a container, or -1 off the path
    for step, up in zip(steps, ups):
        before = 0 if up < 0 else depth[up]
        depth.append(before + 1 if 0 <= before < len(want) and want[before] == step else -1)
    beside = {up for d, step, up in zip(depth, steps, ups) if d == len(want) and step.partition(".")[0] == "article"}
    inside: list[bool] = []
    for d, step, up in zip(depth, steps, ups):
        inside.append((up >= 0 and inside[up]) or d == len(want) or (up in beside and step.partition(".")[0] == "article"))
    return " ".join(b for b, n in zip(blocks, at) if inside[n])


def chosen_text(blocks, at, steps, ups, own: str | None, path: str | None) -> tuple[str, bool]:
    """Main text by the host's path where that holds it, else by the page's own; and whether it was the host's."""
    if own is None:
        return "", False
    text = cut_text(blocks, at, steps, ups, own)
    if path is None:
        return text, False
    if path == own:
        return text, True
    got = cut_text(blocks, at, steps, ups, path)
    named = path.rpartition(" ")[2].partition(".")[0] in ("article", "main")
    return (got, True) if got and (named or len(got) >= LEAST * len(text)) else (text, False)


def extract(text: str | None, path: str | None) -> tuple[str, bool]:
    """Main text of a page, and whether the host's path gave it."""
    page = Page(text)
    return chosen_text(page.blocks, page.at, page.steps, page.ups, page.path, path)


def host_of(url: Column) -> Column:
    """The host of a url in lower case; null where it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _parse(batches):
    for batch in slices(batches):
        pages = [Page(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), batch.column("url"), batch.column("host"),
                pa.array([p.path for p in pages], pa.string()), pa.array([p.steps for p in pages], pa.list_(pa.string())),
                pa.array([p.ups for p in pages], pa.list_(pa.int32())), pa.array([p.blocks for p in pages], pa.list_(pa.string())),
                pa.array([p.at for p in pages], pa.list_(pa.int32())),
            ],
            names=["page_id", "url", "host", "own", "steps", "ups", "blocks", "at"],
        )


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, own, steps, ups, blocks, at): each page's blocks, containers and vote."""
    slim = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        host_of(pages["url"]).alias("host"), pages["html"].cast("string").alias("html"),
    )
    kinds = "own string, steps array<string>, ups array<int>, blocks array<string>, at array<int>"
    return slim.mapInArrow(_parse, f"page_id long, url string, host string, {kinds}")


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winning generalised path."""
    return vote_counts(parsed(pages).select("host", "own")).where("own = path").select("host", "path")


def vote_counts(votes: DataFrame) -> DataFrame:
    """(host, own, votes, path): each path voted for, and its host's winner; ties to the smaller path."""
    counts = votes.where("own is not null and host is not null").groupBy("host", "own").agg(F.count("*").alias("votes"))
    counts = materialise(counts, "page-votes")
    best = counts.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("own").alias("path"))).alias("b"))
    return counts.join(best.select(F.col("host").alias("h"), F.col("b.path").alias("path")), F.col("host") == F.col("h")).drop("h")


def _extract(batches):
    for batch in slices(batches):
        columns = ("blocks", "at", "steps", "ups", "own", "path")
        rows = [chosen_text(*r) for r in zip(*(batch.column(c).to_pylist() for c in columns))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), batch.column("url"), pa.array([r[0] for r in rows], pa.string()),
                pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()),
            ],
            names=["page_id", "url", "text", "n_chars", "by_consensus"],
        )


def with_host_path(read: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``read`` with ``path``, its host's winning one; null where it has no vote."""
    paths = vote_counts(read.select("host", "own"))
    total = read.count()
    hot = F.col("votes") * HOT_PAIRS >= total
    lost = materialise(paths.where((F.col("own") != F.col("path")) | hot).withColumn("hot", hot), "lost-paths")
    size = lost.agg(F.sum(F.octet_length("host") + F.octet_length("own") + F.octet_length("path"))).first()[0] or 0
    voted = F.col("host").isNotNull() & F.col("own").isNotNull()

    def meet(rows: DataFrame, pairs: DataFrame, name: str, host: str) -> DataFrame:
        pairs = pairs.select(F.col("host").alias("h"), F.col("own").alias("o"), F.col("path").alias(name))
        return rows.join(pairs, (F.col(host) == F.col("h")) & (F.col("own") == F.col("o")), "left").drop("h", "o")

    if size <= broadcast_bytes:
        met = meet(read, F.broadcast(lost), "found", "host")
    else:
        met = meet(read, F.broadcast(lost.where("hot")), "first", "host")  # HOT_PAIRS rows at most
        done = F.col("first").isNotNull() | ~voted
        spread = F.concat(F.lit("/"), F.xxhash64("page_id", "url", "blocks").cast("string"))
        met = met.withColumn("key", F.when(done, spread).otherwise(F.col("host")))
        met = meet(met, lost.where("not hot"), "second", "key").withColumn("found", F.coalesce("first", "second"))
    # A page whose pair did not lose has voted for the winner.
    path = F.when(voted, F.coalesce("found", "own"))
    return met.select("page_id", "url", "own", "steps", "ups", "blocks", "at", path.alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, by_consensus) of every page."""
    read = materialise(parsed(pages), "pages-read", codec="zstd")
    return with_host_path(read).mapInArrow(_extract, "page_id long, url string, text string, n_chars long, by_consensus boolean")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
