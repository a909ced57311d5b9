"""Main text of web pages by tree scoring, in time that grows with a page's length, however it is formed.

A page becomes a list of elements, parents first, and a list of blocks of text. Elements that are never main text by
their kind (menus, footers, scripts, ...) have no blocks. Others are doubted from 0 to 1: by words of their names (a name of
adverts or comments alone counts fully, words of other kinds beside them dilute it), by their role, by the heading they
begin with, and, where these leave it open, by links, repeated like-shaped parts and calls to act. Doubt discounts the
points of all inside. Much doubt leaves an element out, less does so only outside the main article, and neither does where
it wraps the page's article, its only heading of level one, or all its text. Every block passes points for its length and
commas to the elements around it, half as many at each step up; an element's points are discounted by the share of its text
inside links. The element with most points is the container, or the outermost article or main around it, whose wanted
blocks are all kept; siblings that earn enough, and plain blocks and text beside it, are kept with it. Points, lengths,
doubt and membership are each one pass over the elements, up or down.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm.common import bound_batches, small_batches

# HTML elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
NEVER = frozenset("head nav footer aside script style noscript template iframe svg math canvas audio video object embed button select textarea input title dialog menu noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div body td blockquote html".split())
# An open element (left) ends when one of these (right) starts.
CLOSES = {
    "p": BLOCK,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
# Beyond these no start tag ends anything.
SCOPE = frozenset("table ul ol dl div section article main body html blockquote td th".split())
# Words in class and id names. These name parts that aren't main text, whatever stands beside them, ...
STRONG_NAME = frozenset(
    "ad ads adsbygoogle adsense advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment commentlist comments disqus gdpr login masthead menu menus modal nav navbar navigation newsletter outbrain pager pagination popup promo promoted promotion replies respond sidebar sidebars signup skyscraper sponsor sponsored subscribe subscription taboola toolbar topbar".split()
)
# ... these do alone or with words of place and form, ...
WEAK_NAME = frozenset("consent cookie cookies disclaimer footer header notice notices overlay recommendations recommended related share sharing social widget widgets".split())
# ... these only beside the main article, ...
SLIGHT_NAME = frozenset("discussion discussions feedback reactions responses reviews thread threads".split())
# ... these are words of place and form, which count for nothing, ...
BESIDE_NAME = frozenset(
    "area article bar block bottom box btn button buttons col column container content entry form global group holder inner item items left link links list main page panel policy post posts primary privacy reader right row secondary section site slot stories story text this top unit user wrap wrapper".split()
)
# ... these make a name say what an element has or is about, not what it is, ...
STATE_NAME = frozenset("about category closed has hide is no not open show tag topic type with without".split())
# ... and these name main text.
GOOD_NAME = frozenset("article body content entry hentry main page post story text".split())
# Heads and feet of these belong to them.
OWN_NAME = frozenset("article chapter entry post section story".split())
BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar alert form".split())
# Headings of parts that aren't main text, and calls to act.
HEADING = re.compile(r"(?:\d+ |all |reader |readers' |user )?(?:comments?|replies|responses|reactions)(?: ?\(\d+\))?:?|(?:leave|post|add) a (?:comment|reply)|join the (?:discussion|conversation)|related (?:articles?|posts?|stories|links)|you (?:may|might) also like|recommended(?: for you)?|more from .{1,40}|share (?:this|on).{0,30}|advertisement|sponsored(?: content)?|(?:our )?newsletter|most (?:read|popular)", re.IGNORECASE)
CALL = re.compile(r"\b(?:subscribe|sign up|log in|buy now|shop now|click here|follow us|share this|accept (?:all )?cookies|learn more|read more)\b", re.IGNORECASE)

ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
INVISIBLE = re.compile(r"display\s*:\s*none")
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
#: Open elements that a start tag ends, the other way round than CLOSES.
ENDED_BY: dict[str, list[str]] = {t: [s for s, ends in CLOSES.items() if t in ends] for t in frozenset().union(*CLOSES.values())}

#: Doubts: from the first on, an element is left out anywhere; from the second on, outside the main article; from the third on, its content is looked at.
LEAVE, LEAVE_BESIDE, LOOK = 0.55, 0.45, 0.35
#: What each sign in an element's content adds to its doubt.
SIGN = 0.2
#: A call to act counts in a text up to this long.
CALL_CHARS = 200


class Page:
    """Elements as parallel lists, parents before children: tag, parent, barred (never main text), doubt, good, shape; and blocks (owner, text, characters in links)."""

    def __init__(self) -> None:
        self.tag, self.parent, self.barred, self.doubt, self.good, self.shape = ["#top"], [-1], [False], [0.0], [False], [""]
        self.blocks: list[tuple[int, str, int]] = []
        self.stack, self.open, self.scopes, self.links = [0], {}, [], 0
        self.never = self.articles = 0
        self.block_owners: list[int] = []
        self.parts: list[str] = []
        self.linked: list[str] = []

    def flush(self) -> None:
        """Ends the current block."""
        if self.parts:
            text = clean_text(self.parts)
            if text:
                owner = self.block_owners[-1] if self.block_owners else 0
                self.blocks.append((owner, text, min(len(text), len(clean_text(self.linked))) if self.linked else 0))
            self.parts, self.linked = [], []

    def text(self, piece: str) -> None:
        if not self.never:
            self.parts.append(piece)
            if self.links:
                self.linked.append(piece)

    def add(self, tag: str, attributes: str) -> int:
        node = len(self.tag)
        barred, doubt, good, shape = judged(tag, attributes, self.articles > 0)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.barred.append(barred)
        self.doubt.append(doubt)
        self.good.append(good)
        self.shape.append(shape)
        return node

    def push(self, node: int) -> None:
        tag = self.tag[node]
        if tag in BLOCK:
            self.flush()
            self.block_owners.append(node)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.links += tag == "a"
        self.never += self.barred[node]
        self.articles += tag in ("article", "main")
        self.stack.append(node)

    def cut(self, place: int) -> None:
        """Ends the open elements from a place of the stack on."""
        while len(self.stack) > place:
            node = self.stack[-1]
            tag = self.tag[node]
            if tag in BLOCK:
                self.flush()
                self.block_owners.pop()
            self.open[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            self.links -= tag == "a"
            self.never -= self.barred[node]
            self.articles -= tag in ("article", "main")
            self.stack.pop()

    def start(self, tag: str, attributes: str) -> None:
        scope = self.scopes[-1] if self.scopes else 0
        place = max((self.open[s][-1] for s in ENDED_BY.get(tag, ()) if self.open.get(s)), default=-1)
        if place >= max(scope, 1):
            self.cut(place)
        if tag in ("br", "hr"):
            self.text(" ")
            if tag == "hr":
                self.flush()
            return
        node = self.add(tag, attributes)
        if tag in BLOCK and (tag in VOID or attributes.endswith("/")):
            self.flush()
        elif tag not in VOID and tag not in RAW and not attributes.endswith("/"):
            self.push(node)

    def end(self, tag: str) -> None:
        places = self.open.get(tag)
        # The end of an inline element doesn't end the blocks it is in.
        if places and (tag in BLOCK or places[-1] > (self.scopes[-1] if self.scopes else 0)):
            self.cut(places[-1])


def name_doubt(parts: list[str]) -> float:
    """How far the words of one class or id name speak against main text; single letters and digits say nothing."""
    words = [p for p in parts if len(p) > 1]
    if not STATE_NAME.isdisjoint(words):
        return 0.0
    own = not OWN_NAME.isdisjoint(words)
    against = sum(1.0 if w in STRONG_NAME else 0.6 if w in WEAK_NAME else 0.5 if w in SLIGHT_NAME else 0.0 for w in words if not (own and w in ("header", "footer")))
    other = sum(w not in STRONG_NAME and w not in WEAK_NAME and w not in SLIGHT_NAME and w not in BESIDE_NAME and w not in GOOD_NAME for w in words)
    return min(1.0, against) / (1 + 0.4 * other)


def judged(tag: str, attributes: str, inside: bool) -> tuple[bool, float, bool, str]:
    """(whether an element is never main text, doubt of its names and role, whether its names speak for it, its shape)."""
    if tag in NEVER or (tag == "header" and not inside):
        return True, 0.0, False, tag
    doubt, good, shape = 0.7 if tag == "form" else 0.0, False, tag
    if attributes:
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or INVISIBLE.search(found.get("style", "").lower()):
            return True, 0.0, False, tag
        names = [[p.lower() for p in NAME_PARTS.findall(x)] for x in (found.get("class", "") + " " + found.get("id", "")).split()]
        shape = f"{tag}.{found.get('class', '')}"
        if tag not in ("html", "body", "main"):
            doubt = max(doubt, 0.8 if found.get("role", "").lower() in BAD_ROLE else 0.0, max(map(name_doubt, names), default=0.0))
        good = doubt < LEAVE_BESIDE and any(p in GOOD_NAME for x in names for p in x)
    return False, doubt, good, shape


def parse(page: str) -> Page:
    """The elements and blocks of a page, however badly it is formed. Every step goes on in the page, so time is linear."""
    out = Page()
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in ("\"", "'", ">")}
    while at < n:
        found = page.find("<", at)
        if found < 0 or found > last[">"]:  # no tag can end any more
            out.text(page[at:])
            break
        if found > at:
            out.text(page[at:found])
        at = found
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2 if page.startswith("<!-->", at) else at + 4)
            at = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            end = n if end < 0 else end
            out.text(page[at + 9 : end].replace("&", "&amp;"))
            at = end + 3
        elif page.startswith(("<!", "<?"), at):
            at = page.find(">", at) + 1
        else:
            closing = page.startswith("</", at)
            name = TAG_NAME.match(page, at + 1 + closing)
            if not name:
                out.text("<")
                at += 1
                continue
            stop = name.end()
            while True:
                stop = PLAIN.match(page, stop).end()
                if stop >= n or page[stop] == ">":
                    break
                quote = page[stop]
                stop = page.find(quote, stop + 1) + 1 if stop < last[quote] else stop + 1
            tag, attributes, at = name[0].lower(), page[name.end() : stop], min(n, stop + 1)
            if closing:
                out.end(tag)
                continue
            out.start(tag, attributes)
            if tag in RAW:
                end = RAW_ENDS[tag].search(page, at)
                at = n if not end else (page.find(">", end.end()) + 1 or n)
    out.cut(1)
    out.flush()
    return out


def clean_text(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def doubts(tree: Page, held: list[int], within: list[int], first: list[int]) -> list[float]:
    """Doubt of each element by name, role and first heading, raised by signs in its content where these leave it open."""
    tag, parent, doubt, rest = tree.tag, tree.parent, list(tree.doubt), list(held)
    for i in range(1, len(tag)):
        if tag[i] in ("div", "section") and first[i] < len(tree.blocks):
            owner, text, _ = tree.blocks[first[i]]
            if parent[owner] == i and tag[owner] in ("h2", "h3", "h4", "h5", "h6") and HEADING.fullmatch(text):
                doubt[i] = max(doubt[i], 0.5)
                rest[i] -= len(text)
    unsure = {i: {} for i, d in enumerate(doubt) if LOOK <= d < LEAVE}
    for i in range(1, len(tag)):
        if tag[i] in ("li", "article") or (tag[i] in CONTAINER and tree.shape[i] != tag[i]):
            for above in (parent[i], parent[parent[i]]):  # parts may lie in a list
                if above in unsure:
                    count, chars = unsure[above].get(tree.shape[i], (0, 0))
                    unsure[above][tree.shape[i]] = (count + 1, chars + held[i])
    for i, shapes in unsure.items():
        repeated = any(count > 1 and chars > 0.6 * rest[i] for count, chars in shapes.values())
        called = 0 < held[i] <= CALL_CHARS and CALL.search(tree.blocks[first[i]][1]) is not None
        doubt[i] += SIGN * (repeated + called + (within[i] > 0.5 * rest[i]))
    return doubt


def wrapping(tree: Page, held: list[int], doubt: list[float]) -> list[bool]:
    """Elements that doubt doesn't leave out: around the page's article, around its only h1, or around all its text.

    The article is the longest one, each discounted by the doubt of what it is in; articles inside much doubt, like comments,
    count only if there is no other and no main. Full doubt outweighs an h1 where there is an article.
    """
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    trust, barred = [1.0] * n, list(tree.barred)
    for i in range(1, n):
        trust[i] = trust[parent[i]] * (1 - min(doubt[i], 0.9))
        barred[i] = barred[i] or barred[parent[i]]
    articles = [i for i in range(1, n) if tag[i] == "article" and held[i]]
    mains = [i for i in range(1, n) if tag[i] == "main" and held[i]]
    chosen = max([i for i in articles if trust[i] > 0.5] or mains or articles, key=lambda i: held[i] * trust[i], default=0)
    headings = [i for i in range(1, n) if tag[i] == "h1" and not barred[i]]
    spared = [held[i] == held[0] for i in range(n)]
    i = chosen
    while i > 0:
        spared[i] = True
        i = parent[i]
    i = headings[0] if len(headings) == 1 else 0
    while i > 0:
        spared[i] = spared[i] or not chosen or doubt[i] < 0.75
        i = parent[i]
    return spared


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by line feeds; empty for a null or empty page, or one without text."""
    if not page:
        return ""
    tree = parse(page)
    blocks, tag, parent, n = tree.blocks, tree.tag, tree.parent, len(tree.tag)
    if not blocks:
        return ""
    points = [(1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text)) for _, text, links in blocks]

    # Up: text and links in and below each element, and its first block. Then doubt, and what it can't leave out.
    held, within, first = [0] * n, [0] * n, [len(blocks)] * n
    for k, (owner, text, links) in enumerate(blocks):
        held[owner] += len(text)
        within[owner] += links
        first[owner] = min(first[owner], k)
    for i in range(n - 1, 0, -1):
        held[parent[i]] += held[i]
        within[parent[i]] += within[i]
        first[parent[i]] = min(first[parent[i]], first[i])
    doubt = doubts(tree, held, within, first)
    spared = wrapping(tree, held, doubt)
    out, trust = [False] * n, [1.0] * n
    for i in range(1, n):
        out[i] = out[parent[i]] or (doubt[i] >= LEAVE and not spared[i])
        trust[i] = trust[parent[i]] * (1 if spared[i] else 1 - doubt[i])

    # Up: points at half a step, lengths of text and of links.
    flow, length, linked = [0.0] * n, [0] * n, [0] * n
    for (owner, text, links), p in zip(blocks, points):
        if not out[owner]:
            flow[owner if tag[owner] in CONTAINER or owner == 0 else parent[owner]] += p * trust[owner]
            length[owner] += len(text)
            linked[owner] += links
    for i in range(n - 1, 0, -1):
        up = parent[i]
        flow[up] += flow[i] / 2
        length[up] += length[i]
        linked[up] += linked[i]

    def score(i: int) -> float:
        bonus = 5.0 if tag[i] in ("article", "main") else 2.0 if tree.good[i] else 0.0
        return (flow[i] + bonus) * (1 - linked[i] / max(1, length[i]))

    candidates = [i for i in range(n) if length[i] and (tag[i] in CONTAINER or i == 0)]
    if not candidates:
        return ""
    best = i = max(candidates, key=score)
    core = 0
    while i > 0:
        if tag[i] in ("article", "main"):
            best = i
        core = core or (i if tag[i] in ("article", "main") or tree.good[i] else 0)
        i = parent[i]
    # Down: outside the article, less doubt leaves out.
    core = core or best
    inside = [False] * n
    inside[core] = True
    around = core
    while around > 0:
        spared[around] = True
        around = parent[around]
    for i in range(1, n):
        inside[i] = inside[i] or inside[parent[i]]
        out[i] = out[i] or out[parent[i]] or (doubt[i] >= LEAVE_BESIDE and not inside[i] and not spared[i])
    keep, beside = [False] * n, -1
    keep[best] = True
    if best and tag[best] not in ("body", "html"):
        beside = parent[best]
        least = max(2.0, score(best) * 0.2)
        for i in range(1, n):
            if parent[i] == beside and i != best and length[i] and not out[i]:
                plain = (tag[i] in BLOCK - CONTAINER or tag[i] == tag[best] == "section") and linked[i] < 0.25 * length[i]
                keep[i] = plain or (tag[i] in CONTAINER and flow[i] > 0 and score(i) >= least)
    for i in range(1, n):
        keep[i] = keep[i] or keep[parent[i]]
    return "\n".join(text for owner, text, links in blocks if not out[owner] and (keep[owner] or (owner == beside and links < 0.25 * len(text))))


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns keep, text and n_chars (code points of text), a row for every row of pages.

    Null and empty pages have an empty text. Pages are read whole, however long; repeated rows are kept. Only the named
    columns are read, so others may have any name.
    """
    bound_batches(pages.sparkSession)
    picked = pages.select(*keep, F.col(html).cast("string").alias("__html"))
    fields = [*picked.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__html"):
            texts = [main_text(x) for x in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return picked.mapInArrow(run, T.StructType(fields))
