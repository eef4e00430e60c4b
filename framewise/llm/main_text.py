"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a row of words and tags. A word's weight is the log-odds, over labelled pages, of lying in the main text
given its place (sectioning element, block tag, link), the length of its block and the block's share of links; a
tag's weight is negative, the less so the commoner the tag is in main texts. One linear scan finds the contiguous
stretch of largest total weight. Inside it, elements that their names say to be no part of an article are taken out:
the evidence of a class, id or role word is learned from the same pages, on top of a stated prior for words that the
pages do not show. Labelled pages are those that mark their article in one semantic element (article, main or
itemprop=articleBody). Whether a word stands in such a mark, outside of it, or on a page without one is part of its
place, so what a mark is worth is learned as well.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, tidied

#: Labelled rows that weights are learned from, at most: those of the smallest hashed ids.
SAMPLE_PAGES = 2_000

# Element names of HTML. NAMED ones have weights of their own.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED = BLOCKS | VOID | frozenset("a b i em strong span u small sup sub code".split())
#: Elements whose content is never shown as text; one that is not closed hides nothing.
HIDDEN = frozenset("noscript template iframe svg select".split())
#: Wrappers around text of the page, that say nothing about its place.
WRAPPERS = frozenset("object canvas math param".split())
#: Elements without text of a page, whatever stands around them.
CONTROLS = frozenset("head title button label option legend".split())
#: Elements that are the page's frame: never dropped for their names.
FRAME = frozenset("html body article main".split())
SECTIONS = frozenset("nav header footer aside form dialog menu".split())
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
#: An open element of the first kind ends at a tag of the second.
IMPLIED_ENDS = frozenset("p li tr td th dd dt option".split())

#: Prior evidence of names against (below 0) or for being part of an article: where labelled pages say nothing, it decides.
PRIOR_NAMES = {
    -3.0: "ad ads adsbygoogle advert adverts advertisement advertisements advertorial sidebar nav navbar navigation menu breadcrumb breadcrumbs comment comments commentlist disqus newsletter",
    -2.5: "sponsor sponsored promo promotion popup modal subscribe subscription "
    "signup login masthead topbar toolbar widget widgets social pagination pager paywall respond reply replies contentinfo complementary",
    -2.0: "banner cookie cookies consent gdpr notice alert footer copyright disclaimer related recommended share sharing search searchbox overlay form hidden",
    -1.5: "header side aside site signin leave responses feedback",
    -1.0: "discussion bar reader readers links skip tags button buttons icons",
    -0.5: "posts articles stories",
    0.5: "article post entry story body main text",
}
PRIOR = {name: value for value, names in PRIOR_NAMES.items() for name in names.split()}
#: Parts of names that say how things are laid out.
LAYOUT = frozenset("box slot unit container wrapper wrap area block section inner outer list item items group row col top bottom left right center content in the a an to of our your this for".split())
#: Names that begin with these say how a page is set up, not what an element is.
STATES = frozenset("has with no without show hide".split())
#: Names that say of a section, as its whole heading, what it holds.
HEADING_NAMES = frozenset("advertisement comment comments newsletter sponsored subscribe related articles posts stories reply replies responses leave reader readers".split())
#: An element is taken out when its evidence is below this.
OUT_BELOW = -1.2
#: Evidence of an element most of whose words are links.
LINKED_SHARE, LINKED_EVIDENCE = 0.66, -0.6

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(script|style|textarea)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|$)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>?",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])")


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)} if source else {}


def name_parts(name: str) -> list[str]:
    """Lower-case words of a class, id or role name: 'post-comments2' and 'postComments' -> post, comments; layout words go."""
    parts = [p.lower() for p in PART.findall(name)]
    return [p for p in parts if p not in LAYOUT] if parts and parts[0] not in STATES else []


@dataclass
class Page:
    """A parsed page: elements in the order they open, and nodes, which are texts and tags in page order.

    A node is (element, text or None, tag or None); closing tags start with '/'.
    """

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    block: list[int] = field(default_factory=list)  # nearest block element, itself included; -1: none
    linked: list[bool] = field(default_factory=list)
    quoted: list[bool] = field(default_factory=list)  # in a listing, whose names say what a programme's words are
    section: list[str] = field(default_factory=list)  # nearest sectioning element's tag
    unseen: list[bool] = field(default_factory=list)
    marks: dict[str, list[int]] = field(default_factory=lambda: {"article": [], "main": [], "articlebody": []})
    nodes: list[tuple[int, str | None, str | None]] = field(default_factory=list)

    def add(self, tag: str, parent: int, attrs: Mapping[str, str]) -> int:
        at = len(self.tag)
        named = tuple(x for k in ("class", "id", "role") for x in attrs.get(k, "").split()) if attrs else ()
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(named)
        self.block.append(at if tag in BLOCKS else self.block[parent] if parent >= 0 else -1)
        self.linked.append(tag == "a" or parent >= 0 and self.linked[parent])
        self.quoted.append(parent >= 0 and (self.quoted[parent] or self.tag[parent] in ("pre", "code")))
        self.section.append(tag if tag in SECTIONS else self.section[parent] if parent >= 0 else "")
        hides = bool(attrs) and tag not in FRAME and ("hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""))))
        self.unseen.append(tag in CONTROLS or hides or parent >= 0 and self.unseen[parent])
        if tag in ("article", "main"):
            self.marks[tag].append(at)
        elif attrs and attrs.get("itemprop", "").lower() == "articlebody":
            self.marks["articlebody"].append(at)
        return at


def hidden_ends(tokens: list[re.Match]) -> dict[int, int]:
    """For each start tag of a HIDDEN element that is closed, the place of its end tag among ``tokens``."""
    ends: dict[int, int] = {}
    open_tags: dict[str, list[int]] = {}
    for i, m in enumerate(tokens):
        if m[3] and (tag := m[3].lower()) in HIDDEN:
            if not m[2]:
                if tag != "svg" or not m[4].rstrip().endswith("/"):
                    open_tags.setdefault(tag, []).append(i)
            elif open_tags.get(tag):
                ends[open_tags[tag].pop()] = i
    return ends


def parse(source: str) -> Page:
    """One pass over tags; every tag opens, closes or ends elements at the top of the stack, so the work is linear."""
    page = Page()
    nodes = page.nodes
    stack: list[int] = []  # open elements
    place: dict[int, int] = {}  # where in the stack an open element is
    still_open: Counter = Counter()
    at, resume = 0, 0
    tokens = list(TOKEN.finditer(source))
    ends = hidden_ends(tokens)

    def close_to(size: int) -> None:
        while len(stack) > size:
            e = stack.pop()
            still_open[page.tag[e]] -= 1
            del place[e]

    for i, m in enumerate(tokens):
        if i < resume:  # in a hidden element
            continue
        if m.start() > at:
            nodes.append((stack[-1] if stack else -1, entities.unescape(source[at : m.start()]), None))
        at = m.end()
        if not m[3]:  # a comment, a declaration or an element whose content is no text
            continue
        tag = m[3].lower()
        if tag in HIDDEN:
            if i in ends:
                at, resume = tokens[ends[i]].end(), ends[i] + 1
            continue
        top = stack[-1] if stack else -1
        # tags of formulas and wrappers change no stretch's weight
        silent = tag in WRAPPERS or tag not in NAMED and still_open["math"] > 0
        if m[2]:
            if still_open[tag]:
                while page.tag[stack[-1]] != tag:
                    close_to(len(stack) - 1)
                top = stack[-1]
                close_to(len(stack) - 1)
                if not silent:
                    nodes.append((top, None, "/" + tag))
            elif tag in ("p", "br"):
                nodes.append((page.add(tag, top, {}), None, tag))
            continue
        if tag in IMPLIED_ENDS and top >= 0 and (b := page.block[top]) >= 0 and page.tag[b] == tag and b in place:
            close_to(place[b])
        elif tag == "body" and still_open["head"]:
            while page.tag[stack[-1]] != "head":
                close_to(len(stack) - 1)
            close_to(len(stack) - 1)
        e = page.add(tag, stack[-1] if stack else -1, attributes(m[4]))
        if not silent:
            nodes.append((e, None, tag))
        if tag not in VOID and not m[4].rstrip().endswith("/"):
            place[e] = len(stack)
            stack.append(e)
            still_open[tag] += 1
    if at < len(source):
        nodes.append((stack[-1] if stack else -1, entities.unescape(source[at:]), None))
    return page


@dataclass
class Scored:
    """What a parsed page's nodes weigh, which of them are taken out, and where they stand."""

    page: Page
    counts: list[int]  # words of a node
    out: list[bool]
    places: list[str]  # feature of a node
    state: list[str]  # of a node: in or out of the page's mark, or none
    weights: list[float]


def mark_of(page: Page) -> list[int]:
    """Elements that mark the article: article ones, else main ones, else itemprop=articleBody."""
    return page.marks["article"] or page.marks["main"] or page.marks["articlebody"]


def evidence(names: tuple[str, ...] | list[str], weights: Mapping[str, float], learned_against: bool) -> float:
    """The least mean evidence of a name's words; words that neither prior nor pages know count 0."""
    least = 0.0
    for name in names:
        parts = name_parts(name)
        if parts:
            total = 0.0
            for p in parts:
                learned = weights.get("name:" + p, 0.0)
                total += min(max(PRIOR.get(p, 0.0) + (learned if learned_against else max(learned, 0.0)), -3.0), 1.0)
            least = min(least, total / len(parts))
    return least


def size_class(words: int) -> str:
    return "1" if words < 3 else "3" if words < 8 else "8" if words < 16 else "16"


def link_class(links: int, words: int) -> str:
    return "none" if not links else "few" if 3 * links < words else "some" if 3 * links < 2 * words else "most"


def taken_out(page: Page, weights: Mapping[str, float], inside: list[bool], words: list[int], links: list[int]) -> list[bool]:
    """Elements that are no part of an article by what they are, by their names, or by a parent's.

    What holds the largest mark is never taken out, nor is a form around half of a page without marks.
    """
    n = len(page.tag)
    holds = [False] * n
    marks = mark_of(page)
    if marks:
        p = page.parent[max(marks, key=lambda e: words[e])]
        while p >= 0:
            holds[p] = True
            p = page.parent[p]
    all_words = sum(words[e] for e in range(n) if page.parent[e] < 0)
    out = [False] * n
    for e in range(n):
        tag, parent = page.tag[e], page.parent[e]
        if page.unseen[e] or parent >= 0 and out[parent]:
            out[e] = True
        elif holds[e] or tag in FRAME and tag != "article":
            continue
        elif tag in SECTIONS and not (tag == "header" and inside[e]) and not (tag == "form" and not marks and 2 * words[e] > all_words):
            out[e] = True
        elif page.names[e] and not page.quoted[e] and not (tag == "article" and len(marks) == 1):
            ev = evidence(page.names[e], weights, not inside[e])
            if ev < 0 and words[e] and links[e] > LINKED_SHARE * words[e]:
                ev += LINKED_EVIDENCE
            out[e] = ev < OUT_BELOW
    return out


def titled_out(page: Page, out: list[bool], words: list[int], weights: Mapping[str, float]) -> list[tuple[int, int]]:
    """Stretches of nodes below headings that name reader comments and the like: to the section's end, or to its next heading of their rank."""
    first, last = {}, [-1] * len(page.tag)
    texts: dict[int, list[str]] = {}
    within: dict[int, int] = {}  # element -> heading it lies in
    for i, (e, text, tag) in enumerate(page.nodes):
        if e < 0:
            continue
        last[e] = i
        if tag in HEADINGS:
            first[e] = i
            within[e] = e
        elif tag and tag[0] != "/" and (h := within.get(page.parent[e])) is not None:
            within[e] = h
        elif text is not None and (h := within.get(e)) is not None:
            texts.setdefault(h, []).append(text)
    for e in range(len(page.tag) - 1, -1, -1):
        if (p := page.parent[e]) >= 0:
            last[p] = max(last[p], last[e])
    headings: dict[int, list[int]] = {}
    for h in first:  # a wrapper around the heading alone is not its section
        p, seen = page.parent[h], not out[h]
        while p >= 0 and words[h] and words[p] == words[h] and page.tag[p] not in FRAME:
            seen = seen or page.tag[p] == "header"
            p = page.parent[p]
        if seen and 0 < words[h] <= 6:
            headings.setdefault(p, []).append(h)
    found = []
    for section, own in headings.items():
        upto = -1
        for k, h in enumerate(own):
            if first[h] <= upto:
                continue
            said = [p for p in (p.lower() for p in PART.findall(" ".join(texts.get(h, [])))) if p not in LAYOUT]
            if not said or not all(p in HEADING_NAMES for p in said) or evidence(["-".join(said)], weights, False) >= OUT_BELOW:
                continue
            end = last[section] if section >= 0 else len(page.nodes) - 1
            upto = next((first[own[g]] - 1 for g in range(k + 1, len(own)) if HEADINGS[page.tag[own[g]]] <= HEADINGS[page.tag[h]]), end)
            found.append((first[h], upto))
    found.sort()
    apart: list[tuple[int, int]] = []
    for a, b in found:
        if not apart or a > apart[-1][1]:
            apart.append((a, b))
        elif b > apart[-1][1]:
            apart[-1] = (apart[-1][0], b)
    return apart


def score(source: str, weights: Mapping[str, float]) -> Scored:
    page = parse(source)
    n = len(page.tag)
    inside = [False] * n
    marks = set(mark_of(page))
    for e in range(n):
        p = page.parent[e]
        inside[e] = e in marks or p >= 0 and inside[p]
    counts = [0] * len(page.nodes)
    words, links, in_block, linked_in_block = [0] * n, [0] * n, [0] * (n + 1), [0] * (n + 1)
    for i, (e, text, _) in enumerate(page.nodes):
        if text is not None:
            counts[i] = c = len(text.split())
            if c and e >= 0:
                words[e] += c
                in_block[page.block[e]] += c
                if page.linked[e]:
                    links[e] += c
                    linked_in_block[page.block[e]] += c
    for e in range(n - 1, -1, -1):
        if (p := page.parent[e]) >= 0:
            words[p] += words[e]
            links[p] += links[e]
    out = taken_out(page, weights, inside, words, links)
    node_out = [e >= 0 and out[e] for e, _, _ in page.nodes]
    for a, b in titled_out(page, out, words, weights):
        node_out[a : b + 1] = [True] * (b + 1 - a)
    places, states, scores = [], [], []
    known: dict[tuple, tuple[str, float]] = {}
    for i, (e, text, tag) in enumerate(page.nodes):
        state = "none" if not marks else "in" if e >= 0 and inside[e] else "out"
        section = page.section[e] if e >= 0 and page.section[e] != "form" else ""  # a form that is not taken out is a page's frame
        if text is None:
            key = (section, tag, state)
            if key not in known:
                f = f"<{section} {tag if tag.lstrip('/') in NAMED else '?'}"
                known[key] = f, tag_weight(f, state, weights)
            f, w = known[key]
        else:
            b = page.block[e] if e >= 0 else -1
            linked = e >= 0 and page.linked[e]
            key = (section, page.tag[b] if b >= 0 else "", linked, state, size_class(in_block[b]), link_class(linked_in_block[b], in_block[b]))
            if key not in known:
                f = f"{section} {key[1]}{' a' if linked else ''}"
                known[key] = f, word_weight(f, state, key[4], key[5], weights)
            f, w = known[key]
            w *= counts[i]
        places.append(f)
        states.append(state)
        scores.append(0.0 if node_out[i] else w)
    return Scored(page, counts, node_out, places, states, scores)


#: Weights where labelled pages say nothing: of words in and out of a mark, in a sectioning element, of linked words, of others, and of tags.
UNKNOWN = {"in": 1.5, "out": -3.0, "section": -2.0, "a": -0.5, "word": 1.0, "tag": -0.7, "tag in": -0.1}
#: Weights stay within these bounds, so that no single kind of token decides alone; a tag's are below zero.
WORD_BOUNDS, TAG_BOUNDS, SHAPE_BOUNDS = (-3.0, 2.0), (-2.0, -0.1), (-0.7, 0.7)


def tag_weight(f: str, state: str, weights: Mapping[str, float]) -> float:
    return weights.get(f"{f}|{state}", UNKNOWN["tag in" if state == "in" else "tag"])


def word_weight(f: str, state: str, size: str, links: str, weights: Mapping[str, float]) -> float:
    w = weights.get(f"{f}|{state}")
    if w is None:
        w = UNKNOWN[state] if state != "none" else UNKNOWN["section"] if f[0] != " " else UNKNOWN["a"] if f.endswith(" a") else UNKNOWN["word"]
    if state == "none":
        w += weights.get(f"size {size}", 0.0) + weights.get(f"links {links}", 0.0)
    return min(max(w, WORD_BOUNDS[0]), WORD_BOUNDS[1])


def best_stretch(weights: list[float]) -> tuple[int, int]:
    """The first of the stretches of largest sum, (0, 0) where none is above 0: one pass."""
    best, best_from, best_to, run, start = 0.0, 0, 0, 0.0, 0
    for i, w in enumerate(weights):
        run += w
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, best_from, best_to = run, start, i + 1
    return best_from, best_to


def extract(source: str | None, weights: Mapping[str, float]) -> str:
    """The main text: the best stretch without elements taken out, white space made one space, blocks joined by one space.

    Elements that are taken out weigh nothing in the scan, so that they part no article.
    """
    if not source:
        return ""
    found = score(source, weights)
    a, b = best_stretch(found.weights)
    parts = []
    for (_, text, tag), out in zip(found.page.nodes[a:b], found.out[a:b], strict=True):
        if text is None:
            if tag.lstrip("/") in BLOCKS:
                parts.append("\n")
        elif not out:
            parts.append(text)
    return " ".join("".join(parts).split())


def count_features(source: str) -> tuple[Counter, Counter]:
    """What is inside and outside of a page's mark, by feature; empty unless exactly one element marks the article.

    Words and tags count by place, once for pages with a mark and once for those without; words by their block's length
    and links, but for those in elements taken out, which weigh nothing in a scan. Elements count by the words of their
    names, with the share of their words that is inside; names with a prior against them count only as far as they stand
    outside, as marks wrap their boxes.
    """
    inside, outside = Counter(), Counter()
    found = score(source, {})
    page = found.page
    marks = mark_of(page)
    parts: list[int] = [0] * len(page.tag)
    in_mark = [False] * len(page.tag)
    chosen = set(marks)
    for e in range(len(page.tag)):
        p = page.parent[e]
        in_mark[e] = e in chosen or p >= 0 and in_mark[p]
    if sum(1 for e in marks if not (page.parent[e] >= 0 and in_mark[page.parent[e]])) != 1:
        return inside, outside
    n = len(page.tag)
    total, in_block, linked_in_block = [0] * n, Counter(), Counter()
    for i, (e, text, _) in enumerate(page.nodes):
        if text is not None and e >= 0:
            total[e] += found.counts[i]
            parts[e] += found.counts[i] if found.state[i] == "in" else 0
            in_block[page.block[e]] += found.counts[i]
            linked_in_block[page.block[e]] += found.counts[i] if page.linked[e] else 0
    for i, (e, text, _) in enumerate(page.nodes):
        k = 1 if text is None else found.counts[i]
        if not k or found.out[i]:
            continue
        side = inside if found.state[i] == "in" else outside
        side[f"{found.places[i]}|none"] += k
        side[f"{found.places[i]}|{found.state[i]}"] += k
        if text is not None:
            b = page.block[e] if e >= 0 else -1
            side[f"size {size_class(in_block[b])}"] += k
            side[f"links {link_class(linked_in_block[b], in_block[b])}"] += k
    for e in range(n - 1, -1, -1):
        if (p := page.parent[e]) >= 0:
            total[p] += total[e]
            parts[p] += parts[e]
    for e in range(n):
        if page.names[e] and total[e]:
            share = parts[e] / total[e]
            for p in {p for name in page.names[e] for p in name_parts(name)}:
                if share < 1 or PRIOR.get(p, 0) >= 0:
                    inside[f"name:{p}"] += round(1000 * share)
                    outside[f"name:{p}"] += round(1000 * (1 - share))
    return inside, outside


def weigh(counts: Mapping[str, tuple[int, int]]) -> dict[str, float]:
    """Weights by feature from counts inside and outside of main texts."""
    words = {f: c for f, c in counts.items() if f.startswith("links ")}
    all_in, all_out = (sum(c[k] for c in words.values()) or 1 for k in (0, 1))
    tags = {f: c for f, c in counts.items() if f[0] == "<" and f.endswith("|none")}
    tags_in, tags_out = (sum(c[k] for c in tags.values()) or 1 for k in (0, 1))
    out = {}
    for f, (a, b) in counts.items():
        if f.startswith("name:"):  # thousandths of elements; a few say little
            n = (a + b) / 1000
            value = min(max(math.log((a / 1000 + 0.5) / (b / 1000 + 0.5)), -3.0), 1.0) * n / (n + 5)
        elif f.startswith(("size ", "links ")):
            low, high = SHAPE_BOUNDS
            value = min(max(math.log((a + 1) / all_in) - math.log((b + 1) / all_out), low), high)
        elif f[0] == "<":
            low, high = TAG_BOUNDS
            value = min(max(math.log((a / tags_in + 1e-4) / (b / tags_out + 1e-4)) - 1, low), high)
        else:
            low, high = WORD_BOUNDS
            value = min(max(math.log((a + 1) / (b + 1)), low), high)
        out[f] = value
    return out


def learn_weights(pages: DataFrame, rows: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most ``rows`` rows of pages, of all places and names that these show."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0):
                a, b = count_features(page.as_py() or "")
                inside.update(a)
                outside.update(b)
        found = sorted(set(inside) | set(outside))
        columns = [pa.array(found, pa.string()), pa.array([inside[n] for n in found], pa.int64()), pa.array([outside[n] for n in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "n_in", "n_out"])

    sample = bounded_rows(pages, "page_id", "html", rows)
    counts = sample.select("html").mapInArrow(tidied(run), "feature string, n_in bigint, n_out bigint")
    counts = counts.groupBy("feature").agg(F.sum("n_in").alias("a"), F.sum("n_out").alias("b"))
    return weigh({r["feature"]: (r["a"], r["b"]) for r in counts.collect()})


def extract_main_text(pages: DataFrame, rows: int = SAMPLE_PAGES, weights: Mapping[str, float] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) per row of ``pages``.

    Null and empty pages, and pages without a stretch of positive weight, have an empty text. Repeated rows and null
    ids are extracted row by row; extra columns are not read. A page is parsed whole, in time linear in its length.
    """
    table = dict(weights) if weights is not None else learn_weights(pages, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), table) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(tidied(run), schema)
