"""Main text of web pages: page structure and host suffix arrays.

Each page is cut into text blocks in its own task. Scripts, styles, menus,
headers, footers, sidebars, forms, notices, adverts and comments are left out
by their elements, roles and names. The blocks that remain are brought
together by host, hot hosts in parts of a bounded number of pages; pages with
the same main text count as one everywhere. There the pages' words form one
stream with a suffix array, whose runs that recur on distinct pages say how
far boilerplate goes. Runs of a hot host are counted over all its parts: each
part asks for those that its own pages can't decide. What is boilerplate in an
article is decided over the whole host and all others: a block, or an end of
one, that several distinct pages of a host have and no page of another host,
and that is no heading.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written

#: Pages of one host that are compared in one task, on average.
PART_PAGES = 500
#: Words that a repeated run has at least (a power of two).
RUN_WORDS = 8
#: Distinct pages, and their share of the host's, on which a run recurs that is
#: boilerplate of pages without an article.
PAGES, SHARE = 3, 0.3
#: Distinct pages of the whole host, however large, on which a block, or a run
#: that is half of its block or more and begins or ends it, is boilerplate; if
#: it has at most as many words (a longer one is a passage) and no page of
#: another host has it.
HOST_PAGES, MOST_WORDS = 4, 40
#: Share of an article that is never exceeded: a page's boilerplate is little
#: beside its text, and what would take more is a copied text.
ARTICLE_LOSS = 0.3
DROPPED, MAIN, OTHER = 0, 1, 2
#: What a part is sent: hashes of its host's common blocks and ends; of runs on
#: as many of the host's pages as boilerplate is; of runs on several pages that
#: the part asked for; and, if its runs are counted over the host, the pages of
#: a part from which on a run may be frequent (0: none is looked for).
COMMON, FREQUENT, SHARED, LEAST = 0, 1, 2, 3

# HTML element names by their part in a page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video title textarea select".split())
LEFT_OUT = frozenset("nav footer aside form header menu dialog button head label fieldset datalist".split())
MAIN_PART = frozenset("article main".split())
BLOCKS = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre
    section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tag ends all that is open in them.
NESTED = frozenset("""address article aside blockquote body button center details dialog div dl fieldset figure footer form
    head header hgroup label main menu nav ol section span table ul""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner sidebar nav
    navbar navigation menu footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal
    newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments
    commentlist disqus replies reply respond widget widgets toolbar pagination pager skip copyright disclaimer
    adsbygoogle dfp outbrain taboola tags tagcloud""".split())
# Words beside a name that make no other sense of it.
FORMS = frozenset("""site page top bottom main primary secondary global google mobile desktop sticky header box bar block
    area container wrapper wrap inner list item items link links button buttons icon icons title form posts articles article unit
    slot panel module group section sections user users reader readers thread threads fb facebook iframe frame feed""".split())
# Last words of names for a kind of page, not for a part of one, and names of
# the head of a page (inside an article a header holds its title).
PAGE_KINDS = frozenset("page template layout body".split())
HEADS = frozenset("header head".split())
REMARKS = frozenset("comment comments commentlist disqus replies reply respond".split())
# Elements that a new block ends if they are open, looked for up to these.
ENDED = frozenset("head p h1 h2 h3 h4 h5 h6 pre".split())
HOLDERS = NESTED - frozenset("span label button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What shows that a form is not a part of the page but goes around it.
WIDE = frozenset("article main nav".split())
# Elements whose end tags may be missing: those that their start tags end, up
# to the element that holds them.
ROWS = frozenset("caption thead tbody tfoot tr td th".split())
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "caption"}, "th": {"td", "th", "caption"},
         "tr": {"tr", "td", "th", "caption"}, "thead": ROWS, "tbody": ROWS, "tfoot": ROWS}
SCOPES = {"li": frozenset("ul ol menu dir".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])} | {x: frozenset(["table"]) for x in ROWS}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>",
    re.S | re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def named(value: str, in_main: bool) -> str:
    """Whether a class or id says what is no main text ("remark", "name" or
    ""): a whole word of it is such a name, or made of such names and of words
    for a place or a form (``site-footer``; not ``has-sidebar``, and not
    ``comment-page``, which is a kind of page). Outside of an article a word
    for the head of a page is such a name."""
    for word in value.split():
        order = [p.lower() for p in NAME_PART.findall(word) if len(p) > 1]
        parts = set(order)
        if len(order) > 1 and order[-1] in PAGE_KINDS or not parts <= NAMES | FORMS | HEADS:
            continue
        if not REMARKS.isdisjoint(parts):
            return "remark"
        if not NAMES.isdisjoint(parts) or not in_main and not HEADS.isdisjoint(parts):
            return "name"
    return ""


def left_out(name: str, more: str, in_main: bool) -> str:
    """Why an element is no part of the main text ("" if it may be): "hidden",
    "form", "element" (or role), "remark" (a reader's) or "name". A header
    inside an article holds its title and stays."""
    why = ""
    if name in LEFT_OUT and not (name == "header" and in_main):
        why = "form" if name == "form" else "element"
    if not more or name in ("body", "html"):
        return why
    for key, value in ATTRIBUTE.findall(more):
        key, value = key.lower(), value.strip("\"'")
        if key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "hidden"
        if key == "role" and value.lower() in ROLES:
            why = why or "element"
        if key in ("class", "id"):
            why = why or named(value, in_main)
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", QUOTED.sub("", more), re.I):
        return "hidden"
    return why


class Title(str):
    """The text of a block that is a heading."""


class Cut:
    """An element that is left out, ``outer`` the one around it."""

    def __init__(self, why: str, outer: Cut | None):
        self.why, self.outer, self.closed, self.wide = why, outer, False, False

    def around(self) -> bool:
        """Whether it is a form around the page (or several elements such)."""
        return self.wide and self.why == "form" and (self.outer is None or self.outer.around())

    def stays(self, alone: bool) -> bool:
        """Whether an article in it stays (of a form: all that it holds);
        ``alone``: if the page has no other text. One in a menu or aside stays
        if that was never closed, a reader's remark only alone."""
        own = {"hidden": False, "form": self.wide, "element": alone or not self.closed, "remark": alone, "name": True}[self.why]
        return own and (self.outer is None or self.outer.stays(alone))


def tags(page: str):
    """(start, end, name, whether an end tag, attributes) of the tags and
    comments of a page; script, style and the like with all they hold.

    Without its end tag such an element is its start tag only, but a script or
    style goes on to the end of the page. A self-closed drawing or formula is
    empty.
    """
    at, endless = 0, set()
    while m := TOKEN.search(page, at):
        name, at = (m["name"] or "").lower(), m.end()
        if name in RAW and not m["end"] and name not in endless and not (name in ("svg", "math") and m["more"].endswith("/")):
            if end := RAW_END[name].search(page, at):
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                endless.add(name)  # none further on either
        yield m.start(), at, name, bool(m["end"]), m["more"]


def implied_end(stack: list[tuple[str, int, Cut | None]], name: str, is_end: bool) -> int | None:
    """How many open elements stay where a start tag ends an element that has
    no end tag, or an end tag its own element."""
    if is_end:
        ends, within = (name,), () if name in NESTED else SCOPES.get(name, HOLDERS)
    elif name in ITEMS:
        ends, within = ITEMS[name], SCOPES[name]
    elif name in BLOCKS:
        ends, within = ENDED, HOLDERS
    else:
        return None
    found = None
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in ends:
            found = i
            if is_end or name not in ITEMS:
                break
        elif stack[i][0] in within:
            break
    return found


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(part, text) of the page's text blocks in order, dropped ones left out;
    the text of a heading is a ``Title``."""
    out: list[tuple[int, str, Cut | None]] = []
    stack: list[tuple[str, int, Cut | None]] = []  # open elements, the part they make and what they are cut by
    pieces: list[str] = []
    part, cut, at = OTHER, None, 0

    def close():
        if pieces:
            if part != DROPPED:
                text = " ".join(html.unescape("".join(pieces)).split())
                if text:
                    title = any(name in HEADINGS for name, _, _ in stack)
                    out.append((part, Title(text) if title else text, cut))
            pieces.clear()

    def end_at(i: int, is_end: bool):
        nonlocal part, cut
        own = stack[i][2]
        if is_end and own is not (stack[i - 1][2] if i else None):
            own.closed = True
        del stack[i:]
        after, by = stack[-1][1:] if stack else (OTHER, None)
        if after != part or by is not cut:
            close()
        part, cut = after, by

    for start, end, name, is_end, more in tags(page):
        if start > at:
            pieces.append(page[at:start])
        at = end
        if not name:
            continue
        if name in BLOCKS:
            close()
        if name == "input" and "__viewstate" in more.lower() or name in WIDE and not is_end:
            outer = cut
            while outer is not None:
                outer.wide = True
                outer = outer.outer
        if name in VOID or name not in NESTED and name not in BLOCKS:
            continue
        i = implied_end(stack, name, is_end)
        if i is not None:
            end_at(i, is_end)
        if is_end:
            continue
        why = left_out(name, more, part == MAIN)
        if name in MAIN_PART and why == "name":
            why = ""
        if why or name in MAIN_PART:
            close()
        if why:
            cut = Cut(why, cut)
        if name in MAIN_PART:
            part = MAIN
        elif why and why != "form":
            part = DROPPED
        stack.append((name, part, cut))
    pieces.append(page[at:])
    close()
    kept = ([x for x in out if x[2] is None or x[2].stays(False)]
            or [x for x in out if x[2].stays(x[0] == MAIN)])
    # Beside an article inside what is left out, the rest of the page counts too.
    sure = any(p == MAIN and (by is None or by.around()) for p, _, by in kept)
    return [(p if sure else OTHER, text) for p, text, by in kept]


def repeated_runs(words: np.ndarray, pages: np.ndarray, length: int = RUN_WORDS) -> np.ndarray:
    """For each place of the stream, the number of distinct pages that share
    the ``length`` words from there on (1: the run is unique).

    Prefix doubling sorts the suffixes by their first 1, 2, 4 ... words; equal
    ranks are neighbours in the suffix array with a common prefix of that
    length. ``words`` holds a number of its own after each block, so no shared
    run crosses one.
    """
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < length:
        after = np.r_[rank[step:], np.full(min(step, len(rank)), -1)] + 1
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    suffixes = np.lexsort((pages, rank))
    r, p = rank[suffixes], pages[suffixes]
    new_page = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])][:len(r)]
    return np.bincount(r, weights=new_page, minlength=1)[rank].astype(np.int64)


def hash_of(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def ends_of(words: list[str]) -> list[int]:
    """Hashes of a block, of its first and of its last ``RUN_WORDS`` words."""
    whole = [("=", words)] if len(words) <= MOST_WORDS else []
    ends = [("<", words[:RUN_WORDS]), (">", words[-RUN_WORDS:])] if len(words) > RUN_WORDS else []
    return [hash_of(" ".join([kind, *x])) for kind, x in whole + ends]


def main_blocks(blocks: list[tuple[int, str]]) -> list[str]:
    """The blocks of a page's article, or all where it has none."""
    return [text for part, text in blocks if part == MAIN] or [text for _, text in blocks]


def page_ends(blocks: list[tuple[int, str]]) -> dict[int, set[int]]:
    """The hashes of a page's main text, without its headings; those of ends
    with what stands for the blocks that have them. One value for a hash on all
    pages says that these are one block that is common as a whole, or blocks so
    long that an end is less than half: no other words need be looked at."""
    found: dict[int, set[int]] = {}
    for text in main_blocks(blocks):
        if isinstance(text, Title):
            continue
        words = text.split(" ")
        hashes = ends_of(words)
        for h in hashes:
            found.setdefault(h, set())
        if len(words) > RUN_WORDS:
            block = {hashes[0]} if len(words) <= MOST_WORDS else {1, 2} if len(words) <= 2 * MOST_WORDS else {0}
            for h in hashes[-2:]:
                found[h] |= block
    return found


def main_key(blocks: list[tuple[int, str]]) -> int:
    """Hash of a page's main text: pages with the same one count as one."""
    return hash_of("\n".join(main_blocks(blocks)))


class Runs:
    """The words of the blocks of pages as one stream; ``of`` has the number of
    each page's main text. A run begins at each place with ``RUN_WORDS`` words
    of a block from there on; a shorter block is a run as a whole."""

    def __init__(self, pages: list[list[tuple[int, str]]], of: list[int]):
        self.pages = len(set(of))
        self.flat = [(n, part, text) for n, blocks in zip(of, pages) for part, text in blocks]
        self.split = [text.split(" ") for _, _, text in self.flat]
        self.size = np.array([len(x) for x in self.split], np.int64)
        self.starts = np.cumsum(self.size + 1) - self.size - 1
        number: dict[str, int] = {}
        self.words = np.fromiter((number.setdefault(w, len(number)) for x in self.split for w in [*x, ""]), np.int64, int(self.size.sum()) + len(self.flat))
        self.distinct = list(number)
        self.of = np.repeat(np.array([n for n, _, _ in self.flat], np.int64), self.size + 1)
        #: Words of the block from each place on (0 behind it).
        self.left = np.repeat(self.starts + self.size, self.size + 1) - np.arange(len(self.words))
        self.begins = self.left >= RUN_WORDS
        self.begins[self.starts[self.size < RUN_WORDS]] = True

    @cached_property
    def shared(self) -> np.ndarray:
        """The number of distinct main texts with the run that begins at each place."""
        if not len(self.flat):
            return self.words
        words = self.words.copy()
        words[self.left == 0] = len(self.distinct) + np.arange(len(self.flat))  # a word of its own after each block
        shared = repeated_runs(words, self.of)
        # Blocks too short for a run are compared as a whole.
        short: dict[str, set[int]] = {}
        for (n, _, text), k in zip(self.flat, self.size):
            if k < RUN_WORDS:
                short.setdefault(text, set()).add(n)
        for b in np.flatnonzero(self.size < RUN_WORDS):
            shared[self.starts[b]] = len(short[self.flat[b][2]])
        return shared

    @cached_property
    def hashes(self) -> np.ndarray:
        """A hash of the run that begins at each place, the same in every task."""
        word = np.array([hash_of(w) for w in self.distinct], np.int64).view(np.uint64)[self.words] if len(self.flat) else self.words.view(np.uint64)
        found = np.minimum(self.left, RUN_WORDS).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(RUN_WORDS):
            at = np.flatnonzero(self.left > j)
            found[at] += word[at + j] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
        return (found ^ (found >> np.uint64(31))).view(np.int64)


def stream(pages: list[list[tuple[int, str]]]) -> tuple[Runs, list, list[int]]:
    """The runs of the different ones among ``pages``, these, and the place
    among them of each page."""
    place: dict[tuple, int] = {}
    of_page = [place.setdefault(tuple(blocks), len(place)) for blocks in pages]
    first = {k: n for n, k in reversed(list(enumerate(of_page)))}
    different, mains = [pages[first[k]] for k in range(len(place))], {}
    return Runs(different, [mains.setdefault(tuple(main_blocks(b)), len(mains)) for b in different]), different, of_page


def host_texts(pages: list[list[tuple[int, str]]], common: set[int] | None = None,
               found: tuple[np.ndarray, np.ndarray] | None = None) -> list[str]:
    """The main text of each page of one host, or of a part of it; then
    ``common`` has the hashes found on ``HOST_PAGES`` distinct pages of all its
    parts and on no other host, and ``found`` those of the runs that all its
    parts make frequent, and of those that the part shares with others (of
    what it asked for, see ``asked_runs``). Pages with the same main text are one page."""
    runs, different, of_page = stream(pages)
    texts = distinct_texts(different, runs, common, found)
    return [texts[k] for k in of_page]


def asked_runs(pages: list[list[tuple[int, str]]], common: set[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of runs that a part of a host can't decide: those on
    ``least`` of its distinct pages or more, which may be frequent on the host
    (a run is, in one of the parts, on its even share of the pages that it is
    on), and those of blocks that have a common end and go on after it."""
    many = np.zeros(0, np.int64)
    if least:
        runs = stream(pages)[0]
        many = np.unique(runs.hashes[runs.begins & (runs.shared >= least)])
    beside = set()
    for blocks in pages:
        for text in main_blocks(blocks):
            words = text.split(" ")
            if RUN_WORDS < len(words) <= 2 * MOST_WORDS and not isinstance(text, Title):
                hashes = ends_of(words)
                if not (len(words) <= MOST_WORDS and hashes[0] in common) and not common.isdisjoint(hashes[-2:]):
                    beside.add(text)
    runs = Runs([[(MAIN, text)] for text in beside], list(range(len(beside))))
    return many, np.unique(runs.hashes[runs.begins])


def distinct_texts(pages: list[list[tuple[int, str]]], runs: Runs, common: set[int] | None,
                   found: tuple[np.ndarray, np.ndarray] | None) -> list[str]:
    """``host_texts`` of different pages."""
    flat, split, size, starts = runs.flat, runs.split, runs.size, runs.starts
    if common is None:
        on = {(h, flat[b][0]) for b, blocks in zip(np.cumsum([0, *map(len, pages)]), pages) for h in page_ends(blocks)}
        common = {h for h, k in Counter(h for h, _ in on).items() if k >= HOST_PAGES}
    if found is None:
        frequent, together = runs.shared >= max(PAGES, SHARE * runs.pages), runs.shared > 1
    else:
        frequent, together = (np.isin(runs.hashes, x) if len(x) else np.zeros(len(runs.words), bool) for x in found)
        together |= frequent | (runs.shared > 1)

    def unique(b: int) -> np.ndarray:
        """Which words of block ``b`` no frequent run covers."""
        s, k = starts[b], size[b]
        if k < RUN_WORDS:
            return np.full(k, not frequent[s])
        begins = np.flatnonzero(frequent[s:s + k - RUN_WORDS + 1])
        change = np.zeros(k + 1, np.int64)
        np.add.at(change, begins, 1)
        np.add.at(change, begins + RUN_WORDS, -1)
        return np.cumsum(change[:k]) == 0

    def own(i: int) -> np.ndarray:
        """Which words of block ``i`` the host's common blocks and ends of
        blocks do not cover. A common end goes on as far as pages of the host
        share its words. Headings stay."""
        k, keep = size[i], np.full(size[i], True)
        if isinstance(flat[i][2], Title) or common.isdisjoint(hashes := ends_of(split[i])):
            return keep
        if k <= MOST_WORDS and hashes[0] in common:
            return ~keep
        if k > RUN_WORDS:
            alone = np.r_[~together[starts[i]:starts[i] + k - RUN_WORDS + 1], True]
            if hashes[-2] in common:
                keep[:RUN_WORDS + max(int(alone.argmax()) - 1, 0)] = False
            if hashes[-1] in common:
                keep[k - RUN_WORDS - max(int(alone[-2::-1].argmax() if alone[:-1].any() else k - RUN_WORDS + 1) - 1, 0):] = False
        gone = int((~keep).sum())
        return keep if k <= 2 * gone and gone <= MOST_WORDS else np.full(k, True)

    def without_common(blocks: list[int], most: float) -> list[np.ndarray]:
        """``own`` of a page's blocks; all stays where more than ``most`` of
        the words would go. Of blocks too short for a run only the first and
        the last ones go: in between they are headings."""
        keep = [own(i) for i in blocks]
        edge = set()
        for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
            for j in order:
                if keep[j].any():
                    break
                edge.add(j)
        keep = [np.full(size[i], True) if size[i] < RUN_WORDS and j not in edge else x for j, (i, x) in enumerate(zip(blocks, keep))]
        if sum((~x).sum() for x in keep) > most * sum(size[i] for i in blocks):
            return [np.full(size[i], True) for i in blocks]
        return keep

    out, b = [], 0
    for blocks in pages:
        mine = range(b, b + len(blocks))
        b += len(blocks)
        main = [i for i in mine if flat[i][1] == MAIN]
        if main:
            keep, most = [np.full(size[i], True) for i in main], ARTICLE_LOSS
        else:
            main = list(mine)
            keep = [unique(i) for i in main]
            most = 1 - 1e-9  # not the whole page
        if common:
            both = [x & y for x, y in zip(keep, without_common(main, most))]
            if sum((~x).sum() for x in both) <= most * sum(size[i] for i in main):
                keep = both
        out.append(" ".join(w for i, k in zip(main, keep) for w, stays in zip(split[i], k.tolist()) if stays))
    return out


def unpacked(packed, sizes) -> list[list[tuple[int, str]]]:
    """The blocks of pages as ``main_texts`` packs them."""
    return [[(kind, Title(text) if title else text) for kind, text, title in json.loads(pa.decompress(x, decompressed_size=n, codec="zstd", asbytes=True))]
            for x, n in zip(packed, sizes)]


def sent_hashes(sent: pd.DataFrame, kind: int) -> np.ndarray:
    return sent["hash"].to_numpy(np.int64)[sent["kind"].to_numpy(np.int64) == kind]


def host_runs(dealt: DataFrame, sent: DataFrame, wide: DataFrame) -> DataFrame:
    """What the parts of the hosts of ``wide`` are sent (host, part, hash,
    kind) beside ``sent``, the common hashes: which runs that a part asks for
    are frequent or shared on the whole host. ``dealt`` has these hosts' pages
    and parts. Only runs that are asked for are counted; where they are few,
    they are broadcast and no other run is shuffled."""
    def ask(key, pdf: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame()
        least = sent_hashes(sent, LEAST)
        many, beside = asked_runs(unpacked(pdf["blocks"], pdf["size"]), set(sent_hashes(sent, COMMON).tolist()), int(least.max(initial=0)))
        return pd.DataFrame({"host": key[0], "part": key[1], "hash": np.r_[many, beside], "kind": np.repeat([FREQUENT, SHARED], [len(many), len(beside)])})

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PART_PAGES):
                some = batch.slice(at, PART_PAGES)
                pages = unpacked(some.column(1).to_pylist(), some.column(2).to_pylist())
                runs = Runs(pages, list(range(len(pages))))
                of, hashes = runs.of[runs.begins], runs.hashes[runs.begins]
                offsets = np.searchsorted(of, np.arange(len(pages) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([main_key(b) for b in pages], pa.int64()), pa.ListArray.from_arrays(offsets, hashes)],
                                                 names=["host", "main", "hashes"])

    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    least = F.when(F.col("bare"), F.ceil(F.col("most") / F.col("parts"))).otherwise(0)
    limits = wide.select("host", every, least.alias("hash"), F.lit(LEAST).alias("kind"))
    known = sent.join(wide.select("host"), "host", "left_semi").unionByName(limits)
    asked = written(dealt.repartition("host", "part").groupBy("host", "part").cogroup(known.repartition("host", "part").groupBy("host", "part"))
                    .applyInPandas(ask, "host long, part int, hash long, kind int"), "asked")
    keys = written(asked.select("host", "hash").distinct(), "keys")
    found = dealt.select("host", "blocks", "size").mapInArrow(count, "host long, main long, hashes array<long>")
    pages = (found.select("host", "main", F.explode("hashes").alias("hash")).join(keys, ["host", "hash"], "left_semi")
             .groupBy("host", "hash").agg(F.count_distinct("main").alias("n")))
    pages = written(pages.filter("n > 1"), "runs")
    frequent = pages.join(wide.filter("bare"), "host").filter("n >= most").select("host", every, "hash", F.lit(FREQUENT).alias("kind"))
    shared = asked.filter(F.col("kind") == SHARED).join(pages, ["host", "hash"], "left_semi").select("host", "part", "hash", "kind")
    return limits.unionByName(frequent).unionByName(shared)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               part_pages: int = PART_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null html counts as empty and gives an empty text. Pages without a url
    share the empty host. An article or main element is the main text; a page
    without one keeps every block that isn't left out and isn't the host's
    boilerplate. Null ids pass through, repeated rows are returned each, other
    columns are not read. Pages of a host with the same main text count as one
    page, so copies change nothing; a hot host's pages are dealt by their place
    in the input, so copies, and rows without an id and url, spread as well, and
    runs are counted over its parts where a page needs them.
    """
    def cut(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            packed, length = [], []
            for page in batch.column(3).to_pylist():
                blocks = [(kind, text, isinstance(text, Title)) for kind, text in blocks_of(page)]
                raw = json.dumps(blocks, ensure_ascii=False).encode("utf-8", "replace")
                packed.append(pa.compress(raw, codec="zstd", asbytes=True))
                length.append(len(raw))
            deal = pa.array((np.int64(part) << 40) + at + np.arange(len(packed)))
            at += len(packed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], deal, pa.array(length, pa.int32()), pa.array(packed, pa.binary())],
                                             names=["page_id", "url", "host", "deal", "size", "blocks"])

    def ends(batches):
        for batch in batches:
            pages = [blocks_of(page) for page in batch.column(1).to_pylist()]
            found = [page_ends(b) for b in pages]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([main_key(b) for b in pages], pa.int64()), pa.array([{p for p, _ in b} == {OTHER} for b in pages], pa.bool_()),
                 pa.array([list(x) for x in found], pa.list_(pa.int64())), *(pa.array([[f(v, default=None) for v in x.values()] for x in found], pa.list_(pa.int64())) for f in (min, max))],
                names=["host", "main", "bare", "hash", "low", "high"])

    def join(pdf: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:  # a part that no page was dealt to
            return pd.DataFrame()
        found = (sent_hashes(sent, FREQUENT), sent_hashes(sent, SHARED)) if len(sent_hashes(sent, LEAST)) else None
        text = host_texts(unpacked(pdf["blocks"], pdf["size"]), set(sent_hashes(sent, COMMON).tolist()), found)
        return pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    def dealt_out(rows: DataFrame) -> DataFrame:
        cuts = rows.mapInArrow(cut, "page_id long, url string, host long, deal long, size int, blocks binary")
        return cuts.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("deal"), parts).cast("int")).drop("deal", "parts")

    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    # A written table, so the planner knows its size: only a small one is broadcast.
    hot = written(rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / part_pages).cast("int").alias("parts"))
                  .filter("parts > 1"), "hosts")
    parts = F.coalesce("parts", F.lit(1))
    # Distinct pages, then for each hash its pages and whether one host has all.
    # A hash of the host itself counts its pages; ``asks`` says of it whether one
    # has text but no article, of the end of a block whether several blocks have it.
    distinct = (rows.select("host", "html").mapInArrow(ends, "host long, main long, bare boolean, hash array<long>, low array<long>, high array<long>")
                .groupBy("host", "main").agg(F.first(F.arrays_zip("hash", "low", "high")).alias("marks"), F.max("bare").alias("bare")))
    of_host = F.xxhash64("host", F.lit("pages"))
    page = F.struct(of_host.alias("hash"), F.when(F.col("bare"), 0).otherwise(1).cast("long").alias("low"), F.lit(1).cast("long").alias("high"))
    # One row per hash and task is shuffled, however many pages have it.
    marks = distinct.select("host", F.explode(F.concat("marks", F.array(page))).alias("mark")).groupBy(F.col("mark.hash").alias("hash")).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.min("host").alias("host"), F.max("host").alias("last"),
        F.coalesce(F.min("mark.low") < F.max("mark.high"), F.lit(False)).alias("asks"))
    marks = written(marks.withColumn("own", F.col("hash") == of_host).filter((F.col("host") == F.col("last")) & ((F.col("n") >= HOST_PAGES) | F.col("own")))
                    .select("host", "hash", "n", "asks", "own"), "marks")
    sent = (marks.filter("NOT own").join(hot, "host", "left")
            .select("host", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "hash", F.lit(COMMON).alias("kind")))
    # Hosts of several parts with pages that need the runs of the whole host.
    wide = written(hot.join(marks, "host").groupBy("host", "parts").agg(
        F.max("asks").alias("asks"), F.greatest(F.lit(float(PAGES)), SHARE * F.max(F.when(F.col("own"), F.col("n")))).alias("most"),
        F.coalesce(F.max(F.when(F.col("own"), F.col("asks"))), F.lit(False)).alias("bare")).filter("asks").drop("asks"), "wide")
    if wide.isEmpty():
        dealt = dealt_out(rows)
    else:  # written, as both steps need the same parts
        known = written(dealt_out(rows.join(wide.select("host"), "host", "left_semi").select(rows.columns)), "pages")
        dealt = dealt_out(rows.join(wide.select("host"), "host", "left_anti").select(rows.columns)).unionByName(known)
        sent = sent.unionByName(host_runs(known, sent, wide))
    # Grouping alone would keep a partitioning by host.
    return (dealt.repartition("host", "part").groupBy("host", "part")
            .cogroup(sent.repartition("host", "part").groupBy("host", "part"))
            .applyInPandas(join, "page_id long, url string, text string, n_chars long"))
