"""Main text of web pages: the page's own structure, and what the pages of a host repeat.

A page is cut into blocks at block-level tags. A block's place says what it is: script, style, menus,
footers, sidebars, forms, adverts, notices and reader comments (by element, or by a word of their class or
id) are chrome; blocks of an article element, or else of a main element, are the main text, all of them.
Where a page has neither, its other blocks are open, and the host decides: of the token streams of chrome and
open blocks of all pages of the host, the substrings of LONG tokens or more that distinct pages share are
found, the tokens of open blocks that they cover go, and the unique runs between them stay. Repeats don't decide
about articles: authors quote, and hosts publish copies, and both belong to the text.

Html never moves for that. Each task reads its pages in groups of bounded size; a suffix array over a group
gives its distinct windows of LONG tokens, and of each and its host 128 bits are sent with the least and the
greatest page that has it. An aggregate over all groups tells which windows distinct pages share: its state
is two pages, so a host that holds a third of all pages is summed up before it is sent. The windows of pages
with open blocks that are shared come back to these pages, and the pages are read once more. So a page's text
depends neither on the groups nor on the number of partitions.

Defined results: a null or empty html has an empty text; a null url is a host of its own; elements whose end tags
may be left out (p, li, dt, dd, tr, td, th, option) end where the next one of their kind or, for p, a block begins;
any other unclosed tag ends with the element around it, an unclosed comment or script with the page; repeated rows are extracted
one by one (as equal pages they are evidence against their own open blocks only if their page_id differs);
an empty table gives no rows; whole pages are read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import map_in_arrow, table, written

#: Tokens of a repeat, block boundaries included.
LONG = 6
#: Pages, and characters of html, that one suffix array covers; they bound memory and decide no row.
GROUP = 512
GROUP_CHARS = 8 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

RAW = "script|style|textarea|title|noscript|iframe|xmp|template|svg|math|object|canvas"
_TAG = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({RAW})(?=[\s/>])[^>]*+(?:>.*?(?:</\1\s*+>|\Z)|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text.
CHROME = frozenset("nav footer aside form head button select menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark chrome.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent notice notices gdpr popup modal newsletter subscribe subscription signup social share sharing related recommended comment comments "
    "disqus reply replies respond widget pagination pager login search masthead copyright".split()
)
#: Of these, the ones that even an article element bears when it isn't the page's article.
NOT_ARTICLES = MARKS & frozenset("ad ads advert advertisement sponsored promo related recommended comment comments reply replies widget".split())
_NEGATED = frozenset("has no with without hide show".split())
OUT, OPEN, MAIN, ARTICLE = range(4)

#: Elements whose end may be implied, in kinds; which tags end an open one of a kind, and which keep it out of reach.
KINDS = ("p", "li", "term", "cell", "row", "option")
KIND_OF = {"p": 0, "li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4, "option": 5}
_CLOSE_P = "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
_PARTS = "tbody thead tfoot".split()
ENDS = {tag: (0,) for tag in _CLOSE_P} | {"li": (1, 0), "dt": (2, 0), "dd": (2, 0), "td": (3,), "th": (3,), "tr": (4, 3), "option": (5,), "optgroup": (5,)} | dict.fromkeys(_PARTS, (4, 3))
_ALL = (-1,) * len(KINDS)
_LISTS = {"ul": (1,), "ol": (1,), "menu": (1,), "dl": (2,), "table": (0, 3, 4), "td": (0,), "th": (0,), "caption": (0,), "button": (0,), "select": (5,)}
#: Pages of more characters are scanned with a table of where tags can end.
PLAIN = 1 << 15
_NAMED = re.compile(rf"</?[a-zA-Z]|<({RAW})(?=[\s/>])|<!--|<!\[CDATA\[", re.I)


def tags(source: str) -> Iterator[re.Match]:
    """The page's tags, comments and raw elements in order. On a long page a tag that never ends is passed over by a look
    at a table, so that the time is in proportion to the page whatever it holds."""
    if len(source) <= PLAIN:
        yield from _TAG.finditer(source)
        return
    special = [m.start() for m in re.finditer("[>\"']", source)]
    stops = [m.start() for m in re.finditer(r"[\s/>]", source)]
    last = source.rfind(">")
    # from the last one on: whether a tag that comes to this character outside of quotes ends
    ends, following = [False] * (len(special) + 1), {'"': len(special), "'": len(special)}
    for i in range(len(special) - 1, -1, -1):
        c = source[special[i]]
        if c == ">":
            ends[i] = True
        else:
            j = following[c]
            ends[i] = j < len(special) and ends[j + 1]
            following[c] = i
    at = 0
    while (at := source.find("<", at)) >= 0:
        m = _NAMED.match(source, at)
        if m is None:
            possible = source[at + 1 : at + 2] in ("!", "?") and at < last
        elif m[0][-1].isalpha() and not _RAW.match(source, at):
            k = bisect_left(stops, m.end())  # the name's end
            possible = k < len(stops) and ends[bisect_left(special, stops[k])]
        else:
            possible = True
        found = _TAG.match(source, at) if possible else None
        if found:
            yield found
        at = found.end() if found else at + 1


_RAW = re.compile(rf"<(?:{RAW})(?=[\s/>])", re.I)


def _marks(attributes: str) -> tuple[set[str], set[str], str, bool]:
    """Words of class and id, those of them that are a whole class or id or a class's first word, the role, and whether
    the element is hidden."""
    words: set[str] = set()
    firm: set[str] = set()
    role, hidden = "", False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            for one in value.split():
                parts = re.split(r"[-_:]+", one)
                words.update(w for k, w in enumerate(parts) if not k or parts[k - 1] not in _NEGATED)
                firm.update([one] if name == "id" else [one, parts[0]])
        elif name == "role":
            role = value
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
    return words, firm, role, hidden


def blocks(source: str) -> list[tuple[int, str]]:
    """The page's blocks in order: where each stands (OUT, OPEN, MAIN or ARTICLE) and its text."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    # element, place of its content, whether no main element can be inside, and where the open ones of each kind are
    stack: list[tuple[str, int, bool, tuple[int, ...]]] = []
    count: Counter = Counter()
    place, firm, seen, at, near = OPEN, False, False, 0, _ALL

    def flush() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((place, text))
            parts.clear()

    def close(k: int) -> None:
        """Ends the elements from the k-th on."""
        nonlocal place, firm, near
        if any(s[1] != place for s in stack[k:]) or (stack[k - 1][1] if k else OPEN) != place:
            flush()
        for s in stack[k:]:
            count[s[0]] -= 1
        del stack[k:]
        _, place, firm, near = stack[-1] if stack else ("", OPEN, False, _ALL)

    for m in tags(source):
        if m.start() > at:
            text = source[at : m.start()]
            parts.append(html.unescape(text) if "&" in text else text)
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and m[1].lower() not in ("script", "style", "template", "noscript", "svg", "math"):
                flush()
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        if m[2]:
            if count[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        for kind in ENDS.get(tag, ()):
            if near[kind] >= 0:
                close(near[kind])
        if tag in VOID or m[4].endswith("/"):
            continue
        words, whole, role, hidden = _marks(m[4]) if m[4].strip() else (set(), set(), "", False)
        now, hard = place, firm
        if not firm:
            if hidden or tag in CHROME or role in ROLES:
                now, hard = OUT, True
            elif tag == "article" or role == "article":
                if words & NOT_ARTICLES:
                    now, hard = OUT, True
                elif place != OUT or not seen:
                    now, seen = ARTICLE, True
            elif tag == "main" or role == "main":
                now = max(place, MAIN)
            elif tag == "header":
                now = OUT
            elif (whole if place == ARTICLE else words) & MARKS and tag not in ("html", "body"):
                now = OUT
        if now != place:
            flush()
        if tag in KIND_OF or tag in _LISTS:
            reach = list(near)
            for kind in _LISTS.get(tag, ()):
                reach[kind] = -1
            if tag in KIND_OF:
                reach[KIND_OF[tag]] = len(stack)
            near = tuple(reach)
        stack.append((tag, now, hard, near))
        count[tag] += 1
        place, firm = now, hard
    if at < len(source):
        parts.append(html.unescape(source[at:]))
    flush()
    return out


def ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array's ranks by prefix doubling, up to ``depth`` tokens: equal ranks, equal first tokens."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank, width = rank.astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        after = np.full(len(rank), -1, np.int64)
        after[: len(rank) - step] = rank[step:] if step else rank
        _, rank = np.unique(rank * (len(rank) + 2) + after + 1, return_inverse=True)
        width += step
    return rank


def repeated(tokens: np.ndarray, page: np.ndarray, depth: int = LONG) -> np.ndarray:
    """Which tokens a substring of ``depth`` tokens covers that distinct pages have; a substring ends at its page's end."""
    n = len(tokens)
    if n < depth:
        return np.zeros(n, bool)
    rank = ranks(tokens, depth)
    whole = np.flatnonzero(page[: n - depth + 1] == page[depth - 1 :])
    r, p = rank[whole], page[whole]
    least, most = np.full(n + 1, np.iinfo(np.int64).max), np.full(n + 1, -1, np.int64)
    np.minimum.at(least, r, p)
    np.maximum.at(most, r, p)
    starts = whole[least[r] != most[r]]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.subtract.at(step, starts + depth, 1)
    return np.cumsum(step[:-1]) > 0


def stream(found: list[list[tuple[int, str]]]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]], list[str]]:
    """Pages' chrome and open blocks: tokens as numbers, the page of each, spans (page, block, first and last token), and the words."""
    words: dict[str, int] = {"": 0}  # "" stands between blocks
    tokens: list[int] = []
    page: list[int] = []
    spans: list[tuple[int, int, int, int]] = []
    for k, bs in enumerate(found):
        before = len(tokens)
        tokens.append(0)
        for j, (place, text) in enumerate(bs):
            if place in (OUT, OPEN):
                a = len(tokens)
                tokens += [words.setdefault(w, len(words)) for w in text.split(" ")]
                spans.append((k, j, a, len(tokens)))
                tokens.append(0)
        page += [k] * (len(tokens) - before)
    return np.array(tokens, np.int64), np.array(page, np.int64), spans, list(words)


def best(bs: list[tuple[int, str]]) -> int:
    """The place of the page's main text; OPEN if the host decides about its blocks."""
    return max((p for p, _ in bs), default=OUT)


def main_texts(found: list[list[tuple[int, str]]], spans: list[tuple[int, int, int, int]], repeat: np.ndarray) -> list[str]:
    """The pages' main texts; repeat: which tokens repeats of the host cover. Of open blocks the other tokens stay."""
    unique = {(k, j): ~repeat[a:b] for k, j, a, b in spans} if len(repeat) else {}
    texts = []
    for k, bs in enumerate(found):
        main, parts = best(bs), []
        for j, (place, text) in enumerate(bs):
            if place == main > OUT:
                keep = unique.get((k, j)) if place == OPEN else None
                parts.append(text if keep is None or keep.all() else " ".join([w for w, stays in zip(text.split(" "), keep.tolist(), strict=True) if stays]))
        texts.append(" ".join([p for p in parts if p]))
    return texts


def extract_group(ids: list, sources: list[str]) -> list[str]:
    """The main texts of pages of one host that are all at hand; ``extract`` gives the same for a host of any size."""
    found = [blocks(s) for s in sources]
    tokens, page, spans, _ = stream(found)
    numbers: dict = {}
    own = np.array([numbers.setdefault(i, len(numbers)) for i in ids], np.int64)
    return main_texts(found, spans, repeated(tokens, own[page] if len(page) else page))


def window_keys(tokens: np.ndarray, starts: np.ndarray, words: list[str], hosts: np.ndarray) -> np.ndarray:
    """128 bits for each window of LONG tokens and its host, as two signed numbers. hosts: a digest for each window."""
    table = digests(words)
    key = hosts.copy()
    for k in range(LONG):
        key = key * _ODD + table[tokens[starts + k]]
    return key.view(np.int64)


def digests(words: list[str]) -> np.ndarray:
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join([xxh3_128_digest(w.encode("utf-8", "replace")) for w in words]), "<u8").reshape(-1, 2)


def evidence(hosts: list[str], ids: list, marks: list[int], sources: list[str]) -> pa.RecordBatch:
    """A group's windows. Every distinct window of a host, with the least and the greatest of its pages; and for
    each page whose blocks are open, its own windows that touch one, with the page's mark."""
    found = [blocks(s) for s in sources]
    tokens, row, spans, words = stream(found)
    last = max(0, len(tokens) - LONG + 1)
    whole = np.flatnonzero(row[:last] == row[LONG - 1 :]) if last else np.zeros(0, np.int64)
    names, host = np.unique(np.array(hosts, object), return_inverse=True)
    numbers: dict = {}
    own = np.array([numbers.setdefault(i, len(numbers)) for i in ids], np.int64)
    at = row[whole]
    rank = ranks(tokens, LONG)[whole] if len(whole) else whole
    _, first, window = np.unique(rank * len(names) + host[at], return_index=True, return_inverse=True)
    least, most = np.full(len(first), len(numbers)), np.full(len(first), -1)
    np.minimum.at(least, window, own[at])
    np.maximum.at(most, window, own[at])
    keys = window_keys(tokens, whole[first], words, digests(list(names))[host[at[first]]])
    two = most != least
    # windows of open pages
    asks = [best(bs) == OPEN for bs in found]
    step = np.zeros(len(tokens) + 1, np.int64)
    for k, j, a, b in spans:
        if asks[k] and found[k][j][0] == OPEN:
            step[a] += 1
            step[b] -= 1
    before = np.r_[0, np.cumsum(np.cumsum(step[:-1]))]
    touch = np.flatnonzero(before[whole + LONG] > before[whole])
    pairs = np.unique(np.stack([at[touch], window[touch]], 1), axis=0)
    key = np.concatenate([keys, keys[two], keys[pairs[:, 1]]])
    known = list(numbers)
    page = [known[k] for k in np.concatenate([least, most[two]]).tolist()] + [ids[k] for k in pairs[:, 0].tolist()]
    mark = [None] * (len(first) + int(two.sum())) + [marks[k] for k in pairs[:, 0].tolist()]
    return pa.RecordBatch.from_arrays([pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(page, pa.int64()), pa.array(mark, pa.int64())], ["k1", "k2", "page", "mark"])


def text_of(source: str, host: str, shared: list[int] | None) -> str:
    """The page's main text; shared: the first halves of the keys of its windows that other pages of the host have."""
    found = [blocks(source)]
    if not shared:
        return main_texts(found, [], np.zeros(0, bool))[0]
    tokens, _, spans, words = stream(found)
    starts = np.arange(len(tokens) - LONG + 1)
    hit = starts[np.isin(window_keys(tokens, starts, words, np.repeat(digests([host]), len(starts), axis=0))[:, 0], np.array(shared, np.int64))]
    step = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(step, hit, 1)
    np.subtract.at(step, hit + LONG, 1)
    return main_texts(found, spans, np.cumsum(step[:-1]) > 0)[0]


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group: list[tuple] = []
    size = 0
    for b in batches:
        for one in zip(*(b[c].to_pylist() for c in ("host", "page_id", "mark", "html")), strict=True):
            if group and (len(group) >= GROUP or size + len(one[3]) > GROUP_CHARS):
                yield evidence(*map(list, zip(*group, strict=True)))
                group, size = [], 0
            group.append(one)
            size += len(one[3])
    if group:
        yield evidence(*map(list, zip(*group, strict=True)))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, GROUP):
            part = b.slice(k, GROUP)
            shared = part["shared"].to_pylist() if "shared" in part.schema.names else [None] * part.num_rows
            texts = [text_of(s, h, x) for s, h, x in zip(part["html"].to_pylist(), part["host"].to_pylist(), shared, strict=True)]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def shared_windows(windows: DataFrame) -> DataFrame:
    """Of the windows of open pages, those that distinct pages of the host have: page, mark, shared (their keys' first halves)."""
    null = F.col("page").isNull()
    distinct = (F.min("page") != F.max("page")) | (F.bool_or(null) & (F.count("page") > 0))
    several = windows.groupBy("k1", "k2").agg(F.coalesce(distinct, F.lit(False)).alias("several"), F.count("mark").alias("asked")).where("several AND asked > 0").select("k1", "k2")
    return windows.where("mark IS NOT NULL").join(several, ["k1", "k2"]).groupBy("page", "mark").agg(F.collect_set("k1").alias("shared"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), source.alias("html"), host.alias("host"), F.xxhash64(host, source).alias("mark"))
    windows = written(map_in_arrow(rows.select("host", "page_id", "mark", "html"), _evidence, "k1 long, k2 long, page long, mark long"), "windows")
    if windows.where("mark IS NOT NULL").isEmpty():  # no page leaves its text to the host
        found = rows.select("page_id", "url", "html", "host")
    else:
        shared = written(shared_windows(windows), "shared-windows").withColumnRenamed("mark", "__mark")
        found = rows.join(shared, rows["page_id"].eqNullSafe(shared["page"]) & (rows["mark"] == shared["__mark"]), "left").select("page_id", "url", "html", "host", "shared")
    return map_in_arrow(found, _texts, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
