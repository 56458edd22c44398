"""Main text of pages, by wrappers inferred from the pages of a host.

A page is read as a stream of block tags and texts; inline tags are markup inside a text.  A wrapper is a
union-free regular expression over such streams: tags, text slots, and groups that are optional or
repeated.  It begins as the first page of a host.  Each further page is aligned with it from left to right.
Where texts differ, the constant becomes a slot.  Where tags differ, what one side has more of becomes
repeated if it repeats what stands before it, and optional otherwise: the nearer of the two places
where the streams meet again says which side has more.  Balanced elements are aligned as a whole and then
inside, so groups never cross them.

Wrappers are aligned with each other as pages are.  So every task folds the pages of its hosts, and the
wrappers of a host are folded in two further rounds; nothing but wrappers is shuffled.  The slots of a
finished wrapper are labelled, and each page is aligned with its host's wrapper once more to take the texts
of the slots that hold the main text.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.llm.storage import keep

#: Deeper elements count as children of the last one that is not too deep; their texts stay.
MOST_DEPTH = 60
#: Items of a list in a wrapper; a page's further ones are not learned, and labelled by their tags alone.
MOST_ITEMS = 400
#: Items of all wrappers that a task holds before it hands them on.
HELD_ITEMS = 200_000
#: Groups that a host's wrappers are dealt to before they meet.
SALTS = 32
#: A text outside an article that is the same on so many pages belongs to the template.
TEMPLATE_PAGES = 5
#: Share of the text that an element must hold for the search for the main region to go into it.
REGION_SHARE = 0.6

# Fixed values of HTML: elements inside a line of text, elements without content, elements whose content is no markup.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
EMPTY = set("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noembed noframes xmp".split())
#: Left out with their content where they are closed; without an end they hide nothing.
WIDGETS = set("svg select button object audio video canvas datalist".split())
HEAD = set("title meta link script style base noscript template".split())
# Which open elements a tag ends, and which element stops the search for them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
}

# What is no main text, by tag and by words of class, id and role.
OUTSIDE_TAGS = set("nav aside footer form template head dialog menu fieldset".split())
OUTSIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar footer copyright contentinfo complementary notice notices alert cookie cookies consent gdpr popup modal overlay "
    "dialog newsletter subscribe subscription signup login social share sharing related recommended comment comments reply replies "
    "discussion disqus form search pagination pager toolbar hidden".split()
)
#: Page headers; the header of an article belongs to it.
HEADER_WORDS = set("header masthead banner topbar".split())
CONTAINERS = set("html body div section center table tbody tr td blockquote".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)", re.DOTALL
)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)|(?=[\s/>]))", re.IGNORECASE)
PART = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[0-9](?![0-9]))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

TEXT = "#"
OPTIONAL, REPEATED = 1, 2
DROPPED, ARTICLE, MAIN, REGION = 0, 1, 2, 3


class Reader:
    """Reads pages as trees of [key, children] with (text, characters in links) as leaves."""

    def __init__(self) -> None:
        self.keys: dict[tuple[str, str], str] = {}
        self.ends: dict[str, re.Pattern] = {}

    def key(self, name: str, attributes: str) -> str:
        """Tag and words of class, id and role; numbers of more than one digit say nothing about what an element is for."""
        if len(attributes) < 2:
            return name
        known = self.keys.get((name, attributes))
        if known is None:
            words = set()
            for found in ATTRIBUTE.finditer(attributes):
                field, value = found.group(1).lower(), (found.group(2) or "").strip("\"'")
                if field in ("class", "id", "role"):
                    words.update(w.lower() for w in PART.findall(value))
                elif field == "hidden" or (field == "aria-hidden" and value.lower() == "true") or UNSEEN.search(value):
                    words.add("hidden")
            known = ".".join([name, *sorted(words)[:12]])
            if len(self.keys) > 50_000:
                self.keys.clear()
            self.keys[name, attributes] = known
        return known

    def after(self, html: str, name: str, at: int) -> int:
        """Where the end tag of a raw element begins, -1 if there is none."""
        if name not in self.ends:
            self.ends[name] = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE)
        end = self.ends[name].search(html, at)
        return end.start() if end else -1

    def page(self, html: str) -> list:
        root: list = []
        stack, names, opened = [root], [""], {}
        pieces: list[str] = []
        links, in_link, muted, at = 0, False, "", 0
        unclosed: set[str] = set()

        def flush() -> None:
            nonlocal links, muted
            text = " ".join("".join(pieces).split())
            if text:
                stack[-1].append((text, min(links, len(text))))
            pieces.clear()
            links, muted = 0, ""

        def pop() -> str:
            stack.pop()
            name = names.pop()
            opened[name] -= 1
            return name

        while True:
            found = TOKEN.search(html, at)
            piece = html[at : found.start()] if found else html[at:]
            if piece and not muted:
                if "&" in piece:
                    piece = unescape(piece)
                pieces.append(piece)
                if in_link:
                    links += len(piece)
            if not found:
                break
            at = found.end()
            closing, name, attributes = found.groups()
            if name is None:
                continue
            name = name.lower()
            if name in RAW or name in WIDGETS:
                if not closing and name not in unclosed:
                    end = self.after(html, name, at)
                    if end < 0:
                        unclosed.add(name)
                    if end >= 0 or name in RAW:
                        at = end if end >= 0 else len(html)
                continue
            if name in INLINE:
                if name == "br":
                    pieces.append(" ")
                elif closing:
                    muted = "" if muted == name else muted
                elif not muted and name not in EMPTY and len(attributes) > 1 and outside(self.key(name, attributes), False):
                    muted = name
                if name == "a":
                    in_link = not closing
                continue
            flush()
            if closing:
                in_link = False
                if opened.get(name):
                    while pop() != name:
                        pass
                continue
            if names[-1] == "p":
                pop()
            if opened.get("head") and name not in HEAD:
                while pop() != "head":
                    pass
            if name in EMPTY:
                continue
            if name in ENDS:
                ended, stop = ENDS[name]
                place = len(names) - 1
                while place > 0 and names[place] not in ended and names[place] not in stop:
                    place -= 1
                if names[place] in ended:
                    while len(names) > place:
                        pop()
            if len(stack) <= MOST_DEPTH:
                children: list = []
                stack[-1].append([self.key(name, attributes), children])
                stack.append(children)
            else:
                stack.append(stack[-1])
            names.append(name)
            opened[name] = opened.get(name, 0) + 1
        flush()
        return root


def outside(key: str, in_article: bool) -> bool:
    """Whether an element holds no main text, whatever is in it."""
    name, *words = key.split(".")
    words = [w.rstrip("0123456789") for w in words]
    if name in OUTSIDE_TAGS or not OUTSIDE_WORDS.isdisjoint(words):
        return True
    return not in_article and (name == "header" or not HEADER_WORDS.isdisjoint(words))


def inside(key: str, code: int) -> int:
    """The code of texts in an element, of the code outside of it."""
    if key.startswith("("):
        return code
    if code == DROPPED or outside(key, code in (ARTICLE, MAIN)):
        return DROPPED
    name, *words = key.split(".")
    if code == ARTICLE or name == "article":
        return ARTICLE
    return MAIN if name == "main" or "main" in words and name in ("div", "section") else code


# Items of a wrapper: [TEXT, kind, pages, characters, in links, hash or None], [key, kind, pages, items], and
# groups of items whose key is "(" and the keys of the items.


def generalised(children: list) -> list:
    """A page's elements as items, with repetitions folded."""
    out: list = []
    for child in children:
        if isinstance(child, tuple):
            item = [TEXT, 0, 1, len(child[0]), child[1], zlib.crc32(child[0].encode())]
        else:
            item = [child[0], 0, 1, generalised(child[1])]
        if out and out[-1][0] == item[0]:
            out[-1] = joined(out[-1], item, True)
        else:
            out.append(item)
    return squares(out) if len(out) >= 4 else out


def squares(items: list) -> list:
    """Two to four items that are repeated right away become one repeated group."""
    for period in (2, 3, 4):
        at = 0
        while at + 2 * period <= len(items):
            keys, times = [i[0] for i in items[at : at + period]], 1
            while [i[0] for i in items[at + times * period : at + (times + 1) * period]] == keys:
                times += 1
            if times > 1:
                body = items[at : at + period]
                for n in range(1, times):
                    again = items[at + n * period : at + (n + 1) * period]
                    body = [joined(a, b, True, a[1] | b[1]) for a, b in zip(body, again, strict=True)]
                items[at : at + times * period] = [["(" + " ".join(keys) + ")", REPEATED, 1, body]]
            at += 1
    return items


def joined(a: list, b: list, same_page: bool, kind: int | None = None) -> list:
    """One item for two with equal keys: of one page, where it is repeated, or of two wrappers."""
    kind = a[1] | b[1] | (REPEATED if same_page else 0) if kind is None else kind
    pages = max(a[2], b[2]) if same_page else a[2] + b[2]
    if a[0] == TEXT:
        return [TEXT, kind, pages, a[3] + b[3], a[4] + b[4], a[5] if a[5] == b[5] else None]
    return [a[0], kind, pages, aligned(a[3], b[3], same_page)]


def aligned(a: list, b: list, same_page: bool = False) -> list:
    """The union-free expression that covers both lists of items."""
    if [i[0] for i in a] == [i[0] for i in b]:
        return [joined(x, y, same_page, x[1] | y[1]) for x, y in zip(a, b, strict=True)]
    a, b = _grouped(a, b), _grouped(b, a)
    places: tuple[dict, dict] = ({}, {})
    for items, where in ((a, places[0]), (b, places[1])):
        for n in range(len(items) - 1, -1, -1):
            where.setdefault(items[n][0], []).append(n)
    out: list = []

    def add(items: list, new: bool) -> None:
        for item in items:
            if not new or len(out) < MOST_ITEMS:
                out.append([item[0], item[1] | OPTIONAL, *item[2:]])

    def ahead(where: dict, key: str, at: int) -> int | None:
        found = where.get(key, [])
        while found and found[-1] < at:
            found.pop()
        return found[-1] if found else None

    i = j = 0
    while i < len(a) and j < len(b):
        if a[i][0] == b[j][0]:
            out.append(joined(a[i], b[j], same_page, a[i][1] | b[j][1]))
            i, j = i + 1, j + 1
            continue
        in_b, in_a = ahead(places[1], a[i][0], j), ahead(places[0], b[j][0], i)
        if in_b is None and in_a is None:
            add([a[i]], False)
            add([b[j]], True)
            i, j = i + 1, j + 1
        elif in_a is None or in_b is not None and in_b - j <= in_a - i:
            add(b[j:in_b], True)
            j = in_b
        else:
            add(a[i:in_a], False)
            i = in_a
    add(a[i:], False)
    add(b[j:], True)
    return out


def _grouped(items: list, other: list) -> list:
    """The items, with what could be one round of a repeated group of the other list as such a group."""
    for group in (i for i in other if i[0].startswith("(")):
        keys = [i[0] for i in group[3]]
        if any(i[0] == group[0] for i in items):
            continue
        for at in range(len(items) - len(keys) + 1):
            if [i[0] for i in items[at : at + len(keys)]] == keys:
                items = [*items[:at], [group[0], 0, 1, items[at : at + len(keys)]], *items[at + len(keys) :]]
                break
    return items


def size(items: list) -> int:
    return sum(1 if i[0] == TEXT else 1 + size(i[3]) for i in items)


def labelled(wrapper: list) -> list:
    """The wrapper's items as [TEXT, code] and [key, items], ready for choosing texts.

    Texts in an article have code ARTICLE, in a main element MAIN.  All others have REGION if they
    are in the region with most of the text that is neither template nor mostly links, or a heading of
    first rank before it.  A page shows the texts of the lowest code that it has.
    """
    weights: dict[int, float] = {}

    def plain(item: list) -> bool:
        return not (item[4] > 0.5 * item[3] or item[5] is not None and item[2] >= TEMPLATE_PAGES)

    def weigh(items: list, code: int) -> float:
        total = 0.0
        for item in items:
            if item[0] == TEXT:
                weight = float(item[3] - item[4]) if code == REGION and plain(item) else 0.0
            else:
                weight = weigh(item[3], inside(item[0], code))
            weights[id(item)] = weight
            total += weight
        return total

    total, region = weigh(wrapper, REGION), wrapper
    path: list = []
    while total:
        best = max((i for i in region if i[0] != TEXT), key=lambda i: weights[id(i)], default=None)
        if best is None or best[1] & REPEATED or best[0].split(".")[0] not in CONTAINERS or weights[id(best)] < REGION_SHARE * total:
            break
        region, total = best[3], weights[id(best)]
        path.append(id(best))

    def label(items: list, code: int, here: bool) -> list:
        out = []
        for item in items:
            if item[0] == TEXT:
                shown = code if code != REGION else REGION if here and plain(item) else DROPPED
                out.append([TEXT, shown])
            else:
                among = here or item[3] is region or item[0].split(".")[0] == "h1"
                out.append([item[0], label(item[3], inside(item[0], code), among)])
        return out

    return label(wrapper, REGION, region is wrapper)


def chosen(children: list, plan: list) -> list[str]:
    """A page's main texts in page order, by a labelled wrapper."""
    found: list[tuple[int, str]] = []
    # Places of a key in a list of the plan, by the list.
    known: dict[int, dict[str, list]] = {}

    def places(items: list) -> dict[str, list]:
        where = known.get(id(items))
        if where is None:
            where = known[id(items)] = {}
            for n, item in enumerate(items):
                where.setdefault(item[0], []).append((n, item))
                for one in item[1] if item[0].startswith("(") else ():
                    where.setdefault(one[0], []).append((n, one))
        return where

    def take(children: list, items: list | None, code: int) -> None:
        where, at = places(items) if items else {}, 0
        for child in children:
            key = TEXT if isinstance(child, tuple) else child[0]
            spots = where.get(key)
            item = None
            if spots:
                at, item = next((s for s in spots if s[0] >= at), spots[-1])
            if key == TEXT:
                found.append((item[1] if item else code, child[0]))
            else:
                take(child[1], item[1] if item else None, inside(key, code))

    take(children, plan, REGION)
    best = min((code for code, _ in found if code != DROPPED), default=DROPPED)
    return [text for code, text in found if code == best and code != DROPPED]


def _learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts of a task's pages."""
    reader, held, items = Reader(), {}, 0

    def out() -> pa.RecordBatch:
        rows = [(host, json.dumps(wrapper)) for host, wrapper in held.items()]
        held.clear()
        return _wrappers(rows)

    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            page = generalised(reader.page(html.as_py() or ""))
            before = held.get(host)
            if before is None:
                held[host], items = page, items + size(page)
            else:
                held[host] = aligned(before, page)
        if items > HELD_ITEMS or len(held) > HELD_ITEMS / 20:
            yield out()
            items = 0
        else:
            items = sum(map(size, held.values()))
    if held:
        yield out()


def _wrappers(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.string()) for n in (0, 1)], ["host", "wrapper"])


def _fold(batches: Iterable[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of sorted rows, in the end with labels; only one host's is held."""
    host, wrapper = None, None

    def done() -> tuple[str, str]:
        return host, json.dumps(labelled(wrapper) if last else wrapper)

    for batch in batches:
        rows = []
        for one, text in zip(batch.column("host").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if wrapper is not None and one == host:
                wrapper = aligned(wrapper, json.loads(text))
                continue
            if wrapper is not None:
                rows.append(done())
            host, wrapper = one, json.loads(text)
        yield _wrappers(rows)
    if wrapper is not None:
        yield _wrappers([done()])


def _take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, plans = Reader(), {}
    for batch in batches:
        texts = []
        for html, plan in zip(batch.column("html"), batch.column("wrapper").to_pylist(), strict=True):
            if plan not in plans:
                if len(plans) > 1000:
                    plans.clear()
                plans[plan] = json.loads(plan or "[]")
            texts.append("\n".join(chosen(reader.page(html.as_py() or ""), plans[plan])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page", "url", "text", "n_chars"],
        )


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, empty if it has none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def learn_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and wrapper (labelled, as JSON) of every host of the pages; pages without host are one more."""
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    found = keep(rows.mapInArrow(_learn, "host string, wrapper string"))
    # A host of very many pages has a wrapper from each task; they meet in two rounds.
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))
    found = found.withColumn("salt", salt).repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").drop("salt")
    found = found.mapInArrow(lambda batches: _fold(batches, False), "host string, wrapper string")
    found = found.repartition("host").sortWithinPartitions("host", "wrapper")
    return keep(found.mapInArrow(lambda batches: _fold(batches, True), "host string, wrapper string"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page: its article, one line a block.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader comments are left out,
    by the labels of the host's wrapper.  Character references are decoded, white space in a block is one space, a line
    break is white space.  A NULL or empty page has an empty text.  Pages without a host are aligned with each
    other.  Repeated rows stay repeated.  Pages are read whole, whatever their length, one at a time; elements
    nested very deeply count as less deep.  Other columns do not matter.

    Only wrappers are shuffled.  Pages meet their host's wrapper in a join that Spark broadcasts while the
    wrappers are small by its own measure; beyond that, pages are shuffled by host.
    """
    wrappers = learn_wrappers(pages, url, html)
    rows = pages.select(F.col(f"`{page_id}`").alias("page"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    joined_rows = rows.withColumn("host", host_of(F.col("url"))).join(wrappers, "host", "left").select("page", "url", "html", "wrapper")
    kind = rows.schema["page"].dataType.simpleString()
    link = rows.schema["url"].dataType.simpleString()
    found = joined_rows.mapInArrow(_take, f"page {kind}, url {link}, text string, n_chars long")
    return found.select(F.col("page").alias(page_id), F.col("url").alias(url), "text", "n_chars")
