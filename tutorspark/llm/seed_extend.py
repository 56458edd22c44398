"""Repeated passages by seed and extend: winnowed anchors, extended both ways to maximal repeats.

A window is ``threshold`` consecutive words of one document.  Of the k-word sequences in each window the
one with the least hash (the last, on ties) is the window's anchor, so equal windows have equal
anchors at equal places.  One anchor stands for the stretch of all windows that chose it.

1. Anchors that occur once in the corpus are dropped; the others are the seeds.
2. Each seed is extended to the left and right as far as its own windows reach.  Among equal extended
   stretches the first is the original, and all words of the others are repeated.
3. Originals of one anchor with different stretches may still share some of their windows: their
   windows are compared one by one, and again all but the first occurrence is repeated.
4. Overlapping and adjoining repeated words are joined into maximal repeats and cut.

Documents meet at an anchor, stretch or window through its hash, never as pairs.  What a task sees more
than once it settles by itself: it reports the later occurrences to their documents and lets only
the first compete for the corpus, so a passage in a third of all documents costs one row a task.
Stretches and windows are compared by two hashes of 64 bits with different factors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.llm.arrow_text import IS_SPACE, first_of, hash_runs, mix64, random_words, runs, slices, spread, utf8

ANCHOR_WORDS = 6
SLICE_BYTES = 2 << 20
#: What a row says: it competes for its route; its route is known to be taken twice; an occurrence
#: that goes on to the next step; words that are repeated.
ASK, FLAG, PASS, CUT = 0, 1, 2, 3
NAMES = ("route", "aux", "did", "th", "s", "e", "kind")
#: On the way from task to task, s, e and kind are one number (at): a text of 2 GB has under 2^30 words.
ROW = "route long, aux long, did long, th long, at long"
NO_ID = (1 << 63) - 1
HAS_ID = -(1 << 63)

Columns = dict[str, np.ndarray]
FACTORS = random_words(2, 77)


class Words:
    """The words of some texts: their hashes, and hashes of any sequence of them."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        starts, ends = runs(~IS_SPACE[data], offsets)
        self.first = first_of(starts, offsets)
        self.hashes = hash_runs(data, starts, ends)
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sequence(self, start: np.ndarray, end: np.ndarray, factor: int) -> np.ndarray:
        """Hash of words[start:end]: a polynomial in the factor, from its prefix sums."""
        if factor not in self._sums:
            n, c = len(self.hashes), int(FACTORS[factor])
            power = np.cumprod(np.r_[np.uint64(1), np.full(n, c, np.uint64)])
            back = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(c, -1, 1 << 64), np.uint64)])
            self._sums[factor] = np.r_[np.uint64(0), np.cumsum(self.hashes * power[:n])], back
        total, back = self._sums[factor]
        return mix64((total[end] - total[start]) * back[start])

    def anchors(self, threshold: int) -> tuple[np.ndarray, ...]:
        """Of each anchor: text, place, hash, and the first and last of the windows that chose it;
        places count words within the slice."""
        n, size = len(self.hashes), min(ANCHOR_WORDS, threshold)
        wide = threshold - size + 1
        if n < threshold:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none, none
        grams = self.sequence(np.arange(n - size + 1), np.arange(size, n + 1), 0)
        least, width = np.arange(len(grams)), 1

        def later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(grams[b] <= grams[a], b, a)

        while 2 * width <= wide:
            least, width = later(least[:-width], least[width:]), 2 * width
        if width < wide:
            least = later(least[: len(least) - (wide - width)], least[wide - width :])
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        window = np.flatnonzero(np.arange(len(least)) + threshold <= self.first[1:][text[: len(least)]])
        chosen = least[window]
        begins = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]]) if len(chosen) else np.zeros(0, np.int64)
        ends = np.r_[begins[1:], len(chosen)] - 1
        place = chosen[begins]
        return text[place], place, grams[place], window[begins], window[ends]


def _batch(columns: Columns) -> pa.RecordBatch:
    wide = {n: np.asarray(columns[n]).astype(np.int64, copy=False) for n in NAMES}
    packed = {n: wide[n] for n in ("route", "aux", "did", "th")}
    return pa.RecordBatch.from_pydict(packed | {"at": wide["s"] << 33 | wide["e"] << 2 | wide["kind"]})


def _unpacked(batch: pa.RecordBatch) -> Columns:
    route, did, th, at = (batch.column(n).to_numpy() for n in ("route", "did", "th", "at"))
    aux = batch.column("aux").to_numpy() if "aux" in batch.schema.names else np.zeros(len(route), np.int64)
    return {"route": route, "aux": aux, "did": did, "th": th, "s": at >> 33, "e": at >> 2 & 0x7FFFFFFF, "kind": at & 3}


def _columns(rows: DataFrame) -> DataFrame:
    """The rows' documents, stretches and kinds as columns."""
    return rows.select(
        "did",
        "th",
        F.shiftright("at", 33).cast("int").alias("s"),
        F.shiftright("at", 2).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("e"),
        F.col("at").bitwiseAND(F.lit(3)).cast("int").alias("kind"),
    )


def _rows(kind: int, did, th, s, e, route=None, aux=0) -> Columns:
    """Rows of one kind; without a route they are scattered evenly."""
    if route is None:
        document = did.astype(np.uint64) ^ mix64(np.asarray(th).astype(np.uint64))
        route = mix64(document ^ mix64(np.asarray(s).astype(np.uint64) + np.uint64(1)))
    n = len(did)
    full = np.broadcast_to
    return {
        "route": np.asarray(route).view(np.int64),
        "aux": np.asarray(full(aux, n)).astype(np.uint64).view(np.int64),
        "did": did,
        "th": th,
        "s": full(s, n),
        "e": full(e, n),
        "kind": full(kind, n),
    }


def _take(rows: Columns, which: np.ndarray) -> Columns:
    return {n: v[which] for n, v in rows.items()}


def _join(parts: list[Columns]) -> Columns:
    return {n: np.concatenate([np.asarray(p[n]) for p in parts]) for n in NAMES}


def _first_wins(asks: Columns) -> tuple[Columns, Columns]:
    """Of rows with one route and aux: the first occurrence, and the others; a repeated row of the
    first occurrence is neither."""
    order = np.lexsort([asks[n] for n in ("s", "th", "did", "aux", "route")])
    asks = _take(asks, order)
    new = np.r_[True, (asks["route"][1:] != asks["route"][:-1]) | (asks["aux"][1:] != asks["aux"][:-1])] if len(order) else np.zeros(0, bool)
    winner = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (asks["did"] == asks["did"][winner]) & (asks["th"] == asks["th"][winner]) & (asks["s"] == asks["s"][winner])
    return _take(asks, new), _take(asks, ~same)


def _shared(rows: Columns) -> np.ndarray:
    """Which rows have a route that is asked for at least twice, or flagged."""
    _, owner = np.unique(rows["route"], return_inverse=True)
    times = np.bincount(owner, weights=np.where(rows["kind"] == FLAG, 2, 1), minlength=1)
    return times[owner] >= 2


def _ask_or_pass(rows: Columns, route: np.ndarray) -> Columns:
    """Rows that find company here go on scattered and leave a flag at their route; the rest ask."""
    asks = _rows(ASK, rows["did"], rows["th"], rows["s"], rows["e"], route)
    shared = _shared(asks)
    known = _take(rows, shared)
    flags = np.unique(asks["route"][shared])
    zero = np.zeros(len(flags), np.int64)
    return _join(
        [
            _take(asks, ~shared),
            _rows(PASS, known["did"], known["th"], known["s"], known["e"]),
            _rows(FLAG, zero, zero, zero, zero, flags),
        ]
    )


def _ids(part: pa.RecordBatch, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return part.column("did").to_numpy()[text], part.column("th").to_numpy()[text]


def _seeds(batches: Iterable[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Anchors of all texts, each asking whether it occurs elsewhere."""
    for batch in batches:
        parts, hashes = [], []
        for part in slices(batch, "text", SLICE_BYTES):
            words = Words(part.column("text"))
            text, place, anchor, _, _ = words.anchors(threshold)
            did, th = _ids(part, text)
            parts.append(_rows(PASS, did, th, place - words.first[text], 0))
            hashes.append(anchor)
        if parts:
            yield _batch(_ask_or_pass(_join(parts), np.concatenate(hashes)))


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Owner of each element of a list column, and the elements."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def _stretches(batches: Iterable[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Each seed of a text with the stretch of its windows, asking whether it is the first such one."""
    for batch in batches:
        parts = []
        for part in slices(batch, "text", SLICE_BYTES):
            words = Words(part.column("text"))
            text, place, anchor, head, tail = words.anchors(threshold)
            owner, places = _lists(part.column("seeds"))
            wanted = owner << 40 | places.to_numpy()
            seed = np.isin(text << 40 | (place - words.first[text]), wanted)
            text, place, anchor, head, tail = (x[seed] for x in (text, place, anchor, head, tail))
            did, th = _ids(part, text)
            shape = mix64((place - head).astype(np.uint64) << np.uint64(32) | (tail - head).astype(np.uint64))
            route = words.sequence(head, tail + threshold, 0) ^ shape
            base = words.first[text]
            parts.append(_rows(ASK, did, th, head - base, tail - base, route, anchor))
        if parts:
            first, others = _first_wins(_join(parts))
            yield _batch(_join([first, _rows(CUT, others["did"], others["th"], others["s"], others["e"] + threshold)]))


def _windows(batches: Iterable[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Windows of the doubtful stretches, asking whether they are first; repeats known so far, joined."""
    for batch in batches:
        parts, cuts = [], []
        for part in slices(batch, "text", SLICE_BYTES):
            owner, found = _lists(part.column("found"))
            kind, s, e = (found.field(n).to_numpy(zero_copy_only=False) for n in ("kind", "s", "e"))
            cut = kind == CUT
            text, begin, end = merged(owner[cut], s[cut], e[cut])
            cuts.append(_rows(CUT, *_ids(part, text), begin, end))
            if cut.all():
                continue
            words = Words(part.column("text"))
            owner, s, e = owner[~cut], s[~cut], e[~cut]
            stretch, nth = spread(e - s + 1)
            text, at = owner[stretch], s[stretch] + nth
            start = words.first[text] + at
            first, second = (words.sequence(start, start + threshold, n) for n in (0, 1))
            parts.append(_rows(ASK, *_ids(part, text), at, 0, first, second))
        if parts:
            first, others = _first_wins(_join(parts))
            cuts += [first, _rows(CUT, others["did"], others["th"], others["s"], others["s"] + threshold)]
        if cuts:
            yield _batch(_join(cuts))


def merged(owner: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjoining ranges of each owner joined: owner, start, end."""
    if not len(owner):
        return owner, s, e
    order = np.lexsort((s, owner))
    owner, s, e = owner[order], s[order].astype(np.int64), e[order].astype(np.int64)
    reach = np.maximum.accumulate((owner.astype(np.int64) << 40) + e) - (owner.astype(np.int64) << 40)
    new = np.r_[True, (owner[1:] != owner[:-1]) | (s[1:] > reach[:-1])]
    last = np.r_[np.flatnonzero(new)[1:], len(new)] - 1
    return owner[new], s[new], reach[last]


def _by_route(step: Callable[[Columns], Columns]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Apply a step to rows sorted by route, in portions that hold all rows of a route.

    A route has at most one row from each task before, so a portion is little more than a batch.
    """

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Columns | None = None
        for batch in batches:
            rows = _unpacked(batch)
            held = rows if held is None else _join([held, rows])
            cut = int(np.argmax(held["route"] == held["route"][-1])) if len(held["route"]) else 0
            if cut:
                yield _batch(step(_take(held, slice(0, cut))))
                held = _take(held, slice(cut, None))
        if held is not None and len(held["route"]):
            yield _batch(step(held))

    return kernel


def _settle_seeds(rows: Columns) -> Columns:
    """Occurrences of anchors that occur more than once."""
    known = _take(rows, rows["kind"] == PASS)
    asks = _take(rows, rows["kind"] != PASS)
    found = _take(asks, _shared(asks) & (asks["kind"] == ASK))
    return _join([known, found])


def _settle_stretches(rows: Columns, threshold: int) -> Columns:
    """Later stretches are cut; originals ask whether their anchor has other originals."""
    first, others = _first_wins(_take(rows, rows["kind"] == ASK))
    return _join(
        [
            _take(rows, rows["kind"] == CUT),
            _rows(CUT, others["did"], others["th"], others["s"], others["e"] + threshold),
            _ask_or_pass(first, first["aux"]),
        ]
    )


def _settle_originals(rows: Columns) -> Columns:
    """Originals of an anchor with more than one go on."""
    known = _take(rows, rows["kind"] == PASS)
    asks = _take(rows, rows["kind"] != PASS)
    found = _take(asks, _shared(asks) & (asks["kind"] == ASK))
    return _join([known, _rows(PASS, found["did"], found["th"], found["s"], found["e"])])


def _settle_windows(rows: Columns, threshold: int) -> Columns:
    _, others = _first_wins(_take(rows, rows["kind"] == ASK))
    return _join([_take(rows, rows["kind"] == CUT), _rows(CUT, others["did"], others["th"], others["s"], others["s"] + threshold)])


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text without its repeated words, the number of words and of repeated ones, and the repeats."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        owner, found = _lists(batch.column("cuts"))
        if len(owner):
            owner, s, e = merged(owner, found.field("s").to_numpy(), found.field("e").to_numpy())
        else:
            s = e = owner
        edge = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        texts, words, removed, repeats = [], [], [], []
        for row, text in enumerate(batch.column("text")):
            parts = (text.as_py() or "").encode().split()  # splits on the six white-space bytes
            words.append(len(parts))
            ranges = list(zip(s[edge[row] : edge[row + 1]].tolist(), e[edge[row] : edge[row + 1]].tolist()))
            for begin, end in reversed(ranges):
                del parts[begin:end]
            removed.append(words[-1] - len(parts))
            texts.append(b" ".join(parts).decode())
            repeats.append([{"start": begin, "end": end} for begin, end in ranges])
        yield pa.RecordBatch.from_arrays(
            [batch.column("did"), batch.column("th"), pa.array(texts, pa.string()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(repeats, span)],
            ["did", "th", "kept_text", "n_words", "n_removed", "repeats"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = 20) -> DataFrame:
    """doc_id, kept_text (the words that are left, joined by one space), n_words, n_removed and
    repeats (the maximal repeats that were cut, as ranges of words) of every row.

    A word goes when it lies in a window of ``threshold`` words whose sequence also starts earlier: in
    a smaller id, or earlier in the same document.  A NULL id counts as larger than any.  A NULL text
    has no words.  Rows that share id and text are one document and get equal results; rows that
    share only the id are ordered by a hash of their text.  Ids must be integers.  Other columns are
    not carried.  Rows with one id, or with none, are told apart by 63 bits of that hash.

    The ids are counted at once, when this is called: where no two rows share one, hashes need not be sent.
    """
    given, words = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("string")
    ids = docs.groupBy(given.alias("did")).count()
    repeated = (ids.agg(F.max("count")).first()[0] or 0) > 1
    text_hash = F.shiftrightunsigned(F.xxhash64(words), 1)
    rows = docs.select(
        F.coalesce(given, F.lit(NO_ID)).alias("did"),
        # Tells rows with one id apart; the sign says that there is an id, so that NULL comes last.
        F.when(given.isNull(), text_hash).otherwise((text_hash if repeated else F.lit(0)).bitwiseOR(F.lit(HAS_ID))).alias("th"),
        words.alias("text"),
    )
    # Repeated rows are settled as one document; only the cuts found for it go to each of them.
    documents = rows.dropDuplicates(["did", "th"]) if repeated else rows

    def settled(rows: DataFrame, step: Callable[[Columns], Columns]) -> DataFrame:
        return rows.repartition("route").sortWithinPartitions("route").mapInArrow(_by_route(step), ROW)

    def of_document(rows: DataFrame, column: Column, name: str) -> DataFrame:
        return _columns(rows).groupBy("did", "th").agg(F.collect_list(column).alias(name))

    # The texts are shuffled once: the three joins below share one exchange of all documents.
    anchors = documents.mapInArrow(lambda b: _seeds(b, threshold), ROW).drop("aux")
    seeds = settled(anchors, _settle_seeds)
    seeded = documents.join(of_document(seeds, F.col("s"), "seeds"), ["did", "th"])
    stretches = settled(seeded.mapInArrow(lambda b: _stretches(b, threshold), ROW), lambda rows: _settle_stretches(rows, threshold))
    # What is cut already goes straight to its document; both branches read one exchange.
    is_cut = F.col("at").bitwiseAND(F.lit(3)) == CUT
    known = stretches.filter(is_cut)
    originals = settled(stretches.filter(~is_cut).drop("aux"), _settle_originals)
    doubtful = documents.join(of_document(known.union(originals), F.struct("kind", "s", "e"), "found"), ["did", "th"])
    windows = settled(doubtful.mapInArrow(lambda b: _windows(b, threshold), ROW), lambda rows: _settle_windows(rows, threshold))
    cut = rows.join(of_document(windows, F.struct("s", "e"), "cuts"), ["did", "th"], "left")
    schema = "did long, th long, kept_text string, n_words long, n_removed long, repeats array<struct<start:int,end:int>>"
    kept = cut.mapInArrow(_kept, schema)
    doc_id = F.when(F.col("th") < 0, F.col("did"))
    return kept.select(doc_id.alias("doc_id"), "kept_text", "n_words", "n_removed", "repeats")
