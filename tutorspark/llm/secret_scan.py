"""Secrets in texts, found through a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams of lower-cased bytes: a
conjunction of disjunctions that every matching text fulfils.  Each slice of a partition is indexed
on its own: the postings of all trigrams that some rule asks for, from one pass over the bytes.  A
rule's candidates are the intersection and union of these postings, and only they are searched with
the expression itself.  A rule without a mandatory trigram, such as a run of hex digits, searches every
text.  Index and search stay in one task, so nothing is shuffled and a lost task is run again alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import product

# The standard library's parser of expressions; it has no public name.
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.llm.arrow_text import ASCII_LOWER, slices, utf8
from tutorspark.llm.storage import numbered

#: Sets of strings larger than this are not followed further.
MAX_STRINGS = 64
SPAN = "array<struct<start:int,end:int,kind:string>>"

Clause = frozenset[str]
Query = frozenset[Clause]
"""Every clause must hold; a clause holds when one of its trigrams occurs."""


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``shortest`` characters."""

    kind: str
    pattern: str
    shortest: int = 1
    group: int = 0
    flags: int = re.ASCII


#: The base rules, in their order.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        shortest=12,
        group=2,
        flags=re.ASCII | re.IGNORECASE,
    ),
    # A shorter run cannot hold a longer match, so the least length may stand in the expression.
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)

#: A key from its BEGIN line to its END line, if no other line of dashes comes before.  Else as far as the
#: body goes: header lines such as "Version: 2", runs of base64, and a last line that may be short.
#: Lines may be quoted or end in a written-out \n.
PRIVATE_KEY = (
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^-]|-(?!----))*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:GAP(?:(?:Proc-Type|DEK-Info):\x20*\S+|[A-Z][A-Za-z-]+:\x20[^\r\n\\]*(?=[\r\n\\])))*"
    r"(?:GAP[A-Za-z0-9+/]{16,}+={0,2})++"
    r"(?:GAP(?:[A-Za-z0-9+/]+={1,2}|=[A-Za-z0-9+/]{4})(?![A-Za-z0-9+/=])|(?:\r?\n|\\n)[A-Za-z0-9+/]+(?=[\x20\t]*(?:[\r\n\\\"']|\Z)))?"
    r"(?:GAP=[A-Za-z0-9+/]{4}(?![A-Za-z0-9+/=]))?)?"
).replace("GAP", r"""(?:[\s"'>]|\\[nr])++""")

#: Further kinds of which the shape alone gives them away.
MORE_RULES = (
    Rule("private_key", PRIVATE_KEY),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("repository_token", r"(?:ghp|gho|ghs|ghu)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", flags=re.ASCII | re.IGNORECASE),
)


@dataclass(frozen=True)
class _Shape:
    """What is known of the strings an expression matches: all of them, or the trigram clauses."""

    strings: frozenset[str] | None
    clauses: Query = frozenset()


ANYTHING = _Shape(None)


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clauses(strings: frozenset[str]) -> Query:
    """Clauses that hold for every text with one of the strings in it."""
    sets = [_trigrams(s) for s in strings]
    if not sets or not all(sets):
        return frozenset()
    if len(sets) == 1:
        return frozenset(frozenset({t}) for t in sets[0])
    common = frozenset.intersection(*sets)
    own = [sorted(s - common) for s in sets]
    found = {frozenset({t}) for t in common}
    if all(own):
        # The n-th trigram of one or another; short lists are repeated at their end.
        longest = max(map(len, own))
        found |= {frozenset(s[min(n, len(s) - 1)] for s in own) for n in range(longest)}
    return frozenset(found)


def _sequence(parts: Iterable[_Shape]) -> _Shape:
    """One shape after another: neighbouring sets of strings are joined while they stay few."""
    clauses: set[Clause] = set()
    run: frozenset[str] = frozenset({""})
    exact = True
    for part in parts:
        clauses |= part.clauses
        if part.strings is not None and len(run) * len(part.strings) <= MAX_STRINGS:
            run = frozenset(a + b for a, b in product(run, part.strings))
            continue
        clauses |= _clauses(run)
        exact = False
        run = part.strings if part.strings is not None else frozenset({""})
    if exact:
        return _Shape(run)
    return _Shape(None, frozenset(clauses | _clauses(run)))


def _either(parts: list[_Shape]) -> _Shape:
    if all(p.strings is not None for p in parts):
        strings = frozenset().union(*(p.strings for p in parts))
        return _Shape(strings) if len(strings) <= MAX_STRINGS else _Shape(None, _clauses(strings))
    queries = [p.clauses if p.strings is None else _clauses(p.strings) for p in parts]
    if not all(queries):
        return ANYTHING
    if len(set(queries)) == 1:
        return _Shape(None, queries[0])
    # One clause of each alternative, widened to a common one.
    return _Shape(None, frozenset({frozenset().union(*(min(q, key=lambda c: (len(c), sorted(c))) for q in queries))}))


def _lower(code: int) -> str | None:
    """The character as the index sees it; other characters than ASCII are left to the search."""
    return chr(code).lower() if code < 128 else None


def _shape(tokens: Iterable) -> _Shape:
    parts = []
    for kind, value in tokens:
        if kind is sre.LITERAL:
            char = _lower(value)
            parts.append(ANYTHING if char is None else _Shape(frozenset({char})))
        elif kind is sre.IN:
            parts.append(_one_of(value))
        elif kind is sre.SUBPATTERN:
            parts.append(_shape(value[3]))
        elif kind is sre.BRANCH:
            parts.append(_either([_shape(branch) for branch in value[1]]))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, inner = value
            one = _shape(inner)
            if least == 0:
                parts.append(_either([_Shape(frozenset({""})), one]) if most == 1 else ANYTHING)
            else:
                parts += [one] * min(least, 3)
                if most != least or least > 3:
                    parts.append(ANYTHING)
        elif kind is sre.AT or kind in (sre.ASSERT, sre.ASSERT_NOT):
            parts.append(_Shape(frozenset({""})))
        else:
            parts.append(ANYTHING)
    return _sequence(parts)


def _one_of(items: list) -> _Shape:
    codes: set[int] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            codes.add(value)
        elif kind is sre.RANGE:
            codes |= set(range(value[0], min(value[1], value[0] + 256) + 1))
        else:
            return ANYTHING
        if len(codes) > MAX_STRINGS or any(c >= 128 for c in codes):
            return ANYTHING
    chars = frozenset(chr(c).lower() for c in codes)
    return _Shape(chars) if len(chars) <= 4 else ANYTHING


def trigram_query(rule: Rule) -> Query:
    """Clauses that every text with a match fulfils; none when the rule has no mandatory trigram."""
    tree = sre_parser.parse(rule.pattern, rule.flags)
    if tree.state.flags & re.IGNORECASE and not tree.state.flags & re.ASCII:
        return frozenset()  # letters outside ASCII may stand for some inside
    return _sequence([_shape(tree), ANYTHING]).clauses


def _code(trigram: str) -> int:
    a, b, c = trigram.encode("ascii")
    return a << 16 | b << 8 | c


class TrigramIndex:
    """Postings of the wanted trigrams over the texts of one slice."""

    def __init__(self, queries: Sequence[Query]):
        self.codes = sorted({_code(t) for q in queries for clause in q for t in clause})
        self.place = {c: n for n, c in enumerate(self.codes)}
        self.slot = np.zeros(1 << 24, np.uint16)
        for n, c in enumerate(self.codes):
            self.slot[c] = n + 1
        self.postings: list[np.ndarray] = []
        self.texts = 0

    def build(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.texts = len(offsets) - 1
        low = ASCII_LOWER[data].astype(np.int32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else low[:0]
        slot = self.slot[codes]
        at = np.flatnonzero(slot)
        owner = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[owner + 1]
        pairs = np.unique(slot[at[inside]].astype(np.int64) * self.texts + owner[inside])
        trigram, text = np.divmod(pairs, max(self.texts, 1))
        edges = np.searchsorted(trigram, np.arange(1, len(self.codes) + 2))
        self.postings = [text[edges[n] : edges[n + 1]] for n in range(len(self.codes))]

    def candidates(self, query: Query) -> np.ndarray:
        """Texts that fulfil the query: unions within clauses, intersected from the shortest on."""
        lists = [np.unique(np.concatenate([self.postings[self.place[_code(t)]] for t in clause])) for clause in query]
        if not lists:
            return np.arange(self.texts)
        found = min(lists, key=len)
        for one in sorted(lists, key=len)[1:]:
            if not len(found):
                break
            found = found[np.isin(found, one, assume_unique=True)]
        return found


def search(rule: Rule, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches whose group is long enough."""
    return [m.span() for m in expression.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.shortest]


def _scan(docs: DataFrame, rules: Sequence[Rule], text: str, carried: Sequence[str], spans: str | None, mark: str | None) -> DataFrame:
    """Columns ``carried``, then the spans if they are given a name; with a mark, texts are masked."""
    rules, names = tuple(rules), list(carried)
    read, plain = numbered(docs, [*names, text])
    carried, text = [plain[c] for c in names], plain[text]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(rule) for rule in rules]
        expressions = [re.compile(rule.pattern, rule.flags) for rule in rules]
        index = TrigramIndex(queries)
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                index.build(*utf8(column))
                found: dict[int, list[tuple[int, int, int]]] = {}
                for n, (rule, expression, query) in enumerate(zip(rules, expressions, queries, strict=True)):
                    for row in index.candidates(query).tolist():
                        hits = search(rule, expression, column[row].as_py() or "")
                        if hits:
                            found.setdefault(row, []).extend((start, n, end) for start, end in hits)
                ordered = {row: [(s, e, rules[n].kind) for s, n, e in sorted(hits)] for row, hits in found.items()}
                out = [part.column(c) for c in carried]
                if mark is not None and ordered:
                    texts = column.to_pylist()
                    for row, hits in ordered.items():
                        texts[row] = _masked(texts[row], hits, mark)
                    out[carried.index(text)] = pa.array(texts, column.type)
                if spans is not None:
                    keys = ("start", "end", "kind")
                    lists = [[dict(zip(keys, hit)) for hit in ordered.get(row, ())] for row in range(part.num_rows)]
                    out.append(pa.array(lists, pa.list_(span)))
                yield pa.RecordBatch.from_arrays(out, carried + ["found"] * (spans is not None))

    schema = [f"{c} {read.schema[c].dataType.simpleString()}" for c in carried]
    found = read.mapInArrow(kernel, ", ".join(schema + [f"found {SPAN}"] * (spans is not None)))
    return found.toDF(*names, *[spans] * (spans is not None))


def scan_texts(
    docs: DataFrame, rules: Sequence[Rule], text: str = "text", spans: str = "spans", columns: Sequence[str] | None = None
) -> DataFrame:
    """The rows of ``docs`` with the given columns (all, if none are named), and ``spans``: array of
    (start, end, kind) in code points.

    Spans are ordered by start, then by the order of the rules; end is exclusive.  A NULL text counts
    as empty and has no spans.  A column of the input that is called as ``spans`` is left out.  Every
    row is searched on its own, so repeated rows get equal spans and an empty table an empty one.
    """
    carried = [c for c in (docs.columns if columns is None else columns) if c.lower() != spans.lower()]
    return _scan(docs, rules, text, carried, spans, None)


def mask(docs: DataFrame, rules: Sequence[Rule], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span replaced by the mark; overlapping spans become one mark.

    Rows without a span are unchanged, NULL texts stay NULL.
    """
    return _scan(docs, rules, text, docs.columns, None, mark)


def _masked(text: str, spans: Iterable[tuple[int, int, str]], mark: str) -> str:
    pieces, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            pieces += [text[at:start], mark]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def span_text(spans: str, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the spans, of the given kinds only, joined by commas."""
    column = F.col(spans)
    if kinds is not None:
        column = F.filter(column, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
