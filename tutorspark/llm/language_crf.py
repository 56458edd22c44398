"""Language of words and of documents, by a linear-chain conditional random field.

A word (a run of letters) has features of its spelling: prefixes and suffixes, letter n-grams, and the
languages in whose lexicon it is.  Neighbouring words are tied by learned transition weights, so that a
short or foreign-looking word leans on its neighbours while a passage in another language is still told
apart.  Forward-backward gives each word a distribution over the languages; a document's language is the
one with the largest expected share of its words, and that share is its score.

The field is fitted on the driver from a sample of at most SAMPLE_DOCS documents a language and
SAMPLE_WORDS words each, spliced into code-switched sequences; that is all that comes to the driver.
Every whole text is labelled, in the tasks that read it, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorspark.llm.arrow_text import ASCII_LOWER, first_of, hash_runs, runs, slices, spread, utf8
from tutorspark.llm.storage import exactly, numbered

SAMPLE_DOCS = 400
#: Languages that are learned, those of the most documents: more are no languages but dirt.
MOST_LANGUAGES = 200
SAMPLE_WORDS = 64
LONGEST_WORD = 64
LEXICON_WORDS = 150
BUCKETS = 1 << 16
EPOCHS = 4
SEQUENCE_WORDS = 32
BATCH = 32
RATE = 0.3
#: Words of a document that are multiplied into one transfer matrix.
BLOCK = 32
#: Steps between rescalings, few enough not to underflow.
RESCALE = 4
SLICE_BYTES = 2 << 20
UNKNOWN = "und"

# A word is a run of ASCII letters and of bytes of other characters.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[128:] = True
IN_WORD[ord("a") : ord("z") + 1] = True
IN_WORD[ord("A") : ord("Z") + 1] = True


@dataclass(frozen=True)
class Field:
    """Fitted weights: of hashed features, of lexicon membership, and of transitions, by language."""

    languages: tuple[str, ...]
    weights: np.ndarray
    lexicon: np.ndarray
    members: np.ndarray
    member_weights: np.ndarray
    transitions: np.ndarray


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the accented letters of Latin-1, in UTF-8."""
    low = ASCII_LOWER[data]
    if len(low) > 1:
        accented = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][accented] += 0x20
    return low


def _bucket(value: np.ndarray, template: int) -> np.ndarray:
    mixed = (value + np.uint64(template << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(48)).astype(np.int64)


def _features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Feature buckets of the words: one array entry a letter, one a word, and each word's first letter."""
    length = ends - starts
    owner, at = spread(length)
    letter = low[starts[owner] + at].astype(np.uint64)
    before = np.where(at == 0, np.uint64(1), np.roll(letter, 1))
    after = np.where(at == length[owner] - 1, np.uint64(2), np.roll(letter, -1))
    pair = before << np.uint64(8) | letter
    by_letter = [_bucket(pair, 1), _bucket(pair << np.uint64(8) | after, 2)]

    def take(offset: np.ndarray) -> np.ndarray:
        inside = (offset >= starts) & (offset < ends)
        return np.where(inside, low[np.clip(offset, 0, len(low) - 1)], 0).astype(np.uint64)

    head = [take(starts + n) for n in range(4)]
    tail = [take(ends - 1 - n) for n in range(4)]
    by_word = []
    for template, letters in ((3, head[:3]), (4, head), (5, tail[:2]), (6, tail[:3]), (7, tail)):
        value = np.zeros(len(starts), np.uint64)
        for one in letters:
            value = value << np.uint64(8) | one
        by_word.append(_bucket(value, template))
    return by_letter, by_word, np.cumsum(length) - length


def _membership(field: Field, words: np.ndarray) -> np.ndarray:
    """Which lexicons each word is in, from its hash: rows of 0 and 1."""
    if not len(field.lexicon):
        return np.zeros((len(words), len(field.languages)), np.float32)
    place = np.minimum(np.searchsorted(field.lexicon, words), len(field.lexicon) - 1)
    return field.members[place] * (field.lexicon[place] == words)[:, None]


def _scores(field: Field, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Summed weights of each word's features, by language."""
    by_letter, by_word, first = _features(low, starts, ends)
    total = _membership(field, hash_runs(low, starts, ends)) @ field.member_weights
    for buckets in by_letter:
        total += np.add.reduceat(field.weights[buckets], first, axis=0)
    for buckets in by_word:
        total += field.weights[buckets]
    return total


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def posteriors(scores: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward: distribution of each word's label, for texts of words first[i]:first[i + 1].

    A chain begins in an unknown state.  Long chains are cut into blocks whose transfer matrices are
    multiplied up first, so the loops are as long as a block and as the largest number of blocks.
    """
    n, labels = scores.shape
    if n == 0:
        return np.zeros((0, labels))
    step = np.exp(transitions - transitions.max())
    lift = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64)) + 1e-30
    words = np.diff(first)
    blocks = -(-words // BLOCK)
    doc, nth = spread(blocks)
    begin = first[:-1][doc] + nth * BLOCK
    size = np.minimum(first[1:][doc] - begin, BLOCK)
    # Blocks by word: word k of each block, or nothing where the block has ended.
    place = begin[:, None] + np.arange(BLOCK)
    there = np.arange(BLOCK) < size[:, None]
    psi = lift[np.where(there, place, 0)]

    transfer = np.broadcast_to(np.eye(labels), (len(begin), labels, labels)).copy()
    for k in range(BLOCK):
        grown = (transfer.reshape(-1, labels) @ step).reshape(transfer.shape) * psi[:, k, None, :]
        transfer = np.where(there[:, k, None, None], grown, transfer)
        if k % RESCALE == RESCALE - 1:
            transfer /= transfer.sum(axis=(1, 2), keepdims=True)

    into = np.full((len(begin), labels), 1.0 / labels)
    out_of = np.ones((len(begin), labels))
    head = np.cumsum(blocks) - blocks
    for k in range(1, int(blocks.max())):
        now = head[blocks > k] + k
        into[now] = _normal(np.einsum("ni,nij->nj", into[now - 1], transfer[now - 1]))
        back = head[blocks > k] + blocks[blocks > k] - 1 - k
        out_of[back] = _normal(np.einsum("nij,nj->ni", transfer[back + 1], out_of[back + 1]))

    forward = np.empty_like(psi)
    state = into
    for k in range(BLOCK):
        moved = (state @ step) * psi[:, k]
        state = np.where(there[:, k, None], moved, state)
        if k % RESCALE == RESCALE - 1:
            state = _normal(state)
        forward[:, k] = state
    gamma = np.empty_like(scores, dtype=np.float64)
    state = out_of
    for k in range(BLOCK - 1, -1, -1):
        now = there[:, k]
        gamma[place[now, k]] = forward[now, k] * state[now]
        moved = (psi[:, k] * state) @ step.T
        state = np.where(now[:, None], moved, state)
        if k % RESCALE == 0:
            state = _normal(state)
    return _normal(gamma)


def _expected_transitions(scores: np.ndarray, transitions: np.ndarray, gamma: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Expected counts of neighbouring label pairs, for equally long short chains."""
    labels = len(transitions)
    length = first[1] - first[0]
    shape = (-1, length, labels)
    psi = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(shape) + 1e-30
    step = np.exp(transitions - transitions.max())
    forward, state = np.empty_like(psi), np.full((len(psi), labels), 1.0 / labels)
    for k in range(length):
        state = forward[:, k] = _normal((state @ step) * psi[:, k])
    total, back = np.zeros((labels, labels)), np.ones((len(psi), labels))
    for k in range(length - 1, 0, -1):
        joint = forward[:, k - 1, :, None] * step * (psi[:, k] * back)[:, None, :]
        total += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = _normal((psi[:, k] * back) @ step.T)
    return total


def _as_words(text: str) -> list[str]:
    data, offsets = utf8(pa.array([text]))
    starts, ends = runs(IN_WORD[data], offsets)
    raw = _lowered(data).tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a <= LONGEST_WORD]


def fit(samples: list[tuple[str, str]], seed: int = 0) -> Field | None:
    """Fit the field to (language, text) pairs by stochastic gradient ascent; None without a word."""
    texts: dict[str, list[list[bytes]]] = {}
    for language, text in samples:
        words = _as_words(text)
        if words:
            texts.setdefault(language, []).append(words)
    if not texts:
        return None
    languages = tuple(sorted(texts))
    labels, rng = len(languages), np.random.default_rng(seed)
    lexicons = _lexicons(texts, languages)
    every = sorted(set().union(*lexicons))
    data, offsets = utf8(pa.array(every, pa.binary())) if every else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    hashes = hash_runs(data, offsets[:-1], offsets[1:])
    members = np.array([[w in lexicon for lexicon in lexicons] for w in every], np.float32).reshape(len(every), labels)
    order = np.argsort(hashes)
    field = Field(
        languages,
        np.zeros((BUCKETS, labels), np.float32),
        hashes[order],
        members[order],
        np.zeros((labels, labels), np.float32),
        np.zeros((labels, labels)),
    )
    sums = [np.full(x.shape, 1e-2) for x in (field.weights, field.member_weights, field.transitions)]
    pieces = [(n, words) for n, language in enumerate(languages) for words in texts[language]]
    for _ in range(EPOCHS):
        for batch in _sequences(pieces, labels, rng):
            _ascend(field, sums, batch)
    return field


def _lexicons(texts: dict[str, list[list[bytes]]], languages: tuple[str, ...]) -> list[set[bytes]]:
    """The words most typical of each language: frequent in it, and more so than elsewhere."""
    counts = [Counter(w for words in texts[language] for w in words) for language in languages]
    whole = sum(counts, Counter())
    lexicons = []
    for count in counts:
        share = sum(count.values()) / max(sum(whole.values()), 1)
        typical = {w: c * np.log(c / (whole[w] * share)) for w, c in count.items() if c >= 3 and (len(counts) == 1 or c > whole[w] * share)}
        lexicons.append(set(sorted(typical, key=lambda w: (-typical[w], w))[:LEXICON_WORDS]))
    return lexicons


def _sequences(pieces: list, labels: int, rng: np.random.Generator) -> Iterator[list[tuple[list[bytes], list[int]]]]:
    """Batches of equally long word sequences, most of them spliced from several texts."""
    queue: list[tuple[list[bytes], list[int]]] = []
    words: list[bytes] = []
    marks: list[int] = []
    cuts: list[tuple[int, list[bytes]]] = []
    for label, text in pieces:
        at = 0
        while at < len(text):
            size = int(rng.choice((4, 8, 16, SEQUENCE_WORDS)))
            cuts.append((label, text[at : at + size]))
            at += size
    for n in rng.permutation(len(cuts)):
        label, cut = cuts[n]
        words, marks = words + cut, marks + [label] * len(cut)
        while len(words) >= SEQUENCE_WORDS:
            queue.append((words[:SEQUENCE_WORDS], marks[:SEQUENCE_WORDS]))
            words, marks = words[SEQUENCE_WORDS:], marks[SEQUENCE_WORDS:]
        if len(queue) >= BATCH:
            yield queue
            queue = []
    if queue:
        yield queue
    elif words and len(pieces) and not len(queue):
        times = -(-SEQUENCE_WORDS // len(words))
        yield [((words * times)[:SEQUENCE_WORDS], (marks * times)[:SEQUENCE_WORDS])]


def _ascend(field: Field, sums: list[np.ndarray], batch: list[tuple[list[bytes], list[int]]]) -> None:
    """One step of AdaGrad on the log-likelihood of the batch's labels."""
    flat = [w for words, _ in batch for w in words]
    marks = np.array([m for _, labels in batch for m in labels])
    low, offsets = utf8(pa.array(flat, pa.binary()))
    starts, ends = offsets[:-1], offsets[1:]
    by_letter, by_word, _ = _features(low, starts, ends)
    scores = _scores(field, low, starts, ends).astype(np.float64)
    first = np.arange(0, len(flat) + 1, SEQUENCE_WORDS)
    gamma = posteriors(scores, field.transitions, first)
    labels = len(field.languages)
    error = np.eye(labels)[marks] - gamma
    gradient = np.zeros(field.weights.shape)
    owner = np.repeat(np.arange(len(flat)), ends - starts)
    for buckets in by_letter:
        np.add.at(gradient, buckets, error[owner])
    for buckets in by_word:
        np.add.at(gradient, buckets, error)
    lexicon = _membership(field, hash_runs(low, starts, ends)).T @ error
    chains = marks.reshape(-1, SEQUENCE_WORDS)
    seen = np.zeros((labels, labels))
    np.add.at(seen, (chains[:, :-1].ravel(), chains[:, 1:].ravel()), 1)
    moves = seen - _expected_transitions(scores, field.transitions, gamma, first)
    parts = ((field.weights, gradient), (field.member_weights, lexicon), (field.transitions, moves))
    for (weights, slope), total in zip(parts, sums, strict=True):
        slope /= len(batch)
        total += slope * slope
        weights += (RATE * slope / np.sqrt(total)).astype(weights.dtype)


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept out of learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text: str, lang: str) -> list[tuple[str, str]]:
    """At most SAMPLE_DOCS documents of each language, and of each at most SAMPLE_WORDS words from a
    place drawn by hash; rows without id, language or text, and held-out rows, take no part.

    Languages are counted first (one row each comes to the driver, MOST_LANGUAGES at most), so that the draw is a
    plain filter where the texts are read, and only about twice the sample leaves those tasks.  Rows draw by id and
    text, so that rows of one id are drawn one by one; the least draw of a language is always in.
    """
    draws = 1 << 30
    number, words, name = exactly([id_col, text, lang])
    known = docs.filter(number.isNotNull() & name.isNotNull() & words.isNotNull() & ~held_out(number))
    drawn = known.select(
        name.cast("string").alias("lang"), words.cast("string").alias("text"), F.pmod(F.xxhash64(number, words, F.lit("draw")), F.lit(draws)).alias("h")
    )
    counts = drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    counts = counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return []
    limits = {r.lang: max(int(2 * SAMPLE_DOCS * draws / r.n), r.least + 1) for r in counts}
    below = F.create_map(*[F.lit(x) for item in sorted(limits.items()) for x in item])
    chosen = drawn.filter(F.col("h") < F.try_element_at(below, F.col("lang")))
    words = F.split(F.trim("text"), r"[\x20\x09-\x0D]+")
    start = F.pmod(F.col("h"), F.greatest(F.size("words") - SAMPLE_WORDS, F.lit(0)) + 1) + 1
    pieces = chosen.withColumn("words", words).withColumn("piece", F.slice("words", start.cast("int"), SAMPLE_WORDS))
    short = F.array_join(F.filter("piece", lambda w: F.length(w) <= LONGEST_WORD), " ")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))
    first = pieces.select("lang", "h", short.alias("piece")).withColumn("place", place).filter(F.col("place") <= SAMPLE_DOCS)
    return [(r.lang, r.piece) for r in sorted(first.collect(), key=lambda r: (r.lang, r.place))]


def fit_on(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Field | None:
    return fit(training_sample(docs, id_col, text, lang))


def _label(field: Field | None, column: pa.Array, with_runs: bool) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list]:
    """Language, score, number of words and of label changes of each text, and its runs of labels."""
    data, offsets = utf8(column)
    texts = len(column)
    starts, ends = runs(IN_WORD[data], offsets)
    first = first_of(starts, offsets)
    words = np.diff(first)
    languages, share, switches = [UNKNOWN] * texts, np.zeros(texts), np.zeros(texts, np.int64)
    spans: list = [[] for _ in range(texts)]
    if field is None or not len(starts):
        return languages, share, words, switches, spans
    gamma = posteriors(_scores(field, _lowered(data), starts, ends), field.transitions, first)
    filled = np.flatnonzero(words)
    mass = np.add.reduceat(gamma, first[:-1][filled], axis=0) / words[filled][:, None]
    best = mass.argmax(axis=1)
    ascii_letter = np.r_[0, np.cumsum(IN_WORD[data] & (data < 128))]
    plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    label = gamma.argmax(axis=1)
    owner = np.repeat(np.arange(texts), words)
    change = np.flatnonzero((label[1:] != label[:-1]) & (owner[1:] == owner[:-1])) + 1
    switches = np.bincount(owner[change], minlength=texts)
    edges = np.unique(np.r_[first[:-1][filled], change, len(label)]) if with_runs else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        spans[owner[a]].append({"lang": field.languages[label[a]], "words": b - a})
    for row, n in zip(filled.tolist(), best.tolist(), strict=True):
        if plain[row] or any(c.isalpha() for c in column[row].as_py()):
            languages[row] = field.languages[n]
    share[filled] = np.clip(mass.max(axis=1), 0.0, 1.0)
    share[[n for n, one in enumerate(languages) if one == UNKNOWN]] = 0.0
    return languages, share, words, switches, spans


def label_languages(docs: DataFrame, field: Field | None, text: str = "text", with_runs: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The named columns of ``docs`` (or all) and lang_pred, score, n_letter_words, n_switches and,
    with runs, lang_runs.

    lang_runs lists the runs of words with one most likely label, as (lang, words).  A text that is
    NULL or has no letter is ``und`` with score 0, as is every text when nothing could be learned.
    Columns of the input with these names are left out.  Rows are labelled one by one: repeated rows
    alike, an empty table gives an empty one.
    """
    types = {"lang_pred": "string", "score": "double", "n_letter_words": "long", "n_switches": "long"}
    if with_runs:
        types["lang_runs"] = "array<struct<lang:string,words:long>>"
    names = [c for c in (docs.columns if columns is None else columns) if c.lower() not in types]
    read, plain = numbered(docs, [*names, text])
    carried, text = [plain[c] for c in names], plain[text]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                languages, share, words, switches, spans = _label(field, part.column(text), with_runs)
                new = [pa.array(languages, pa.string()), pa.array(share), pa.array(words), pa.array(switches)]
                new += [pa.array(spans, run)] * with_runs
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + new, [*carried, *types])

    schema = [f"{c} {read.schema[c].dataType.simpleString()}" for c in carried]
    return read.mapInArrow(kernel, ", ".join(schema + [f"{c} {t}" for c, t in types.items()])).toDF(*names, *types)


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, then label every row: doc_id, held_out, and what
    ``label_languages`` adds but the runs.  A row without id is not held out, and not learned from."""
    field = fit_on(docs, id_col, text, lang)
    number, words = exactly([id_col, text])
    narrow = docs.select(number.alias("doc_id"), words.cast("string").alias("text"))
    return label_languages(narrow, field, with_runs=False, columns=["doc_id"]).withColumn("held_out", held_out(F.col("doc_id")))
