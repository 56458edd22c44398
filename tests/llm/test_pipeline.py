"""The stages against plain Python, and their handling of odd rows."""

import re

import pyarrow as pa
import pytest
from llm.test_bin_packing import check_packing, words
from llm.test_gray_simhash import plain_fingerprint, plain_roots

import corpus_pipeline as pipeline
from tutorspark.llm import language_crf
from tutorspark.llm.storage import keep

SF_DIR = "/root/testdata/sf0.001"
SECRETS = [
    (r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    (r"(AKIA[A-Z0-9]+)", 18),
    (r"([0-9a-f]+)", 16),
]


def plain_mask(text):
    spans = [m.span() for p, least in SECRETS for m in re.finditer(p, text, re.ASCII) if len(m.group(1)) >= least]
    out, at = "", 0
    for start, end in sorted(spans):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def plain_copies(rows):
    """How often each row (id, text, source) is taken, by sorting each source by hash."""
    import hashlib

    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + words(text)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    target, open_ = {}, list(order)
    left = sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            open_.remove(s)
    target |= share
    taken = {}
    for s in order:
        whole, budget = (int(target[s] // size[s]), target[s] % size[s]) if size[s] else (1, 0)
        cells = {}
        for doc, text, source in rows:
            if source == s:
                key = f"{'' if doc is None else doc}\n{text or ''}"
                h = int(hashlib.md5(key.encode()).hexdigest()[:9], 16)
                cells.setdefault(h, []).append((doc, text))
        total, open_cells = 0, size[s] > 0
        for h in sorted(cells):
            cell = sum(words(t) for _, t in cells[h])
            if open_cells and total + cell > budget:
                open_cells, more = False, total + cell - budget < budget - total
            else:
                more = open_cells
            total += cell
            for doc, text in cells[h]:
                taken[doc, text, s] = whole + more
    return taken


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    field = language_crf.fit_on(docs)
    names, score, _, _, _ = language_crf._label(field, pa.array([t for _, t, _ in rows]), False)
    rows = [r for r, name, share in zip(rows, names, score) if name != "und" and share >= 0.3]
    assert len(rows) > 190

    step = keep(pipeline.identify_language(spark, docs, SF_DIR))
    assert sorted(r.doc_id for r in step.collect()) == sorted(r[0] for r in rows)
    roots = plain_roots([(r[0], plain_fingerprint(r[1])) for r in rows], 2)
    rows = [r for r, root in zip(rows, roots) if r[0] == root]
    step = keep(pipeline.drop_near_duplicates(spark, step, SF_DIR))
    assert sorted((r.doc_id, r.text) for r in step.collect()) == sorted(r[:2] for r in rows)
    rows = [(doc, plain_mask(text), source) for doc, text, source in rows]
    step = keep(pipeline.mask_secrets(spark, step, SF_DIR))
    assert sorted((r.doc_id, r.text, r.source, r.n_chars) for r in step.collect()) == sorted((d, t, s, len(t)) for d, t, s in rows)
    mixed = sorted(r for r, times in plain_copies(rows).items() for _ in range(times))
    step = keep(pipeline.mix_sources(spark, step, SF_DIR))
    assert step.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.source) for r in step.collect()) == mixed
    packed = pipeline.pack_bins(spark, step, SF_DIR).collect()
    check_packing(packed, [(r[0], words(r[1])) for r in mixed], pipeline.BIN_WORDS)
    whole = pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.first_word, r.n_words) for r in whole) == sorted((r.doc_id, r.first_word, r.n_words) for r in packed)


def odd_documents(documents):
    df, _ = documents
    names = ["doc_id", "text", "lang", "source", "_h", "score"]
    more = ["_id", "lang_pred", "c0", "Text", "_copies"]
    return df.toDF(*names).selectExpr("*", *[f"{n} AS `{name}`" for n, name in enumerate(more)])


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_odd_rows_and_names(spark, documents, name):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = keep(odd_documents(documents))
        result = dict(pipeline.STAGES)[name](spark, docs, SF_DIR)
        rows = result.collect()
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert rows
    if name != "best_fit_packing":
        assert result.columns == docs.columns
        assert {(r["_id"], r["lang_pred"], r["c0"], r["Text"], r["_copies"]) for r in rows} == {(0, 1, 2, 3, 4)}
        ids = {r.doc_id for r in rows}
        gone = {"language_id": {10_001, 10_002, 10_003}}.get(name, set())
        assert not ids & gone
        if name == "simhash_near_dedup":
            assert 10_006 not in ids and 10_001 in ids and not ids & {10_002, 10_003}


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_empty(spark, no_documents, name):
    result = dict(pipeline.STAGES)[name](spark, no_documents, SF_DIR)
    assert result.collect() == []
    if name != "best_fit_packing":
        assert result.columns == no_documents.columns


def test_repeated_rows_of_one_component_stay_once(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (3, "x y z"), (None, "p q r"), (None, "p q r"), (None, "x y z")]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = pipeline.drop_near_duplicates(spark, df, SF_DIR).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == ["(3, 'a b c d')", "(3, 'x y z')", "(None, 'p q r')"]
