"""Pseudonyms: permutations, formats, round trips."""

import random
import re
from datetime import date, datetime

import pytest

from tutorspark.llm import pseudonyms
from tutorspark.llm.pseudonyms import KINDS, Replacer, check_digit, permute, pseudonym
from tutorspark.llm.queries import llm_queries

KEY = b"a key"
BY_NAME = {kind.name: kind for kind in KINDS}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 26, 100, 1000, 4097])
def test_permutation(size):
    there = [permute(KEY, "t", n, size) for n in range(size)]
    assert sorted(there) == list(range(size))
    assert [permute(KEY, "t", n, size, back=True) for n in there] == list(range(size))
    if size >= 100:
        assert there != [permute(KEY, "u", n, size) for n in range(size)]
        assert there != [permute(b"other", "t", n, size) for n in range(size)]
        assert sum(a == b for a, b in enumerate(there)) < 10


def test_large_domains():
    rng = random.Random(1)
    for size in (10**15, 26**40, (1 << 61) - 1):
        for _ in range(20):
            value = rng.randrange(size)
            other = permute(KEY, "t", value, size)
            assert 0 <= other < size and permute(KEY, "t", other, size, back=True) == value


VALUES = {
    "email": ["of.55@mail9.example.com", "A_b-9%+c@x-y.org"],
    "card": ["4845168114407329", "4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "6304000000000000000"],
    "phone": ["+1 (017) 555-7713", "(974) 555-3436", "555-555-1234", "+49 30.123 4567"],
    "address": ["97.51.17.173", "255.0.0.1"],
    "insurance": ["123-45-6789"],
    "date": ["2024-02-29", "1999/12/31", "31.12.1999", "12/31/1999", "01-02-2003"],
}
INVALID = [
    "9807915762804490",
    "256.1.1.1",
    "1.2.3.4.5",
    "01.2.3.4",
    "666-12-1234",
    "123-00-1234",
    "2023-02-29",
    "1899-12-31",
    "31/12/1999",
    "2024-02/29",
    "x9807915762804490",
    "98079157628044900000",
    "@example.com",
    "12345",
]


@pytest.mark.parametrize("name", VALUES)
def test_values(name):
    kind = BY_NAME[name]
    for value in VALUES[name]:
        text = f"é «{value}», {value}."
        new, spans = Replacer(KEY)(text)
        other = pseudonym(kind, KEY, value)
        assert other != value and new == f"é «{other}», {other}."
        assert [k for _, _, k in spans] == [name, name] and text[spans[0][0] : spans[0][1]] == value
        assert re.fullmatch(kind.pattern, other, re.ASCII)
        if name != "address":
            assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", other.split("@")[0]))) == re.sub(
                "[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value.split("@")[0]))
            )
        assert kind.number(other) is not None
        assert Replacer(KEY, back=True)(new)[0] == text


def test_invalid_values_stay():
    for value in INVALID:
        assert Replacer(KEY)(f" {value} ") == (f" {value} ", []), value


def test_neighbours():
    cards = "7536784127813050 4845168114407329 123"
    new, spans = Replacer(KEY)(cards)
    assert [(s, e) for s, e, _ in spans] == [(0, 16), (17, 33)] and new.endswith(" 123")


def test_formats_are_bijections():
    days = [date(1900, 1, 1).toordinal() + n for n in range(0, 73049, 7)]
    texts = [date.fromordinal(d).isoformat() for d in days]
    assert len({pseudonym(BY_NAME["date"], KEY, t) for t in texts}) == len(texts)
    bodies = [f"{n:012}" for n in range(3000)]
    cards = {pseudonym(BY_NAME["card"], KEY, b + check_digit(b)) for b in bodies}
    assert len(cards) == 3000 and all(check_digit(c[:-1]) == c[-1] for c in cards)


MORE_VALUES = {
    "day_first_date": ["25/12/1980", "31/12/1999", "29/02/2024", "13/01/1900"],
    "phone": [
        "+34 612 345 678",
        "+33 1 23 45 67 89",
        "+49 30 12345678",
        "+4915112345679",  # ...78 has the check digit of a card number and counts as one
        "+44 (0)20 7946 0958",
        "0171 2345678",
        "030/12345678",
        "01 23 45 67 89",
        "020 7946 0958",
        "663 555 6869",
    ],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "ES9121000418450200051332", "FR14 2004 1010 0505 0001 3M02 606"],
}


def test_more_values(spark):
    values = [(kind, v) for kind, vs in MORE_VALUES.items() for v in vs]
    rows = [(n, f"é «{v}» NEXT, {v}.") for n, (_, v) in enumerate(values)]
    new = pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k")
    got = {r.doc_id: r for r in new.collect()}
    back = {r.doc_id: r.text for r in pseudonyms.pseudonymise(new.drop("pseudonyms"), "k", back=True).collect()}
    for n, (kind, value) in enumerate(values):
        assert value not in got[n].text, value
        assert [s.kind for s in got[n].pseudonyms] == [kind] * 2 and got[n].pseudonyms[0].end - got[n].pseudonyms[0].start == len(value)
        assert back[n] == rows[n][1]


@pytest.mark.parametrize("value", ["32/01/2000", "30/02/2000", "25/13/1980", "DE88 3704 0044 0532 0130 00", "+12 34", "0171 23456"])
def test_more_invalid_values_stay(value):
    assert Replacer(KEY, pseudonyms.ALL_KINDS)(f" {value} ") == (f" {value} ", [])


def test_more_formats_are_bijections():
    """Day-first dates, and long phone numbers, which must not turn into card numbers."""
    replace, back = Replacer(KEY, pseudonyms.ALL_KINDS), Replacer(KEY, pseudonyms.ALL_KINDS, back=True)
    days = [date.fromordinal(d) for d in range(date(1999, 1, 1).toordinal(), date(2005, 1, 1).toordinal())]
    texts = [d.strftime("%d/%m/%Y") for d in days] + [f"+49151{n * 7919:08}" for n in range(2000)] + [f"0171 {n:07}" for n in range(2000)]
    new = [replace(t)[0] for t in texts]
    assert len(set(new)) == len(set(texts)) and [back(t)[0] for t in new] == texts


def test_documents(spark, documents):
    df, rows = documents
    new = pseudonyms.pseudonymise(df, "k")
    assert new.columns == [*df.columns, "pseudonyms"]
    got = new.collect()
    replace = Replacer(b"k")
    want = sorted(((str(r[0]), None, []) if r[1] is None else (str(r[0]), *replace(r[1]))) for r in rows)
    assert sorted((str(r.doc_id), r.text, [tuple(s) for s in r.pseudonyms]) for r in got) == want
    back = pseudonyms.pseudonymise(new.drop("pseudonyms"), "k", back=True)
    assert sorted((str(r.doc_id), r.text or "") for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in rows)


def test_equal_values_stay_linked(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs = {}
    new = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "k").filter("size(pseudonyms) > 0").collect()}
    old = {r.doc_id: r.text for r in docs.collect()}
    for doc, row in new.items():
        shift = 0
        for s in row.pseudonyms:
            value = old[doc][s.start : s.end]
            other = pseudonym(BY_NAME[s.kind], b"k", value)
            assert row.text[s.start + shift : s.start + shift + len(other)] == other
            assert pairs.setdefault(value, other) == other and value not in row.text
            shift += len(other) - len(value)
    assert len(set(pairs.values())) == len(pairs) > 100


def test_edges(spark, no_documents):
    assert pseudonyms.pseudonymise(no_documents, "k").collect() == []
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "call " * 50_000 + "9" * 100_000 + " a" * 1000, "x")], "doc_id long, text string, Pseudonyms string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(df, "k").collect()}
    assert got[1].text is None and got[2].text == "" and got[3].pseudonyms == []


def test_query(spark):
    got = llm_queries()["op9_pseudonyms"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and sum(r.n_values for r in got) > 30


NOTATIONS = [
    ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"],
    ["12/25/1980", "1980-12-25", "25.12.1980", "1980/12/25", "25-12-1980", "1980-12-25T10:00:00Z"],
    ["05/03/1980", "5/3/1980", "1980-5-3", "1980-05-03", "3.5.1980"],
    ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"],
    ["555-123-4567", "(555) 123-4567", "555.123.4567", "555 123 4567", "5551234567"],
    ["+49 30 1234567", "+49 (30) 123-4567", "+49 30 123 4567"],
]


def canonical(text):
    """A value without its notation, read by code of its own."""
    text = re.sub(r"T\d\d:.*", "", text)
    for form in ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d.%m.%Y", "%d-%m-%Y"):
        try:
            return datetime.strptime(text, form).date()
        except ValueError:
            pass
    return re.sub(r"[^A-Z0-9+]", "", text)


@pytest.mark.parametrize("values", NOTATIONS, ids=lambda v: v[0])
def test_values_are_linked_however_they_are_written(values):
    replace, back = Replacer(KEY, pseudonyms.ALL_KINDS), Replacer(KEY, pseudonyms.ALL_KINDS, back=True)
    assert len({canonical(v) for v in values}) == 1
    new = [replace(f"on {v}, too")[0][3:-5] for v in values]
    assert len({canonical(v) for v in new}) == 1 and canonical(new[0]) != canonical(values[0])
    for old, other in zip(values, new, strict=True):
        assert re.sub("[0-9A-Z]+", "", old) == re.sub("[0-9A-Z]+", "", other)
        assert canonical(back(f"on {other}, too")[0][3:-5]) == canonical(old)


def luhn(digits):
    doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
    return sum(sum(divmod(d, 10)) for d in doubled) % 10 == 0


def test_pseudonyms_are_valid_and_distinct():
    """By checks of the test's own: Luhn sums, the calendar, IBANs modulo 97."""
    replace, rng = Replacer(KEY, pseudonyms.ALL_KINDS), random.Random(2)
    cards = {f"{n}{c}" for n in rng.sample(range(10**14, 10**15), 400) for c in range(10) if luhn(f"{n}{c}")}
    new = {replace(c)[0] for c in cards}
    assert len(new) == len(cards) and all(len(c) == 16 and luhn(c) for c in new) and len(new & cards) < 3
    days = {date.fromordinal(rng.randrange(date(1950, 1, 1).toordinal(), date(2020, 1, 1).toordinal())) for _ in range(2000)}
    assert len({datetime.strptime(replace(d.strftime("%m/%d/%Y"))[0], "%m/%d/%Y") for d in days}) == len(days)
    for n in range(200):
        body = f"37040044{n:010}"
        iban = f"DE{98 - int(f'{body}131400') % 97:02}{body}"
        other = replace(iban)[0]
        assert other != iban and int(other[4:] + "1314" + other[2:4]) % 97 == 1
    phones = {f"{n}" for n in rng.sample(range(2 * 10**9, 10**10), 500)}
    new = {replace(p)[0] for p in phones}
    assert len(new) == len(phones) and all(re.fullmatch("[2-9][0-9]{9}", p) for p in new)


@pytest.mark.parametrize("value", ["1980-13-5", "2/30/1980", "1234567890", "0551234567", "55512345678", "1980-12-25Tuesday", "v5551234567", "5551234567.5"])
def test_what_only_looks_like_a_value_stays(value):
    assert Replacer(KEY, pseudonyms.ALL_KINDS)(f" {value} ") == (f" {value} ", [])


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", 3)], "doc_id long, text string, `a.b` int")
    got = pseudonyms.pseudonymise(df, "key").collect()
    assert [(r.doc_id, r.text, r["a.b"]) for r in got] == [(1, "a", 3)]
