"""Rules and host reputations on small tables; the whole query is compared with SQL elsewhere."""

import math
import re

import pytest

from tutorspark.llm import url_reputation
from tutorspark.llm.queries import URL_RULES, llm_queries

URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "://x.net/es/",
    "HTTP://WWW.Example.COM/en/a?b#c",
    "http://a.www.example.com/en/",
    "http://example.com/en",
    "http://example.com/en/#x",
    "http://xexample.com/en/",
    "http://com",
    "http://com/",
    "http://é.net/fr/a/b",
    "http://ÀÉ.Net/fr/",
    "http://host.net?q=/fr/",
    "http://host.net#/fr/",
    "http://a.b.co.uk/x",
    "http://10.0.0.1/x",
    "x://y://z.com/a",
    "http://net/es/\nnext",
    "http://u@h.org:80/p",
]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    after = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", after).group()
    path = re.match(r"[^?#]*", after[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if not fits:
        return host, path, None, None
    best = max(fits, key=lambda r: len(r[1] + r[2]))
    return host, path, best[1] + best[2], best[0]


def test_rules(spark):
    rows = [(n, u, "x", 1.0) for n, u in enumerate(URLS)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, Verdict string, other double")
    got = url_reputation.judge_urls(df, URL_RULES)
    assert got.columns == ["page_id", "url", "other", "host", "path", "rule", "verdict", "lower_bound"]
    seen = sorted((r.page_id, r.host, r.path, r.rule) for r in got.collect())
    assert seen == sorted((n, *plain_rule(u)[:3]) for n, u, *_ in rows)
    for r in got.collect():
        verdict = plain_rule(URLS[r.page_id])[3]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    got = llm_queries()["op1_url_reputation"](spark, sf_dir).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = plain_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_reputation.judge_urls(df, URL_RULES).collect() == []


def test_a_suspect_host_is_blocked_and_an_unknown_one_allowed(spark):
    """Among hosts that are mostly mixed, one bad page is not enough, and thirty are."""
    rules = [("block", "net", "/x/"), ("allow", "net", "/z/"), ("block", "odd.org", "/x/")]
    urls = [f"http://bad.net/x/{n}" for n in range(30)] + [f"http://good.net/z/{n}" for n in range(30)]
    urls += [f"http://h{n}.net/{'x' if m < 3 else 'z'}/{m}" for n in range(20) for m in range(10)]
    urls += ["http://odd.org/x/1", "http://bad.net/y", "http://good.net/y", "http://odd.org/y", "http://new.info/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.url: r.verdict for r in url_reputation.judge_urls(df, rules).collect() if r.rule is None}
    assert got == {"http://bad.net/y": "block", "http://good.net/y": "allow", "http://odd.org/y": "allow", "http://new.info/": "allow"}


def test_posterior(spark):
    """One domain a suffix, several hosts: the formulas by hand."""
    counts = {"a.d.net": (10, 9), "b.d.net": (20, 2), "c.d.net": (0, 0), "e.f.org": (5, 5)}
    rows = []
    for host, (n, k) in counts.items():
        rows += [(host, 1)] * k + [(host, 0)] * (n - k) + [(host, None)] * 3
    got = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, outcome int")).collect()}

    def strengths(children):
        """children: n, k, prior mean, pages behind it, parent's mean, labelled children of the parent."""
        fit = [(n, k, m, (c - 1) / c) for n, k, _, _, m, c in children.values() if n]
        noise = sum(m * (1 - m) * free for _, _, m, free in fit)
        room = sum(m * (1 - m) * (n - 1) * free for n, _, m, free in fit)
        rho = (sum(n * (k / n - m) ** 2 for n, k, m, _ in fit) - noise) / room if room > 0 else 0
        rho = min(max(rho, 1 / (len(fit) + 1)), 0.999)
        return {name: 1 / (rho / (1 - rho) + 1 / known) for name, (_, _, _, known, _, _) in children.items()}

    suffix = {"net": (30, 11, 5.5 / 6, 6.0, 16.5 / 36, 2), "org": (5, 5, 11.5 / 31, 31.0, 16.5 / 36, 2)}
    s = strengths(suffix)
    # Each suffix has one domain, so nothing but the suffix's own prior tells of it.
    domain = {}
    for name, up in (("d.net", "net"), ("f.org", "org")):
        n, k, m, *_ = suffix[up]
        domain[name] = n, k, m, s[up], (k + s[up] * m) / (n + s[up]), 1
    s = strengths(domain)
    assert s["d.net"] < 1 and s["f.org"] < 1
    host = {}
    for name, (n, k) in counts.items():
        parent = name.split(".", 1)[1]
        known = domain[parent][0] - n + s[parent]
        before = s[parent] * domain[parent][2]
        pooled = (domain[parent][1] + before) / (domain[parent][0] + s[parent])
        host[name] = n, k, (domain[parent][1] - k + before) / known, known, pooled, 2 if parent == "d.net" else 1
    s = strengths(host)
    for name, (n, k, m, *_) in host.items():
        a, b = s[name] * m + k + 0.5, s[name] * (1 - m) + n - k + 0.5
        low = a / (a + b) - 1.645 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        assert got[name].posterior_mean == pytest.approx(a / (a + b)) and got[name].lower_bound == pytest.approx(low)
        assert (got[name].n_labelled, got[name].n_bad) == (n, k)


@pytest.mark.parametrize("hosts, domains", [(1, 1), (50, 1), (50, 50)])
def test_one_labelled_suffix_says_nothing_of_others(spark, hosts, domains):
    """Fifty bad pages below net, on one host or many: another suffix's host is allowed, net's own are not."""
    urls = [f"http://h{n % hosts}.d{n % domains}.net/x/{n}" for n in range(50)] + ["http://x.org/", "http://h0.d0.net/y", "http://z"]
    df = spark.createDataFrame([(n, u, 1) for n, u in enumerate(urls)], "page_id long, url string, `a.b` int")
    got = url_reputation.judge_urls(df, [("block", "net", "/x/")])
    assert got.columns[:3] == ["page_id", "url", "a.b"]
    verdicts = {r.url: r.verdict for r in got.collect()}
    assert verdicts["http://x.org/"] == verdicts["http://z"] == "allow" and verdicts["http://h0.d0.net/y"] == "block"


def test_no_label_at_all(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in url_reputation.judge_urls(df, []).collect()} == {"allow"}


def test_a_crowded_host(spark):
    rows = [("hot.net", n % 2) for n in range(3000)] + [(f"h{n}.net", 1) for n in range(50)]
    got = url_reputation.host_reputation(spark.createDataFrame(rows, "host string, outcome int").repartition(8)).collect()
    assert len(got) == 51 and {r.n_labelled for r in got if r.host == "hot.net"} == {3000}
