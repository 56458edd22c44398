"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Labelled pages give each host a count of pages and of bad pages.  The bad rate of a host is a beta
distribution whose prior comes from the other hosts of its registered domain, whose prior comes from
the other domains of its public suffix, and that from all other suffixes; a host's own pages count
once.  How much a level shrinks is estimated from the data: the spread of the children's rates around
their parent's mean, beyond what binomial noise explains, by the method of moments.  Few children cannot
tell that there is no spread, so with c labelled children it is taken to be one part in c + 1 at least.  A prior is
never worth more than the pages it was learned from, and never certain: half a page of either kind is added to
every posterior.  A page without a rule is blocked when the lower posterior bound of its host's bad
rate lies above a threshold, so a host that little is known about is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.llm.storage import keep

Rule = tuple[str, str, str]
"""Verdict (allow or block), host, path prefix."""

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels that are told apart from registered domains.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
SALTS = 32
MAX_CORRELATION = 0.999
#: Pages of either kind that a posterior has besides its prior and its own pages.
DOUBT = 0.5


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(after, r"\A[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    """Text after the host up to ``? #`` or the end; empty without ``://``."""
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def fits(rule: Rule) -> Column:
    _, host, path = rule
    at_host = (F.col("host") == host) | F.col("host").endswith(f".{host}")
    return at_host & F.col("path").startswith(path)


def longest_first(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda rule: (-len(rule[1] + rule[2]), -len(rule[1]), rule))


def with_rules(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``rule`` and ``rule_verdict``, those of the longest rule that fits; NULL without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for one in reversed(longest_first(rules)):
        rule = F.when(fits(one), F.lit(one[1] + one[2])).otherwise(rule)
        verdict = F.when(fits(one), F.lit(one[0])).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def registered_domain(host: Column) -> Column:
    """Last two labels, or three below a suffix of two; a numeric address is its own domain."""
    two = F.substring_index(host, ".", -2)
    name = F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)
    return F.when(host.rlike(r"\A[0-9.]*\z"), host).otherwise(name)


def public_suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    name = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))
    return F.when(host.rlike(r"\A[0-9.]*\z"), "").otherwise(name)


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """Join many rows to one row per key; a key's rows go to SALTS tasks, its row to each of them."""
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def below(children: DataFrame, parent_n: str, parent_k: str, n: str, k: str) -> DataFrame:
    """Replace the parent's prior and strength by what the parent's other children and that prior say:
    ``prior`` for the child, ``known``, the number of pages behind it, and ``pooled``, the parent's own mean."""
    before = F.col("strength") * F.col("prior")
    known = F.col(parent_n) - F.col(n) + F.col("strength")
    pooled = (F.col(parent_k) + before) / (F.col(parent_n) + F.col("strength"))
    prior = (F.col(parent_k) - F.col(k) + before) / known
    return children.withColumns({"pooled": pooled, "prior": prior, "known": known}).drop("strength")


def with_strength(children: DataFrame, n: str, k: str, siblings: str) -> DataFrame:
    """Add ``strength``, how many pages the prior is worth: by the over-dispersion of all children around
    their parents' means, and by the pages behind this prior.

    ``siblings`` is the number of labelled children of the parent, which its mean was taken from: of one child
    there is nothing to be seen, of c children c - 1 parts in c.
    """
    m, pages = F.col("pooled"), F.col(n).cast("double")
    free = (F.col(siblings) - 1) / F.greatest(F.col(siblings), F.lit(1))
    noise = m * (1 - m) * free
    labelled = F.col(n) > 0

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(labelled, c)), F.lit(0.0))

    excess = total(pages * F.pow(F.col(k) / F.when(labelled, pages) - m, F.lit(2.0))) - total(noise)
    room = total(noise * (pages - 1))
    seen = F.when(room > 0, excess / F.when(room > 0, room)).otherwise(0.0)
    rho = F.least(F.greatest(seen, 1 / (F.count_if(labelled) + 1.0)), F.lit(MAX_CORRELATION))
    spread = children.agg((rho / (1 - rho)).alias("spread")).scalar()
    return children.withColumn("strength", 1 / (spread + 1 / F.col("known")))


def host_reputation(labelled: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of the bad rate of each host.

    Takes rows (host, outcome) with outcome 1 for a bad page, 0 for a good one and NULL for an
    unlabelled one.  Returns host, domain, suffix, n_labelled, n_bad, prior_mean, prior_strength,
    posterior_mean, lower_bound and upper_bound (mean -/+ z standard deviations of the beta posterior).
    Without any label every mean is 0.5.
    """
    hosts = labelled.groupBy("host").agg(
        F.count("outcome").alias("n_h"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("k_h")
    )
    hosts = keep(hosts).withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", public_suffix(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n_h").alias("n_d"), F.sum("k_h").alias("k_d"), F.count_if(F.col("n_h") > 0).alias("c_h"))
    domains = keep(domains)
    suffixes = domains.groupBy("suffix").agg(F.sum("n_d").alias("n_s"), F.sum("k_d").alias("k_s"), F.count_if(F.col("n_d") > 0).alias("c_d"))
    whole = {"n": F.coalesce(F.sum("n_s"), F.lit(0)), "k": F.coalesce(F.sum("k_s"), F.lit(0)), "c_s": F.count_if(F.col("n_s") > 0)}
    suffixes = suffixes.withColumns({name: suffixes.agg(c).scalar() for name, c in whole.items()})
    others, others_bad = F.col("n") - F.col("n_s"), F.col("k") - F.col("k_s")
    pooled = (F.col("k") + 0.5) / (F.col("n") + 1.0)
    suffixes = suffixes.withColumns({"pooled": pooled, "prior": (others_bad + 0.5) / (others + 1.0), "known": others + 1.0})
    suffixes = with_strength(suffixes, "n_s", "k_s", "c_s")
    domains = keep(join_hot(domains, suffixes.select("suffix", "n_s", "k_s", "c_d", "prior", "strength"), "suffix", F.col("domain")))
    domains = with_strength(below(domains, "n_s", "k_s", "n_d", "k_d"), "n_d", "k_d", "c_d")
    # A domain belongs to one suffix, so its name is a key.
    hosts = keep(join_hot(hosts, domains.select("domain", "n_d", "k_d", "c_h", "prior", "strength"), "domain", F.col("host")))
    hosts = with_strength(below(hosts, "n_d", "k_d", "n_h", "k_h"), "n_h", "k_h", "c_h")
    a = F.col("strength") * F.col("prior") + F.col("k_h") + DOUBT
    b = F.col("strength") * (1 - F.col("prior")) + (F.col("n_h") - F.col("k_h")) + DOUBT
    mean = a / (a + b)
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select(
        "host",
        "domain",
        "suffix",
        F.col("n_h").alias("n_labelled"),
        F.col("k_h").alias("n_bad"),
        F.col("prior").alias("prior_mean"),
        F.col("strength").alias("prior_strength"),
        mean.alias("posterior_mean"),
        (mean - z * deviation).alias("lower_bound"),
        (mean + z * deviation).alias("upper_bound"),
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """Judge every page: all its columns but those named below, then host, path, rule, verdict, lower_bound.

    Pages that a rule decides are the labelled ones; the others get the verdict of their host's
    posterior.  A NULL url, or one without ``://``, has an empty host, which is a host like any other.
    Columns of the input named host, path, rule, verdict or lower_bound are replaced.  Repeated rows
    are judged alike, an empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "rule_verdict", "verdict", "lower_bound")]
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in kept]
    link = F.col("`" + url.replace("`", "``") + "`")
    located = pages.select(*rest, url_host(F.coalesce(link, F.lit(""))).alias("host"), url_path(F.coalesce(link, F.lit(""))).alias("path"))
    ruled = with_rules(located, rules)
    outcome = F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)
    hosts = host_reputation(ruled.select("host", outcome.alias("outcome")), z)
    # Both sides come from an exchange on the host, so a crowded host's pages can be split at run time.
    judged = ruled.join(hosts.select("host", "lower_bound"), "host", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("lower_bound") > threshold, "block").otherwise("allow"))
    return judged.select(*rest, "host", "path", "rule", verdict.alias("verdict"), "lower_bound")
