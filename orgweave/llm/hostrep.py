"""URL filter by empirical-Bayes host reputation (DataFrame functions only).

Outcomes (bad or not) of labelled pages are counted per host, registered domain and suffix. Each level's rate is
shrunk to that of the level above through a beta-binomial prior:

    corpus → suffix → registered domain → host

The suffix is the last label of a host, or the last two where they are a public suffix of two labels (`TWO_LABEL_SUFFIXES`, a parameter); the registered domain
has one label more. A port doesn't count. An IP address is its own domain, under a suffix that all addresses share.

The prior's strength (its pseudo-count) is fitted at each level by the method of moments from the spread of its children's rates. A host
is blocked if even the lower posterior bound of its bad rate exceeds `BLOCK_ABOVE`: mean - Z * sd of its beta posterior.
Explicit rules on host and path go first; the longest that fits wins. Hosts without a labelled page inherit
their domain's, suffix's or the corpus' rate with that prior's own uncertainty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.llm.shared import materialise

BLOCK_ABOVE = 0.25
Z = 1.645
#: Bounds of a fitted prior's pseudo-count.
STRENGTH_MIN, STRENGTH_MAX = 2.0, 200.0
ROUND = 9
#: Second-level labels under which country registries sell names, and the countries that do so for most of them.
_SECOND, _COUNTRIES = ("ac", "co", "com", "edu", "gov", "net", "or", "org"), ("ar", "au", "br", "cn", "id", "il", "in", "jp", "ke", "kr", "mx", "my", "nz", "sg", "th", "tr", "tw", "uk", "za")
TWO_LABEL_SUFFIXES = tuple(f"{a}.{b}" for a in _SECOND for b in _COUNTRIES)
ADDRESSES = "(address)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: str | Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: str | Column) -> Column:
    """From the host's end up to `?`, `#` or the end; null or no `://`: empty."""
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_domain(hosts: DataFrame, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """`hosts` (host, …) plus domain and suffix."""
    bare = F.regexp_replace("host", ":[0-9]*$", "")
    address = bare.rlike(r"^([0-9]{1,3}[.]){3}[0-9]{1,3}$|^\[")
    last = F.substring_index(bare, ".", -2)
    two = last.isin(*two_label)
    domain = F.when(address, bare).when(two, F.substring_index(bare, ".", -3)).otherwise(last)
    suffix = F.when(address, ADDRESSES).when(two, last).otherwise(F.substring_index(bare, ".", -1))
    return hosts.withColumns({"domain": domain, "suffix": suffix})


def fitting_rule(rules: list[Rule], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits host and path as struct(rule, verdict), else null; of rules equally long the first in alphabetical order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(children: DataFrame, child_rate: str, by: list[str]) -> DataFrame:
    """Pseudo-count of the beta prior over each parent's children, by moments; children: n, k and the parent's rate `child_rate`."""
    spread = children.groupBy(*by).agg(
        F.sum("n").alias("_n"),
        F.sum(F.expr("n * n")).alias("_nn"),
        F.count("*").alias("_c"),
        F.first(child_rate).alias("_m"),
        F.sum(F.expr(f"n * (k / n - {child_rate}) * (k / n - {child_rate})")).alias("_ss"),
    )
    # between-children variance beyond binomial noise (DerSimonian-Laird form)
    var = "greatest((_ss - (_c - 1) * _m * (1 - _m)) / nullif(_n - _nn / _n, 0), 0)"
    raw = f"case when _c < 2 or {var} <= 0 or {var} is null then {STRENGTH_MAX} else _m * (1 - _m) / {var} - 1 end"
    return spread.select(*by, F.expr(f"round(least(greatest({raw}, {STRENGTH_MIN}), {STRENGTH_MAX}), {ROUND})").alias("strength"))


def host_reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """outcomes: (host, bad 0/1) per labelled page; hosts: (host), distinct → host, alpha, beta, mean, low, high of its bad rate.

    Rows with a null host or bad are not counted; bad is null where a label leaves it open, not where one of two known faults suffices. Without any outcome the corpus rate is taken as 0. Each rate is rounded to nine
    places, so results don't depend on the order of sums.
    """
    per_host = outcomes.where("host is not null and bad is not null").groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("k"))
    # (each level is read by several of those below)
    per_host = materialise(with_domain(per_host), "host-outcomes")
    per_domain = materialise(per_host.groupBy("domain").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k")), "domain-outcomes")
    per_suffix = per_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    top = per_suffix.agg(F.expr(f"round(coalesce(sum(k) / nullif(sum(n), 0), 0), {ROUND})").alias("m0"))

    # (one row, so a cross join adds a column)
    suffix = per_suffix.crossJoin(F.broadcast(top))
    s0 = _strength(suffix.withColumn("one", F.lit(1)), "m0", ["one"]).select(F.col("strength").alias("s0"))
    suffix = suffix.crossJoin(F.broadcast(s0)).select("suffix", F.expr(f"round((k + s0 * m0) / (n + s0), {ROUND})").alias("m_suffix"))
    suffix = materialise(suffix, "suffix-rates")

    domain = per_domain.join(suffix, "suffix")
    s1 = _strength(domain, "m_suffix", ["suffix"]).select("suffix", F.col("strength").alias("s_suffix"))
    suffix = materialise(suffix.join(s1, "suffix"), "suffix-priors")
    domain = domain.join(suffix.select("suffix", "s_suffix"), "suffix").select("domain", F.expr(f"round((k + s_suffix * m_suffix) / (n + s_suffix), {ROUND})").alias("m_domain"))
    domain = materialise(domain, "domain-rates")

    known = per_host.join(domain, "domain")
    s2 = _strength(known, "m_domain", ["domain"]).select("domain", F.col("strength").alias("s_domain"))
    domain = domain.join(s2, "domain")

    all_hosts = with_domain(hosts.select("host").distinct())
    joined = all_hosts.join(per_host.select("host", "n", "k"), "host", "left").join(domain, "domain", "left").join(suffix, "suffix", "left").crossJoin(F.broadcast(top))
    mean, strength = "coalesce(m_domain, m_suffix, m0)", f"coalesce(s_domain, s_suffix, {STRENGTH_MIN})"
    beta = joined.select("host", F.expr(f"coalesce(k, 0) + {strength} * {mean}").alias("alpha"), F.expr(f"coalesce(n, 0) - coalesce(k, 0) + {strength} * (1 - {mean})").alias("beta"))
    rate = beta.withColumn("mean", F.expr("alpha / (alpha + beta)"))
    sd = "sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))"
    return rate.select(
        "host",
        *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "mean")],
        F.expr(f"round(greatest(mean - {Z} * {sd}, 0), 6)").alias("low"),
        F.expr(f"round(least(mean + {Z} * {sd}, 1), 6)").alias("high"),
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per row of `pages` (page_id, url): page_id, host, path, rule, verdict, low.

    outcomes: (url, bad 0/1). A url that is null or has no `://` has empty host and path, and is judged as the empty host,
    which has no labelled page of its own. Nulls in outcomes are not counted; repeated rows count as often as they come; extra columns are ignored.
    """
    slim = pages.select(F.col("`page_id`").alias("page_id"), url_host("`url`").alias("host"), url_path("`url`").alias("path"))
    seen = outcomes.select(url_host("`url`").alias("host"), F.col("`bad`").cast("int").alias("bad")).where("host <> ''")
    reputation = host_reputation(seen, slim.select("host").distinct()).select("host", "low")
    judged = slim.join(reputation, "host", "left").withColumn("fit", fitting_rule(rules))
    method = F.when(F.col("low") > BLOCK_ABOVE, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "low")
