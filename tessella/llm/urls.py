"""URL filters with an empirical-Bayes host reputation (operator 8).

Rules decide the pages they fit; these are the labelled outcomes from which every host gets a reputation.
Beta-binomial priors pass down from all pages to suffix, registered domain and host, each level's prior
strength fitted by moments. A page without a rule is blocked if the lower bound of its host's posterior
blocking rate exceeds one half.

A null url, or one without `://`, has an empty host and path and falls to the reputation of the empty host.
The registered domain is a host's last two labels, the suffix its last one; no list of public suffixes is read. Of rules
that fit, the longest decides; two of one length that fit the same url are the same rule. Repeated rows count each time
and each come back. Urls of any length are cut where they lie. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.stage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @classmethod
    def of(cls, action: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(action, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (Rule.of("block", "com/en/"), Rule.of("allow", "example.com/en/7"), Rule.of("allow", "net/de/"), Rule.of("block", "example.net/de/8"), Rule.of("block", "org/es/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url, both empty if it has none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def with_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, and the longest fitting rule with its action, else nulls."""
    url = F.col("url").cast("string")
    host, path = split_url(url)
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # a longer rule overrides
        hit = fits(r, F.col("host"), F.col("path"))
        rule, action = F.when(hit, F.lit(r.text)).otherwise(rule), F.when(hit, F.lit(r.action)).otherwise(action)
    return parts.withColumns({"rule": rule, "action": action})


def reputations(outcomes: DataFrame, z: float = 1.645, floor: float = 1.0, ceiling: float = 1000.0) -> DataFrame:
    """host with `rate`, `weight` and `low` from (host, action) outcomes; hosts without any get their parents' prior.

    At each level the prior's strength m solves the beta-binomial moments of the level's groups:
    spread mu (1 - mu) over the variance of the groups' rates, less one, kept within [floor, ceiling].
    """
    labelled = F.col("action").isNotNull().cast("long")
    blocked = F.coalesce((F.col("action") == "block").cast("long"), F.lit(0))
    hosts = outcomes.groupBy("host").agg(F.sum(labelled).alias("n"), F.sum(blocked).alias("k"))
    # Each level is written once: its moments and its rates both read it.
    hosts = written(hosts.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)}), "hosts")
    overall = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    prior = overall.select(((F.coalesce("k", F.lit(0)) + 0.5) / (F.coalesce("n", F.lit(0)) + 1)).alias("mu"))
    suffixes = _level(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).crossJoin(F.broadcast(prior)), floor, ceiling)  # one row
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = _level(domains.join(suffixes.select("suffix", F.col("rate").alias("mu")), "suffix"), floor, ceiling)
    told = _level(hosts.join(domains.select("domain", F.col("rate").alias("mu")), "domain"), floor, ceiling)
    low = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return told.select("host", "rate", "weight", low.alias("low"))


def _level(groups: DataFrame, floor: float, ceiling: float) -> DataFrame:
    """Posterior rate and weight of groups with counts n and k and prior mean mu."""
    groups = written(groups, "reputations")
    off = F.col("k") - F.col("n") * F.col("mu")
    spread = F.col("mu") * (1 - F.col("mu"))
    # E[(k - n mu)^2] = n spread (1 + (n - 1) rho), so rho comes from two sums over all groups.
    fit = groups.agg(F.sum(off * off - F.col("n") * spread).alias("over"), F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("full"))
    rho = F.when(F.col("full") > 0, F.greatest(F.col("over") / F.col("full"), F.lit(1e-9))).otherwise(F.lit(1.0))
    strength = fit.select(F.least(F.greatest(1 / rho - 1, F.lit(floor)), F.lit(ceiling)).alias("m"))
    posed = groups.crossJoin(F.broadcast(strength))  # one row
    return posed.withColumns({"weight": F.col("n") + F.col("m"), "rate": (F.col("k") + F.col("m") * F.col("mu")) / (F.col("n") + F.col("m"))}).drop("m", "mu")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, max_rate: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's rate bound, one row per input row."""
    ruled = with_rules(pages, rules)
    known = reputations(ruled).select(F.col("host").alias("_host"), F.col("low"))
    joined = ruled.join(known, F.col("host") == F.col("_host"), "left")
    verdict = F.coalesce(F.col("action"), F.when(F.col("low") > max_rate, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


JUDGE_URLS_SQL = r"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), cut as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
  from parts
), ruled as (
  select *, case
    when ('.' || host) like '%.example.com' and starts_with(path, '/en/7') then 'example.com/en/7'
    when ('.' || host) like '%.example.net' and starts_with(path, '/de/8') then 'example.net/de/8'
    when ('.' || host) like '%.com' and starts_with(path, '/en/') then 'com/en/'
    when ('.' || host) like '%.net' and starts_with(path, '/de/') then 'net/de/'
    when ('.' || host) like '%.org' and starts_with(path, '/es/') then 'org/es/' end as rule
  from cut
), acted as (
  select *, case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow' end as action from ruled
), hosts as (
  select host, array_to_string(string_split(host, '.')[-2:], '.') as domain, string_split(host, '.')[-1] as suffix,
    count(action)::double as n, count(*) filter (action = 'block')::double as k
  from acted group by host
), top as (
  select (sum(k) + 0.5) / (sum(n) + 1) as mu from hosts
), suffix0 as (
  select suffix, sum(n) as n, sum(k) as k, any_value(mu) as mu from hosts, top group by suffix
), suffix_m as (
  select least(greatest(1 / (case when f > 0 then greatest(o / f, 1e-9) else 1.0 end) - 1, 1.0), 1000.0) as m
  from (select sum((k - n * mu) * (k - n * mu) - n * mu * (1 - mu)) as o, sum(n * (n - 1) * mu * (1 - mu)) as f from suffix0)
), suffix1 as (
  select suffix, (k + m * mu) / (n + m) as rate from suffix0, suffix_m
), domain0 as (
  select h.suffix, domain, sum(n) as n, sum(k) as k, any_value(rate) as mu from hosts h join suffix1 s on h.suffix = s.suffix group by h.suffix, domain
), domain_m as (
  select least(greatest(1 / (case when f > 0 then greatest(o / f, 1e-9) else 1.0 end) - 1, 1.0), 1000.0) as m
  from (select sum((k - n * mu) * (k - n * mu) - n * mu * (1 - mu)) as o, sum(n * (n - 1) * mu * (1 - mu)) as f from domain0)
), domain1 as (
  select domain, (k + m * mu) / (n + m) as rate from domain0, domain_m
), host0 as (
  select host, n, k, rate as mu from hosts join domain1 using (domain)
), host_m as (
  select least(greatest(1 / (case when f > 0 then greatest(o / f, 1e-9) else 1.0 end) - 1, 1.0), 1000.0) as m
  from (select sum((k - n * mu) * (k - n * mu) - n * mu * (1 - mu)) as o, sum(n * (n - 1) * mu * (1 - mu)) as f from host0)
), host1 as (
  select host, (k + m * mu) / (n + m) as rate, n + m as weight from host0, host_m
), told as (
  select host, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) as low from host1
)
select page_id, a.host, path, rule, coalesce(action, case when low > 0.5 then 'block' else 'allow' end) as verdict
from acted a join told t on a.host = t.host
"""
