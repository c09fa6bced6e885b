"""Allow or block urls by rules, and by trust passed along the links between hosts.

Rules name a host, its subdomains and a path prefix; the longest that fits a url
decides. Other urls are judged by their host: trust starts at hosts with allowed
pages and follows links (personalised PageRank), distrust starts at hosts with
blocked pages and runs against the links, to those that point at them. A host is
blocked if its distrust is above its trust by more than ``MARGIN``.

Links within a host carry nothing. Links are summed per pair of hosts before
anything is joined, so a hot host is one row per host it links to. Every few
rounds the scores are written out and compared with those written before, until
they change by no more than ``TOLERANCE`` in all. All of it is DataFrame operations.

Nulls and urls without ``://`` have an empty host and path and fit no rule; the
empty host has no scores and is allowed. Null html has no links. Repeated pages
count their links again; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.common import ascii_lower, release, scratch
from citesift.session import durable

# Fixed by the contract.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

HOST = r"://([^/?#]*)"
PATH = r"://[^/?#]*([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
DAMPING = 0.85
# Rounds of the SQL twin, which can't stop by itself; the two agree where links end within them.
ROUNDS = 8
WRITTEN_EVERY = 4
MARGIN = 1e-6
# Summed change of all scores over WRITTEN_EVERY rounds. What is still to come is at most
# 0.85^4 / (1 - 0.85^4) = 1.1 times as much, less than half of MARGIN.
TOLERANCE = 4e-7


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    # From the shortest to the longest, so that the longest is asked first.
    for kind, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, name + prefix).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def judged_by_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, by_rule``."""
    placed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return placed.withColumns({"rule": rule, "by_rule": verdict})


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: how often pages of one host link to another one."""
    links = pages.select(
        host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link")
    )
    # A link may leave its scheme to the page.
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    links = links.select("src", host(target).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_scores(judged: DataFrame, links: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` of hosts that either has reached."""
    links = durable(links, "host-links")
    out = links.groupBy("src").agg(F.sum("n").alias("total"))
    into = links.groupBy("dst").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    forward = links.join(out, "src").select(
        F.lit("allow").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), share.alias("share")
    )
    backward = links.join(into, "dst").select(
        F.lit("block").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), share.alias("share")
    )
    edges = durable(forward.unionAll(backward), "host-edges")
    seeds = durable(
        judged.filter("by_rule is not null").select(F.col("by_rule").alias("kind"), "host").distinct(), "host-seeds"
    )
    start = seeds.withColumn("score", F.lit(1 - damping))
    scores = written = start
    last = None
    for k in itertools.count(1):
        passed = scores.join(edges, ["kind", "host"]).select(
            "kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")
        )
        scores = start.unionAll(passed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % WRITTEN_EVERY == 0:
            scores = scratch(scores, "host-scores")
            change = _change(written, scores)
            release(written)
            # Each round changes less than the one before, rounding aside.
            if change <= tolerance or last is not None and change >= last:
                break
            written, last = scores, change
    of = {k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)) for k in ("allow", "block")}
    return scores.groupBy("host").agg(of["allow"].alias("trust"), of["block"].alias("distrust"))


def _change(before: DataFrame, after: DataFrame) -> float:
    """The summed absolute change of all scores."""
    both = after.unionAll(before.withColumn("score", -F.col("score")))
    each = both.groupBy("kind", "host").agg(F.sum("score").alias("change"))
    return each.agg(F.sum(F.abs("change")).alias("c")).first()["c"] or 0.0


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust``; scores are 0 where nothing has reached a host."""
    judged = judged_by_rules(pages, rules)
    scores = host_scores(judged, host_links(pages))
    zero = F.lit(0.0)
    joined = judged.join(scores, "host", "left").withColumns(
        {"trust": F.coalesce("trust", zero), "distrust": F.coalesce("distrust", zero)}
    )
    by_host = F.when(F.col("distrust") > F.col("trust") + MARGIN, "block").otherwise("allow")
    return joined.select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "trust", "distrust"
    )


def sql(rounds: int = ROUNDS, damping: float = DAMPING) -> str:
    """The same for DuckDB, rounds unrolled."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hosted = lower.format(f"regexp_extract(coalesce({{}}, ''), '{HOST}', 1)")
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in ordered]
    rule = " ".join(f"when {f} then '{h}{p}'" for f, (_, h, p) in zip(fits, ordered))
    verdict = " ".join(f"when {f} then '{k}'" for f, (k, _, _) in zip(fits, ordered))
    link = LINK.replace("'", "''")
    steps = "".join(
        f""", s{k} as (
  select kind, host, sum(score) as score from (
    select kind, host, {1 - damping} as score from seeds union all
    select e.kind, e.dst, s.score * e.share * {damping} from s{k - 1} s join edges e on e.kind = s.kind and e.host = s.host
  ) group by kind, host)"""
        for k in range(1, rounds + 1)
    )
    return f"""
with placed as (
  select page_id, {hosted.format('url')} as host, regexp_extract(coalesce(url, ''), '{PATH}', 1) as path, html from pages
), judged as (
  select page_id, host, path, case {rule} end as rule, case {verdict} end as by_rule from placed
), linked as (
  select host as src, unnest(regexp_extract_all(html, '{link}', 1)) as link from placed
), links as (
  select src, dst, count(*) as n from (
    select src, {hosted.format("case when starts_with(link, '//') then 'http:' || link else link end")} as dst from linked
  ) where src <> '' and dst <> '' and src <> dst group by src, dst
), edges as (
  select 'allow' as kind, src as host, dst, n / sum(n) over (partition by src) as share from links union all
  select 'block', dst, src, n / sum(n) over (partition by dst) from links
), seeds as (select distinct by_rule as kind, host from judged where by_rule is not null)
, s0 as (select kind, host, 1.0::double as score from seeds){steps}
, scores as (
  select host, sum(case when kind = 'allow' then score else 0 end) as trust, sum(case when kind = 'block' then score else 0 end) as distrust
  from s{rounds} group by host
)
select page_id, j.host, path, rule,
  coalesce(by_rule, case when coalesce(distrust, 0) > coalesce(trust, 0) + {MARGIN} then 'block' else 'allow' end) as verdict
from judged j left join scores s on s.host = j.host
"""
