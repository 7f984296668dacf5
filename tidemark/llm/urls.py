"""Operator 7: URL filter by rules and by trust that spreads over the host graph.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its
path goes on from there up to ``?``, ``#`` or the end; both are empty without ``://`` or for null. A rule is
a host and a path: it fits that host and its subdomains where the path starts with the rule's; the
longest rule decides. Other pages get their host's verdict: hosts of allowed pages are trusted seeds,
hosts of blocked ones blocked seeds (by the share of their pages), links in the html make host edges,
personalised PageRank carries trust along the edges and distrust against them, and a host is blocked
when its distrust passes ``ratio`` times its trust. Seeds have their ranks with and without links; a host
that nothing reaches is allowed.

Ranks are DataFrames, one row a host, summed with map-side partial sums and cut each round, until they are
settled. Links to the
own host and repeated links count nothing or once; a link's tag ends at the next < or >; null html has no links; pages of any length are searched
whole; repeated rows get equal results; columns beside page_id, url and html are not read, whatever their
names; two rules of equal length go by their text; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ROUNDS = 60  # of the SQL, which cannot tell when ranks are settled
#: Rounds in one plan, after which ranks are written and looked at.
TOGETHER = 4
#: Links of a host that are joined together.
SLICE = 200_000
#: Ranks are settled when they change by no more in sum and no further host is reached, or after so many rounds.
TOLERANCE = 1e-9
MOST_ROUNDS = 1000
DAMPING = 0.85
RATIO = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"^(?s).*?://([^/?#]*)([^?#]*)"
#: An opening link as far as the next < or >, and the host that its href names; possessive, so that neither goes back over what it has read.
LINK = r"""(?i)<a\s[^<>]*+"""
HREF = r"""(?i)href\s*+=\s*+["']?+\s*+(?:https?:)?+//([^/"'\s<>?#]++)"""


def host_and_path(url: str) -> tuple[Column, Column]:
    """Columns of host and path for a url column."""
    found = F.col(url).contains("://")
    host = F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER)
    return F.when(found, host).otherwise(F.lit("")), F.when(found, F.regexp_extract(url, URL, 2)).otherwise(F.lit(""))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """Columns of the deciding rule (as host and path) and its verdict, for columns host and path."""
    name = verdict = None
    for what, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts."""
    linked = pages.filter(F.col("html").contains("//")).select(host_and_path("url")[0].alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(0))).alias("tag"))
    linked = linked.select("src", F.regexp_extract("tag", HREF, 1).alias("dst"))
    return linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src <> '' and dst <> '' and src <> dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = MOST_ROUNDS, damping: float = DAMPING, tolerance: float | None = TOLERANCE, slice_rows: int = SLICE) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, seed) along edges (src, dst).

    It goes on until the ranks are settled; without a tolerance it takes just those rounds. A host that is further
    than that many links from every seed counts as not reached: its rank would be under damping ** rounds. Edges are cut up by (src, slice), a host having a slice for each
    ``slice_rows`` of its edges, and its rank is sent to each of them: a host with very many links is no hot key.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out")).withColumn("slices", F.ceil(F.col("out") / slice_rows))
    edges = C.cut(edges.join(degree, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), F.col("slices")).alias("slice")))
    degree = C.cut(degree.withColumnRenamed("src", "host"))
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"))

    def moved(rank: DataFrame) -> DataFrame:
        sent = rank.join(degree, "host").select(F.col("host").alias("src"), (F.col("rank") / F.col("out") * damping).alias("rank"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
        received = edges.join(sent, ["src", "slice"]).select(F.col("dst").alias("host"), "rank")
        return received.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank"))

    rank, last = seeds.select("host", F.col("seed").alias("rank")), None
    for done in range(0, rounds, TOGETHER):
        now = rank
        for _ in range(min(TOGETHER, rounds - done)):
            now = moved(now)
        sums = now.withColumn("was", F.lit(0.0)).unionByName(rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("was")))
        both = C.cut(sums.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")))
        if last is not None:
            C.drop(last)
        last, rank = both, both.filter("rank > 0").select("host", "rank")
        if tolerance is None:
            continue
        change, fresh = both.agg(F.sum(F.abs(F.col("rank") - F.col("was"))), F.count_if((F.col("was") == 0) & (F.col("rank") > 0))).first()
        if (change or 0.0) <= tolerance and not fresh:
            return rank
    return rank


def verdicts(pages: DataFrame, rules=RULES, rounds: int = MOST_ROUNDS, damping: float = DAMPING, ratio: float = RATIO, tolerance: float | None = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict: one row a page."""
    host, path = host_and_path("url")
    rule, said = rule_of(rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    edges = C.cut(host_edges(pages))
    ruled = judged.filter("host <> ''").groupBy("host").agg(*[F.avg(F.coalesce(F.col("said") == w, F.lit(False)).cast("double")).alias(w) for w in ("allow", "block")])
    ruled = C.cut(ruled.filter("allow > 0 or block > 0"))
    whole = ruled.agg(F.sum("allow"), F.sum("block")).first()

    def seeds(which: str, total: float | None) -> DataFrame:
        return ruled.filter(F.col(which) > 0).select("host", (F.col(which) / (total or 1.0)).alias("seed"))

    trust = spread(edges, seeds("allow", whole[0]), rounds, damping, tolerance).select("host", F.col("rank").alias("trust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = spread(back, seeds("block", whole[1]), rounds, damping, tolerance).select("host", F.col("rank").alias("distrust"))
    bad = distrust.join(trust, "host", "left").filter(F.col("distrust") > F.coalesce("trust", F.lit(0.0)) * ratio).select(F.col("host").alias("bad"))
    out = judged.join(bad, judged["host"] == bad["bad"], "left")
    verdict = F.coalesce("said", F.when(F.col("bad").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle() -> str:
    """The same for DuckDB, the rounds written out."""

    def rounds(name: str, src: str, dst: str, which: str) -> str:
        out = f"{name}_d as (select {src} as src, count(*) as n from e group by 1), {name}_s as (select host, {which} / (select sum({which}) from s) as seed from s where {which} > 0), {name}0 as (select host, seed as rank from {name}_s)"
        for i in range(ROUNDS):
            out += f""", {name}{i + 1} as (select host, sum(rank) as rank from (select e.{dst} as host, {DAMPING} * r.rank / d.n as rank from e join {name}{i} r on r.host = e.{src} join {name}_d d on d.src = e.{src}
                union all select host, seed * (1 - {DAMPING}) from {name}_s) group by host)"""
        return out

    link, href = (re.sub(r"([*+?])\+", r"\1", p).replace("'", "''") for p in (LINK, HREF))
    names = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
    said = " ".join(f"when '{h}{p}' then '{w}'" for w, h, p in RULES)
    lower = f"'{UPPER}', '{LOWER}'"
    return f"""
with h as (select page_id, html, case when contains(url, '://') then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {lower}) else '' end as host,
        case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) else '' end as path from pages),
j as (select page_id, host, path, case {names} end as rule from h),
k as (select *, case rule {said} end as said from j),
e as (select distinct host as src, translate(dst, {lower}) as dst from (select host, regexp_extract(unnest(regexp_extract_all(html, '{link}')), '{href}', 1) as dst from h) where host <> '' and dst <> '' and host <> translate(dst, {lower})),
s as (select host, avg((said is not distinct from 'allow')::int) as allow, avg((said is not distinct from 'block')::int) as block from k where host <> '' group by host),
{rounds('t', 'src', 'dst', 'allow')}, {rounds('b', 'dst', 'src', 'block')},
bad as (select b{ROUNDS}.host from b{ROUNDS} left join t{ROUNDS} using (host) where b{ROUNDS}.rank > coalesce(t{ROUNDS}.rank, 0) * {RATIO})
select page_id, host, path, rule, coalesce(said, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from k
"""
