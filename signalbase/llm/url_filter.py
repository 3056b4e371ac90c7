"""URL filters: longest-match rules, and link-graph propagation for the rest.

Rules name a host and a path prefix; one fits its host and every subdomain. Urls that
no rule decides get the verdict of their host:

* host edges are the links of pages to other hosts (absolute and protocol-relative
  ``href``), plus edges between a host and its parent domain where both have pages;
* trust is personalised PageRank from trusted seeds along the edges; distrust is
  the same from blocked seeds along reversed edges (who links to bad hosts);
* rank at hosts without an edge onward goes back to the seeds, so none is lost; that is the
  ranks' sum over walks that end there, made to add up to one, whatever the host. Rounds
  go on until walks carry less than ``CONVERGED`` of the rank;
* seeds are given hosts and hosts whose rule-decided pages are mostly allowed, or
  mostly blocked;
* a host is blocked when distrust makes up ``THRESHOLD`` or more of its two ranks.

Everything is DataFrame operations; ranks are written out every few rounds.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule
and the verdict allow; hosts that no rank reaches are allowed; repeated rows are
judged each; null or missing html has no links; an empty table gives no rows; further
columns are ignored; equal ranks block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
CONVERGED = 1e-3
SAVE_EVERY = 4
THRESHOLD = 0.5
LINKS = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of columns host and path; the longest fitting rule wins."""
    host, path = F.col("host"), F.col("path")
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different hosts; pages: host, html."""
    linked = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINKS), 1))).alias("to"))
    links = linked.select("src", F.translate(F.regexp_replace("to", r"^[^@]*@", ""), UPPER, LOWER).alias("dst"))
    hosts = pages.select("host").distinct()
    child = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst"))
    family = child.join(hosts.withColumnRenamed("host", "dst"), "dst").select("src", "dst")
    both = family.union(family.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.union(both).where("src <> '' and dst <> '' and src <> dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, converged: float = CONVERGED) -> DataFrame:
    """(host, trust, distrust): personalised PageRank, each adding up to one.

    edges: src, dst. seeds: host, kind ('trust' or 'distrust'). Trust follows edges,
    distrust their reverse; both go in one table, told apart by kind. A host's rank is the
    sum over all walks from the seeds to it, each step weighing ``damping`` over the
    edges onward. Every round takes all walks a step further, so what they carry shrinks by
    the damping at least, and rounds end; it is looked at every ``SAVE_EVERY`` rounds.
    """
    way = edges.select(F.lit("trust").alias("kind"), "src", "dst").union(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = way.groupBy("kind", "src").agg((damping / F.count("*")).alias("share"))
    way = scratch.save(way.join(degree, ["kind", "src"]).withColumnRenamed("src", "host"), "edges")
    total = seeds.groupBy("kind").agg(F.count("*").alias("n"))
    walks = scratch.save(seeds.join(total, "kind").select("kind", "host", (1.0 / F.col("n")).alias("rank"), (1.0 / F.col("n")).alias("carried")), "rank0")
    i = 0
    while True:
        i += 1
        moved = walks.join(way, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("carried") * F.col("share")).alias("carried"))
        both = walks.select("kind", "host", "rank", F.lit(0.0).alias("carried")).union(moved.select("kind", "host", "carried", "carried"))
        walks = both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("carried").alias("carried"))
        if i % SAVE_EVERY == 0:
            walks = scratch.save(walks, f"rank{i}")
            scratch.drop(f"rank{i - SAVE_EVERY}")
            left = walks.groupBy("kind").agg((F.sum("carried") / F.sum("rank")).alias("left")).agg(F.max("left")).first()[0]
            if left is None or left <= converged * (1 - damping):
                whole = walks.groupBy("kind").agg(F.sum("rank").alias("whole"))
                share = walks.join(whole, "kind").select("kind", "host", (F.col("rank") / F.col("whole")).alias("rank"))
                one = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
                return share.groupBy("host").agg(one("trust"), one("distrust"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, trusted: tuple[str, ...] = (), blocked: tuple[str, ...] = ()) -> DataFrame:
    """page_id, host, path, rule and verdict of every url."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "url_filter")
    host, path = split_url(F.col("url"))
    rule, verdict = matched_rule(rules)
    parsed = pages.select("page_id", "url", "html").select("page_id", host.alias("host"), path.alias("path"), "html").select("*", rule.alias("rule"), verdict.alias("decided"))
    rules_of = parsed.where("host <> ''").groupBy("host").agg(F.count_if(F.col("decided") == "allow").alias("allowed"), F.count_if(F.col("decided") == "block").alias("barred"), F.count("*").alias("pages"))
    given = F.col("host").isin(list(blocked)) if blocked else F.lit(False)
    liked = F.col("host").isin(list(trusted)) if trusted else F.lit(False)
    kind = F.when(given | (~liked & (2 * F.col("barred") >= F.col("pages"))), "distrust").when(liked | (F.col("allowed") > F.col("barred")), "trust")
    seeds = scratch.save(rules_of.select("host", kind.alias("kind")).where("kind is not null"), "kinds")
    ranks = propagate(scratch.save(host_edges(parsed.select("host", "html")), "links"), seeds, scratch)
    mass = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    hosts = scratch.save(ranks.where("trust + distrust > 0").select("host", F.when(mass >= THRESHOLD, "block").otherwise("allow").alias("of_host")), "hosts")
    decided = parsed.select("page_id", "host", "path", "rule", "decided").join(hosts, "host", "left")
    return decided.select("page_id", "host", "path", "rule", F.coalesce("decided", "of_host", F.lit("allow")).alias("verdict"))
