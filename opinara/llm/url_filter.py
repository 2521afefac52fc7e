"""URL rules, and a verdict by link-graph propagation where no rule fits.

Hosts are nodes.  Edges come from the absolute links in the pages and from the
site structure (a host and its parent domain refer to each other).  Trust starts
at hosts with allowed pages and flows along edges; distrust starts at hosts
with blocked pages and flows against them: whoever links to a blocked host
shares its distrust.  Both are personalised PageRank, as joins and sums over
the edge table, one written table per round.  A host is blocked when its
distrust exceeds its trust.

A host's seed is the part of its own pages that a rule allows or blocks, so
what is elsewhere in the table changes nothing for hosts that are not linked to
it.  Rounds go on until no host is reached any more and no mass grows by more
than ``TOLERANCE`` of itself; they are as many as the longest chain of links
calls for.  A host with very many edges is spread over ``SALTS`` keys.

Defined cases: a NULL url, or one without ``://``, has empty host and path, no
rule and no evidence, so it is allowed; a NULL page has no links; a NULL id is
carried along; repeated rows each get their verdict and count as often in their host's share;
very long pages are searched whole;
an empty table gives no rows; columns other than those named are ignored.
Without any seed every host is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.sources.state import store

#: (verdict, host, path) of the production list.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
#: Growth of a mass, relative to itself, below which it counts as settled.
TOLERANCE = 1e-3
#: Distrust has to exceed trust by more than rounding.
MARGIN = 1e-6
#: Keys of a host's edges.
SALTS = 8
_ROOT_LABELS = 2


def url_host(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(at > 0, F.translate(host, upper, lower)).otherwise("")


def url_path(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], give: int | None = None) -> Column:
    """The longest rule that fits as host and path, or with ``give=0`` its verdict; NULL if none fits."""
    chain = None
    for rule in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        value = F.lit(rule[0] if give == 0 else rule[1] + rule[2])
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain if chain is not None else F.lit(None).cast("string")


def link_edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst`` and ``n`` links from the absolute links in ``html`` (columns ``host``, ``html``)."""
    targets = F.expr(r"""regexp_extract_all(html, '(?i)href\\s*=\\s*["\']?\\s*(https?://[^"\'\\s<>]+)', 1)""")
    found = pages.select(F.col("host").alias("src"), F.explode(targets).alias("url"))
    found = found.select("src", url_host(F.col("url")).alias("dst"))
    return found.filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def site_edges(hosts: DataFrame) -> DataFrame:
    """A host and the domain above it, both ways, up to two labels."""
    parent = F.regexp_extract("host", "^[^.]+\\.(.+)$", 1)
    up = hosts.select("host", parent.alias("parent")).filter(F.size(F.split("parent", "\\.")) >= _ROOT_LABELS)
    one = F.lit(1).cast("long").alias("n")
    return up.select(F.col("host").alias("src"), F.col("parent").alias("dst"), one).unionAll(
        up.select(F.col("parent").alias("src"), F.col("host").alias("dst"), one)
    )


def propagate(seeds: DataFrame, edges: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """``kind, host, mass`` when settled, from seeds ``kind, host, mass``.

    Trust moves along the edges and distrust against them, a host's mass dealt
    by the number of links; mass at dead ends is lost.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n").unionAll(
        edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n")
    )
    salt = F.pmod(F.xxhash64("to"), F.lit(SALTS)).cast("int")
    flows = store(both.withColumn("salt", salt), "host_flows")
    outflow = store(flows.frame.groupBy("kind", F.col("from").alias("host")).agg(F.sum("n").alias("total")), "host_outflow")
    start = store(seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"), F.lit(0.0).alias("before")), "host_seeds")
    mass, settled = start, edges.isEmpty()
    none = F.lit(0.0)
    while not settled:
        # One row a host meets its total; only the parts of it meet the edges.
        each = mass.frame.join(outflow.frame, ["kind", "host"]).select(
            "kind", F.col("host").alias("from"), (F.col("mass") * damping / F.col("total")).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        )
        moved = each.join(flows.frame, ["kind", "from", "salt"]).select("kind", F.col("to").alias("host"), (F.col("part") * F.col("n")).alias("mass"), none.alias("before"))
        known = mass.frame.select("kind", "host", none.alias("mass"), F.col("mass").alias("before"))
        every = start.frame.unionAll(moved).unionAll(known).groupBy("kind", "host")
        following = store(every.agg(F.sum("mass").alias("mass"), F.sum("before").alias("before")), "host_mass")
        if mass is not start:
            mass.drop()
        mass = following
        settled = mass.frame.filter(F.col("mass") - F.col("before") > F.col("mass") * tolerance).isEmpty()
    flows.drop()
    outflow.drop()
    return mass.frame.select("kind", "host", "mass")


def blocked_hosts(judged: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Hosts whose distrust exceeds their trust, from pages ``host, ruled, html``."""
    share = lambda verdict: (F.count_if(F.col("ruled") == verdict) / F.count("*")).alias("trust" if verdict == "allow" else "distrust")
    hosts = store(judged.filter("host <> ''").groupBy("host").agg(share("allow"), share("block")), "hosts").frame
    edges = link_edges(judged).unionAll(site_edges(hosts.select("host"))).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    seeds = hosts.unpivot(["host"], ["trust", "distrust"], "kind", "mass").filter("mass > 0")
    mass = propagate(seeds, store(edges, "host_edges").frame, tolerance, damping)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    return mass.groupBy("host").agg(of("trust"), of("distrust")).filter(F.col("distrust") > F.col("trust") * (1 + MARGIN)).select("host")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **options) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict``."""
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), "html")
    host, path = F.col("host"), F.col("path")
    host, path = F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = rule_of(F.col("host"), F.col("path"), rules, give=0)
    blocked = blocked_hosts(rows.select("host", ruled.alias("ruled"), "html"), **options)
    marked = blocked.select("host", F.lit(True).alias("distrusted"))
    out = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"), ruled.alias("ruled"))
    verdict = F.coalesce("ruled", F.when(F.col("distrusted"), "block").otherwise("allow"))
    return out.join(marked, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
