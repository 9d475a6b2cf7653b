"""URL filter: rules on hosts and paths, then trust and distrust that spread over the link graph of hosts.

Rules come first: the longest rule that fits a page decides.  Pages without one are judged by their host.  Hosts most
of whose pages a rule allows (blocks) are trusted (blocked) seeds, weighted by their number of pages.  Trust is a
personalised PageRank from the trusted seeds along the links; distrust is one from the blocked seeds against them,
as whoever links to a bad host is suspect.  Both go on until they have settled and reach no new host.  What a host
without onward links holds goes nowhere.  A host whose share of distrust in both is over `threshold` is blocked; all
others, also those that nothing reaches, are allowed.

Links are the absolute `href` and `src` addresses in a page's html; links within one host carry nothing.  They are
counted for each pair of hosts before any of it is joined, so a host that holds a third of all pages is one row.

Null url, or one without `://`: host and path are empty, no rule, allowed.  Null html: no links.  Repeated rows are
judged each on its own.  An empty table gives no rows.  Only page_id, url and html are read, so other columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm._common import written

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. A short list, held in the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest becomes the outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts: src, dst, n."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("dst"))
    found = found.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst AND src <> '' AND dst <> ''")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, every: int = 4) -> DataFrame:
    """Personalised PageRank by kind: links (kind, src, dst, n), seeds (kind, host, mass) give (kind, host, mass).

    Rounds go on until no host is newly reached and no mass has changed by more than `tolerance` of itself in the last
    `every` rounds.
    """
    out = links.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    share = written(links.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("total")).alias("share")), "links")
    if share.isEmpty():
        return seeds
    own = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("mass"))
    mass = seeds
    while True:
        last = mass
        for _ in range(every):
            moved = share.join(mass, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass"))
            mass = moved.unionByName(own).groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        mass = written(mass, "mass")
        both = mass.join(last.withColumnRenamed("mass", "last"), ["kind", "host"], "left")
        change = F.abs(F.col("mass") - F.col("last")) / F.greatest("mass", F.lit(1e-300))
        if (both.agg(F.max(F.coalesce(change, F.lit(1.0)))).first()[0] or 0) <= tolerance:
            return mass


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.5, majority: float = 0.5, tolerance: float = 1e-6, broadcast_rows: int = 1_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page."""
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    hosts = named.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("fit.verdict") == "allow").alias("allow"),
        F.count_if(F.col("fit.verdict") == "block").alias("block"),
    )
    kinds = hosts.select("host", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("own")) for k in ("allow", "block")])).alias("x"))
    kinds = written(kinds.select("host", "x.kind", "x.own").where(F.col("x.own") > majority * F.col("n")), "seeds")
    sums = {r["kind"]: r["n"] for r in kinds.groupBy("kind").agg(F.sum("own").alias("n")).collect()}  # two rows at most
    total = F.when(F.col("kind") == "allow", F.lit(sums.get("allow"))).otherwise(F.lit(sums.get("block")))
    seeds = kinds.select("kind", "host", (F.col("own") / total).alias("mass"))
    links = host_links(pages)
    both = links.select(F.explode(F.array(
        F.struct(F.lit("allow").alias("kind"), "src", "dst", "n"),
        F.struct(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"),
    )).alias("x")).select("x.*")
    mass = propagate(both, seeds, tolerance=tolerance)
    held = mass.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "allow", F.col("mass"))).alias("trust"),
        F.sum(F.when(F.col("kind") == "block", F.col("mass"))).alias("distrust"),
    )
    held = written(held, "held")  # apart from the join, so that a host of very many pages can be split
    held = F.broadcast(held) if held.count() <= broadcast_rows else held
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    bad = zero("distrust") > threshold * (zero("trust") + zero("distrust"))
    return named.join(held, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        zero("trust").alias("trust"), zero("distrust").alias("distrust"),
    )
