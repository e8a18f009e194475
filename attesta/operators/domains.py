"""Quality of sources: registered domains by longest suffix, and their rank in the graph of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.tables import materialise

DAMPING = 0.85
TOLERANCE = 1e-9
MAX_ROUNDS = 200
CROWD = 20_000

HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)"
ADDRESS = r"^(\[.*\]|\d{1,3}(\.\d{1,3}){3})$"


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user, port and last dot; NULL for anything else."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), HOST, 1)), r"\.+$", "")
    return F.nullif(host, F.lit(""))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(source, target) for every quoted href; a relative one stays on its host, other schemes and anchors go."""
    href = F.explode(F.regexp_extract_all(F.col(f"`{html_col}`"), F.lit(r"""(?i)\shref\s*=\s*["']([^"']*)["']"""), F.lit(1)))
    rows = pages.select(*keep, F.col(f"`{url_col}`").alias("source"), href.alias("href"))
    host = F.regexp_extract("source", r"^([^:]+://[^/?#]*)", 1)
    target = (
        F.when(F.col("href").rlike("(?i)^https?://"), F.col("href"))
        .when(F.startswith(F.col("href"), F.lit("//")), F.concat(F.lit("http:"), "href"))
        .when(F.startswith(F.col("href"), F.lit("/")), F.concat(host, "href"))
        .when(~F.col("href").rlike("^(#|[a-zA-Z][a-zA-Z0-9+.-]*:)"), F.concat(host, F.lit("/"), "href"))
    )
    return rows.withColumn("target", F.when(host != "", target)).filter("target IS NOT NULL").drop("href")


def registered_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(host, domain): the longest listed suffix of each distinct host with one label more.

    ``suffixes`` has one ``suffix`` column. Without a listed one the last label is the suffix; a host that is a suffix, and an
    address, are their own domain. Each host meets the suffixes by equality of its endings.
    """
    known = suffixes.select(F.lower(F.trim("suffix")).alias("ending")).filter("ending != ''").distinct()
    known = known.withColumn("listed", F.lit(True))
    labels = F.split("host", r"\.")
    rows = hosts.select("host").filter("host IS NOT NULL").distinct().withColumn("labels", labels)
    endings = F.transform(
        F.sequence(F.lit(1), F.size("labels")),
        lambda n: F.struct(n.alias("n"), F.array_join(F.slice("labels", -n, n), ".").alias("ending")),
    )
    ends = rows.select("host", "labels", F.inline(endings)).join(known, "ending", "left")
    longest = ends.groupBy("host").agg(
        F.first("labels").alias("labels"), F.max(F.when(F.col("listed"), F.col("n")).otherwise(1)).alias("n")
    )
    size = F.least(F.col("n") + 1, F.size("labels"))
    domain = F.array_join(F.slice(F.col("labels"), -size, size), ".")
    return longest.select("host", F.when(F.col("host").rlike(ADDRESS), F.col("host")).otherwise(domain).alias("domain"))


def domain_links(links: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(src, dst, n): how many links lead from one registered domain to another; links within one go."""
    hosts = links.select(host_of(F.col("source")).alias("a"), host_of(F.col("target")).alias("b"))
    hosts = hosts.filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    hosts = materialise(hosts, "host-links")
    names = registered_domains(hosts.select(F.explode(F.array("a", "b")).alias("host")), suffixes)
    a = names.select(F.col("host").alias("a"), F.col("domain").alias("src"))
    b = names.select(F.col("host").alias("b"), F.col("domain").alias("dst"))
    met = hosts.join(a, "a").join(b, "b").filter("src != dst")
    return met.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def rank_domains(
    links: DataFrame, domains: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS, crowd: int = CROWD,
) -> DataFrame:
    """(domain, rank): the stationary share of a walk that follows weighted links and else starts anew anywhere.

    ``links`` has src, dst and n, ``domains`` a ``domain`` column; ends of links are domains as well. Domains without
    links out pass their share to all. Rounds end when the shares move by less than ``tolerance`` in total, and fail
    after ``max_rounds``; each is written to the shared folder, and only two sums a round reach the driver. Links out of
    a domain with many of them are dealt to several parts, and its rank is sent to each. NULL ends and links of no weight
    are ignored, repeated ones add up; no domains give no rows.
    """
    edges = links.filter("src IS NOT NULL AND dst IS NOT NULL AND n > 0").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    edges = materialise(edges, "domain-edges")
    out = edges.groupBy("src").agg(F.sum("n").alias("all"), F.ceil(F.count("*") / F.lit(crowd)).cast("int").alias("parts"))
    nodes = domains.select("domain").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("domain")))
    nodes = nodes.filter("domain IS NOT NULL").distinct().join(
        out.select(F.col("src").alias("domain"), "all", "parts"), "domain", "left")
    nodes = materialise(nodes, "domains")
    n = nodes.count()
    if n == 0:
        return nodes.select("domain", F.lit(0.0).alias("rank"))
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")
    # Only a source with several parts needs its number of parts to deal its links.
    dealt = edges.join(out.filter("parts > 1").select("src", "parts"), "src", "left")
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = materialise(dealt.select("src", part.alias("part"), "dst", "n"), "dealt-edges")
    ranks = nodes.select("domain", "all", "parts", F.lit(1.0 / n).alias("rank"))
    lost = nodes.filter("all IS NULL").count() / n
    for _ in range(max_rounds):
        sent = ranks.filter("all IS NOT NULL").select(
            F.col("domain").alias("src"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
            (F.col("rank") / F.col("all")).alias("share"),
        )
        got = dealt.join(sent, ["src", "part"]).groupBy(F.col("dst").alias("domain"))
        got = got.agg(F.sum(F.col("share") * F.col("n")).alias("got"))
        base = (1.0 - damping) / n + damping * lost / n
        new = F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        ranks = ranks.join(got, "domain", "left").select("domain", "all", "parts", new.alias("rank"), F.col("rank").alias("old"))
        ranks = materialise(ranks, "ranks")
        moved, lost = ranks.agg(
            F.sum(F.abs(F.col("rank") - F.col("old"))),
            F.coalesce(F.sum(F.when(F.col("all").isNull(), F.col("rank"))), F.lit(0.0)),
        ).head()
        ranks = ranks.drop("old")
        if moved < tolerance:
            return ranks.select("domain", "rank")
    raise RuntimeError(f"ranks still move after {max_rounds} rounds")


def source_quality(pages: DataFrame, links: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(domain, n_pages, n_in, rank, place): pages, linking domains and rank of each registered domain.

    ``place`` is 1 for the highest rank; equal ranks (to nine digits) share a place. Pages without a host count nowhere.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"))
    counted = hosts.join(registered_domains(hosts, suffixes), "host").groupBy("domain").agg(F.sum("n").alias("n_pages"))
    counted = materialise(counted, "domain-pages")
    edges = materialise(domain_links(links, suffixes), "links")
    ranks = rank_domains(edges, counted).withColumn("level", F.round("rank", 9))
    incoming = edges.groupBy(F.col("dst").alias("domain")).agg(F.count("*").alias("n_in"))
    return ranks.join(counted, "domain", "left").join(incoming, "domain", "left").join(_places(ranks), "level").select(
        "domain", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_in", F.lit(0)).alias("n_in"),
        F.round("rank", 6).alias("rank"), "place",
    )


def _places(ranks: DataFrame) -> DataFrame:
    """(level, place) for each distinct rank: one more than the number of domains above it.

    Levels are sorted in ranges; each range is numbered by itself and moved on by the sizes of those before it,
    of which there is one row a range, so no task sees all levels.
    """
    levels = ranks.groupBy("level").agg(F.count("*").alias("n"))
    levels = levels.repartitionByRange(F.desc("level")).withColumn("range", F.spark_partition_id())
    levels = materialise(levels, "levels")
    inside = Window.partitionBy("range").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = levels.groupBy("range").agg(F.sum("n").alias("size"))
    sizes = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    numbered = levels.withColumn("above", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sizes, "range")
    return numbered.select("level", (F.col("start") + F.col("above") + 1).alias("place"))


def page_quality(pages: DataFrame, quality: DataFrame, suffixes: DataFrame, url_col: str = "url") -> DataFrame:
    """The pages with the domain, rank and place of their host; NULL where a page has no host or its domain no rank.

    Hosts are few beside pages, so their ranks are joined to the distinct hosts first; a host with very many pages is
    met by a measured broadcast or a split join.
    """
    host = host_of(F.col(f"`{url_col}`"))
    names = registered_domains(pages.select(host.alias("host")), suffixes)
    ranked = names.join(quality.select("domain", "rank", "place"), "domain", "left")
    known = pages.select("*", host.alias("page_host")).filter("page_host IS NOT NULL")
    found = known.join(ranked, known["page_host"] == ranked["host"]).drop("page_host", "host")
    none = pages.filter(host.isNull()).select(
        "*", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("rank"),
        F.lit(None).cast("long").alias("place"),
    )
    return found.select(*none.columns).unionByName(none)
