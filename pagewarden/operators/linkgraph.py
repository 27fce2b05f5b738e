"""Reachability over an already fetched snapshot: breadth first, by joins, one level at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import frontier_url
from ..sources.staging import cut, ranked


def url_ids(urls: DataFrame) -> DataFrame:
    """(site, url) to (site, url, id), each once; ids ascend with site and url. A level of a walk shuffles ids, no URLs."""
    d = urls.select("site", "url").distinct().repartitionByRange("site", "url").sortWithinPartitions("site", "url")
    return cut(d.withColumn("id", F.monotonically_increasing_id()), "url-ids")


def adjacency(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, links): of each page the ids that it links to, in the order of their first places. edges: site, from, pos, url."""
    a, b = (ids.select("site", F.col("url").alias(c), F.col("id").alias(f"{c}_id")) for c in ("from", "url"))
    e = edges.join(a, ["site", "from"]).join(b, ["site", "url"]).groupBy("from_id", "url_id").agg(F.min("pos").alias("pos"))
    links = F.transform(F.array_sort(F.collect_list(F.struct("pos", "url_id"))), lambda x: x["url_id"])
    return e.groupBy(F.col("from_id").alias("id")).agg(links.alias("links"))


def first_discovery(found: DataFrame, keys: tuple[str, ...] = ("site", "url")) -> DataFrame:
    """Of (keys, parent_ord, pos) the first discovery of each URL."""
    return found.groupBy(*keys).agg(F.min(F.struct("parent_ord", "pos")).alias("m")).select(*keys, "m.parent_ord", "m.pos")


def within_budget(found: DataFrame, max_pages: int, site: str = "site", last: str = "url") -> DataFrame:
    """Numbers a site's discoveries in order and keeps the first max_pages: tasks drop the rest before they meet."""
    order = Window.partitionBy(site).orderBy("parent_ord", "pos", last)
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_pages)


def crawl_reach(edges: DataFrame, snapshot: DataFrame, seeds: DataFrame, allowed: DataFrame | None = None, max_pages: int | None = 200, max_depth: int = 3, first: str | None = None) -> DataFrame:
    """(site, url, depth, ord, visit_status): what a polite crawl of the snapshot visits.

    edges: (site, url, pos, link); snapshot: (site, url, status_code); seeds: (site, url, depth, ord), depth 0 for the
    start and 1 for sitemap URLs; allowed: (site, url, allowed), absent URLs are allowed. URLs are compared normalized.
    visit_status is visited, skipped_by_robots or missing; all three consume budget. Only visited pages of status 200
    above max_depth are expanded. Discovery order is (depth, parent's order, position). max_pages None is no budget: all
    that is reached, numbered over ranges, so a site of any size is many tasks; rows of ord <= n are a budget of n. Of a
    URL's rows in the snapshot that of the smallest `first` counts, if that column is named.

    URLs become ids once, links lists of ids, and pages rows of (id, status, allowed); the levels join and group ids alone.
    """
    e = cut(edges.select("site", frontier_url(F.col("url")).alias("from"), "pos", frontier_url(F.col("link")).alias("url")), "links")
    status = F.min_by("status_code", first) if first else F.first("status_code")
    pages = cut(snapshot.select("site", frontier_url(F.col("url")).alias("url"), "status_code", *([first] if first else [])).groupBy("site", "url").agg(status.alias("status_code")), "pages")
    seeds = cut(seeds.select("site", frontier_url(F.col("url")).alias("url"), "depth", F.col("ord").cast("long").alias("ord")), "seeds")
    ids = url_ids(e.select("site", F.col("from").alias("url")).unionByName(e.select("site", "url")).unionByName(pages.select("site", "url")).unionByName(seeds.select("site", "url")))
    sites = ids.groupBy("site").agg(F.min("id").alias("site_id"))
    links = cut(adjacency(e, ids), "adjacency")
    nodes = ids.join(sites, "site").join(pages, ["site", "url"], "left")
    if allowed is not None:
        a = cut(allowed.select("site", "url", "allowed"), "allowed")  # its plan is as large as all others here
        a = cut(a.select("site", frontier_url(F.col("url")).alias("url"), "allowed").groupBy("site", "url").agg(F.bool_and("allowed").alias("allowed")), "allowed-urls")
        nodes = nodes.join(a, ["site", "url"], "left")
    else:
        nodes = nodes.withColumn("allowed", F.lit(True))
    nodes = cut(nodes.select("id", "site_id", "status_code", F.coalesce("allowed", F.lit(True)).alias("allowed")), "nodes")
    starts = cut(seeds.join(ids, ["site", "url"]).select("id", "depth", "ord"), "starts")
    done: DataFrame | None = None
    last: DataFrame | None = None
    for depth in range(max_depth + 1):
        found = starts.filter(F.col("depth") == depth).select("id", F.lit(-1).cast("long").alias("parent_ord"), F.col("ord").alias("pos"))
        if last is not None:
            out = last.filter("expands").select("id", F.col("ord").alias("parent_ord")).join(links, "id")
            found = found.unionByName(out.select("parent_ord", F.posexplode("links").alias("pos", "id")).select("id", "parent_ord", F.col("pos").cast("long").alias("pos")))
        new = first_discovery(found, ("id",))
        if done is not None:
            new = new.join(done.select("id"), "id", "left_anti")
        new = new.join(nodes, "id")
        if max_pages is None:
            new = ranked(new, ["site_id"], [F.col("parent_ord"), F.col("pos"), F.col("id")], "n")
        else:
            new = within_budget(new, max_pages, "site_id", "id")
        new = new.withColumn("ord", F.col("n").cast("long"))
        if done is not None:
            used = done.groupBy("site_id").agg(F.count(F.lit(1)).alias("used"))
            new = new.join(used, "site_id", "left").withColumn("ord", F.col("n") + F.coalesce("used", F.lit(0)))
            new = new if max_pages is None else new.filter(F.col("ord") <= max_pages)
        status = F.when(~F.col("allowed"), "skipped_by_robots").when(F.col("status_code").isNull(), "missing").otherwise("visited")
        last = cut(new.select("id", "site_id", F.lit(depth).alias("depth"), F.col("ord").cast("long").alias("ord"), status.alias("visit_status"), ((status == "visited") & (F.col("status_code") == 200)).alias("expands")), "level")
        done = last if done is None else done.unionByName(last)
        if depth and last.isEmpty():
            break
    return done.join(ids, "id").select("site", "url", "depth", "ord", "visit_status")


def single_page(snapshot: DataFrame, starts: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """The start pages alone, as written; blocked ones give nothing; never truncated."""
    out = starts.select("site", "url").join(snapshot.select("site", "url", "status_code"), ["site", "url"])
    if allowed is not None:
        out = out.join(allowed.filter("not allowed").select("site", "url"), ["site", "url"], "left_anti")
    return out.withColumn("depth", F.lit(0))


def crawl_summary(reach: DataFrame, max_pages: int = 200, sitemap_cut: DataFrame | None = None) -> DataFrame:
    """Counts, the list of URLs skipped by robots, and whether the crawl was cut off (budget used up, or a sitemap cap)."""
    skipped = F.array_sort(F.collect_list(F.when(F.col("visit_status") == "skipped_by_robots", F.struct("ord", "url"))))
    out = reach.groupBy("site").agg(
        F.count_if(F.col("visit_status") == "visited").alias("visited"), F.count_if(F.col("visit_status") == "skipped_by_robots").alias("skipped"),
        F.transform(skipped, lambda x: x["url"]).alias("skipped_urls"), (F.count(F.lit(1)) >= max_pages).alias("truncated"),
    )
    if sitemap_cut is not None:
        c = sitemap_cut.groupBy("site").agg(F.bool_or("truncated").alias("cut"))
        out = out.join(c, "site", "left").withColumn("truncated", F.col("truncated") | F.coalesce("cut", F.lit(False))).drop("cut")
    return out


def crawl_schedule(frontier: DataFrame, start: Column, rate: float = 1.0, delays: DataFrame | None = None) -> DataFrame:
    """When each request of a site may start: 1/rate seconds apart, or the site's crawl delay where it is longer."""
    if rate <= 0:
        raise ValueError("rate must be above 0")
    out = frontier.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy("ord")) - 1)
    gap = F.lit(1.0 / rate)
    if delays is not None:
        out = out.join(delays.select("site", "delay_s"), "site", "left")
        gap = F.greatest(gap, F.coalesce("delay_s", F.lit(0.0)))
    return out.select("site", "url", "ord", F.timestamp_micros((F.unix_micros(start) + F.round(F.col("k") * gap * 1_000_000)).cast("long")).alias("starts_at"))
