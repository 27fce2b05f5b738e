"""Sitemap documents: entries, expansion of indexes, and the gap to what was crawled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import url_path
from ..sources.staging import cut, ranked
from . import sitemap_xml


ENTRIES = "site string, sitemap_url string, kind string, ord int, loc string"
#: Rows and characters of a batch of entries on its way out of the parser.
BATCH, CHARS = 10_000, 1 << 22


def sitemap_entries(docs: DataFrame) -> DataFrame:
    """(site, sitemap_url, kind, ord, loc) of well-formed documents of status 200 and at most 50 MB; ord counts from 0.

    Bodies are parsed where they lie, one pass each, and entries leave in bounded batches: see `sitemap_xml` for what
    counts as a location. An index is looked for before a urlset. A null body, or one beyond the cap, has no entries.
    """
    body = F.coalesce("body", F.lit(""))
    d = docs.filter("status_code = 200").select("site", "sitemap_url", body.alias("body")).filter(F.octet_length("body") <= sitemap_xml.MAX_BYTES)
    return d.mapInArrow(_parse, ENTRIES)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ENTRIES.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
    out: list[list] = [[] for _ in names]
    held = 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    for b in batches:
        for site, url, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            kind, locs = sitemap_xml.locations(body.as_py())
            for i, loc in enumerate(locs):
                for c, v in zip(out, (site, url, kind, i, loc), strict=True):
                    c.append(v)
                held += len(loc)
                if len(out[0]) == BATCH or held > CHARS:
                    yield row()
                    out, held = [[] for _ in names], 0
    yield row()


def _met(entries: DataFrame, roots: DataFrame, max_children: int | None) -> tuple[DataFrame, DataFrame]:
    """(site, path, url) of all levels under the roots, and (site, path, pos) of the indexes' entries.

    Levels are joined one after another until no index is left. A path of positions keeps the depth-first order; its
    first element numbers the root. A document met again under itself is not opened again, so the levels end.
    """
    entries = cut(entries.withColumn("pos", F.col("ord") + 1).drop("ord"), "sitemap-entries")
    frontier = roots.select("site", "sitemap_url", F.array(F.col("ord").cast("int")).alias("path"), F.array("sitemap_url").alias("opened"))
    found, indexes = None, None
    while True:
        met = cut(frontier.join(entries, ["site", "sitemap_url"]).withColumn("path", F.concat("path", F.array("pos"))), "sitemap-level")
        urls, children = met.filter("kind = 'urlset'").select("site", "path", F.col("loc").alias("url")), met.filter("kind = 'index'")
        seen = children.select("site", "path", "pos")
        found, indexes = (urls, seen) if found is None else (found.unionByName(urls), indexes.unionByName(seen))
        opens = ~F.array_contains("opened", F.col("loc"))
        children = children.filter(opens if max_children is None else opens & (F.col("pos") <= max_children))
        if children.isEmpty():
            return found, indexes
        frontier = children.select("site", F.col("loc").alias("sitemap_url"), "path", F.concat("opened", F.array("loc")).alias("opened"))


def sitemap_urls(docs: DataFrame, roots: DataFrame, max_pages: int = 200, max_children: int = 50) -> DataFrame:
    """(site, root, ord, url, truncated): the URLs under each root, depth first in document order, within a crawl's budget.

    An index opens its first max_children children; a root keeps its first max_pages URLs. truncated: there were more
    children or URLs, or children were left when the budget was used up. Only max_pages + 1 rows of a root are ranked
    beyond the tasks that read them.
    """
    found, indexes = _met(sitemap_entries(docs), roots, max_children)
    root = F.element_at("path", 1).alias("root")
    order = Window.partitionBy("site", "root").orderBy("path")
    first = found.select("site", root, "path", "url").withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= max_pages + 1)
    first = cut(first, "sitemap-first")
    met = first.groupBy("site", "root").agg(F.max("ord").alias("n"), F.max(F.when(F.col("ord") <= max_pages, F.col("path"))).alias("last"))
    opened = indexes.select("site", root, "path", (F.col("pos") > max_children).alias("wide")).groupBy("site", "root").agg(
        F.bool_or("wide").alias("wide"), F.max(F.when(~F.col("wide"), F.col("path"))).alias("child"))
    cuts = met.join(opened, ["site", "root"], "left").select(
        "site", "root", (F.coalesce("wide", F.lit(False)) | (F.col("n") > max_pages) | ((F.col("n") == max_pages) & F.coalesce(F.col("child") > F.col("last"), F.lit(False)))).alias("truncated"))
    return first.filter(F.col("ord") <= max_pages).join(cuts, ["site", "root"]).select("site", "root", "ord", "url", "truncated")


def all_sitemap_urls(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """(site, ord, url): every URL under each site's roots, without a budget; ord is the path of positions, nothing is ranked."""
    return _met(sitemap_entries(docs), roots, None)[0].select("site", F.col("path").alias("ord"), "url")


def sitemap_gap(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """(site, run_id, path) of crawled pages of status 200 whose path no sitemap URL of the site has."""
    crawled = pages.filter("status_code = 200").select("site", "run_id", url_path(F.col("url")).alias("path")).filter("path is not null").distinct()
    listed = urls.select("site", url_path(F.col("url")).alias("path")).filter("path is not null").distinct()
    return crawled.join(listed, ["site", "path"], "left_anti").select("site", "run_id", "path")


def proposed_urls(gap: DataFrame, urls: DataFrame) -> DataFrame:
    """Missing paths under the origin of the site's first sitemap URL; without one, the path is skipped (url is null)."""
    from ..functions.urls import url_origin

    first = urls.groupBy("site").agg(F.min_by(url_origin(F.col("url")), "ord").alias("origin"))
    return gap.join(first, "site", "left").select("site", "run_id", "path", F.concat("origin", "path").alias("url"))


def missing_parts(gap: DataFrame, size: int = 1_000) -> DataFrame:
    """(site, run_id, part, n, marker): missing paths in order as JSON arrays of at most `size`, so a site of any size is many rows."""
    placed = ranked(gap.select("site", "run_id", "path"), ["site", "run_id"], [F.col("path")])
    part = F.floor((F.col("place") - 1) / size).cast("int").alias("part")
    rows = placed.groupBy("site", "run_id", part).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return rows.select("site", "run_id", "part", F.size("paths").cast("long").alias("n"), F.to_json("paths").alias("marker"))
