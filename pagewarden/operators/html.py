"""Page signals and links: one parse of each page, in Arrow batches. The only Python in the page path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.jsonld import BLOCKS, parsed_blocks
from . import html_tokens

SIGNALS = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("h1_count", T.IntegerType()), T.StructField("h1_text", T.StringType()),
    T.StructField("meta_robots", T.StringType()), T.StructField("jsonld_blocks", T.ArrayType(T.StringType())), T.StructField("og_title", T.StringType()), T.StructField("og_url", T.StringType()),
    T.StructField("og_description", T.StringType()), T.StructField("meta_description", T.StringType()), T.StructField("images_without_alt", T.IntegerType()), T.StructField("body_text", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
])
SPACE = " \t\n\r\x0b\x0c                 　﻿"


def collapsed(text: str) -> str:
    return " ".join(text.translate(_TO_SPACE).split(" ")).strip(" ") if not text.isascii() else " ".join(text.split())


_TO_SPACE = dict.fromkeys(map(ord, SPACE), " ")


NAMED = {"robots": "meta_robots", "description": "meta_description"}
PROPERTIES = {"og:title": "og_title", "og:url": "og_url", "og:description": "og_description"}


def signals_of(page: str | None) -> dict:
    """Of canonical links, and of meta elements of one name or property, the first decides, even without a value."""
    out = dict.fromkeys((*NAMED.values(), *PROPERTIES.values()))
    seen: set[str] = set()
    title, script, h1, body = None, None, [], None
    canonical, h1_count, images, links, blocks = None, 0, 0, [], []
    inside = {"title": False, "h1": False}

    def first(key: str, value: str | None) -> None:
        if key not in seen:
            seen.add(key)
            out[key] = value

    for kind, name, rest in html_tokens.tokens(page or ""):
        if kind == "text":
            if inside["title"]:
                title.append(name)
                continue
            if inside["h1"]:
                h1.append(name)
            if script is not None:
                script.append(name)
            if body is not None:
                body.append(name)
        elif kind == "close":
            if name in inside:
                inside[name] = False
            elif name == "script" and script is not None:
                if block := "".join(script).strip(SPACE):
                    blocks.append(block)
                script = None
        elif name == "title":
            if title is None:
                title, inside["title"] = [], True
        elif name == "body":
            body = [] if body is None else body
        elif name == "h1":
            h1_count += 1
            inside["h1"] = h1_count == 1
        elif name in ("link", "meta", "script", "img", "a"):
            a = html_tokens.attributes(rest)
            if name == "link" and a.get("rel", "").lower() == "canonical" and "canonical" not in seen:
                seen.add("canonical")
                canonical = a.get("href")
            elif name == "meta":
                if (key := NAMED.get(a.get("name", "").lower())) is not None:
                    first(key, a.get("content"))
                if (key := PROPERTIES.get(a.get("property", "").lower())) is not None:
                    first(key, a.get("content"))
            elif name == "script":
                script = [] if a.get("type", "").lower() == "application/ld+json" else None
            elif name == "img":
                images += "alt" not in a
            elif name == "a" and "href" in a:
                links.append(a["href"])
    return out | {
        "title": None if title is None else "".join(title).strip(SPACE), "canonical": canonical, "h1_count": h1_count, "h1_text": "".join(h1).strip(SPACE) if h1_count else None,
        "jsonld_blocks": blocks, "images_without_alt": images, "body_text": collapsed("".join(body or ())), "links": links,
    }


#: Bytes of html that a task holds as Python objects, and rows of a batch that leaves it.
CHARS, ROWS = 1 << 20, 256


def slices(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS rows and some CHARS bytes in the columns; a longer row is a slice of its own."""
    for b in batches:
        sizes = [pc.fill_null(pc.binary_length(b.column(b.schema.names.index(c))), 0).to_pylist() for c in columns]
        start, held = 0, 0
        for i, n in enumerate(map(sum, zip(*sizes, strict=True))):
            if i > start and (held + n > CHARS or i - start == ROWS):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)


def extract_signals(df: DataFrame, columns: dict[str, str], jsonld: dict[str, str] | None = None) -> DataFrame:
    """df with a signal struct for each html column ({html column: new column}), in one Python pass; html columns go.

    A page whose html columns are equal is parsed once. Null or empty html gives null, 0, [] and "". jsonld: {signal
    column: new column} of those whose JSON-LD blocks are parsed in the same pass. Of an Arrow batch some CHARS of html
    are Python objects at once, and their rows leave before the next are read.
    """
    rest = [f for f in df.schema.fields if f.name not in columns]
    jsonld = jsonld or {}
    schema = T.StructType([*rest, *(T.StructField(new, SIGNALS) for new in columns.values()), *(T.StructField(new, BLOCKS) for new in jsonld.values())])
    parsed_type = to_arrow_type(BLOCKS)
    arrow = pa.struct([(f.name, pa.list_(pa.string()) if isinstance(f.dataType, T.ArrayType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in SIGNALS])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, list(columns)):
            keep = [b.column(b.schema.names.index(f.name)) for f in rest]
            made: list[list[dict]] = []
            pages = [b.column(b.schema.names.index(c)).to_pylist() for c in columns]
            for k, column in enumerate(pages):
                made.append([made[0][i] if k and x == pages[0][i] else signals_of(x) for i, x in enumerate(column)])
            parsed = [pa.array([parsed_blocks(x["jsonld_blocks"]) for x in made[list(columns.values()).index(c)]], parsed_type) for c in jsonld]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(m, arrow) for m in made), *parsed], names=schema.names)

    return df.mapInArrow(each, schema)


SCALARS = ("title", "canonical", "h1_count", "h1_text", "meta_robots", "og_title", "og_url", "og_description", "meta_description", "images_without_alt", "body_text")


def signal_diff(df: DataFrame, keys: list[str], raw: str = "raw", rendered: str = "rendered") -> DataFrame:
    """A row for each scalar signal that differs between the two structs; null and "" differ."""
    pair = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"{raw}.{f}").cast("string").alias("raw_value"), F.col(f"{rendered}.{f}").cast("string").alias("rendered_value"))
    rows = df.select(*keys, F.explode(F.array(*[pair(f) for f in SCALARS])).alias("d")).select(*keys, "d.*")
    return rows.filter(~F.col("raw_value").eqNullSafe(F.col("rendered_value")))


def has_indexing_gap(raw: str = "raw", rendered: str = "rendered") -> Column:
    """Canonical, title or robots directive only after rendering."""
    gaps = [~_has(F.col(f"{raw}.{f}")) & _has(F.col(f"{rendered}.{f}")) for f in ("canonical", "title", "meta_robots")]
    return gaps[0] | gaps[1] | gaps[2]


def _has(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def extract_links(df: DataFrame, keys: list[str], url: str = "url", links: str = "raw.links") -> DataFrame:
    """(keys, pos, link): same-origin http(s) links in document order, each once, at its first position."""
    from ..functions.urls import frontier_url, let, resolve_href, url_origin

    rows = df.select(*keys, F.col(url).alias("__u"), F.posexplode(F.col(links)).alias("pos", "href"))
    same = lambda x: F.when(x.isNotNull() & (url_origin(x) == url_origin(F.col("__u"))), F.array(frontier_url(x))).otherwise(F.array().cast("array<string>"))
    # Exploding keeps the long expression in one place; a filter over it would repeat it.
    rows = rows.select(*keys, "pos", F.explode(let(resolve_href(F.col("href"), F.col("__u")), same)).alias("link"))
    return rows.groupBy(*keys, "link").agg(F.min("pos").alias("pos"))
