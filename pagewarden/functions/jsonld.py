"""JSON-LD: one strict parse in an Arrow batch, then columns over its result.

The parse is the part that built-in functions cannot state: try_parse_json accepts trailing text. Everything that asks
about the result (status, types, products) is a column expression.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _reject(token: str):
    raise ValueError(token)


def nodes_of(block: str) -> tuple[str, list[dict]]:
    """Status and reachable nodes: an array root is flattened by one level, an item with an @graph array is replaced by it."""
    try:
        root = json.loads(block, parse_constant=_reject)
    except (ValueError, RecursionError):
        return "malformed_json", []
    items = root if isinstance(root, list) else [root]
    if any(not isinstance(x, dict) for x in items):
        return "not_object", []
    nodes = [n for x in items for n in (x["@graph"] if isinstance(x.get("@graph"), list) else [x])]
    typed = any(isinstance(n, dict) and "@type" in n for n in nodes)
    status = "valid" if any("@context" in x for x in items) and typed else "missing_context_or_type"
    out = []
    for n in nodes:
        if not isinstance(n, dict):
            out.append({"types": [], "name": None, "has_review": False, "has_rating": False, "has_offers": False, "json": json.dumps(n, ensure_ascii=False)})
            continue
        t = n.get("@type")
        types = [t] if isinstance(t, str) else [x for x in t if isinstance(x, str)] if isinstance(t, list) else []
        name = n.get("name")
        out.append({"types": types, "name": name if isinstance(name, str) else None, "has_review": "review" in n, "has_rating": "aggregateRating" in n, "has_offers": "offers" in n, "json": json.dumps(n, ensure_ascii=False)})
    return status, out


_NODE = T.StructType([
    T.StructField("types", T.ArrayType(T.StringType())), T.StructField("name", T.StringType()), T.StructField("has_review", T.BooleanType()), T.StructField("has_rating", T.BooleanType()),
    T.StructField("has_offers", T.BooleanType()), T.StructField("json", T.StringType()),
])
BLOCKS = T.ArrayType(T.StructType([T.StructField("status", T.StringType()), T.StructField("nodes", T.ArrayType(_NODE))]))


def parsed_blocks(blocks: list[str] | None) -> list[dict] | None:
    return None if blocks is None else [dict(zip(("status", "nodes"), nodes_of(x), strict=True)) for x in blocks]


def _parsed(blocks: pd.Series) -> pd.Series:
    return pd.Series([parsed_blocks(b) for b in blocks], dtype=object)


def parse_blocks(blocks: Column) -> Column:
    """array<string> of JSON-LD texts to array<struct<status, nodes>>. `extract_signals` does the same beside its own parse."""
    return F.pandas_udf(_parsed, BLOCKS)(blocks)


def jsonld_nodes(parsed: Column) -> Column:
    """All nodes of all blocks; blocks that do not parse have none."""
    return F.flatten(F.transform(parsed, lambda b: b["nodes"]))


def jsonld_types(parsed: Column) -> Column:
    return F.flatten(F.transform(jsonld_nodes(parsed), lambda n: n["types"]))


def jsonld_status(parsed: Column) -> Column:
    """Status of each block, in order."""
    return F.transform(parsed, lambda b: b["status"])
