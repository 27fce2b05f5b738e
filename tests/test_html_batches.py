"""The parser of pages lets a batch's first rows go before it reads the others, and its rows are those of one page each."""

from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import types as T

from pagewarden.operators import html


def test_rows_of_a_batch_leave_in_slices(monkeypatch):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.StringType())])
    each = html.extract_signals(SimpleNamespace(schema=schema, mapInArrow=lambda f, schema: f), {"h": "raw"})
    pages = [f"<title>{i}</title>" for i in range(3 * html.ROWS)]
    read, own = [], html.signals_of
    monkeypatch.setattr(html, "signals_of", lambda page: read.append(page) or own(page))
    out = each(iter([pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["id", "h"])]))
    first = next(out)
    assert first.num_rows == len(read) == html.ROWS
    rows = [r for b in (first, *out) for r in b.to_pylist()]
    assert [(r["id"], r["raw"]["title"]) for r in rows] == [(i, str(i)) for i in range(len(pages))]
