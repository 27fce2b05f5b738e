"""A batch of pages is parsed in slices: few rows are Python objects at once, and each row comes out once, in order."""

import pyarrow as pa

from pagewarden.operators import html


def test_slices_are_small_and_whole():
    pages = ["x" * 10] * 600 + ["y" * (html.CHARS + 1)] + [None, "", "z"]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages), pa.array(pages[::-1])], ["id", "h", "r"])
    out = list(html.slices(iter([b, b.slice(0, 0)]), ["h", "r"]))
    assert [i for x in out for i in x.column(0).to_pylist()] == list(range(len(pages)))
    assert max(x.num_rows for x in out) <= html.ROWS
    for x in out:
        held = sum(len(p or "") for c in (1, 2) for p in x.column(c).to_pylist())
        assert x.num_rows <= 1 or held <= html.CHARS
