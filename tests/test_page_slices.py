"""A worker parses a bounded part of an Arrow batch at a time."""

import pyarrow as pa

from webrisk.operators.html import _parse_batches, read_page


def test_output_batches_are_cut_by_bytes_of_source():
    page = "<html><body>" + "<p class='x'>word</p>" * 5000 + "</body></html>"
    pages = [page, None, "", *[page] * 60]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(pages))), pa.array(pages)], ["_carry", "_html"])
    out = list(_parse_batches(iter([batch])))
    sizes = [sum(len(pages[i] or "") for i in b.column(0).to_pylist()) for b in out]
    assert max(sizes) < 1024 * 1024
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(len(pages)))
    assert [t for b in out for t in b.column("dom_text").to_pylist()] == [read_page(p)[1] for p in pages]
    assert [len(e or []) for b in out for e in b.column("elements").to_pylist()] == [len(read_page(p)[0] or []) for p in pages]
