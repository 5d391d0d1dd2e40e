"""Page parsing: one Python pass per page, everything downstream is relational.

``parse_pages`` sends only the key, the page source and nothing else through Arrow
and gets back two nested columns per page: its start tags and its visible text.
Keeping the tags of a page in one array means that the page rules need no shuffle
at all; ``page_elements`` gives the exploded one-row-per-tag table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from webrisk import catalogs as K
from webrisk.functions.plan import explode_rows

# ship the reader inside the task, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ELEMENT = S.StructType([
    S.StructField("seq", S.IntegerType()),
    S.StructField("tag", S.StringType()),
    S.StructField("forms", S.ArrayType(S.IntegerType())),
    S.StructField("attrs", S.MapType(S.StringType(), S.StringType())),
])
_ELEMENT_ARROW = pa.struct([
    ("seq", pa.int32()),
    ("tag", pa.string()),
    ("forms", pa.list_(pa.int32())),
    ("attrs", pa.map_(pa.string(), pa.string())),
])
_VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
))
_NO_TEXT = frozenset(("script", "style", "template"))
# bytes of page source parsed at once: tags as Python objects take many times the source, so this, not the input, sets a worker's memory
_SLICE_BYTES = 512 * 1024


class _PageReader(HTMLParser):
    """Collects start tags with their enclosing forms, and visible text runs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.runs: list[str] = []
        self._buffer: list[str] = []
        self._open: list[tuple[str, int]] = []
        self._forms: list[int] = []
        self._muted = 0

    def _flush(self) -> None:
        if self._buffer:
            run = "".join(self._buffer).strip()
            self._buffer.clear()
            if run:
                self.runs.append(run)

    def handle_starttag(self, tag, attrs):
        self._flush()
        seq = len(self.elements)
        values = {name: ("" if value is None else value) for name, value in attrs}
        self.elements.append(
            {"seq": seq, "tag": tag, "forms": list(self._forms), "attrs": list(values.items())}
        )
        if tag not in _VOID:
            self._open.append((tag, seq))
            if tag == "form":
                self._forms.append(seq)
            elif tag in _NO_TEXT:
                self._muted += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if not any(name == tag for name, _ in self._open):
            return
        while self._open:
            name, seq = self._open.pop()
            if name == "form" and self._forms and self._forms[-1] == seq:
                self._forms.pop()
            elif name in _NO_TEXT:
                self._muted -= 1
            if name == tag:
                break

    def handle_data(self, data):
        if not self._muted:
            self._buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()


def read_page(source: str | None) -> tuple[list[dict] | None, str | None]:
    """Start tags and visible text of one page; (None, None) for a missing or empty page."""
    if not source:
        return None, None
    reader = _PageReader()
    reader.feed(source)
    reader.close()
    reader._flush()
    return reader.elements, " ".join(reader.runs)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        start = 0
        while start < batch.num_rows:
            # bound the memory of one output batch by bytes, not by rows
            stop, size = start, 0
            while stop < batch.num_rows and size < _SLICE_BYTES:
                size += lengths[stop]
                stop += 1
            part = batch.slice(start, stop - start)
            parsed = [read_page(value) for value in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([p[0] for p in parsed], pa.list_(_ELEMENT_ARROW)),
                    pa.array([p[1] for p in parsed], pa.string()),
                ],
                names=["_carry", "elements", "dom_text"],
            )
            start = stop


def parse_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """Replace the page source by ``elements`` (array of start tags) and ``dom_text``.

    All other columns ride along as one struct, so they pass through the Python
    worker untouched as Arrow buffers. Rules that need the raw source should be
    evaluated before this call (see ``dom_rules.source_flags``).
    """
    carried = [c for c in df.columns if c != html]
    packed = df.select(F.struct(*carried).alias("_carry"), F.col(html).alias("_html"))
    schema = S.StructType([
        S.StructField("_carry", packed.schema["_carry"].dataType),
        S.StructField("elements", S.ArrayType(ELEMENT)),
        S.StructField("dom_text", S.StringType()),
    ])
    parsed = packed.mapInArrow(_parse_batches, schema)
    return parsed.select("_carry.*", "elements", "dom_text")


def page_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per start tag: seq, tag, innermost form, attributes, class text, hidden flag."""
    parsed = parse_pages(pages.select(key, html), html)
    e = F.col("e")
    return explode_rows(parsed, [key], "elements", "_i", "e").select(
        key,
        e["seq"].alias("seq"),
        e["tag"].alias("tag"),
        F.try_element_at(e["forms"], F.lit(-1)).alias("form_seq"),
        e["attrs"].alias("attrs"),
        attr(e, "class").alias("class_text"),
        is_hidden(e).alias("hidden"),
    )


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Visible text of each page: stripped text runs joined by one blank."""
    return parse_pages(pages.select(key, html), html).select(key, F.col("dom_text").alias("page_text"))


def attr(element: Column, name: str) -> Column:
    """Attribute text, '' when absent."""
    return F.coalesce(F.try_element_at(element["attrs"], F.lit(name)), F.lit(""))


def has_attr(element: Column, name: str) -> Column:
    return F.map_contains_key(element["attrs"], name)


def is_hidden(element: Column) -> Column:
    """Hidden by attribute, aria state, inline style, or a class name with 'hidden' in it."""
    return (
        has_attr(element, "hidden")
        | (F.lower(attr(element, "aria-hidden")) == "true")
        | attr(element, "style").rlike(K.HIDDEN_STYLE)
        | F.lower(attr(element, "class")).contains("hidden")
    )


def tags(elements: Column, *names: str) -> Column:
    return F.filter(elements, lambda e: e["tag"].isin(*names))
