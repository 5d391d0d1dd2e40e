"""Licence scans by diagonal voting.

Templates are phrases and licence sentences. Every rolling word k-gram of a text is hashed; the hashes are joined with
the positions of the templates' k-grams. A match at word p of the text and position t of a template votes for the
diagonal p - t. A diagonal with all k-grams of a phrase is a place of that phrase. For sentences, matches are chained
along the text: positions grow in the text and in the template, and the diagonal moves by at most DRIFT words at a step
(an inserted word makes it larger, a dropped word smaller). The longest chains that don't overlap are the spans, verified
by the share of the template's k-grams in them.

Before the join, k-grams that occur in no template are left out in the task that hashes them; the template table is the
bounded side (a few hundred rows).

Words are A-Z lower-cased runs of ASCII letters, digits and characters beyond ASCII. Defined results: null or empty
texts have no words and no labels; rows without doc_id or with a repeated one are scanned as rows of their own;
an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrisk.llm import columns as C
from webrisk.llm.wordhash import ALNUM, chained, words_of

GRAM = 2


@dataclass(frozen=True)
class LicenceTemplate:
    label: str
    text: str
    exact: bool = False  # a phrase: all words, consecutive


#: The phrases that every scan must report.
PHRASES = (
    LicenceTemplate("mit", "mit license", True),
    LicenceTemplate("apache", "apache license", True),
    LicenceTemplate("gpl", "general public license", True),
)
SENTENCES = (
    LicenceTemplate("mit", "Released under the MIT License."),
    LicenceTemplate("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    LicenceTemplate("apache", "Licensed under the Apache License, Version 2.0."),
    LicenceTemplate("gpl", "This work is licensed under the GNU General Public License, version 3."),
    LicenceTemplate("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    LicenceTemplate("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    LicenceTemplate("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    LicenceTemplate("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    LicenceTemplate("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    LicenceTemplate("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    LicenceTemplate("reserved", "All rights reserved."),
)
#: Share of a sentence's k-grams that a span must hold, and words by which the diagonal may move at a step.
LEAST_SHARE = 0.75
DRIFT = 3


def template_words(text: str) -> list[str]:
    lowered = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def template_grams(templates) -> list[tuple[int, str, bool, int, int, int]]:
    """(template, label, exact, position, number of k-grams, hash)."""
    out = []
    for k, t in enumerate(templates):
        w = words_of(pa.array([" ".join(template_words(t.text))]), ALNUM)
        grams = chained(w.hash, GRAM).view(np.int64)
        out += [(k, t.label, t.exact, i, len(grams), int(h)) for i, h in enumerate(grams)]
    return out


def scan_licences(docs: DataFrame, templates=PHRASES + SENTENCES) -> DataFrame:
    """(row, doc_id, n_words, spans): spans is an array of (label, exact, first, last, share), in word positions."""
    spark = docs.sparkSession
    grams = template_grams(templates)
    known = np.unique(np.array([g[5] for g in grams], np.int64))

    def hits(batches):
        for batch in batches:
            w = words_of(batch.column(1), ALNUM, lower=True)
            h = chained(w.hash, GRAM).view(np.int64)
            at = np.searchsorted(known, h)
            found = known[np.minimum(at, len(known) - 1)] == h
            if len(h):
                found &= w.row[:len(h)] == w.row[GRAM - 1:GRAM - 1 + len(h)]
            at = np.flatnonzero(found)
            rows = w.row[at]
            cut = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            pos = (at - w.first[rows]).astype(np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(pos), pa.array(h[at])], ["p", "h"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(w.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), pairs)],
                ["doc_id", "n_words", "hits"])

    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        hits, "doc_id long, n_words long, hits array<struct<p:long,h:long>>")
    # numbered once and written, so that rows which repeat a doc_id stay apart
    scanned = C.stored(scanned.withColumn("row", F.monotonically_increasing_id()), "licence-hits")
    table = F.broadcast(spark.createDataFrame(grams, "template int, label string, exact boolean, t long, n long, h long"))
    votes = (scanned.where(F.size("hits") > 0).select("row", "doc_id", "n_words", F.explode("hits").alias("x"))
             .select("row", "doc_id", "n_words", F.col("x.p").alias("p"), F.col("x.h").alias("h")).join(table, "h"))
    diagonals = votes.groupBy("row", "doc_id", "n_words", "template", "label", "exact", "n", (F.col("p") - F.col("t")).alias("d")).agg(
        F.count("*").alias("found"), F.when(~F.first("exact"), F.collect_list("p")).alias("ps"))
    per_text = diagonals.groupBy("row", "doc_id", "n_words").agg(F.collect_list(F.struct(
        "template", "d", "label", "exact", "n", "found", "ps")).alias("ds"))
    spans = per_text.mapInArrow(_merge, "row long, doc_id long, n_words long, spans array<struct<label:string,exact:boolean,first:long,last:long,share:double>>")
    empty = F.array().cast("array<struct<label:string,exact:boolean,first:long,last:long,share:double>>")
    return spans.unionByName(scanned.where(F.size("hits") == 0).select("row", "doc_id", "n_words", empty.alias("spans")))


def _merge(batches):
    """Phrases: full diagonals. Sentences: chains of matches."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
    for batch in batches:
        out = []
        for ds in batch.column("ds").to_pylist():
            spans, hits = [], {}
            for x in sorted(ds, key=lambda x: (x["template"], x["d"])):
                if not x["exact"]:
                    hits.setdefault((x["template"], x["label"], x["n"]), []).extend((p, p - x["d"]) for p in x["ps"])
                elif x["found"] == x["n"]:
                    spans.append((x["label"], True, x["d"], x["d"] + x["n"] + GRAM - 2, 1.0))
            for (_, label, n), found in hits.items():
                spans += [(label, False, a, b + GRAM - 1, k / n) for a, b, k in chains(sorted(found), n)]
            out.append([dict(zip(("label", "exact", "first", "last", "share"), s)) for s in spans])
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("n_words"), pa.array(out, kind)], ["row", "doc_id", "n_words", "spans"])


def chains(hits: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """(first, last, matches) of the longest chains over ascending (text, template) positions that hold enough of n."""
    taken: list[tuple[int, int, int]] = []
    while len(hits) >= LEAST_SHARE * n:
        # per hit: matches and moves (negative) of the best chain that ends there, and the place of its start
        best: list[tuple[int, int, int]] = []
        low = 0
        for i, (p, t) in enumerate(hits):
            while hits[low][0] < p - n - DRIFT:
                low += 1
            top = (1, 0, p)
            for (q, u), (k, moved, start) in zip(hits[low:i], best[low:i]):
                if q < p and u < t and (move := abs(p - t - q + u)) <= DRIFT:
                    top = max(top, (k + 1, moved - move, start))
            best.append(top)
        ends = sorted((-k, -moved, p, start) for (k, moved, start), (p, _) in zip(best, hits) if k >= LEAST_SHARE * n)
        if not ends:
            break
        used: set[int] = set()
        for k, _, last, first in ends:
            if used.isdisjoint(range(first, last + 1)):
                used.update(range(first, last + 1))
                taken.append((first, last, -k))
        hits = [h for h in hits if h[0] not in used]
    return taken
