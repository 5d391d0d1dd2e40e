"""Substring deduplication by recompression of word sequences.

A window is WINDOW consecutive words of one text. Words covered by a window whose words also start anywhere else,
in the same text or another, are removed.

1. Recompression. Words are symbols. A round names runs of two equal symbols and pairs of a left and a right
   symbol by the hash of what they replace; the side of a symbol is a bit of its name. Names depend on nothing else,
   so they are the same in every task without exchange, and equal word sequences get equal symbols except near
   their ends: with the rounds below, up to MARGIN words at either end may differ.
2. In every window the symbol of smallest name at least MARGIN words away from both ends is its anchor, keyed by the
   words around it. Equal windows have the same anchor at the same place, so a repeated window has a key that
   occurs twice. Keys are counted over all texts.
3. Texts that hold a shared key hash the windows which that key anchors; hashes are counted over all
   texts, and the windows that occur twice or more are removed.

Texts with equal words collapse first: their windows are all repeated. A key or window that many texts share is
one row per text, summed before it is shuffled; joins are plain sort-merge joins that Spark can split.

Defined results: null and empty texts have no words; repeated rows are texts of their own, so their windows repeat;
rows without doc_id take part like others; an empty table gives an empty result; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrisk.llm import columns as C
from webrisk.llm.near_dedup import _lists
from webrisk.llm.wordhash import Words, chained, mix, text_bytes, words_of

WINDOW = 35
#: Rounds, as (name runs of two, name pairs). A run cut by a window's end costs its two symbols and a partner, a pair one symbol.
ROUNDS = ((True, True), (False, True))
MARGIN, LONGEST = 5, 4
ROWS = 256
_SECOND = np.uint64(0xA0761D6478BD642F)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def recompress(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start word, name) of the symbols after all rounds. Symbols never cross texts."""
    starts = np.arange(len(names))
    for level, (runs, pairs) in enumerate(ROUNDS):
        if len(names) < 2:
            break
        joined = text[starts[1:]] == text[starts[:-1]]
        equal = joined & (names[1:] == names[:-1])
        take = np.zeros(len(names), bool)  # symbol i is replaced together with i + 1
        if runs:
            before = np.r_[False, equal[:-1]]
            after = np.r_[equal[1:], False]
            take[:-1] = equal & ~before & ~after
        gone = np.r_[False, take[:-1]]
        if pairs:
            right = (mix(names + np.uint64(level + 1)) >> np.uint64(60)) & np.uint64(1) == 1
            take[:-1] |= joined & ~right[:-1] & right[1:] & ~(take[:-1] | gone[:-1]) & ~(take[1:] | gone[1:])
        gone = np.r_[False, take[:-1]]
        made = names.copy()
        at = np.flatnonzero(take)
        made[at] = mix(mix(names[at]) * np.uint64(3) + names[at + 1])
        names, starts = made[~gone], starts[~gone]
    return starts, names


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, anchor word of each window) over all texts of a batch."""
    n = len(w.hash)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, names = recompress(w.hash, w.row)
    order = np.full(n, _NONE)
    # smallest name, leftmost of equals: the name's upper bits above the word's number
    order[starts] = (mix(names ^ _SECOND) >> np.uint64(28) << np.uint64(28)) | starts.astype(np.uint64)
    span = WINDOW - 2 * MARGIN - LONGEST + 1
    least, width = order, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    windows = np.flatnonzero(w.row[:n - WINDOW + 1] == w.row[WINDOW - 1:])
    return windows, (least[windows + MARGIN] & np.uint64((1 << 28) - 1)).astype(np.int64)


def window_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window, from running sums."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return chained(hashes, WINDOW).view(np.int64), (chained(mix(hashes ^ _SECOND), WINDOW, 1) >> np.uint64(33)).view(np.int64)


def _slices(batches):
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            yield whole.slice(at, ROWS)
            at += ROWS


def _keys(batches):
    """Per text: words, digest of their sequence, digest of the words joined, and the distinct anchor keys with a flag for repeats."""
    for batch in _slices(batches):
        w = words_of(batch.column("text"))
        data, offsets = text_bytes(batch.column("text"))
        _, at = anchors(w)
        at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
        around = chained(w.hash, 2 * MARGIN + LONGEST).view(np.int64)
        keys, rows = around[at - MARGIN], w.row[at]
        cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        once, twice, d1, d2, sha = [], [], [], [], []
        for i in range(batch.num_rows):
            k, c = np.unique(keys[cut[i]:cut[i + 1]], return_counts=True)
            once.append(k[c == 1])
            twice.append(k[c > 1])
            h = w.hash[w.first[i]:w.first[i + 1]]
            place = mix(np.arange(len(h), dtype=np.uint64) + np.uint64(1))
            d1.append(int(mix(h + place).sum(dtype=np.uint64).view(np.int64)))
            d2.append(int(mix((h ^ _SECOND) * np.uint64(5) + place).sum(dtype=np.uint64).view(np.int64)))
            sha.append(hashlib.sha256(b" ".join(data[offsets[i]:offsets[i + 1]].tobytes().split())).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(d1, pa.int64()),
             pa.array(d2, pa.int64()), pa.array(sha, pa.string()), _lists(once), _lists(twice)],
            ["doc_id", "row", "n_words", "d1", "d2", "sha", "once", "twice"])


def _windows(batches):
    """(h1, h2, id, repeats): the distinct windows that shared keys anchor."""
    for batch in _slices(batches):
        w = words_of(batch.column("text"))
        starts, at = anchors(w)
        around = chained(w.hash, 2 * MARGIN + LONGEST).view(np.int64)
        keys = around[at - MARGIN] if len(at) else np.zeros(0, np.int64)
        h1, h2 = window_hashes(w.hash)
        cut = np.searchsorted(w.row[starts], np.arange(batch.num_rows + 1)) if len(starts) else np.zeros(batch.num_rows + 1, int)
        for i, (key, shared) in enumerate(zip(batch.column("id"), batch.column("shared"))):
            a, b = cut[i], cut[i + 1]
            own = starts[a:b][np.isin(keys[a:b], shared.values.to_numpy(zero_copy_only=False))]
            if not len(own):
                continue
            pairs, counts = np.unique(np.stack([h1[own], h2[own]], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array([key.as_py()] * len(pairs), pa.int64()), pa.array(np.minimum(counts, 2).astype(np.int64))],
                ["h1", "h2", "id", "copies"])


def _cut(batches):
    """Removes the words of repeated windows: all of them where `whole` is set."""
    for batch in _slices(batches):
        w = words_of(batch.column("text"))
        h1, _ = window_hashes(w.hash)
        removed, texts = [], []
        for i, gone in enumerate(batch.column("gone")):
            a, b = int(w.first[i]), int(w.first[i + 1])
            keep = np.ones(b - a, bool)
            if b - a >= WINDOW and gone.is_valid:
                hit = np.isin(h1[a:b - WINDOW + 1], gone.values.to_numpy(zero_copy_only=False))
                edge = np.zeros(b - a + 1, np.int32)
                edge[:len(hit)] += hit
                edge[WINDOW:WINDOW + len(hit)] -= hit
                keep = np.cumsum(edge[:b - a]) == 0
            words = (batch.column("text")[i].as_py() or "").encode().split()
            removed.append(int((~keep).sum()))
            texts.append(b" ".join(compress(words, keep)).decode())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["id", "n_removed", "kept_text"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, row, n_words, n_removed, kept_text, kept_sha256.

    kept_text holds the kept words joined by one space for every text that lost some; it is null for unchanged
    texts, which are not moved. kept_sha256 is of the kept words joined by one space, for all.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.row_key(C.whole_text()).alias("row"), C.whole_text().alias("text"))
    keyed = base.mapInArrow(_keys, "doc_id long, row long, n_words long, d1 long, d2 long, sha string, once array<long>, twice array<long>")
    keyed = C.stored(keyed.withColumn("id", F.monotonically_increasing_id()), "keys")
    copies = C.stored(keyed.groupBy("n_words", "d1", "d2").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "copies")
    firsts = copies.where(F.col("n_words") >= WINDOW).select(F.col("first").alias("id"))
    lone = keyed.join(firsts, "id", "left_semi").select("id", "doc_id", "row", "once", "twice")
    held = C.stored(lone.select("id", "doc_id", "row", F.explode("once").alias("key"), F.lit(1).alias("times")).unionByName(
        lone.select("id", "doc_id", "row", F.explode("twice").alias("key"), F.lit(2).alias("times"))), "held")
    common = held.groupBy("key").agg(F.sum("times").alias("times")).where("times > 1").select("key")
    shared = held.join(common, "key").groupBy("id", "doc_id", "row").agg(F.collect_list("key").alias("shared"))
    # rows that repeat a doc_id with the same text have collapsed, so doc_id and row find one text
    texts = base.where(F.col("doc_id").isNotNull()).join(shared.where(F.col("doc_id").isNotNull()), ["doc_id", "row"])
    unnamed = base.where(F.col("doc_id").isNull()).drop("doc_id").join(shared.where(F.col("doc_id").isNull()).drop("doc_id"), "row")
    texts = texts.select("id", "text", "shared").unionByName(unnamed.select("id", "text", "shared"))
    texts = C.stored(texts, "texts")
    windows = C.stored(texts.mapInArrow(_windows, "h1 long, h2 long, id long, copies long"), "windows")
    repeated = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("copies")).where("copies > 1").select("h1", "h2")
    gone = windows.join(repeated, ["h1", "h2"]).groupBy("id").agg(F.collect_set("h1").alias("gone"))
    cut = texts.select("id", "text").join(gone, "id").dropDuplicates(["id"]).mapInArrow(_cut, "id long, n_removed long, kept_text string")
    cut = C.stored(cut, "cut")
    whole = F.col("copies").isNotNull()
    many = copies.where((F.col("copies") > 1) & (F.col("n_words") >= WINDOW))
    out = keyed.select("id", "doc_id", "row", "n_words", "d1", "d2", "sha").join(many, ["n_words", "d1", "d2"], "left").join(cut, "id", "left")
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(whole, F.lit("")).otherwise(F.when(F.col("n_removed") > 0, F.col("kept_text")))
    return out.select("doc_id", "row", "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_text"),
                      F.coalesce(F.sha2(kept, 256), F.col("sha")).alias("kept_sha256"))
