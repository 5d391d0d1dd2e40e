"""Phrase collocations from weighted acyclic automata of n-grams.

A word of a language is a 64-bit symbol. Every task sorts the n-grams of a few million words and builds a count transducer
of them: states are shared prefixes, arcs carry symbols, the last arcs carry counts (`Transducer`). It is written as one
piece per prefix range. The pieces of a range meet in one task, which unites them as they come and sums the weights; arcs below the
support go. Parts of a candidate (its first k words, its rest) are looked up by composing the candidates with the united
transducers: an equi-join of arcs on the path of the part, which Spark spreads and splits like any join.

Longer n-grams are only built where all shorter parts can have the support: bitmaps of fixed size (2 ** FILTER_BITS
bits) of the frequent words and pairs go to the tasks. A full bitmap filters less and loses nothing.
Prefixes that hold more than one range's share of the corpus (so there are fewer of them than ranges) are split by
their next word, so no range depends on one word or pair.

Defined results: null texts are empty, a null language is `und`; rows without doc_id and repeated rows count like all others; a
language with fewer candidates gives fewer rows; an empty table gives an empty result; other columns are not read.
Words are bytes: anything but the breaks `.,;:!?`, line ends, space and tab. Symbols are checked to be distinct over all
words of the corpus; otherwise the next seed is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrisk.llm import columns as C
from webrisk.llm.wordhash import mix, text_bytes

FILTER_BITS = 25
#: Bytes of text worked on at once, and n-grams of one shard.
SLICE, SHARD = 1 << 22, 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Pieces:
    """Words of some texts: symbol, byte range in `data`, language, and whether the next word follows in the same piece."""

    data: np.ndarray
    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lang: np.ndarray
    joined: np.ndarray


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, languages) in runs of about SLICE bytes; one text is never cut."""
    texts = batch.column(0).fill_null("").cast(pa.large_string())
    sizes = np.cumsum(np.asarray(pc.binary_length(texts)))
    lo = 0
    while lo < len(texts):
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + SLICE, "right")))
        yield texts.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
        lo = hi


def _symbol(data: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=seed.to_bytes(16, "little")).digest(), "little")


def symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray, lang: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit symbol per word, from its bytes taken eight at a time, and its language's symbol."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    key = np.uint64(_symbol(b"", seed))
    code = mix((eight[start] & _MASKS[np.minimum(size, 8)]) ^ key)
    rest = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(rest):
        chunk = eight[start[rest] + at] & _MASKS[np.minimum(size[rest] - at, 8)]
        code[rest] = mix(code[rest] * _ODD + chunk)
        at += 8
        rest = rest[size[rest] > at]
    for i in np.flatnonzero(size > LONG):
        code[i] = _symbol(data[start[i]:end[i]].tobytes(), seed)
    return mix(code + size.astype(np.uint64) * _ODD + lang)


def pieces_of(texts: pa.Array, langs: pa.Array, seed: int) -> Pieces:
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    named = langs.fill_null("und").dictionary_encode()
    marks = np.array([_symbol(x.encode(), seed) for x in named.dictionary.to_pylist()], np.uint64)
    lang = np.asarray(named.indices)[row] if len(row) else np.zeros(0, np.int32)
    piece = np.searchsorted(np.flatnonzero(_BREAK[data]), start)
    joined = np.zeros(len(start), bool)
    joined[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
    code = symbols(data, start, end, marks[lang] if len(row) else np.zeros(0, np.uint64), seed)
    return Pieces(data, code, start, end, lang, joined)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    body = data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(body)).cast(pa.string())


def _words(seed: int):
    def run(batches):
        for batch in batches:
            for texts, langs in _slices(batch):
                p = pieces_of(texts, langs, seed)
                if not len(p.code):
                    continue
                order = np.argsort(p.code, kind="stable")
                code, size = p.code[order], (p.end - p.start)[order]
                first = p.data[p.start[order]]
                # words that share a symbol by chance stay apart where their size or first byte tells them apart
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (size[1:] != size[:-1]) | (first[1:] != first[:-1])
                at = np.flatnonzero(new)
                kept = order[at]
                names = langs.fill_null("und").dictionary_encode().dictionary.cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(p.lang[kept])), _strings(p.data, p.start[kept], p.end[kept]), pa.array(p.code[kept].view(np.int64)),
                     pa.array(np.diff(at, append=len(code)).astype(np.int64))], ["lang", "word", "code", "f"])

    return run


class Transducer:
    """Weighted deterministic acyclic automaton over sequences of `depth` symbols, built from sorted n-grams.

    Level i holds the symbols on its arcs in order and how many arcs leave the state each leads to; the last level's arcs
    carry the counts. Sequences with a common beginning share its arcs.
    """

    def __init__(self, labels: list[np.ndarray], fans: list[np.ndarray], weights: np.ndarray):
        self.labels, self.fans, self.weights = labels, fans, weights

    @classmethod
    def build(cls, keys: list[np.ndarray], weights: np.ndarray) -> Transducer:
        """Of n-grams in any order: sorted, equal ones merged with their weights summed."""
        order = np.lexsort(keys[::-1])
        keys, weights = [k[order] for k in keys], weights[order]
        labels, fans, new = [], [], np.zeros(len(weights), bool)
        new[:1] = True
        starts = []
        for k in keys:
            new = new.copy()
            new[1:] |= k[1:] != k[:-1]
            starts.append(np.flatnonzero(new))
            labels.append(k[starts[-1]])
        for upper, lower in zip(starts, starts[1:], strict=False):
            fans.append(np.diff(np.searchsorted(lower, upper), append=len(lower)).astype(np.int32))
        summed = np.add.reduceat(weights, starts[-1]) if len(weights) else weights
        return cls(labels, fans, summed)

    def paths(self) -> list[np.ndarray]:
        """The n-grams, one array per position."""
        keys = list(self.labels)
        for level in range(len(keys) - 1):
            for above in range(level + 1):
                keys[above] = np.repeat(keys[above], self.fans[level])
        return keys

    @classmethod
    def union(cls, parts: list[Transducer]) -> Transducer:
        paths = [p.paths() for p in parts]
        return cls.build([np.concatenate(k) for k in zip(*paths, strict=True)], np.concatenate([p.weights for p in parts]))

    def at_least(self, support: int) -> tuple[list[np.ndarray], np.ndarray]:
        keep = self.weights >= support
        return [k[keep] for k in self.paths()], self.weights[keep]

    def dump(self) -> bytes:
        sizes = np.array([len(self.labels), *(len(x) for x in self.labels)], np.int64)
        return b"".join(x.tobytes() for x in (sizes, *self.labels, *self.fans, self.weights.astype(np.int64)))

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        depth = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, depth, 8)
        at, labels, fans = 8 + 8 * depth, [], []
        for n in sizes:
            labels.append(np.frombuffer(data, np.uint64, n, at))
            at += 8 * int(n)
        for n in sizes[:-1]:
            fans.append(np.frombuffer(data, np.int32, n, at))
            at += 4 * int(n)
        return cls(labels, fans, np.frombuffer(data, np.int64, int(sizes[-1]), at))


def pair_symbol(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _ODD + b)


def _among(values: np.ndarray, few: np.ndarray) -> np.ndarray:
    few = np.sort(few)
    at = np.searchsorted(few, values)
    return few[np.minimum(at, len(few) - 1)] == values if len(few) else np.zeros(len(values), bool)


def _pair_symbols(batches):
    for b in batches:
        first, second = (np.asarray(b.column(i)).view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(pair_symbol(first, second).view(np.int64)), b.column(2)], ["code", "f"])


def _range(keys: list[np.ndarray], hot: list[np.ndarray], bits: int) -> np.ndarray:
    """Prefix range of each n-gram: the leading bits of its first symbol; hot prefixes go by one more symbol each."""
    at, prefix, split = keys[0], keys[0], np.ones(len(keys[0]), bool)
    for heavy, symbol in zip(hot, keys[1:], strict=False):
        split = split & _among(prefix, heavy)
        prefix = pair_symbol(prefix, symbol)
        at = np.where(split, mix(prefix), at)
    return (at >> np.uint64(64 - bits)).astype(np.int32)


def _passes(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    at = (code >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _shards(seed: int, depth: int, filters: list, hot: list[np.ndarray], bits: int):
    def flush(held):
        keys = [np.concatenate(k) for k in zip(*held, strict=True)]
        where = _range(keys, hot, bits)
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange((1 << bits) + 1))
        names, blobs = [], []
        for r in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[r]:cuts[r + 1]]
            names.append(int(r))
            blobs.append(Transducer.build([k[mine] for k in keys], np.ones(len(mine), np.int64)).dump())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["range", "part"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for texts, langs in _slices(batch):
                p = pieces_of(texts, langs, seed)
                known = _passes(filters[0].value, p.code)
                pair = np.flatnonzero(known[:-1] & known[1:] & p.joined[:-1])
                a, b = p.code[pair], p.code[pair + 1]
                if depth == 2:
                    keys = [a, b]
                else:
                    good = _passes(filters[1].value, pair_symbol(a, b))
                    pair = pair[good]
                    follow = np.flatnonzero(pair[1:] == pair[:-1] + 1)
                    keys = [p.code[pair[follow] + i] for i in range(3)]
                held.append(keys)
                n += len(keys[0])
                if n >= SHARD:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    return run


def _unite(depth: int, support: int):
    def run(batches):
        current, parts, arcs = None, [], 0

        def close():
            keys, weights = Transducer.union(parts).at_least(support)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(k.view(np.int64)) for k in keys), pa.array(weights)], [*(f"c{i + 1}" for i in range(depth)), "f"])

        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != current and parts:
                    yield close()
                    parts, arcs = [], 0
                current = name
                parts.append(Transducer.load(part.as_py()))
                arcs += len(parts[-1].weights)
                if arcs > 2 * SHARD and len(parts) > 1:
                    parts = [Transducer.union(parts)]
                    arcs = len(parts[0].weights)
        if parts:
            yield close()

    return run


def _bitmap(codes: DataFrame) -> np.ndarray:
    """The bitmap of a column `code`, put together in Spark in parts of 32768 bits."""
    at = F.expr(f"shiftrightunsigned(code, {64 - FILTER_BITS})")
    parts = codes.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).toArrow()
    out = np.zeros((1 << FILTER_BITS) >> 3, np.uint8)
    for part, bits in zip(parts["part"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        out[part * 4096:(part + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _codes(df: DataFrame) -> np.ndarray:
    found = df.toArrow()
    return np.asarray(found.column(0).combine_chunks()).astype(np.int64).view(np.uint64)


def count_words(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, code, f) of all words, and the seed with which their codes are distinct."""
    for seed in range(64):
        rows = docs.select("text", "lang").mapInArrow(_words(seed), "lang string, word string, code long, f long")
        words = C.stored(rows.groupBy("lang", "word", "code").agg(F.sum("f").alias("f")), "words")
        if not words.groupBy("code").count().where("count > 1").limit(1).count():
            return words, seed
    raise ValueError("words without distinct symbols under any seed")


def count_ngrams(docs: DataFrame, depth: int, seed: int, support: int, filters: list, hot: list[np.ndarray], bits: int) -> DataFrame:
    """(c1 … c_depth, f) of all n-grams of this length with at least the support."""
    parts = docs.select("text", "lang").mapInArrow(_shards(seed, depth, filters, hot, bits), "range int, part binary")
    schema = "".join(f"c{i + 1} long, " for i in range(depth)) + "f long"
    united = parts.repartition("range").sortWithinPartitions("range").mapInArrow(_unite(depth, support), schema)
    return C.stored(united, f"ngrams{depth}")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in exact decimals; counts may have 16 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    top = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, support: int = 10, contained_percent: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of two and three words, by score, a and phrase.

    A phrase goes when a longer candidate around it has at least `contained_percent` of its occurrences.
    Without `top` all candidates are returned, unranked.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bits = max(2, (4 * tasks - 1).bit_length())
    every, seed = count_words(docs)
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = C.stored(every.where(F.col("f") >= support), "frequent")
    heavy = (words.agg(F.sum("f")).first()[0] or 0) >> bits

    filters = [spark.sparkContext.broadcast(_bitmap(words.select("code")))]
    hot = [_codes(words.where(F.col("f") > heavy).select("code"))]
    pairs = count_ngrams(docs, 2, seed, support, filters, hot, bits)

    named = pairs.select("c1", "c2", "f").mapInArrow(_pair_symbols, "code long, f long")
    filters.append(spark.sparkContext.broadcast(_bitmap(named.select("code"))))
    hot.append(_codes(named.where(F.col("f") > heavy).select("code")))
    triples = count_ngrams(docs, 3, seed, support, filters, hot, bits)

    # composition: the parts of every candidate are paths of the united transducers
    one = lambda i: words.select(F.col("code").alias(f"c{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"), *(["lang"] if i == 1 else []))
    two = C.stored(pairs.withColumnRenamed("f", "a").join(one(1), "c1").join(one(2), "c2"), "pairs")
    head = two.select("lang", "c1", "c2", "w1", "w2", F.col("f1"), F.col("a").alias("f12"))
    tail = two.select(F.col("c1").alias("c2"), F.col("c2").alias("c3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    three = C.stored(triples.withColumnRenamed("f", "a").join(head, ["c1", "c2"]).join(tail, ["c2", "c3"]), "triples")

    longer = three.select("c1", "c2", "a").union(three.select("c2", "c3", "a")).groupBy("c1", "c2").agg(F.max("a").alias("most"))
    free = two.join(longer, ["c1", "c2"], "left").where(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * contained_percent))
    short = free.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                        _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    early, late = _score(F.col("a"), F.col("f1"), F.col("f23")), _score(F.col("a"), F.col("f12"), F.col("f3"))
    cut = F.when(early <= late, F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), early.alias("score"))).otherwise(
        F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), late.alias("score")))
    long = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.*")
    found = short.unionByName(long)
    if top is not None:
        found = _ranked(found, top, tasks)
    else:
        found = found.withColumn("rank", F.lit(None).cast("long"))
    return found.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(found: DataFrame, top: int, tasks: int) -> DataFrame:
    """The first `top` of each language: in as many parts as tasks, then fewer, so that no task sees a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = found.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(tasks)))
    for parts in (tasks, int(tasks ** 0.5) + 1, 1):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.col("deal") % parts).orderBy(*order)).cast("long"))
        found = found.where(F.col("rank") <= top)
    return found.drop("deal")
