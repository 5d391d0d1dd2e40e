"""Sentencepiece encoding and decoding with a relational lattice.

The vocabulary is BPE with byte fallback: its pieces carry merge priorities, not probabilities. The path of largest score sum
would not be the library's, so the fold takes the edge of best priority whose two halves stand, again and again, instead
of the best sum.

1. Texts are cut into words: runs of the blank sign with the signs after it. No piece crosses a word's edge.
2. The frequent words of the corpus (at most SENT_WORDS, of up to MASK signs) are exploded into substrings of bounded length,
   which meet the piece table; the edges are grouped by word and folded with `aggregate`. The state is the set of
   places where the word is cut, as bits of a long, with the edges that can still be taken.
3. The table of cuts, of bounded size, is sent to all tasks, which map texts to ids. Rare words are not worth a
   shuffle (it would move one row per text and rare word, several times the text): each task cuts those it meets where no
   piece can cross, takes frequent parts from the table and merges the rest.

Decoding maps ids to pieces, byte pieces to bytes, and blanks back. It returns the text itself unless that holds
the blank sign, which comes back as a space.

Defined results: null and empty texts have no ids and decode to the empty text; rows that repeat a doc_id are encoded
one by one; an empty table gives an empty result; columns other than the text are passed on.
"""

from __future__ import annotations

import heapq
import os
import re
import uuid
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrisk.llm import columns as C

BLANK = "▁"
#: Words of the table sent to all tasks (about 30 bytes each), and signs of a word that it may hold.
SENT_WORDS = 200_000
MASK = 60
#: A task reports words that it has met this often among FLUSH different ones; less frequent ones don't reach the table anyway.
REPORTED, FLUSH = 4, 300_000
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
_MODELS: dict[str, "Pieces"] = {}
#: The table of a worker, kept over its tasks: (broadcast, words with ids)
_SENT: dict[tuple, "_Ids"] = {}


class Pieces:
    """The vocabulary of a sentencepiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.bytes = np.zeros(256, np.int64)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.surface: list[bytes] = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[value] = i
                self.surface[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.surface[i] = piece.replace(BLANK, " ").encode()
        self.longest = max(map(len, self.ids))
        #: pairs of signs that stand side by side in some piece
        self.inner = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}

    def segments(self, word: str) -> list[str]:
        """The word cut where no piece holds the two signs side by side: no merge crosses such a place."""
        inner = self.inner
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in inner]
        return [word[x:y] for x, y in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]

    def merge(self, text: str) -> list[str]:
        """Merges by score, leftmost first."""
        if len(text) > MASK:
            return self._merge_long(text)
        get, none = self.scores.get, -np.inf
        parts = list(text)
        rated = [get(text[i:i + 2], none) for i in range(len(text) - 1)]
        while rated and (best := max(rated)) > none:
            i = rated.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del rated[i]
            if i:
                rated[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(rated):
                rated[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same over a heap of neighbouring parts, for long texts."""
        n = len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        part: list[str | None] = list(text)
        scores = self.scores
        heap = [(-scores[text[i:i + 2]], i, text[i:i + 2]) for i in range(n - 1) if text[i:i + 2] in scores]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or part[i] + part[j] != whole:
                continue
            part[i], part[j] = whole, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (both := whole + part[k]) in scores:
                    heapq.heappush(heap, (-scores[both], i, both))
            if (h := before[i]) >= 0 and (both := part[h] + whole) in scores:
                heapq.heappush(heap, (-scores[both], h, both))
        return [p for p in part if p is not None]

    def numbers(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            found = self.ids.get(p)
            if found is None:
                out.extend(self.bytes[list(p.encode("utf-8", "replace"))].tolist())
            else:
                out.append(found)
        return out


def vocabulary(path: str) -> Pieces:
    key = os.path.abspath(path)
    if key not in _MODELS:
        _MODELS[key] = Pieces(path)
    return _MODELS[key]


def _spelled(text: str) -> str:
    """Blanks made visible, one put in front."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def _words(text: str) -> list[str]:
    """The words of a text, without the one blank that begins most of them; a word of another form keeps all its blanks."""
    if not text:
        return []
    if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
        return [_bare(w) for w in _WORD.findall(_spelled(text))]
    return text.split(" ")


def _bare(word: str) -> str:
    return word[1:] if word[1:2] not in ("", BLANK) else word


def _whole(word: str) -> str:
    """A word of `_words` with its blanks."""
    return word if word[0] == BLANK else BLANK + word


class _Ids(dict):
    """Word of `_words` → ids: those of the table, and of further words as they are met; with their parts at most FLUSH."""

    def __init__(self, vocab: Pieces, words: list[str], cuts: list[int]):
        super().__init__((_bare(w), vocab.numbers(_parts(w, c))) for w, c in zip(words, cuts))
        self.vocab = vocab
        self.met: list[str] = []
        self.parts: dict[str, list[int]] = {}  # those that no blank begins

    def __missing__(self, word: str) -> list[int]:
        if len(self.met) + len(self.parts) >= FLUSH:
            for w in self.met:
                del self[w]
            self.met.clear()
            self.parts.clear()
        vocab, parts, found = self.vocab, self.parts, []
        for part in vocab.segments(_whole(word)):
            known = self.get(_bare(part)) if part[0] == BLANK else parts.get(part)
            if known is None:
                known = vocab.numbers(vocab.merge(part))
                if part[0] != BLANK:
                    parts[part] = known
                elif (first := _bare(part)) != word:
                    self[first] = known
                    self.met.append(first)
            found += known
        self[word] = found
        self.met.append(word)
        return found


def _word_counts(batches):
    """Words of a task's texts with counts, given out whenever many have gathered."""
    held: Counter = Counter()

    def out():
        often = [(_whole(w), n) for w, n in held.items() if n >= REPORTED and len(w) < MASK]
        table = pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["word", "n"])
        held.clear()
        return table

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(_words(text))
            if len(held) > FLUSH:
                yield out()
    yield out()


def frequent_words(docs: DataFrame, most: int = SENT_WORDS) -> DataFrame:
    counts = docs.select(C.whole_text().alias("text")).mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(most).select("word")


def lattice(words: DataFrame, path: str) -> DataFrame:
    """(word, edges): the substrings of two signs and more that are pieces, best priority first.

    An edge is (cost, i, ends, inside): the bits of its two ends and of the places inside it.
    """
    vocab = vocabulary(path)
    table = F.broadcast(words.sparkSession.createDataFrame([(p, -s) for p, s in vocab.scores.items() if len(p) > 1], "piece string, cost double"))
    size = F.char_length("word")
    spans = (words.where(size <= MASK).select("word", F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
             .where(F.col("i") < size - 1)
             .select("word", "i", F.explode(F.sequence(F.col("i") + 2, F.least(size, F.col("i") + vocab.longest))).alias("j")))
    edges = spans.withColumn("piece", F.substring(F.col("word"), F.col("i") + 1, F.col("j") - F.col("i"))).join(table, "piece")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    edge = F.struct("cost", "i", bit(F.col("i")).bitwiseOR(bit(F.col("j"))).alias("ends"), (bit(F.col("j")) - bit(F.col("i") + 1)).alias("inside"))
    return edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def best_cuts(words: DataFrame, path: str) -> DataFrame:
    """(word, cuts): bit k is set where the word is cut before its sign k. Words without edges are cut everywhere and left out."""
    size = F.char_length("word")
    start = F.struct((F.call_function("shiftleft", F.lit(2).cast("long"), size) - 1).alias("cuts"), F.col("edges").alias("edges"))

    def step(acc, _):
        ready = F.filter(acc["edges"], lambda e: F.bit_count(acc["cuts"].bitwiseAND(e["inside"])) == 1)
        cuts = F.transform(F.array(ready), lambda r: acc["cuts"].bitwiseAND(F.bitwise_not(F.coalesce(F.get(r, F.lit(0))["inside"], F.lit(0).cast("long")))))
        after = F.transform(cuts, lambda c: F.struct(c.alias("cuts"), F.filter(
            acc["edges"], lambda e: (c.bitwiseAND(e["ends"]) == e["ends"]) & (c.bitwiseAND(e["inside"]) != 0)).alias("edges")))
        return F.get(after, F.lit(0))

    fold = F.aggregate(F.sequence(F.lit(1), size), start, step, lambda acc: acc["cuts"])
    return lattice(words, path).select("word", fold.alias("cuts"))


def _parts(word: str, cuts: int) -> list[str]:
    places = [k for k in range(len(word) + 1) if cuts >> k & 1]
    return [word[a:b] for a, b in zip(places, places[1:])]


def encode(docs: DataFrame, path: str, column: str = "text", sent_words: int = SENT_WORDS) -> DataFrame:
    """docs with `ids`, the ids of the text's pieces."""
    spark = docs.sparkSession
    table = best_cuts(frequent_words(docs.select(F.col(column).alias("text")), sent_words), path).toArrow()
    sent = spark.sparkContext.broadcast((table.column("word").to_pylist(), table.column("cuts").to_pylist()))
    schema = docs.drop("ids").schema.add("ids", T.ArrayType(T.IntegerType()))
    names, name = schema.names[:-1], uuid.uuid4().hex

    def run(batches):
        key = (name, os.path.abspath(path))
        if key not in _SENT:
            _SENT.clear()
            _SENT[key] = _Ids(vocabulary(path), *sent.value)
        ids = _SENT[key].__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                flat, ends = array("i"), [0]
                for text in batch.column(column).to_pylist():
                    flat.extend(chain.from_iterable(map(ids, _words(text))))
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists], schema.names)

    return docs.drop("ids").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, column: str = "decoded") -> DataFrame:
    """encoded with the text of its `ids`."""
    schema = encoded.drop(column).schema.add(column, "string")
    names = schema.names[:-1]

    def run(batches):
        vocab = vocabulary(path)
        size = np.array([len(b) for b in vocab.surface], np.int64)
        begin = np.cumsum(size) - size
        signs = np.frombuffer(b"".join(vocab.surface), np.uint8)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch.column("ids").fill_null([])
                ids, lengths = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
                each = size[ids]
                ends = np.cumsum(each)
                raw = signs[np.repeat(begin[ids] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
                cut = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]]
                texts = [raw[x:y].decode("utf-8", "replace")[1:] for x, y in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], schema.names)

    return encoded.drop(column).mapInArrow(run, schema)
