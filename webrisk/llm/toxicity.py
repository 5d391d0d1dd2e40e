"""Toxicity scores over deobfuscated text.

1. A character language model is counted over all texts of the corpus: trigrams over the letters of Western European
   languages and the corpus' most frequent other letters, LETTERS in all.
2. Noisy channel: tokens with leetspeak, letters spaced out, or letters repeated three times and more become
   lattices: each run of a sign can stand for itself, for the letters it imitates, or for one or two copies. Viterbi
   takes the path that the channel and the language model together find likeliest. Signs outside the channel (other
   letters, separators) stay as they are; the stretches between them are decoded apart.
3. Restored texts are described by their short words and word beginnings (hashed, presence only). All features that speak
   clearly for the label are weighed by a sparse logistic regression, fitted with Spark ML on at most TRAIN_ROWS labelled rows.

Whole texts are decoded and scored; only the fit is bounded. Defined results: null and empty texts are scored from
the intercept alone; rows that repeat a doc_id are scored one by one; repeated labels of a document count as the
largest; rows without doc_id are scored and never trained on; without labels of both kinds, or without a clear feature, every
score is the share of toxic labels, or 0; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrisk.llm import columns as C
from webrisk.llm.near_dedup import _lists
from webrisk.llm.wordhash import _BYTE, Words, _powers, mix, text_bytes, words_of

#: Bound of the labelled rows that the classifier is fitted on.
TRAIN_ROWS = 20_000
#: Hash buckets of the features: a few times the number of word beginnings, so that few share one.
DIMENSIONS = 1 << 20
#: Toxic rows of a feature, and standard deviations by which they must exceed their expected number: about the level at which
#: one of a million features passes by chance. All that pass are weighed.
LEAST_ROWS, LEAST_EXCESS = 5, 5.0
PENALTY = 3e-4
BEGINNINGS = (3, 4, 5, 6)
#: Start of the language model's alphabet: word edge, any other sign, and the letters of Western European languages.
ALPHABET = "\x00\x01abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
#: Signs of the alphabet at most; its trigram table is this to the third.
LETTERS = 128
#: Signs and the letters they imitate.
LEET = {
    "0": "oо", "1": "il", "2": "z", "3": "eзе", "4": "aча", "5": "s", "6": "gб", "7": "t", "8": "b", "9": "g",
    "@": "aа", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "",
}
#: Costs in nats: reading a sign as a letter, dropping a sign inside a word, keeping a letter twice, a sign as itself.
COST_LEET, COST_DROP, COST_TWICE, COST_SELF = 1.0, 4.0, 1.5, 2.0
_SPACED = re.compile(r"\S(?:[ .\-_*]\S)+")
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SIGNS, _GAPS = np.zeros(256, bool), np.zeros(256, bool)
_SIGNS[[ord(c) for c in LEET if ord(c) < 0x80]] = True
_GAPS[[ord(c) for c in ".-_*"]] = True
#: Signs that the channel puts into words.
_CHANNEL = frozenset(LEET) | frozenset(".-_* ")


@dataclass
class LanguageModel:
    """log P(third | first two) over the alphabet."""

    alphabet: str
    logs: np.ndarray

    def __post_init__(self):
        self.code = {c: i for i, c in enumerate(self.alphabet)}
        # letters that aren't doubled: the channel has one reading for each
        self.plain = re.compile(f"(?:([{re.escape(self.alphabet[2:])}])(?!\\1))+")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _count_letters(batches):
    """Per task one batch: counts of the letters outside ALPHABET."""
    total: dict[int, int] = {}
    for batch in batches:
        for text in batch.column(0).to_pylist():
            points = _points(text or "")
            for c, n in zip(*np.unique(points[points >= 0x80], return_counts=True)):
                total[int(c)] = total.get(int(c), 0) + int(n)
    found = [c for c in total if chr(c).isalpha() and chr(c) not in ALPHABET]
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([total[c] for c in found], pa.int64())], ["letter", "n"])


def corpus_alphabet(docs: DataFrame) -> str:
    """ALPHABET and the most frequent other letters of the texts."""
    rows = (docs.select(F.lower(C.whole_text()).alias("text")).mapInArrow(_count_letters, "letter long, n long").groupBy("letter")
            .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "letter").limit(LETTERS - len(ALPHABET)).collect())
    return ALPHABET + "".join(chr(r.letter) for r in rows)


def _count_trigrams(alphabet: str, batches):
    """Per task one batch: counts of the trigrams of its words, edges included."""
    a = len(alphabet)
    total = np.zeros(a ** 3, np.int64)
    table = np.ones(max(map(ord, alphabet)) + 2, np.int64)
    table[[ord(c) for c in alphabet[2:]]] = np.arange(2, a)
    table[[0x20, *range(0x09, 0x0E)]] = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            codes = table[np.minimum(_points(" " + (text or "") + " "), len(table) - 1)]
            codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
            if len(codes) > 2:
                grams, n = np.unique((codes[:-2] * a + codes[1:-1]) * a + codes[2:], return_counts=True)
                total[grams] += n
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])


def language_model(docs: DataFrame) -> LanguageModel:
    """Counted over all texts; its size is bounded by LETTERS."""
    alphabet = corpus_alphabet(docs)
    a = len(alphabet)
    grams = docs.select(F.lower(C.whole_text()).alias("text")).mapInArrow(partial(_count_trigrams, alphabet), "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros(a ** 3)
    counts[grams.column("gram").to_numpy()] = grams.column("n").to_numpy()
    counts = counts.reshape(a, a, a)
    pairs, single = counts.sum(0), counts.sum((0, 1))
    one = (single + 1) / (single.sum() + a)
    two = (pairs + 20 * one) / (pairs.sum(1, keepdims=True) + 20)
    three = (counts + 20 * two[None]) / (counts.sum(2, keepdims=True) + 20)
    return LanguageModel(alphabet, np.log(three).astype(np.float32))


def decode(token: str, lm: LanguageModel) -> str:
    """One obfuscated token with the stretches between signs outside the channel decoded."""
    stretches = groupby(token, lambda c: c in lm.code or c in _CHANNEL)
    return "".join(_decode("".join(signs), lm) if inside else "".join(signs) for inside, signs in stretches)


def _decode(token: str, model: LanguageModel) -> str:
    """Likeliest spelling of one stretch, by Viterbi over (previous two letters).

    A state keeps a pointer to its predecessor. Where only one state is left its path is settled and forgotten, so time is
    linear in the stretch and memory holds what is still undecided.
    """
    code, lm = model.code, model.logs
    said: list[str] = []
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    at = 0
    while at < len(token):
        if len(states) == 1:
            ((p, q), (_, node)), = states.items()
            said += _path(node)
            plain = model.plain.match(token, at)
            if plain:
                # letters that can only be themselves
                at = plain.end()
                said.append(plain[0])
                last = [code[c] for c in plain[0][-2:]]
                p, q = (last[0], last[1]) if len(last) == 2 else (q, last[0])
            states = {(p, q): (0.0, None)}
            if plain:
                continue
        sign, end = token[at], at + 1
        while end < len(token) and token[end] == sign:
            end += 1
        options: list[tuple[str, float]] = []
        if sign in code:
            options.append((sign, 0.0))
            if end - at > 1:
                options.append((sign * 2, COST_TWICE if end - at > 2 else 0.0))
        for letter in LEET.get(sign, ""):
            if letter in code:
                options.append((letter, COST_LEET))
                if end - at > 1:
                    options.append((letter * 2, COST_LEET + COST_TWICE))
        if sign not in code:
            options.append(("", COST_DROP if sign.isalnum() else 0.5))
            options.append((token[at:end], COST_SELF))
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (p, q), (cost, node) in states.items():
            for letters, extra in options:
                c, x, y = cost + extra, p, q
                for letter in letters:
                    z = code.get(letter, 1)
                    c -= float(lm[x, y, z])
                    x, y = y, z
                best = after.get((x, y))
                if best is None or c < best[0]:
                    after[x, y] = (c, (node, letters))
        states, at = after, end
    _, node = min(((cost - float(lm[p, q, 0]), node) for (p, q), (cost, node) in states.items()), key=lambda found: found[0])
    return "".join(said + _path(node))


def _path(node: tuple | None) -> list[str]:
    found = []
    while node is not None:
        node, letters = node
        found.append(letters)
    return found[::-1]


class Restorer:
    """Restores texts with a bounded memory of decoded tokens."""

    def __init__(self, lm: LanguageModel, remember: int = 100_000):
        self.lm, self.remember, self.known = lm, remember, {}

    def token(self, token: str) -> str:
        said = self.known.get(token)
        if said is None:
            bare = re.sub(r"(?<=.)[ .\-_*](?=.)", "", token) if _SPACED.fullmatch(token) else token
            said = decode(bare.rstrip(".,;:!?"), self.lm)
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[token] = said
        return said

    def __call__(self, column: pa.Array) -> pa.Array:
        """Lower-cased texts with every suspect token decoded."""
        column = pc.utf8_lower(column.fill_null("").cast(pa.large_string()))
        w = words_of(column)
        first, last = suspects(w)
        rows = w.row[first]
        data, offsets = text_bytes(column)
        out, cut = [], np.searchsorted(rows, np.arange(len(column) + 1))
        raw = data.tobytes()
        for i in range(len(column)):
            at, pieces = int(offsets[i]), []
            for k in range(cut[i], cut[i + 1]):
                a, b = int(w.start[first[k]]), int(w.end[last[k]])
                pieces += [raw[at:a], self.token(raw[a:b].decode()).encode()]
                at = b
            pieces.append(raw[at:int(offsets[i + 1])])
            out.append(b"".join(pieces))
        return pa.array(out, pa.large_binary()).cast(pa.large_string())


def suspects(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of every stretch to decode: signs among letters, repetition, spacing."""
    d, n = w.data, len(w.data)

    def held(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[w.end] - sums[w.start]

    thrice = np.zeros(n, bool)
    thrice[:-2] = (d[:-2] == d[1:-1]) & (d[1:-1] == d[2:]) & _LETTERS[d[:-2]]
    thrice[:-5] |= (d[:-5] >= 0xC0) & (d[:-5] == d[2:-3]) & (d[:-5] == d[4:-1]) & (d[1:-4] == d[3:-2]) & (d[1:-4] == d[5:])
    length = w.end - w.start
    letters = held(_LETTERS[d])
    alone = (letters > 0) & (held(_SIGNS[d]) > 0) | (held(thrice) > 0) | ((length >= 5) & (held(_GAPS[d]) * 2 + 1 == held(d < 0x80) + held(d >= 0xC0)))
    single = held((d < 0x80) | (d >= 0xC0)) == 1
    single &= _LETTERS[d[w.start]] | _SIGNS[d[w.start]] if n else single
    new = np.ones(len(single), bool)
    new[1:] = ~(single[1:] & single[:-1] & (w.row[1:] == w.row[:-1]) & (w.start[1:] == w.end[:-1] + 1))
    group = np.flatnonzero(new)
    last = np.r_[group[1:], len(single)][:len(group)] - 1
    spaced = (last - group >= 2)
    keep = spaced | alone[group] if len(group) else spaced
    return group[keep], last[keep]


def features(column: pa.Array) -> list[np.ndarray]:
    """Per text the distinct buckets of its short words and of its word beginnings (lengths in bytes)."""
    w = words_of(column, _LETTERS)
    length = w.end - w.start
    short = length <= BEGINNINGS[-1]
    rows, buckets = [w.row[short]], [w.hash[short]]
    for n in BEGINNINGS:
        at = np.flatnonzero(length >= n)
        h = np.zeros(len(at), np.uint64)
        up, _ = _powers(1 << 21)
        for i in range(n):
            h += _BYTE[w.data[w.start[at] + i]] * up[i]
        rows.append(w.row[at])
        buckets.append(mix(h + np.uint64(n * 7919)))
    row = np.concatenate(rows)
    bucket = (np.concatenate(buckets) >> np.uint64(20)).astype(np.int64) & (DIMENSIONS - 1)
    packed = np.unique(row * DIMENSIONS + bucket)
    cut = np.searchsorted(packed, np.arange(len(column) + 1) * DIMENSIONS)
    return [packed[a:b] & (DIMENSIONS - 1) for a, b in zip(cut, cut[1:])]


def _restored(lm: LanguageModel, batches, rows: int = 512):
    """(batch, restored texts) in slices."""
    restore = Restorer(lm)
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            yield batch, restore(batch.column("text"))


@dataclass
class ToxicityModel:
    lm: LanguageModel
    weights: np.ndarray
    intercept: float


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """labels: doc_id, toxic; at most train_rows of them are used, chosen by hash."""
    lm = language_model(docs)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("label"))
    parts = max(1, -(-known.count() // train_rows))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")

    def described(batches):
        for batch, restored in _restored(lm, batches):
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.float64()), _lists(features(restored))], ["label", "buckets"])

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    rows = C.stored(texts.mapInArrow(described, "label double, buckets array<long>"), "toxic-train")
    total, toxic = rows.agg(F.count("*"), F.sum("label")).first()
    if not toxic or toxic == total:
        share = (toxic or 0) / total if total else 0.0
        return ToxicityModel(lm, np.zeros(DIMENSIONS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    # how far a feature's toxic rows exceed their expected number, in standard deviations
    base, n = toxic / total, F.count("*")
    clear = (rows.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket")
             .agg(((F.sum("label") - n * base) / F.sqrt(n * base * (1 - base))).alias("z"), F.sum("label").alias("n"))
             .where((F.col("z") >= LEAST_EXCESS) & (F.col("n") >= LEAST_ROWS)).select("bucket").toArrow())
    names = np.sort(clear.column("bucket").to_numpy())
    if not len(names):
        return ToxicityModel(lm, np.zeros(DIMENSIONS, np.float32), float(np.log(base / (1 - base))))

    def vector(buckets):
        at = np.searchsorted(names, buckets)
        at = at[names[np.minimum(at, len(names) - 1)] == buckets]
        return Vectors.sparse(len(names), at, np.ones(len(at)))

    # half way to equal totals of both kinds: features that are toxic in every second row don't decide alone
    weight = F.when(F.col("label") > 0, F.lit(((total - toxic) / toxic) ** 0.5)).otherwise(1.0)
    # few partitions: each sends a gradient as long as the features in every round
    fitted = LogisticRegression(maxIter=100, regParam=PENALTY, standardization=False, weightCol="weight").fit(
        rows.coalesce(4).select("label", weight.alias("weight"), F.udf(vector, VectorUDT())("buckets").alias("features")))
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[names] = fitted.coefficients.toArray()
    return ToxicityModel(lm, weights, float(fitted.intercept))


def score_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; a column of that name is replaced."""
    lm, weights, intercept = model.lm, model.weights, model.intercept
    schema = docs.drop(column).schema.add(column, "double")

    def run(batches):
        for batch, restored in _restored(lm, batches):
            scores = [1 / (1 + np.exp(-np.clip(intercept + float(weights[f].sum()), -30, 30))) for f in features(restored)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:-1]), pa.array(scores, pa.float64())], schema.names)

    return docs.drop(column).mapInArrow(run, schema)

