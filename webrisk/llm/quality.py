"""Quality rules: text counts, and tokeniser fertility with rejection bands per language or script, taken from the corpus.

Fertility is measured with a public sentencepiece vocabulary: characters per token, share of byte-fallback tokens and
entropy of the tokens in bits. All three depend on the language and, for short texts, on the length, so the bands are
the quartiles of the corpus' own texts per language and length class, widened by a multiple of the quartile distance.
Where fewer than LEAST_TEXTS different texts speak for a class, the language over all lengths counts, then the script
most characters are written in (by class, then over all lengths), then a fixed wide band. Texts that fail the base rules
and copies (equal measures) don't speak. A class of which a quarter or more is junk widens to hold that junk.

Defined results: null and empty texts have no words, zero counts, fertility 0 and are rejected for length; a null or
unknown language falls back to the script; rows that repeat a doc_id are judged one by one; an empty table gives an
empty result; columns other than doc_id, text and lang are not read. Whole texts are measured.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrisk.llm import columns as C
from webrisk.llm.columns import WHITE
from webrisk.llm.wordhash import chained, text_bytes, words_of

WINDOW = 8
ROWS = 128
#: Words of a text, at least.
LEAST_WORDS = 20


@dataclass(frozen=True)
class Band:
    """Accepted fertility: characters per token from low to high, byte share at most, entropy at least."""

    low: float
    high: float
    bytes_most: float
    entropy_least: float


#: Different texts that a band needs.
LEAST_TEXTS = 50
#: Quartile distances by which a band exceeds the quartiles: characters per token and entropy; byte share.
WIDER, WIDER_BYTES = 2.0, 3.0
#: Least quartile distance: share of the median (characters per token, entropy); byte share.
LEAST_SPREAD, LEAST_SPREAD_BYTES = 0.01, 0.005
#: Wide bands for corpora too small to tell their own.
SCRIPT_BANDS = {
    "latin": Band(1.1, 6.5, 0.15, 2.5), "cyrillic": Band(0.9, 5.0, 0.2, 2.5),
    "east asian": Band(0.3, 2.5, 0.8, 2.5), "other": Band(0.25, 5.0, 0.9, 2.0),
}
#: Upper code point of each range and its script; later ranges are "other".
SCRIPT_RANGES = ((0x024F, "latin"), (0x03FF, "other"), (0x052F, "cyrillic"), (0x2E7F, "other"), (0x9FFF, "east asian"), (0xABFF, "other"), (0xD7AF, "east asian"))
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "chars_per_token double, byte_share double, token_entropy double, script string")

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_LEADING = np.ones(256, np.int64)
_LEADING[0x80:0xC0] = 0
_MODELS: dict[str, tuple] = {}


def _model(path: str):
    if path not in _MODELS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _MODELS[path] = model, np.array([model.is_byte(i) for i in range(model.vocab_size())])
    return _MODELS[path]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(grams: np.ndarray, n: int) -> int:
    """Words of a text in windows that it holds twice or more."""
    if n < WINDOW:
        return 0
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int32)
    edge[:len(grams)] += twice
    edge[WINDOW:WINDOW + len(grams)] -= twice
    return int((np.cumsum(edge[:n]) > 0).sum())


def dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += bool(line.strip(WHITE))
        else:
            seen.add(line)
    return n


def script_of(text: str) -> str:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[points > 0x40]
    if not len(points):
        return "other"
    tops = np.array([top for top, _ in SCRIPT_RANGES], np.uint32)
    counts: dict[str, int] = {}
    for k, c in zip(*np.unique(np.searchsorted(tops, points), return_counts=True)):
        name = SCRIPT_RANGES[k][1] if k < len(SCRIPT_RANGES) else "other"
        counts[name] = counts.get(name, 0) + int(c)
    return max(sorted(counts), key=counts.get)


def _fertility(texts: list[str], model, is_byte) -> np.ndarray:
    out = np.zeros((len(texts), 3))
    for i, ids in enumerate(model.encode(texts, num_threads=1)):
        if ids:
            ids = np.array(ids)
            counts = np.bincount(ids)
            p = counts[counts > 0] / len(ids)
            out[i] = len(texts[i]) / len(ids), is_byte[ids].mean(), abs(float((p * np.log2(p)).sum()))
    return out


def measure(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of docs: the counts and the fertility."""

    def run(batches):
        model, is_byte = _model(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                column = batch.column(1).fill_null("")
                data, offsets = text_bytes(column)
                w = words_of(column)
                grams = chained(w.hash, WINDOW)
                inside = np.zeros(len(data) + 1, np.int64)
                np.add.at(inside, w.start, 1)
                np.add.at(inside, w.end, -1)
                texts = column.to_pylist()
                n = np.diff(w.first)
                repeats = [repeat_words(grams[a:a + k - WINDOW + 1], int(k)) if k >= WINDOW else 0 for a, k in zip(w.first, n)]
                f = _fertility(texts, model, is_byte)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(n.astype(np.int64)),
                    pa.array(_sums(_LEADING[data] * np.cumsum(inside[:-1]), offsets)), pa.array(_sums(_SYMBOL[data], offsets)),
                    pa.array([dup_lines(t) for t in texts], pa.int64()), pa.array(repeats, pa.int64()),
                    pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(f[:, 2]), pa.array([script_of(t) for t in texts], pa.string()),
                    batch.column(2)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_per_token", "byte_share", "token_entropy", "script", "lang"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(run, SCHEMA + ", lang string")


def _within(bands: dict[str, Band], column: str):
    inside = None
    for name, b in bands.items():
        ok = F.col("chars_per_token").between(b.low, b.high) & (F.col("byte_share") <= b.bytes_most) & (F.col("token_entropy") >= b.entropy_least)
        inside = F.when(F.col(column) == name, ok) if inside is None else inside.when(F.col(column) == name, ok)
    return inside


def _keys():
    """From the closest to the widest: names of the bands that can hold a text; null without a language."""
    size = F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(LEAST_WORDS)))).cast("string")
    return [F.concat(F.lit(kind), F.col(column), F.lit("/"), of) for kind, column in (("l:", "lang"), ("s:", "script")) for of in (size, F.lit("all"))]


def corpus_bands(measured: DataFrame) -> DataFrame:
    """(key, low, high, bytes_most, entropy_least) of every language, script and length class with enough texts."""
    different = measured.where(~_base_failed()).select("lang", "script", "n_words", "chars_per_token", "byte_share", "token_entropy").distinct()
    quartiles = {m: F.percentile_approx(m, [0.25, 0.5, 0.75]) for m in ("chars_per_token", "byte_share", "token_entropy")}
    of = different.withColumn("key", F.explode(F.array(*_keys()))).where("key is not null").groupBy("key").agg(
        F.count("*").alias("n"), *[q.alias(m) for m, q in quartiles.items()]).where(F.col("n") >= LEAST_TEXTS)
    wide = lambda m: WIDER * F.greatest(F.col(m)[2] - F.col(m)[0], LEAST_SPREAD * F.col(m)[1])
    return of.select(
        "key", (F.col("chars_per_token")[0] - wide("chars_per_token")).alias("low"), (F.col("chars_per_token")[2] + wide("chars_per_token")).alias("high"),
        (F.col("byte_share")[2] + WIDER_BYTES * F.greatest(F.col("byte_share")[2] - F.col("byte_share")[0], F.lit(LEAST_SPREAD_BYTES))).alias("bytes_most"),
        (F.col("token_entropy")[0] - wide("token_entropy")).alias("entropy_least"))


def _base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def judge(docs: DataFrame, model_path: str) -> DataFrame:
    """The measures with base_failed, fertile (inside its band) and kept."""
    out = C.stored(measure(docs, model_path), "quality-measures")
    bands = corpus_bands(out).agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("low", "high", "bytes_most", "entropy_least")))).alias("bands"))
    band = F.coalesce(*[F.col("bands")[k] for k in _keys()])
    held = out.crossJoin(F.broadcast(bands)).withColumn("band", band).drop("bands")
    own = (F.col("chars_per_token").between(F.col("band.low"), F.col("band.high")) & (F.col("byte_share") <= F.col("band.bytes_most"))
           & (F.col("token_entropy") >= F.col("band.entropy_least")))
    fertile = F.coalesce(own, _within(SCRIPT_BANDS, "script"))
    return held.withColumns({"base_failed": _base_failed(), "fertile": fertile}).withColumn("kept", ~F.col("base_failed") & F.col("fertile")).drop("band")
