"""Token counts from a compiled finite-state tokenizer (byte-level BPE).

Two deterministic transducers, both with a tabulated transition function:

* The splitter reads character classes and marks where a pre-token starts. It has eight states. Long texts are cut
  into chunks; each chunk's map from entry state to exit state is run for all states at once, the maps are composed
  by a parallel prefix scan, and the marks follow from the true entry states.
* The counter reads the bytes of a pre-token. Its state is the longest suffix read that begins a vocabulary entry, with
  the last token of the text up to each place inside that suffix: enough to know the last token after the next byte,
  because a sequence of tokens is the tokenizer's own exactly if each adjacent pair is. A transition carries how many tokens the
  count changes by. States and transitions are compiled when first met and kept in tables; chunks that start at
  pre-tokens run side by side, one table look-up per byte and step.

Special strings inside a text are one token each and split it, as the library does by default. Memory is bounded by the
batch slice and by STATES: when the tables hold more, they are dropped and compiled anew.

Defined results: null and empty texts have no tokens; rows that repeat a doc_id are counted one by one; an empty table gives
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 512
SLICE = 1 << 22
CHUNK = 2048
STATES = 400_000

# character classes of the splitter; each has a variant for the first character of a text
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK_IN, SPACE_LAST, BLANK_LAST = range(8)
# states: at a token's edge; inside letters, numbers, other signs, blanks; after a space that joins what follows; one and two characters to go of a contraction
EDGE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, GLUE, ONE_LEFT, TWO_LEFT = range(8)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a token) by state and class."""
    to, mark = np.zeros((8, 16), np.uint8), np.zeros((8, 16), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SHORT: IN_OTHERS, LONG: IN_OTHERS}
    blank = {BLANK_IN: IN_BLANKS, SPACE_LAST: GLUE, BLANK_LAST: EDGE}
    for state in range(8):
        for kind in range(8):
            if state == TWO_LEFT:
                to[state, kind], mark[state, kind] = ONE_LEFT, False
            elif state == ONE_LEFT:
                to[state, kind], mark[state, kind] = EDGE, False
            elif kind in blank:  # the last blank of a run starts a token of its own or joins what follows
                to[state, kind] = blank[kind]
                mark[state, kind] = not (state == IN_BLANKS and kind == BLANK_IN)
            elif state == GLUE or run[kind] == state:
                to[state, kind], mark[state, kind] = run[kind], False
            else:
                to[state, kind] = {SHORT: ONE_LEFT, LONG: TWO_LEFT}.get(kind, run[kind])
                mark[state, kind] = True
    to[:, 8:], mark[:, 8:] = to[EDGE, :8], mark[EDGE, :8]
    return to, mark


TO, MARK = _splitter()
_CLASSES: dict[str, np.ndarray] = {}


def _class_table() -> np.ndarray:
    """Letter, number, blank or other, by code point."""
    if "t" not in _CLASSES:
        blanks = {0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x09, 0x0E), *range(0x2000, 0x200B)}
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[list(blanks)] = BLANK_IN
        _CLASSES["t"] = table
    return _CLASSES["t"]


def classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes with the look-ahead that the splitter needs; first marks where texts start."""
    kind = _class_table()[points]
    n = len(points)
    ends = np.r_[first[1:], True]
    follows = np.r_[kind[1:], BLANK_IN]
    lasting = (kind == BLANK_IN) & (follows != BLANK_IN) & ~ends
    kind[lasting & (points == 0x20)] = SPACE_LAST
    kind[lasting & (points != 0x20)] = BLANK_LAST
    quote = np.flatnonzero((points == 0x27) & ~ends)
    if len(quote):
        a = points[quote + 1]
        short = np.isin(a, [ord(c) for c in "stmd"])
        two = quote[quote + 2 < n]
        b = np.zeros(len(quote), np.uint32)
        b[:len(two)] = np.where(first[two + 2], 0, points[two + 2])
        long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        kind[quote[short]] = SHORT
        kind[quote[long & ~short]] = LONG
    return kind + 8 * first.astype(np.uint8)


def marks(kinds: np.ndarray) -> np.ndarray:
    """Where tokens start: chunk maps, prefix scan over the maps, then the chunks again from their true states."""
    n = len(kinds)
    lanes = -(-n // CHUNK)
    grid = np.full(lanes * CHUNK, LETTER, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    if lanes > 1:
        flat = TO.ravel()
        for row in grid:
            maps = flat[maps.astype(np.intp) * 16 + row[:, None]]
    step = 1
    while step < lanes:  # inclusive scan: map of everything up to and with each chunk
        maps[step:] = np.take_along_axis(maps[step:].copy(), maps[:-step].astype(np.intp), 1)
        step *= 2
    state = np.zeros(lanes, np.intp)
    state[1:] = maps[:-1, EDGE]
    out = np.empty((CHUNK, lanes), bool)
    flat, flags = TO.ravel(), MARK.ravel()
    for i, row in enumerate(grid):
        at = state * 16 + row
        out[i] = flags[at]
        state = flat[at].astype(np.intp)
    return out.T.ravel()[:n]


class Counter:
    """The counting transducer of a vocabulary, compiled as far as texts have needed it."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = {c: b for b, c in _byte_letters().items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocabulary = {bytes(letters[c] for c in token) for token in spec["model"]["vocab"]}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[bytes(letters[c] for c in a), bytes(letters[c] for c in b)] = k
        #: the merge that makes each token: (rank, halves)
        self.made = {a + b: (k, (a, b)) for (a, b), k in self.ranks.items()}
        self.beginnings = {v[:i] for v in self.vocabulary for i in range(1, len(v) + 1)}
        self.valid: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.keys: list[tuple[bytes, tuple]] = []
        self.numbers: dict[tuple[bytes, tuple], int] = {}
        self.columns = np.full(256, -1, np.int64)
        self.width = 16
        self.next = np.full((1024, self.width), -1, np.int32)
        self.delta = np.zeros((1024, self.width), np.int8)
        self._number((b"", ((None, 0),)))

    def _number(self, key) -> int:
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            if found >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
        return found

    def _columns(self, used: np.ndarray) -> None:
        for b in used[self.columns[used] < 0]:
            taken = int((self.columns >= 0).sum())
            if taken == self.width:
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)], 1)
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)], 1)
                self.width *= 2
            self.columns[b] = taken

    def encode(self, piece: bytes) -> list[bytes]:
        """Merges by rank, leftmost first."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            pair, merged, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def adjacent(self, a: bytes | None, b: bytes) -> bool:
        """Whether the two tokens stand when their bytes are encoded together: no merge across their border comes first.

        The merge that made the border sides is undone from the latest on; at every stage the two sides that face each
        other must not be a pair that would have been merged before the later of the merges undone so far.
        """
        if a is None:
            return True
        pair = (a, b)
        known = self.valid.get(pair)
        if known is None:
            known = self.valid[pair] = self._stands(a, b)
        return known

    def _stands(self, a: bytes, b: bytes) -> bool:
        until = 1 << 40  # rank before which a merge of the border pair would have come; ties go to the left pair
        while True:
            if self.ranks.get((a, b), 1 << 40) < until:
                return False
            ra, rb = self.made.get(a, (-1, None))[0], self.made.get(b, (-1, None))[0]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a = ra, self.made[a][1][1]
            else:
                until, b = rb + 1, self.made[b][1][0]

    def _compile(self, state: int, byte: int) -> None:
        """last: for every place in the suffix, oldest first, the last token up to it and its count relative to now."""
        suffix, last = self.keys[state]
        read = suffix + bytes([byte])
        token = count = None
        for i in range(len(read)):  # the token that ends here: longest first, and only one fits
            if last[i] is not None and read[i:] in self.vocabulary and self.adjacent(last[i][0], read[i:]):
                token, count = read[i:], last[i][1] + 1
                break
        keep = 0
        while read[keep:] not in self.beginnings and keep < len(read):
            keep += 1
        # places from which no vocabulary entry can go on are forgotten, so that states which differ only there are one
        window = [(x[0], x[1] - count) if x is not None and read[i:] in self.beginnings else None
                  for i, x in enumerate(last[keep:], keep)] + [(token, 0)]
        to = self._number((read[keep:], tuple(window)))
        column = self.columns[byte]
        self.next[state, column], self.delta[state, column] = to, count

    def run(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Tokens by byte: sums over a stretch of whole pre-tokens give its tokens. start marks first bytes of pre-tokens."""
        n = len(data)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        if len(self.keys) > STATES:
            self._reset()
            self.valid.clear()
        self._columns(np.unique(data))
        places = np.flatnonzero(start)
        begin = places[np.unique(np.searchsorted(places, np.arange(0, n, CHUNK // 4)).clip(max=len(places) - 1))]
        length = np.diff(np.r_[begin, n])
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        state = np.zeros(len(begin), np.int64)
        column = self.columns[data]
        for i in range(int(length[0])):
            lanes = int(np.searchsorted(-length, -i, "left"))
            at = begin[:lanes] + i
            state = np.where(start[at], 0, state[:lanes])
            to = self.next[state, column[at]]
            missing = np.flatnonzero(to < 0)
            if len(missing):
                for s, b in np.unique(np.stack([state[missing], data[at[missing]].astype(np.int64)], 1), axis=0):
                    self._compile(int(s), int(b))
                to = self.next[state, column[at]]
            out[at] = self.delta[state, column[at]]
            state = to.astype(np.int64)
        return out


def _byte_letters() -> dict[int, str]:
    """The public mapping of bytes to printable letters: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_COUNTERS: dict[str, Counter] = {}


def count_texts(texts: list[str], counter: Counter) -> np.ndarray:
    special = re.compile("|".join(map(re.escape, counter.special))) if counter.special else None
    parts, owner, counts = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        pieces = [text]
        if special and any(s in text for s in counter.special):
            pieces = special.split(text)
            counts[i] += len(pieces) - 1
        for piece in pieces:
            if piece:
                parts.append(piece)
                owner.append(i)
    if not parts:
        return counts
    joined = "".join(parts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    begin = np.r_[0, np.cumsum([len(p) for p in parts])[:-1]]
    first = np.zeros(len(points), bool)
    first[begin] = True
    mark = marks(classes(points, first))
    data = np.frombuffer(joined.encode(), np.uint8)
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    start = np.zeros(len(data), bool)
    start[leads[mark]] = True
    delta = counter.run(data, start)
    total = np.add.reduceat(delta.astype(np.int64), leads[begin])
    np.add.at(counts, owner, total)
    return counts


def _cut(texts: list[str]):
    """Runs of rows of at most SLICE characters, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens."""

    def run(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            counts = [count_texts(texts[a:b], _COUNTERS[path]) for a, b in _cut(texts)]
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
