"""Phrases, whitening and personal data against plain versions, and on dirty rows."""

import hashlib
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from webrisk.llm.phrases import Transducer, collocations
from webrisk.llm.pii import emails, find_pii, luhn, masked, mod97, spans_of
from webrisk.llm.q_corpus import embedding_whitening, pii
from webrisk.llm.whitening import whiten

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))


def clashes():
    """Extra columns with names that the operators use themselves."""
    return [F.lit(None).cast("string").alias(c) for c in ("code", "f", "c1", "spans", "kind", "n", "x")]


# --- phrases

def brute_phrases(rows, support=10, top=2000):
    """Counts of all n-grams in dictionaries."""
    grams, totals = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    g = lang, tuple(w[i:i + k])
                    grams[g] = grams.get(g, 0) + 1
    cands = {g: a for g, a in grams.items() if len(g[1]) > 1 and a >= support}
    out = {}
    for (lang, g), a in cands.items():
        if any(m == lang and len(h) > len(g) and 100 * b >= 50 * a and any(h[i:i + len(g)] == g for i in range(len(h))) for (m, h), b in cands.items()):
            continue
        cuts = [(1000000 * a * a // (grams[lang, g[:k]] * grams[lang, g[k:]]), k) for k in range(1, len(g))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((s, a, " ".join(g), grams[lang, g[:k]], grams[lang, g[k:]]))
    return {(lang, i + 1, p, a, left, right, totals[lang], s)
            for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found, key=lambda x: (-x[0], -x[1], x[2].encode()))[:top])}


def test_phrases_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["new", "york", "city", "über", "a" * 70, "b" * 70, "ninechars", "ninecharz", "x", "Y"]
    rows = [(" ".join(rng.choice(vocabulary, 40)) + ", new york city. New York!", lang) for lang in ("en", "de", None, "und") for _ in range(30)]
    rows += [(None, "en"), ("", "en"), (" \t\n", None), ("new york\ncity new york", "en"), ("one two", "xx"), (LONG, "en"), (LONG, "en")]
    df = spark.createDataFrame(rows, "text string, lang string").select("text", "lang", *clashes())
    assert {tuple(r) for r in collocations(df).collect()} == brute_phrases(rows)
    assert {tuple(r) for r in collocations(df, top=3).collect()} == brute_phrases(rows, top=3)


def test_one_pair_holds_a_third_of_all_words(spark):
    rng = np.random.default_rng(4)
    rows = [("hot pair " + " ".join(f"v{i}" for i in rng.integers(0, 40, 4)), "en") for _ in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert {tuple(r) for r in collocations(df, support=3).collect()} == brute_phrases(rows, support=3)


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations(empty).collect() == []
    assert collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).collect() == []


def test_transducers_unite():
    rng = np.random.default_rng(5)
    parts = [[rng.integers(0, 6, n).astype(np.uint64) for _ in range(3)] for n in (50, 0, 200)]
    built = [Transducer.load(Transducer.build(p, np.ones(len(p[0]), np.int64)).dump()) for p in parts]
    union = Transducer.union(built)
    want = {}
    for p in parts:
        for g in zip(*(x.tolist() for x in p), strict=True):
            want[g] = want.get(g, 0) + 1
    got = dict(zip(zip(*(x.tolist() for x in union.paths()), strict=True), union.weights.tolist(), strict=True))
    assert got == want and list(got) == sorted(got)
    assert len(union.labels[0]) == len({g[0] for g in want})  # prefixes are shared


# --- whitening

def plain_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1][:k], vectors_[:, ::-1][:, :k]
    return centred @ vectors_ / np.sqrt(values), values / np.trace(centred.T @ centred / n), [sum(int(v) ** 2 for v in r) for r in (n * x - sums)]


def test_query_matches_eigenvectors(spark):
    rows = embedding_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want, explained, deviation = plain_whitening([r.embedding for r in table])
    at = {r.vec_id: i for i, r in enumerate(table)}
    assert len(rows) == 8 * len(table)
    got = np.zeros(want.shape)
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(table) and r.deviation == deviation[at[r.vec_id]] and r.identity_error < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    signs = np.sign((got * want).sum(0))
    assert np.abs(got - want * signs).max() < 1e-8


def test_whitening_of_equal_variances_and_blocks(spark):
    """Eight directions of one variance, twice each sign: any basis of them is right; results whiten for any block width."""
    eye = np.eye(10)[:8] * 3.0
    vectors = [*eye.tolist(), *(-eye).tolist(), *eye.tolist(), *(-eye).tolist()]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").select("*", *clashes())
    for block in (1, 3, 8):
        out = whiten(df, block=block).collect()
        assert len(out) == len(vectors) and all(len(r.whitened) == 8 for r in out)
        assert max(r.identity_error for r in out) < 1e-9
        assert abs(sum(out[0].explained) - 1) < 1e-9


def test_whitening_on_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]),
            (None, [2.0, -1.0]), (8, [1e30, 0.0]), (9, [1.0, 5.0])]
    out = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(r.vec_id or 0 for r in out) == [0, 1, 1, 9]
    assert all(r.n == 4 and len(r.whitened) == 2 and r.identity_error < 1e-9 for r in out)
    assert whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")).count() == 0
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert all(len(r.whitened) == 1 for r in line)


# --- personal data

def plain_spans(text):
    """The base patterns as they are written, for texts short enough for backtracking."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_match_plain_patterns(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = pii(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_spans(docs[r.doc_id])
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone")]


def test_base_spans_of_odd_texts():
    rng = np.random.default_rng(6)
    for _ in range(4000):
        text = "".join(rng.choice(list("a@b.c-_+12 ()5é%"), 30))
        assert [s[:3] for s in spans_of(text) if s[4]] == plain_spans(text), text
    assert list(emails("a@b.c_d@e.f@g.h")) == [(0, 5), (5, 11)]
    assert spans_of("1.2.3." + "9" * 5000) == []


def test_added_kinds_need_checksum_or_context():
    kinds = lambda t: [s[0] for s in spans_of(t)]
    assert mod97("GB82 WEST 1234 5698 7654 32") and not mod97("GB83 WEST 1234 5698 7654 32")
    assert kinds("pay to DE89370400440532013000 now") == ["iban"]
    assert kinds("pay to DE88370400440532013000 now") == []
    assert kinds("ssn 123-45-6789") == ["national_id"] and kinds("code 123-45-6789") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("call (030) 5550 1234 today") == ["local_phone"] and kinds("row (030) 5550 1234 today") == []
    assert kinds('token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"') == ["secret"]
    assert kinds('commit "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"') == []
    near, far = spans_of("server 10.0.0.1"), spans_of("version 10.0.0.1")
    assert near[0][3] > far[0][3] and near[0][4] and far[0][4]


def test_masking_and_dirty_rows(spark):
    assert masked("mail a@b.co or +1 (555) 010-9999.", spans_of("mail a@b.co or +1 (555) 010-9999.")) == "mail [email] or [phone]."
    rows = [(1, None), (2, ""), (None, "x@y.zz"), (3, LONG), (4, "ü 1.1.1.1"), (4, "ü 1.1.1.1"), (4, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *clashes())
    out = find_pii(df, mask=True).collect()
    assert len(out) == len(rows)
    assert [(r.spans[0].start, r.spans[0].end, r.masked_text) for r in out if r.doc_id == 4 and r.spans] == [(2, 9, "ü [ip]")] * 2
    assert [r.masked_text for r in out if r.doc_id is None] == ["[email]"]
    assert find_pii(df.where("false")).count() == 0


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "a." * 200_000 + "@", "+1" + "(" * 400_000, "A" * 400_000 + "=", "12 " * 130_000, "a@" * 200_000])
def test_scans_are_linear(text):
    start = time.perf_counter()
    spans_of(text)
    assert time.perf_counter() - start < 5
