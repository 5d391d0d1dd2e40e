"""The training-data operators against plain versions, on dirty rows and on registered tables."""

import collections
import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from webrisk.llm.chat_format import ChatTemplate, format_chats, read_chats
from webrisk.llm.decontaminate import contamination, find_leaks
from webrisk.llm.license_scan import scan_licences
from webrisk.llm.line_dedup import LineStore, drop_repeated_lines
from webrisk.llm.near_dedup import near_duplicates
from webrisk.llm.pieces import decode, encode
from webrisk.llm.quality import judge
from webrisk.llm.substrings import dedup_substrings
from webrisk.llm.token_count import count_tokens
from webrisk.llm.q_models import held_out
from webrisk.llm.toxicity import Restorer, fit_toxicity, language_model, score_toxicity
from webrisk.llm.toxicity import decode as restored

import public_tokenizers

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
#: Nulls, empties, a very long text, ties and repeated rows.
DIRTY = [(1, None), (2, ""), (3, " \t\n "), (None, "some words here"), (4, LONG), (5, LONG), (5, LONG), (6, "one two"), (6, "other text"), (7, "é　ü\n\nx")]


@pytest.fixture(scope="module")
def dirty(spark):
    """Extra columns carry names that the operators use themselves."""
    rows = spark.createDataFrame(DIRTY, "doc_id long, text string")
    return rows.select("doc_id", "text", F.lit("en").alias("lang"), *(F.lit(None).cast("string").alias(c) for c in ("n", "row", "h1", "score", "kept", "id")))


@pytest.fixture(scope="module")
def nothing(dirty):
    return dirty.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().split()


# --- near duplicates

def brute_components(texts):
    def shingles(text):
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())

    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_near_duplicates_match_all_pairs(spark, docs):
    planted = []
    base = [f"t{i}" for i in range(120)]
    for k in range(60):  # a group of near copies longer than the lists that are expanded
        w = list(base)
        for j in range(k % 4):
            w[(k * 7 + j * 29) % 120] = f"e{k}_{j}"
        planted.append((100_000 + k, " ".join(w)))
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    want = brute_components({r.doc_id: r.text for r in rows.collect()})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(rows).collect()}
    assert got == want


def test_near_duplicates_on_dirty_rows(dirty, nothing):
    rows = near_duplicates(dirty).collect()
    assert len(rows) == len(DIRTY)
    found = collections.defaultdict(set)
    for r in rows:
        found[r.doc_id].add((r.component_id, r.kept))
    assert found[4] == {(4, True)} and found[5] == {(4, False)}
    assert found[1] == {(1, True)} and found[None] == {(None, True)}
    assert near_duplicates(nothing).count() == 0


A, B, OTHER = (" ".join(f"{c}{i}" for i in range(40)) for c in "abo")


def test_a_repeated_doc_id_is_one_document(spark):
    df = spark.createDataFrame([(3, A), (6, A), (6, B), (7, B), (8, OTHER), (9, B + " x"), (9, OTHER + " y")], "doc_id long, text string")
    found = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert found == {(3, 3, True), (6, 3, False), (7, 3, False), (8, 3, False), (9, 3, False)}
    by_text = near_duplicates(df, by_text=True)
    kept = by_text.where("kept").join(df.withColumn("row", F.xxhash64("text")), ["doc_id", "row"]).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(3, A), (6, B), (8, OTHER)]


# --- toxicity

def test_restores_obfuscated_words(spark):
    corpus = spark.createDataFrame([("the idiot said stupid things to the loser and the idiot left " * 20,)], "text string")
    restore = Restorer(language_model(corpus))
    import pyarrow as pa

    said = restore(pa.array(["an 1d10t", "s t u p i d", "looooser", "clean words 12 stay", None, "i-d-i-o-t"])).to_pylist()
    assert said == ["an idiot", "stupid", "loser", "clean words 12 stay", "", "idiot"]


def test_restoring_deletes_no_letters(spark):
    corpus = spark.createDataFrame([("ты полный дурак и дурак ушёл домой " * 20,), ("the idiot said stupid things and the idiot left " * 20,)], "text string")
    restore = Restorer(language_model(corpus))
    import pyarrow as pa

    said = restore(pa.array(["ты дур4к!", "д у р а к", "дурааааак", "你真是个笨蛋!你走开1", "stupid/1d10t,left", "żółć1", "γεια!"])).to_pylist()
    assert said[:3] == ["ты дурак", "дурак", "дурак"]
    assert said[3].startswith("你真是个笨蛋") and "你走开" in said[3]
    assert said[4] == "stupid/idiot,left" and said[5].startswith("żółć") and said[6] == "γεια"


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = fit_toxicity(docs, labels.where(~held))
    rows = score_toxicity(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(held).collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in rows)
    assert right >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_decoding_is_linear_and_keeps_long_tokens(spark):
    corpus = spark.createDataFrame([("the idiot said stupid things to the loser and the idiot left " * 20,)], "text string")
    lm = language_model(corpus)
    plain = "theidiotsaid" * 350_000
    seen = time.perf_counter()
    assert restored(plain, lm) == plain
    assert restored("1d10t," * 30_000, lm).count("idiot,") >= 29_000
    assert time.perf_counter() - seen < 30


def test_toxicity_recall_and_precision(spark):
    """About one toxic row in nine of these tables has no toxic word, so recall can't reach one."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_toxicity(docs, labels.where(~held_out()))
    rows = score_toxicity(docs.join(labels.where(held_out()), "doc_id"), model).select("toxic", "score").collect()
    found = sum(r.toxic for r in rows if r.score >= 0.5)
    assert found >= 0.85 * sum(r.toxic for r in rows)
    assert found >= 0.75 * sum(r.score >= 0.5 for r in rows)


def test_every_clear_feature_weighs(spark):
    """Far more than 512 words speak for the label, each in a few rows; none is left out."""
    word = ["q" + chr(97 + g // 676) + chr(97 + g // 26 % 26) + chr(97 + g % 26) for g in range(1500)]
    rows = [(g * 6 + k, f"{word[g]} plain text of row", 1) for g in range(1500) for k in range(6)] + [
        (20_000 + k, "plain text of row", 0) for k in range(60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(8)
    model = fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"), train_rows=100_000)
    assert (model.weights > 0).sum() > 1400


def test_toxicity_on_dirty_rows(spark, dirty, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_toxicity(dirty, none)
    assert score_toxicity(dirty, model).count() == len(DIRTY)
    assert score_toxicity(nothing, model).count() == 0
    labels = spark.createDataFrame([(2, 0), (2, 0), (6, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    scored = score_toxicity(dirty, fit_toxicity(dirty, labels))
    assert sorted(scored.columns) == sorted(dirty.columns) and scored.count() == len(DIRTY)


# --- pieces and token counts

def test_pieces_are_the_library_s(spark, dirty, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    odd = spark.createDataFrame([(90, "  a  b   c "), (91, "日本語" * 40), (92, "a" * 200), (93, " " * 40), (94, "x\U0001F600\ty")], "doc_id long, text string")
    rows = dirty.select("doc_id", "text").union(odd).union(docs.select("doc_id", "text").limit(60))
    for sent in (200_000, 20):
        back = decode(encode(rows, PIECES, sent_words=sent), PIECES).collect()
        assert len(back) == rows.count()
        for r in back:
            assert list(r.ids) == model.encode(r.text or "")
            assert r.decoded == (r.text or "")


def test_pieces_of_nothing(nothing):
    assert encode(nothing, PIECES).count() == 0
    assert encode(nothing.withColumn("ids", F.lit(1)), PIECES).columns[-1] == "ids"


def test_token_counts_are_the_library_s(spark, dirty, nothing, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    odd = ["<|endoftext|>", "a<|endoftext|> b", "'s ''s it's  'll", " \n x", "   ", "x  ", " y", "a" * 5000, "they've'd!!"]
    rows = dirty.select("doc_id", "text").union(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")).union(docs.select("doc_id", "text"))
    texts = [r.text or "" for r in rows.collect()]
    got = count_tokens(rows, BYTES).collect()
    want = collections.Counter((len(t.encode()), len(e.ids)) for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)))
    assert collections.Counter((r.n_bytes, r.n_tokens) for r in got) == want
    assert count_tokens(nothing, BYTES).count() == 0


# --- chats

def test_chats_read_back_and_roles_are_checked(spark):
    said = "\\### Assistant: </turn> ok \\h \\b ##</turn>### #"
    rows = spark.createDataFrame([
        (1, 0, "user", said, "x"), (1, 1, "assistant", said, "x"), (2, 1, "assistant", "b", None), (2, 0, "user", None, None),
        (3, 0, "assistant", "a", None), (4, 0, None, "r: x", None), (None, None, "user", "n", None), (1, 1, "assistant", said, "x"),
    ], "conv_id long, turn int, role string, text string, formatted string")
    t = ChatTemplate()
    out = {r.conv_id: r for r in read_chats(format_chats(rows, t), t).collect()}
    assert [(x.role, x.text) for x in out[1].turns] == [("user", said), ("assistant", said), ("assistant", said)]
    assert not out[1].valid and out[1].bad_turn == 2
    assert out[2].valid and [(x.role, x.text) for x in out[2].turns] == [("user", ""), ("assistant", "b")]
    assert not out[3].valid and out[3].bad_turn == 0
    assert [(x.role, x.text) for x in out[4].turns] == [("", "r: x")] and len(out) == 5
    assert "".join(s.text for s in out[1].segments) == out[1].formatted
    assert format_chats(rows.where("false"), t).count() == 0


# --- lines

def test_lines_keep_the_largest_document(spark, dirty, nothing):
    line = "A line that is long enough to be a key, surely."
    rows = [(i, f"{line}\n own {i}") for i in range(6)] + [(10, f" {line.lower()}\t"), (11, None), (12, line + "\n" + line), (None, line), (3, f"{line}\n own 3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in drop_repeated_lines(docs).collect())
    want = collections.Counter([(i, 2, 1, f" own {i}") for i in (0, 1, 2, 3, 4, 5, 3)] + [(10, 1, 1, ""), (11, 1, 0, ""), (12, 2, 0, line + "\n" + line), (None, 1, 0, line)])
    assert got == want
    assert drop_repeated_lines(dirty).count() == len(DIRTY)
    assert drop_repeated_lines(nothing).count() == 0


def test_store_compacts_its_runs(spark):
    store = LineStore(spark, fanout=2)
    for k in range(5):
        store.add(spark.createDataFrame([(h, h, 100 - k) for h in range(k, k + 3)], "h1 long, h2 long, doc_id long"))
    assert sum(map(len, store.levels.values())) <= 2
    runs = {r.h1: (r.n_docs, r.owner) for r in store.runs().collect()}
    assert runs == {h: (min(h, 4) - max(0, h - 2) + 1, 100 - max(0, h - 2)) for h in range(7)}


# --- licences, quality

def test_licences(spark, dirty, nothing):
    texts = ["The MIT License, an mit-license; Apache\nLicense", "gnu general public license GENERAL PUBLIC LICENSE", None,
             "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated documentation files", "general public general public license"]
    out = {r.doc_id: r for r in scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    places = lambda i: sorted((s.label, s.first) for s in out[i].spans if s.exact)
    assert places(0) == [("apache", 6), ("mit", 1), ("mit", 4)]
    assert places(1) == [("gpl", 1), ("gpl", 4)] and places(4) == [("gpl", 2)]
    assert out[2].spans == [] and out[2].n_words == 0
    assert [(s.label, s.exact) for s in out[3].spans] == [("mit", False)] and 0.75 <= out[3].spans[0].share < 1
    assert scan_licences(dirty).count() == len(DIRTY) and scan_licences(nothing).count() == 0


def test_licence_sentences_with_changed_words(spark):
    whole = "Redistribution and use in source and binary forms with or without modification are permitted".split()
    texts = ["so " + " ".join(w) + " end" for w in (
        whole, whole[:9] + whole[10:], whole[:6] + ["also"] + whole[6:], whole[:6] + ["other"] + whole[7:], whole[:4] + whole[5:8] + ["x"] + whole[8:], whole + whole[:9] + whole[10:])]
    texts.append(" ".join(whole[7:] + whole[:7]) + " words " * 30 + " ".join(whole[:7]))
    out = {r.doc_id: r.spans for r in scan_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = {i: [(s.label, s.first, s.last, round(s.share * 13)) for s in out[i]] for i in out}
    assert found[0] == [("bsd", 1, 14, 13)] and found[1] == [("bsd", 1, 13, 11)]
    assert found[2] == [("bsd", 1, 15, 12)] and found[3] == [("bsd", 1, 14, 11)] and found[4] == [("bsd", 1, 14, 10)]
    assert sorted(found[5]) == [("bsd", 1, 14, 13), ("bsd", 15, 27, 11)] and found[6] == []


def test_quality_counts(docs, dirty, nothing):
    rows = {r.doc_id: r for r in judge(docs, PIECES).collect()}
    for d in docs.collect():
        w, r = [x.decode() for x in words(d.text)], rows[d.doc_id]
        grams = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        seen, dups = set(), 0
        for line in d.text.split("\n"):
            dups += line in seen and bool(words(line))
            seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", d.text)), dups, len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert judge(dirty, PIECES).count() == len(DIRTY) and judge(nothing, PIECES).count() == 0
    assert {r.kept for r in judge(dirty.where("text is null"), PIECES).collect()} == {False}


def test_quality_bands_decide(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = judge(docs, PIECES).join(labels, "doc_id").where(~F.col("base_failed")).collect()
    kept = {q: [r.kept for r in rows if r.quality == q] for q in (0, 1)}
    assert kept[0] and sum(kept[0]) <= 0.5 * len(kept[0])
    assert kept[1] and sum(kept[1]) >= 0.97 * len(kept[1])


# --- substrings

def brute_substrings(texts):
    counts = collections.Counter(tuple(w[i:i + 35]) for w in map(words, texts) for i in range(len(w) - 34))
    out = []
    for text in texts:
        w = words(text)
        gone = {j for i in range(len(w) - 34) if counts[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def test_substrings_match_all_windows(spark, docs):
    passage = [f"p{i}" for i in range(60)]
    cut = lambda a, b: " ".join(passage[a:b])
    extra = ["x y " + cut(0, 35) + " z", "q " + cut(0, 35), cut(1, 35) + " r", "s " + cut(20, 60), "Is onhe. " * 60, "Is onhe. " * 40 + "a",
             "a a a " * 30, "b " * 34, "b " * 36, cut(0, 60), cut(0, 60), None, ""]
    extra += [f"u{k} v{k} " + " ".join(f"c{(i * k) % 7}" for i in range(50)) + f" n{k}" for k in range(12)] * 2
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = [r.text for r in rows.collect()]
    got = collections.Counter((r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(rows).collect())
    assert got == brute_substrings(texts)


def test_substrings_on_dirty_rows(dirty, nothing):
    rows = dedup_substrings(dirty).collect()
    assert collections.Counter((r.n_words, r.n_removed, r.kept_sha256) for r in rows) == brute_substrings([t for _, t in DIRTY])
    assert dedup_substrings(nothing).count() == 0


# --- decontamination

def test_leaks_by_exact_containment(spark, dirty, nothing):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    docs = spark.createDataFrame([
        (1, "start " + item.upper() + " end"), (2, item.replace("kappa", "other")), (3, "quick brown"), (4, "a Quick\nbrown fox"),
        (5, None), (6, item.rsplit(" ", 2)[0]), (6, "nothing"), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (10, item), (11, "quick brown fox"), (12, None), (13, ""), (None, "quick brown")], "item_id long, text string").withColumn("n", F.lit(1))
    got = collections.Counter((r.doc_id, tuple(r.items), r.kept) for r in contamination(docs, items).collect())
    assert got == collections.Counter([(1, (10,), False), (2, (), True), (3, (), True), (4, (11,), False), (5, (), True), (6, (10,), False), (6, (), True), (None, (), True)])
    assert contamination(dirty, items).count() == len(DIRTY)
    assert contamination(nothing, items).count() == 0
    assert find_leaks(docs, items.where("false")).count() == 0


def test_query_runs_the_automaton(spark):
    """The verdicts of the role automaton are part of the result, so the fold is in the plan that runs."""
    from webrisk.llm.q_native import chat_format

    df = chat_format(spark, SF)
    assert "aggregate(" in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.valid for r in df.collect()} <= {True, False} and df.where("conv_id = -7").first().bad_turn == -1
