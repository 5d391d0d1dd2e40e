"""Words of the sentencepiece operator, cut with and without regular expressions, and the table that a worker keeps."""

import public_tokenizers
import sentencepiece

from webrisk.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["a plain text", " leading", "trailing ", "two  blanks   three", "▁ sign▁inside ▁", "▁", " ", "  ", "", None, "line\nbreak\ttab here", "über straße "
         "日本語 text 🙂", "x" * 200 + " y", "a", "a ▁ b", "tre.\nDu. thnt.\nFor"]


def test_words_are_those_of_the_pattern():
    for text in TEXTS:
        assert [P._whole(w) for w in P._words(text)] == P._WORD.findall(P._spelled(text or ""))


def test_ids_with_a_full_table_are_the_library_s(monkeypatch):
    monkeypatch.setattr(P, "FLUSH", 3)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    table = P._Ids(P.vocabulary(PATH), ["▁a", "▁text"], [0b111, 0b111111])
    table = P._Ids(P.vocabulary(PATH), [], [])
    for text in TEXTS * 3:
        assert [i for w in P._words(text) for i in table[w]] == model.encode(text or "")


def test_a_worker_builds_its_table_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i} of texts {i % 7}") for i in range(400)], "doc_id long, text string").repartition(40)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in P.encode(docs, PATH).collect():
        assert r["ids"] == model.encode(r["text"])
