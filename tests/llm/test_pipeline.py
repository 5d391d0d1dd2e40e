"""Registered training-data queries against SQL, and the pipeline's stages against plain versions."""

import duckdb
import pytest

import corpus_pipeline as P
from checks.compare import TABLES, _rows
from webrisk.llm import columns as C
from webrisk.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        cur = con.execute(ORACLES[name])
        columns = [d[0] for d in cur.description]
        assert _rows(df.columns, rows) == _rows(columns, cur.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, text = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in P.STAGES:
        after = C.stored(stage(spark, docs, SF), "stage")
        rows = {r.doc_id: r for r in after.collect()}
        gone = set(text) - set(rows)
        assert after.count() == len(rows)
        if name != "sentencepiece":
            assert after.columns == columns
        if name == "toxicity":
            assert sum(labels.get(i) == 0 for i in gone) <= 1
            assert all(rows[i].text == text[i] for i in rows)
        if name == "line dedup":
            assert not gone and all(r.n_chars == len(r.text) for r in rows.values())
        if name == "near dedup":
            sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().encode().split()) else set() for i, t in text.items()}
            like = lambda a, b: 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0
            assert not any(like(a, b) for a in rows for b in rows if a < b)
            assert all(any(like(a, b) for b in text if b != a) for a in gone)
        if name == "decontamination":
            items = [r.text.lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            whole = {" ".join(w) for w in items}
            assert not any(w in " ".join(r.text.lower().split()) for w in whole for r in rows.values())
        if name == "sentencepiece":
            assert not gone and all(r.n_tokens == len(r.ids) for r in rows.values())
        docs, text = after, {i: r.text for i, r in rows.items()} if name != "sentencepiece" else {}


def test_empty_documents_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = C.stored(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_stages_on_dirty_rows(spark):
    """Nulls, repeated doc_ids with other texts, a very long text; no clean text gets lost."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(20_000))
    rows = [(3, a), (6, a), (6, b), (7, b), (None, "no id here"), (None, None), (8, None), (9, ""), (10, long), (10, long), (11, long + " end")]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40 and doc_id > 11")
    docs = docs.unionByName(given, allowMissingColumns=True).selectExpr("*", "null as _toxicity_", "null as row", "null as kept_text", "null as n", "null as component_id")
    columns = docs.columns
    docs = C.stored(docs, "dirty")
    for name, stage in P.STAGES:
        docs = C.stored(stage(spark, docs, SF), "stage")
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "near dedup":
            left = docs.where("doc_id < 12 or doc_id is null").select("doc_id", "text").collect()
            assert sorted((r.doc_id, r.text) for r in left if r.text in (a, b)) == [(3, a), (6, b)]
            assert [r.doc_id for r in left if r.text and len(r.text) > 1000] == [10, 10]
            assert sum(r.doc_id is None for r in left) == 2
    assert docs.where("doc_id in (3, 6, 8, 9, 10) or doc_id is null").count() == 8
