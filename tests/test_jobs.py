"""Readers, sinks, preparation, history, ML, calibration, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from webrisk.operators import calibrate, evaluate, history, ml, prep
from webrisk.sources import readers, sinks
from webrisk.streaming import jobs


@pytest.fixture()
def feeds(tmp_path):
    (tmp_path / "openphish.txt").write_text("https://bad.example/a\n\n bad2.example \nhttps://bad.example/a\n")
    (tmp_path / "latin.txt").write_bytes("http://caf\xe9.example/\n".encode("latin-1"))
    (tmp_path / "top-sites.csv").write_text("1,good.example\n2,fine.example\n3,www.good.example\n")
    (tmp_path / "tank.csv").write_text("id,Phish_URL\n1,https://bad3.example/\n2,\n")
    (tmp_path / "corpus.json").write_text(json.dumps([
        {"id": "a", "label": "malicious", "category": "c", "url": "https://m.example/"},
        {"id": "b", "label": "ambiguous", "category": "c", "url": "https://q.example/", "expected_patterns": ["x"]},
    ]))
    (tmp_path / "results").mkdir()
    (tmp_path / "results" / "skip.txt").write_text("https://never.example/\n")
    return tmp_path


def test_readers(spark, feeds):
    lines = readers.read_url_lines(spark, str(feeds / "openphish.txt")).orderBy("line_no").collect()
    assert [r.url for r in lines] == ["https://bad.example/a", "https://bad2.example", "https://bad.example/a"]
    assert {(r.label, r.label_text, r.source_dataset) for r in lines} == {(1, "malicious", "openphish")}
    assert readers.read_url_lines(spark, str(feeds / "latin.txt")).first().url == "http://café.example/"
    csv = readers.read_url_csv(spark, str(feeds / "tank.csv")).collect()
    assert csv[0].url == "https://bad3.example/" and csv[1].url == "https://nan"
    ranked = readers.read_ranked_domains(spark, str(feeds / "top-sites.csv")).orderBy("line_no").collect()
    assert [r.url for r in ranked][:2] == ["https://good.example", "https://fine.example"]
    corpus = {r.id: r for r in readers.read_corpus(spark, str(feeds / "corpus.json")).collect()}
    assert corpus["a"].text == "" and corpus["a"].expected_patterns == [] and corpus["b"].expected_patterns == ["x"]
    urls = {r.url: r.label for r in readers.read_json_urls(spark, str(feeds / "corpus.json")).collect()}
    assert urls == {"https://m.example/": 1, "https://q.example/": -1}
    preset = readers.read_preset(spark, str(feeds / "tank.csv"), "phishtank").first()
    assert (preset.url, preset.label, preset.source) == ("https://bad3.example/", 1, "phishtank")
    with pytest.raises(ValueError):
        readers.read_preset(spark, str(feeds / "top-sites.csv"), "openphish").count()
    feed = readers.read_phish_feed(spark, str(feeds / "openphish.txt"), str(feeds / "latin.txt"))
    assert feed.count() == 4


def test_load_all(spark, feeds):
    merged, summary = readers.load_all(spark, str(feeds))
    urls = {r.url for r in merged.collect()}
    assert "https://never.example/" not in urls and "https://bad.example/a" in urls
    assert "https://fine.example" in urls  # numeric first column: the second holds domains
    counts = {r.source_dataset: (r.rows, r.duplicate_rows) for r in summary.collect()}
    assert counts["openphish"] == (2, 1)


def test_prepare_dataset(spark):
    phish = spark.createDataFrame([(f"https://p{i}.example/x", "a", "f", i) for i in range(60)], "url string, source_dataset string, source_file string, line_no long")
    good = spark.createDataFrame([(f"https://g{i}.example/", "b", "g", i) for i in range(90)] + [("https://p1.example/", "b", "g", 99), ("nope", "b", "g", 100)], "url string, source_dataset string, source_file string, line_no long")
    out = prep.prepare_dataset(phish, good).cache()
    rows = out.groupBy("split", "label").count().collect()
    sizes = {(r.split, r.label): r["count"] for r in rows}
    assert sizes[("train", 1)] == 42 and sizes[("train", 0)] == 28
    assert sizes[("validation", 1)] == 9 and sizes[("validation", 0)] == 14
    assert out.filter("normalized_domain = 'p1.example'").first().label == 1
    prep.verify_no_overlap(out)
    with pytest.raises(ValueError):
        prep.verify_no_overlap(out.unionByName(out.withColumn("split", F.lit("other"))))
    with pytest.raises(ValueError):
        prep.stratified_split(out, (0.5, 0.2, 0.2))


def test_group_rank_with_one_hot_group(spark):
    df = spark.range(5000).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label"))
    digest = prep.sample_hash(1)
    ranked = prep.group_rank(df, ["label"], prep.hash_bucket(digest), [digest, F.col("url")]).collect()
    import hashlib

    for label in (0, 1):
        mine = sorted((r for r in ranked if r.label == label), key=lambda r: r.rank_in_group)
        assert [r.rank_in_group for r in mine] == list(range(1, len(mine) + 1))
        keys = [hashlib.md5(f"1|{r.url}".encode()).hexdigest() for r in mine]
        assert keys == sorted(keys) and mine[0].group_size == len(mine)


def _history(spark, n=40):
    return spark.range(n).select(
        F.col("id"), (F.col("id") % 2).alias("user_id"), F.lit("https://x.example/").alias("url"),
        F.lit("url").alias("scan_type"), (F.col("id") * 3 % 100).cast("int").alias("risk_score"),
        F.lit("Safe").alias("classification"), F.lit(0.5).alias("confidence"), F.lit("e").alias("explanation"),
        F.lit(False).alias("llm_used"),
        F.array().cast("array<struct<code:string,title:string,description:string,severity:string>>").alias("detected_issues"),
        F.create_map(F.lit("a"), F.lit(1)).alias("source_breakdown"),
        F.timestamp_seconds(F.col("id") * 43200).alias("created_at"),
        F.to_date(F.timestamp_seconds(F.col("id") * 43200)).alias("scan_date"))


def test_history_store(spark, tmp_path):
    path = str(tmp_path / "history")
    sinks.append_history(_history(spark), path)
    read = lambda: spark.read.schema(history.HISTORY_DDL).parquet(path)
    assert read().count() == 40
    days = history.rewrite_without(spark, path, str(tmp_path / "staging"), 1, [1, 3, 3, -5])
    assert len(days) == 2 and read().count() == 38
    history.rewrite_without(spark, path, str(tmp_path / "staging2"), 0)
    assert read().filter("user_id = 0").count() == 0 and read().count() == 18
    with pytest.raises(ValueError):
        history.delete_scans(read(), 1, [0])
    with pytest.raises(ValueError):
        history.recent_scans(read(), 1, 101)


def test_evaluation_sinks(spark, tmp_path):
    records = spark.createDataFrame(
        [("u1", 1, 80, "ok", False, 0.5, ["p"]), ("u2", 0, 50, "ok", False, 0.5, []), ("u3", 1, 10, "ok", False, 0.1, [])],
        "url string, true_label int, risk_score int, status string, timeout_exceeded boolean, duration_seconds double, attack_patterns array<string>")
    frame = spark.createDataFrame([("u1", 1, "s")], "url string, label int, source_dataset string")
    sinks.write_evaluation(records, frame, str(tmp_path))
    report = json.loads(spark.read.text(f"{tmp_path}/evaluation_report").first()[0])
    assert report["metrics"][0]["tp"] == 1 and report["false_positive_samples"][0]["url"] == "u2"
    assert spark.read.json(f"{tmp_path}/evaluation_records_jsonl").count() == 3
    empty = evaluate.metrics_at_threshold(records.filter("url = 'none'"), 40).first()
    assert (empty.tp, empty.accuracy) == (0, 0.0)


def test_training_and_artifacts(spark, tmp_path):
    df = spark.range(400).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"),
        (F.col("id") % 4 == 0).cast("int").alias("label"),
        (F.col("id") % 4 + F.col("id") % 7 / 10.0).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y")).cache()
    space = {"numTrees": [5], "maxDepth": [2, 3]}
    forest = ml.random_search("random_forest", df, ["x", "y"], space, draws=2, folds=3)
    boosted = ml.random_search("gradient_boosting", df, ["x", "y"], {"maxIter": [2], "maxDepth": [2]}, draws=1, folds=3)
    best = ml.select_best([forest, boosted])
    assert best.mean_score > 0.9
    model = ml.retrain(best, df)
    row = ml.model_metrics(ml.predict(model, df)).first()
    assert row.accuracy > 0.95 and row.auc_roc > 0.95
    ml.save_artifacts(model, str(tmp_path / "m"), ["x", "y"], {"v": 1})
    loaded, schema = ml.load_artifacts(spark, str(tmp_path / "m"))
    assert schema["feature_count"] == 2
    assert ml.predict(loaded, df).count() == 400


def test_cached_lookup_with_a_hot_key(spark):
    import random

    from webrisk.operators.intel import lookup_cached

    rng = random.Random(7)
    pick = lambda: "hot" if rng.random() < 0.4 else f"u{rng.randrange(20)}"
    results = [(pick(), rng.randrange(6000), i) for i in range(600)]
    results = list({(u, t): (u, t, i) for u, t, i in results}.values())
    scans = [(i, pick(), rng.randrange(7000)) for i in range(900)]
    ts = F.timestamp_seconds(F.col("t") + 1_700_000_000)
    out = lookup_cached(
        spark.createDataFrame(scans, "id long, url string, t long").withColumn("ts", ts),
        spark.createDataFrame(results, "url string, t long, score int").withColumn("ts", ts), ["score"])
    got = {r.id: r.cached_score for r in out.collect()}
    for i, url, t in scans:
        usable = [(rt, s) for u, rt, s in results if u == url and rt <= t]
        last = max(usable) if usable else None
        assert got[i] == (last[1] if last and t - last[0] <= 900 else None)
    assert len(got) == len(scans)


def test_dedupe_with_a_hot_url(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("https://hot.example/")).otherwise(
            F.concat(F.lit("https://u.example/"), (F.col("id") % 500).cast("string"))).alias("url"),
        F.lit("f").alias("source_file"), F.lit("f").alias("source_dataset"), F.col("id").alias("line_no"))
    rows = {r.url: r.line_no for r in prep.dedupe_urls(df.repartition(16)).collect()}
    assert rows["https://hot.example/"] == 0
    want = {}
    for i in range(6000):
        want.setdefault("https://hot.example/" if i % 3 == 0 else f"https://u.example/{i % 500}", i)
    assert rows == want
    total = prep.load_summary(df).first()
    assert (total.rows, total.duplicate_rows, total.invalid_rows) == (len(want), 6000 - len(want), 0)


@pytest.mark.parametrize("labels,want", [
    ([-1, 1], 0.3), (["NotPhishy", "Phishy"], 0.7), (["safe", "other"], 0.7), (["a", "b"], 0.7)])
def test_label_probability(spark, labels, want):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense([0.3, 0.7]),)], ["probability"])
    assert df.select(ml.label_probability(df, labels)).first()[0] == pytest.approx(want)


def test_cached_lookup_edges(spark):
    from webrisk.operators.intel import lookup_cached

    results = spark.createDataFrame([("u", 0, 1), ("u", 400, 2), ("v", 0, 9)], "url string, t long, score int")
    scans = spark.createDataFrame(
        [("u", 0), ("u", 399), ("u", 400), ("u", 1300), ("u", 1301), ("v", 900), ("v", 901), ("w", 1), ("u", -1)],
        "url string, t long")
    ts = F.timestamp_seconds(F.col("t") + 1_700_000_000)
    out = lookup_cached(scans.withColumn("ts", ts), results.withColumn("ts", ts), ["score"])
    got = {(r.url, r.t): (r.cache_hit, r.cached_score) for r in out.collect()}
    assert got == {
        ("u", 0): (True, 1), ("u", 399): (True, 1), ("u", 400): (True, 2), ("u", 1300): (True, 2),
        ("u", 1301): (False, None), ("v", 900): (True, 9), ("v", 901): (False, None),
        ("w", 1): (False, None), ("u", -1): (False, None)}


def test_calibration(spark):
    df = spark.range(1000).select(
        (F.col("id") / 1000.0).alias("raw_prob"),
        (F.pow(F.col("id") / 1000.0, 3) * 1000 > (F.col("id") * 7919 % 1000)).cast("int").alias("label")).cache()
    before = calibrate.calibration_error(df, "raw_prob").first().ece
    for method in ("platt", "isotonic"):
        out = calibrate.fit_calibrator(df, method).transform(df)
        assert calibrate.calibration_error(out).first().ece < min(before, 0.1)
        values = [r.calibrated_prob for r in out.orderBy("raw_prob").collect()]
        assert all(0 <= a <= 1 for a in values) and all(b >= a - 1e-12 for a, b in zip(values, values[1:]))
    for bad in (df.filter("label = 1"), df.limit(0), df.withColumn("raw_prob", F.lit(1.5)), df.withColumn("label", F.lit(2))):
        with pytest.raises(ValueError):
            calibrate.fit_calibrator(bad)
    with pytest.raises(ValueError):
        calibrate.fit_calibrator(df, "other")


def test_stream_replay_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, 7, "https://a.example/", "<html></html>", "2024-01-01 00:00:00"), (2, 7, "http://b.example/", None, "2024-01-01 00:00:01")]
    schema = "page_id long, user_id long, url string, html string, ts string"
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(src))
    for _ in range(2):  # a second run with a fresh checkpoint replays batch 0
        stream = spark.readStream.schema("page_id long, user_id long, url string, html string, ts timestamp").parquet(str(src))
        query = jobs.score_stream(stream, str(tmp_path / "out"), str(tmp_path / f"cp{_}"))
        query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 and {r.classification for r in out.collect()} == {"Safe"}
