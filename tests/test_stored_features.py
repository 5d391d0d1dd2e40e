"""Features and splits are computed once: what follows reads stored columns."""

from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_scaled_features_are_read_and_unpacked_once(spark):
    df = QUERIES["standardized_features"](spark, SF)
    assert all("/features-" in f for f in df.inputFiles())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("events.parquet") == 0 and plan.count("UDF(") <= 3  # assembler, scaler, vector to array


def test_fits_read_stored_splits(spark, monkeypatch):
    from webrisk.operators import ml

    read = []
    predict = ml.predict
    monkeypatch.setattr(ml, "predict", lambda model, rows: (read.append(rows.inputFiles()), predict(model, rows))[1])
    QUERIES["logistic_baseline"](spark, SF)
    assert len(read) == 2 and all("/halves-" in f for files in read for f in files)
