"""Operator behaviour on hand-made frames (encoders, leakage, gates, reports)."""

import math
import tempfile

import pytest
from pyspark.sql import functions as F

from estatelens.operators.encoders import apply_encoders, fit_encoders
from estatelens.operators.evaluate import oof_rule_predictions, regression_metrics

SCHEMA = "listing_id string, city_key string, sector string, society string, price double, price_per_sqft double, area double"


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_society_smoothing(spark):
    rows = [(f"a{i}", "c", "s1", "big", 20 * 1500 / 1e7, 20000.0, 1500.0) for i in range(20)]
    rows += [("b0", "c", "s1", "one", 4000 * 1500 / 1e7, 4000.0, 1500.0)]
    rows += [(f"n{i}", "c", "s1", None, 10000 * 1500 / 1e7, 10000.0, 1500.0) for i in range(9)]
    enc = fit_encoders(_frame(spark, rows))
    g = enc.global_stats.first()["g_median"]
    soc = {r["society"]: (r["society_ppsf"], r["soc_count"]) for r in enc.society_stats.collect()}
    assert None not in soc                      # a missing name is not a building
    assert soc["big"][1] == 20 and math.isclose(soc["big"][0], (20 * 20000 + 10 * g) / 30)
    assert math.isclose(soc["one"][0], (4000 + 10 * g) / 11)


def test_fallback_chain(spark):
    rows = [(f"x{i}", "c", "hi", f"b{i}", 20000 * 1000 / 1e7, 20000.0, 1000.0) for i in range(30)]
    rows += [(f"y{i}", "c", "lo", f"c{i}", 6000 * 1000 / 1e7, 6000.0, 1000.0) for i in range(30)]
    enc = fit_encoders(_frame(spark, rows))
    q = spark.createDataFrame([("c", "hi", "unknown"), ("c", "lo", None), ("c", "nowhere", None)],
                              "city_key string, sector string, society string")
    got = {r["sector"]: (r["society_ppsf"], r["sector_ppsf"], r["sector_count"])
           for r in apply_encoders(q, enc, full=True).collect()}
    assert got["hi"][0] == 20000.0 and got["lo"][0] == 6000.0     # unknown building -> own locality
    assert got["nowhere"][1] == 13000.0 and got["nowhere"][2] == 0.0  # unknown locality -> city median, count 0


def test_no_target_leakage(spark):
    """One listing per locality: fold-safe locality rates cannot see the
    listing's own price, a leaky encoder would price it exactly."""
    rows = [(f"l{i:03d}", "c", f"s{i}", None, (5000 + 97 * i) * 1200 / 1e7, 5000.0 + 97 * i, 1200.0)
            for i in range(120)]
    df = _frame(spark, rows)
    honest = {r["predictor"]: r["r2"] for r in regression_metrics(
        oof_rule_predictions(df), ["baseline_sector"]).collect()}["baseline_sector"]
    leaky = apply_encoders(df, fit_encoders(df), full=True).withColumn(
        "pred_baseline_sector", F.col("sector_ppsf") * F.col("area") / 1e7)
    leaky_r2 = regression_metrics(leaky, ["baseline_sector"]).first()["r2"]
    assert leaky_r2 > 0.999 and honest < leaky_r2 - 0.3


def test_histogram_edges(spark):
    from estatelens.operators.reports import histogram
    df = spark.createDataFrame([("c", float(v)) for v in (0, 1, 2, 10)] + [("z", 5.0), ("z", 5.0)],
                               "city_key string, x double")
    h = {(r["city_key"], r["bin"]): r for r in histogram(df, "x", 5).collect()}
    assert h[("c", 4)]["n"] == 1 and h[("c", 0)]["n"] == 2 and h[("c", 2)]["n"] == 0   # max in last bin
    assert h[("z", 2)]["n"] == 2 and h[("z", 0)]["lo"] == 4.5 and h[("z", 4)]["hi"] == 5.5


def test_quintiles_keep_ties(spark):
    from estatelens.operators.reports import assign_quintile, quintile_edges
    df = spark.createDataFrame([("c", float(v)) for v in [1] * 6 + list(range(2, 12))], "city_key string, price double")
    e = quintile_edges(df, "price")
    q = df.join(e, "city_key").withColumn("q", assign_quintile(F.col("price")))
    assert q.where(F.col("price") == 1).select("q").distinct().count() == 1


def test_unit_hint(spark):
    from estatelens.operators.ingest import suggest_price_unit
    df = spark.createDataFrame([(500000.0,), (50.0,)], "m double")
    got = [r[0] for r in df.select(suggest_price_unit(F.col("m"), "lakh")).collect()]
    assert got == ["rupees", "crore"]


def test_stored_basis_errors(spark):
    """Only an absent table counts as none; a mixed one is refused, an unreadable one raises."""
    from estatelens.operators.ingest import read_existing_basis
    d = tempfile.mkdtemp(prefix="estatelens-basis-", dir="/tmp")
    spark.createDataFrame([("a", "carpet"), ("a", "builtup")], "city_key string, area_basis string").write.parquet(f"{d}/mixed")
    with pytest.raises(ValueError, match="a have more than one"):
        read_existing_basis(spark, f"{d}/mixed")
    with open(f"{d}/broken", "wb") as f:
        f.write(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        read_existing_basis(spark, f"{d}/broken").count()


def test_reingest_with_other_basis_is_refused(spark):
    from estatelens.operators.ingest import ingest_listings, read_existing_basis
    from estatelens.plans.ingest_queries import TEST_CONTRACT, contract_feed
    from estatelens.sources.feeds import write_processed
    from tests.conftest import SF_SMALL
    d = tempfile.mkdtemp(prefix="estatelens-proc-", dir="/tmp")
    assert read_existing_basis(spark, f"{d}/absent").count() == 0
    first = ingest_listings(contract_feed(spark, SF_SMALL), TEST_CONTRACT)
    write_processed(first.listings.withColumn("area_basis", F.lit("carpet")), f"{d}/listings")
    prior = read_existing_basis(spark, f"{d}/listings")
    again = ingest_listings(contract_feed(spark, SF_SMALL), TEST_CONTRACT, existing_basis=prior)
    assert not any(r["passed"] for r in again.gate_report.collect())
    assert again.listings.count() == 0


def test_band_sign(spark):
    from estatelens.functions.columns import band_high, band_low
    df = spark.createDataFrame([(1.0, -0.24198, 0.26663)], "p double, q10 double, q90 double")
    r = df.select(band_low("p", "q90").alias("lo"), band_high("p", "q10").alias("hi")).first()
    assert r["lo"] < 1.0 < r["hi"] and abs(r["lo"] - math.exp(-0.26663)) < 1e-12


def test_unknown_model_name():
    from estatelens.operators.models import ModelSpec
    with pytest.raises(ValueError, match="Valid: accurate, default"):
        ModelSpec("fancy").settings()


def test_pipeline_registry():
    from estatelens.operators.cleaning import clean_listings, pipeline_for
    assert pipeline_for("asia", ["asia", "europe"]) is clean_listings
    with pytest.raises(ValueError, match="Valid: asia, europe"):
        pipeline_for("atlantis", ["europe", "asia"])


def test_contract_checks():
    from dataclasses import replace

    from estatelens.plans.ingest_queries import TEST_CONTRACT
    cols = ["price_lakh", "area_text", "size_label", "bathroom", "ptype", "balcony_raw", "locality_raw",
            "area_type", "lift", "parking", "gym"]
    TEST_CONTRACT.check(cols)
    with pytest.raises(ValueError, match="area_unit"):
        replace(TEST_CONTRACT, area_unit="acre").check(cols)
    with pytest.raises(ValueError, match="not in the feed"):
        TEST_CONTRACT.check(cols[:-1])
    with pytest.raises(ValueError, match="used twice"):
        replace(TEST_CONTRACT, columns={**TEST_CONTRACT.columns, "bathrooms": "size_label"}).check(cols)


def test_rate_table_reader(spark):
    """A dated table is read; empty, undated and inverted ones are refused."""
    import json

    from estatelens.operators.rates import read_rates
    row = {"zone": "a", "property_type": "flat", "rate_low_per_sqft": 1.0, "rate_high_per_sqft": 2.0, "source": "s",
           "source_date": "2025-01-01", "last_updated": "2025-02-01"}
    cases = {"good": [row, {**row, "zone": "b"}], "empty": [], "undated": [{**row, "last_updated": None}],
             "inverted": [{**row, "rate_low_per_sqft": 3.0}], "two": [row, {**row, "last_updated": "2025-03-01"}]}
    d = tempfile.mkdtemp(prefix="estatelens-rates-", dir="/tmp")
    for name, rows in cases.items():
        with open(f"{d}/{name}.json", "w") as f:
            f.write("\n".join(map(json.dumps, rows)))
    rates, updated = read_rates(spark, f"{d}/good.json")
    assert rates.count() == 2 and updated == "2025-02-01"
    for name, what in (("empty", "no rows"), ("undated", "last_updated"), ("inverted", "low above high"), ("two", "last_updated")):
        with pytest.raises(ValueError, match=what):
            read_rates(spark, f"{d}/{name}.json")


def test_quintiles_need_different_edges(spark):
    from estatelens.operators.reports import quintile_edges
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 1.0)] * 10, "city_key string, price double")
    assert quintile_edges(df.where("city_key = 'a'"), "price").count() == 1
    with pytest.raises(Exception, match="equal quintile edges in b"):
        quintile_edges(df, "price").collect()


def test_metrics_table_is_keyed(spark):
    from estatelens.sources.feeds import write_metrics
    d = tempfile.mkdtemp(prefix="estatelens-metrics-", dir="/tmp") + "/m"
    m = lambda rows: spark.createDataFrame(rows, "city_key string, predictor string, mape_pct double")
    write_metrics(m([("a", "model", 1.0), ("b", "model", 2.0)]), "default", d)
    write_metrics(m([("a", "model", 3.0)]), "accurate", d)
    write_metrics(m([("b", "model", 4.0)]), "default", d)
    got = {(r["city_key"], r["model_name"]): r["mape_pct"] for r in spark.read.parquet(d).collect()}
    assert got == {("a", "default"): 1.0, ("a", "accurate"): 3.0, ("b", "default"): 4.0}


def test_model_gates_refuse_a_city_only(spark):
    from estatelens.operators.models import model_gates
    rows = [("good", 1.0, "furnished"), ("price", -1.0, "furnished"), ("label", 1.0, "odd"), ("label", 1.0, "furnished"), ("plain", 1.0, None)]
    df = spark.createDataFrame(rows, "city_key string, price double, furnishing_type string")
    assert {r["city_key"]: r["refused"] for r in model_gates(df).collect()} == {
        "good": None, "price": "prices", "label": "furnishing", "plain": None}


def test_rows_meet_the_encoder_tables_without_a_shuffle(spark):
    """Encoder tables are written, so their size is known and the rows that join them stay where they are; copies are dealt by a digest that does not travel."""
    from estatelens.operators.cleaning import drop_duplicates
    from estatelens.operators.encoders import apply_encoders, fit_encoders
    rows = spark.range(400).select(F.col("id").cast("string").alias("listing_id"), F.lit("c").alias("city_key"), (F.col("id") % 3).cast("string").alias("sector"),
                                   (F.col("id") % 9).cast("string").alias("society"), (F.col("id") % 2).cast("int").alias("fold"),
                                   (F.col("id") * 1.5).alias("price_per_sqft"))
    plan = apply_encoders(rows, fit_encoders(rows, 2))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    copies = rows.unionByName(rows.withColumn("listing_id", F.concat(F.lit("x"), "listing_id")))
    kept = drop_duplicates(copies.drop("fold"), with_counts=True)
    assert "Exchange hashpartitioning(xxhash64(" in kept._jdf.queryExecution().executedPlan().toString()
    assert {r["listing_id"]: r["_copies"] for r in kept.collect()} == {str(i): 2 for i in range(400)}
