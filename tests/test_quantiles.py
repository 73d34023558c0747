"""Distributed exact quantiles and ranks against numpy / brute force."""

import numpy as np
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from estatelens.operators.quantiles import exact_quantiles, multi_quantiles, rank_within, top_k_per_group


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.normal(100, 30, 500))]
    rows += [("hot", 5.0)] * 300 + [("hot", float(v)) for v in range(50)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"p005": 0.005, "med": 0.5, "p995": 0.995},
                                              count_col="n").collect()}
    for k in ("a", "b", "hot"):
        xs = np.array([v for kk, v in rows if kk == k])
        assert got[k]["n"] == len(xs)
        for name, p in (("p005", 0.005), ("med", 0.5), ("p995", 0.995)):
            assert abs(got[k][name] - np.quantile(xs, p)) < 1e-9


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 20)), min_size=1, max_size=60))
def test_multi_quantiles_property(spark, rows):
    df = spark.createDataFrame([(k, float(v), float(v) * 2) for k, v in rows], "k string, a double, b double")
    got = {r["k"]: r for r in multi_quantiles(df, ["k"], {"a": {"a_med": 0.5}, "b": {"b_q1": 0.25}}).collect()}
    for k in {k for k, _ in rows}:
        xs = np.array([float(v) for kk, v in rows if kk == k])
        assert abs(got[k]["a_med"] - np.quantile(xs, 0.5)) < 1e-9
        assert abs(got[k]["b_q1"] - np.quantile(xs * 2, 0.25)) < 1e-9


def test_rank_and_top_k(spark):
    rows = [("c", i % 7, f"id{i:03d}") for i in range(100)] + [("d", 1, "z")]
    df = spark.createDataFrame(rows, "g string, v int, id string")
    ranked = rank_within(df, ["g"], ["v", "id"], "r").collect()
    expected = {}
    for g in ("c", "d"):
        srt = sorted([r for r in rows if r[0] == g], key=lambda t: (t[1], t[2]))
        expected.update({(g, t[2]): i for i, t in enumerate(srt)})
    assert {(r["g"], r["id"]): r["r"] for r in ranked} == expected
    top = top_k_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 3).collect()
    assert sorted((r["g"], r["rank"], r["id"]) for r in top)[:3] == [("c", 1, "id006"), ("c", 2, "id013"),
                                                                    ("c", 3, "id020")]


def test_global_quantile_sort_path(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    r = exact_quantiles(df, [], "v", {"q": 0.25}, count_col="n").first()
    assert r["q"] == 25.0 and r["n"] == 101
    assert exact_quantiles(df.limit(0), [], "v", {"q": 0.25}).count() == 0


def test_moments_same_pass(spark):
    from estatelens.operators.quantiles import weighted_quantiles
    rows = [("a", float(v)) for v in range(1, 21)] + [("b", 3.0)] + [("c", 0.1)] * 3
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["w"] for r in weighted_quantiles(df, ["k"], "v", {"w": F.lit(1)}, {"m": 0.5}, moments=True).collect()}
    assert got["a"]["m"] == 10.5 and got["a"]["mean"] == 10.5 and got["a"]["n"] == 20
    assert abs(got["a"]["std"] - np.std(np.arange(1, 21), ddof=1)) < 1e-12
    assert got["b"]["std"] is None and got["b"]["n"] == 1 and got["c"]["std"] == 0.0


def test_repeated_value_is_one_row_of_the_selection(spark, monkeypatch):
    """A value that most rows share is ranked as one row; only values near a wanted rank are ranked at all."""
    import estatelens.operators.quantiles as Q
    seen = []
    keep = Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df: seen.append(keep(df)) or seen[-1])
    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.when(F.col("id") % 4 < 3, 7.0).otherwise(F.col("id") % 4_000).alias("v"))
    r = Q.exact_quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.9}, count_col="n").first()
    xs = np.array([7.0 if i % 4 < 3 else i % 4_000 for i in range(200_000)], float)
    assert r["n"] == 200_000 and r["m"] == 7.0 and abs(r["p"] - np.quantile(xs, 0.9)) < 1e-9
    ranked = next(d for d in seen if "_c" in d.columns)
    assert ranked.where("_v = 7.0 and _t = '_q' and _i = 0").count() == 1 and ranked.count() < len(set(xs)) / 10


def test_intervals_are_cut_until_they_are_small(spark, monkeypatch):
    """Many rounds of splitters, with a value that most rows share, find the same ranks."""
    import estatelens.operators.quantiles as Q
    monkeypatch.setattr(Q, "ACCURACY", 20)
    monkeypatch.setattr(Q, "MOST_INSIDE", 5)
    monkeypatch.setattr(Q, "SPLITTERS", 4)
    rng = np.random.default_rng(9)
    rows = [("a", float(v)) for v in rng.normal(0, 1, 3_000).round(3)] + [("b", 4.0)] * 2_000 + [("b", float(v)) for v in rng.normal(4, 1, 900)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p1": 0.1, "p5": 0.5, "p66": 0.66, "p99": 0.99}
    got = {r["k"]: r for r in Q.exact_quantiles(df, ["k"], "v", probs, count_col="n").collect()}
    for k in ("a", "b", None):
        xs = np.array([v for kk, v in rows if kk == k])
        assert got[k]["n"] == len(xs)
        for name, p in probs.items():
            assert abs(got[k][name] - np.quantile(xs, p)) < 1e-9


def test_leave_one_out_weights(spark):
    rng = np.random.default_rng(6)
    rows = [("a" if i % 2 else None, int(rng.integers(0, 3)), float(rng.integers(0, 30))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, f int, v double")
    from estatelens.operators.quantiles import weighted_quantiles
    got = {r["k"]: r for r in weighted_quantiles(df, ["k"], "v", {f"w{f}": (F.col("f") != f).cast("int") for f in range(3)},
                                                 {"m": 0.5, "q": 0.1}, moments=True).collect()}
    for k in ("a", None):
        for f in range(3):
            xs = np.array([v for kk, ff, v in rows if kk == k and ff != f])
            w = got[k][f"w{f}"]
            assert w["n"] == len(xs) and abs(w["m"] - np.median(xs)) < 1e-9 and abs(w["q"] - np.quantile(xs, 0.1)) < 1e-9
            assert abs(w["mean"] - xs.mean()) < 1e-9 and abs(w["std"] - xs.std(ddof=1)) < 1e-9


def test_ranks_survive_ties_over_partitions(spark):
    """Many rows of one leading value spread over partitions keep distinct ranks."""
    df = spark.range(5_000).select(F.lit("g").alias("g"), F.lit(1).alias("v"), "id")
    r = rank_within(df, ["g"], ["v", "id"], "r")
    assert r.where("r != id").count() == 0
