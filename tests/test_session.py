"""Scratch tables, the checkpoint folder on clusters, and the entry without the corpus subpackage."""

import os
import subprocess
import sys

import pytest

from estatelens.session import ensure_checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Option:
        def isDefined(self):  # noqa: N802
            return False

    class Fake:
        """As much of a session as the check reads."""
        conf = Conf()
        master = "spark://host:7077"

        def __init__(self):
            self.sparkContext = self  # noqa: N803
            self._jsc = self

        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return Option()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Fake())


def test_tables_are_released():
    code = ("from estatelens.session import *; import os; s = get_session('local[1]', 1); t = materialize(s.range(5)); "
            "root = ensure_checkpoint_dir(s).removeprefix('file:') + '/tables'; assert len(os.listdir(root)) == 1 and t.count() == 5; "
            "assert release_tables(s) == 1 and os.listdir(root) == []; p = materialize(s.range(6).selectExpr('id', 'id % 2 as k'), by=['k']); "
            "assert p.where('k = 1').count() == 3; s.stop()")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=200, cwd=ROOT)


def test_entry_without_corpus_subpackage(tmp_path):
    """In a copy without the corpus folders the entry imports and has all other queries."""
    import shutil
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = ("import __spark_entry__ as e; q = e.queries(); "
            "assert len(q) > 50 and not any(k.startswith('op1') for k in q) and 'pipeline' not in q; assert e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=100, cwd=copy)


def test_package_reaches_the_workers(tmp_path):
    """A session started elsewhere, whose workers cannot import the package by themselves."""
    code = (f"import sys; sys.path.insert(0, {ROOT!r}); from pyspark.sql import SparkSession; "
            "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); "
            "from estatelens.session import ship_package; ship_package(s); ship_package(s); "
            "f = lambda it: [__import__('estatelens.functions.columns').__name__ for _ in it]; "
            "assert s.sparkContext.parallelize([1], 1).mapPartitions(f).collect() == ['estatelens']; s.stop()")
    subprocess.run([sys.executable, "-c", code], check=True, timeout=200, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_tables_and_shuffles_on_the_way_are_deleted(spark, tmp_path):
    """The copy of all values that quantiles write goes when they are done; a large table's shuffle files go when it is written."""
    import os
    import time

    from pyspark.sql import functions as F

    from estatelens import session
    from estatelens.operators.quantiles import exact_quantiles

    rows = session.materialize(spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v")))
    before = list(session._written)
    q = exact_quantiles(rows.distinct(), ["k"], "v", {"m": 0.5})
    assert session._written[:len(before)] == before
    assert all(spark.read.parquet(p).count() < 1000 for p in session._written[len(before):])
    small = session.finished(spark, lambda: session.materialize(session.materialize(rows.limit(7))))
    assert small.count() == 7 and len([p for p in session._written if spark.read.parquet(p).count() == 7]) == 1
    assert {r["k"]: r["m"] for r in q.collect()} == {0: 499.5, 1: 499.0, 2: 500.0}

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def held() -> int:
        return sum(os.path.getsize(os.path.join(at, f)) for d in local for at, _, files in os.walk(d) for f in files if f.endswith(".data"))

    wide = spark.range(1_200_000).select(F.md5(F.col("id").cast("string")).alias("a"), "id").repartition(4, "a")
    session.materialize(wide)
    session.materialize(spark.range(1))
    end = time.time() + 20
    while held() > 20_000_000 and time.time() < end:
        time.sleep(0.5)
    assert held() < 20_000_000  # the shuffle wrote about 50 MB


def test_training_rows_meet_their_encoders_once(spark):
    """The encoders of all folds joined at once give what a copy of the row for each fold got; ties, nulls and unknown names included."""
    from pyspark.sql import functions as F

    from estatelens.operators.encoders import apply_encoders, apply_training_encoders, fit_encoders
    from estatelens.operators.folds import training_folds
    rows = [(f"{i % 40}", "ab"[i % 2], f"s{i % 3}" if i % 7 else None, f"t{i % 11}" if i % 5 else None, float(i % 13), i % 5) for i in range(90)]
    rows += [("x", "c", "only", "one", 4.0, 2), ("y", None, "s1", "t1", 5.0, 1)]
    df = spark.createDataFrame(rows, "listing_id string, city_key string, sector string, society string, price_per_sqft double, fold int")
    enc = fit_encoders(df, 5)
    want = apply_encoders(df.withColumn("fold", F.explode(training_folds(F.col("fold"), 5))), enc)
    got = apply_training_encoders(df, enc, 5)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.count() == 4 * len(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")  # copied after the joins
