"""CSV feed reading with NA tokens, report writing, registry joins."""

import tempfile

import pytest

from estatelens.sources.feeds import cities_table, read_raw_csv, unknown_cities, write_report


def test_read_raw_csv_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="estatelens-csv-", dir="/tmp")
    with open(f"{d}/feed.csv", "w") as fh:
        fh.write("price,area,bedRoom\n1.2,1500,3\nNA,,n/a\n0.9, 875 ,None\n")
    rows = read_raw_csv(spark, f"{d}/feed.csv").collect()
    assert [tuple(r) for r in rows] == [("1.2", "1500", "3"), (None, None, None), ("0.9", " 875 ", None)]


def test_write_report_refuses_nan(spark):
    d = tempfile.mkdtemp(prefix="estatelens-rep-", dir="/tmp")
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    with pytest.raises(ValueError):
        write_report(df, f"{d}/r")
    write_report(spark.createDataFrame([(1.0,)], "x double"), f"{d}/ok")


def test_registry(spark):
    cities = cities_table(spark, [("gurgaon", "Gurgaon")], [("pune", "Pune")])
    listings = spark.createDataFrame([("gurgaon",), ("mumbai",)], "city_key string")
    assert [r[0] for r in unknown_cities(listings, cities).collect()] == ["mumbai"]


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    """A write that dies half-way leaves readers with the version before; the next one goes on from it."""
    from pyspark.sql import functions as F

    from estatelens.sources import versions as V
    root = str(tmp_path / "store")
    assert V.current(spark, root) is None
    one = spark.createDataFrame([("a", 1), ("b", 2)], "city_key string, x int")
    V.commit(spark, root, {"listings": one, "metrics": one.limit(1)})
    bound = V.current(spark, root)
    broken = one.withColumn("x", F.when(F.col("city_key") == "b", F.raise_error(F.lit("lost"))).otherwise(F.lit(9)).cast("int"))
    with pytest.raises(Exception, match="lost"):
        V.commit(spark, root, {"metrics": one, "listings": broken})
    assert V.current(spark, root) == bound
    assert sorted(map(tuple, V.current(spark, root).read(spark, "listings").collect())) == [("a", 1), ("b", 2)]
    # only one city is replaced; tables that are not named stay; a reader bound before sees the old rows
    new = V.commit(spark, root, {"listings": spark.createDataFrame([("b", 7), ("c", 3)], "city_key string, x int")}, by={"listings": "city_key"})
    assert new.number == bound.number + 1 and new.tables["metrics"] == bound.tables["metrics"]
    assert sorted(map(tuple, new.read(spark, "listings").collect())) == [("a", 1), ("b", 7), ("c", 3)]
    assert sorted(map(tuple, bound.read(spark, "listings").collect())) == [("a", 1), ("b", 2)]
    # the number of a version is taken once
    files = V._Files(spark, root)
    with pytest.raises(RuntimeError, match="another writer"):
        files.publish(V._manifest(new.number), "{}")
    assert V.vacuum(spark, root, keep=1) >= 2  # the old listings, and what the broken write left
    assert V.current(spark, root) == new and new.read(spark, "metrics").count() == 1


def test_a_missing_table_is_built_once(spark, tmp_path):
    from estatelens.sources import versions as V
    root, built = str(tmp_path / "store"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert V.read_or_build(spark, root, "processed", build).count() == 3
    assert V.read_or_build(spark, root, "processed", build).count() == 3 and built == [1]
    assert V.current(spark, root).read(spark, "nothing") is None
