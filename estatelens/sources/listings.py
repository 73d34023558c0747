"""The listing feeds this engine is tested on, derived from the driver's tables.

A listing is a line item: the region is the city, the nation the locality
("sector") and the supplier the building ("society").  Every column is a pure
function of one joined row plus a hash of its provenance key, so the same view
can be written in DuckDB SQL (see ``estatelens.plans.oracle``) and compared
value for value.

``raw_listings``   a raw feed: camel-case column names, exact copies, missing
                   prices, placeholder labels and free-text variants.
``signal_listings`` a cleaned-shape feed whose prices follow location, size
                   and a bedroom premium, so that a model can learn them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatelens.session import materialize
from estatelens.sources.tables import read_table

# Order priority -> possession label, in priority order.
PRIORITY_TO_AGE = {
    "1-URGENT": "Under Construction",
    "2-HIGH": "New Property",
    "3-MEDIUM": "Relatively New",
    "4-NOT SPECIFIED": "Moderately Old",
    "5-LOW": "Old Property",
}
# Raw basis labels as a feed writes them (inner double blanks kept).
AREA_TYPE_LABELS = ("Super built-up  Area", "Carpet  Area", "Built Up  Area")


def hash_bucket(listing_id: Column) -> Column:
    """First 32 bits of the hex md5 key, as a non-negative BIGINT."""
    return F.conv(F.substring(listing_id, 1, 8), 16, 10).cast("bigint")


def shuffled(df: DataFrame) -> bool:
    """Whether the planner shuffles the sides of a join of ``df``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the dimension columns a listing needs (pruned reads)."""
    li = read_table(spark, sf_dir, "lineitem", columns=[
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"])
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    # names change case once a nation, not once a listing
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", F.lower("n_name").alias("_n_lower"),
                                                        F.upper("n_name").alias("_n_upper"))
    region = read_table(spark, sf_dir, "region").select("r_regionkey", F.lower("r_name").alias("_r_lower"))
    # orders / part / supplier grow with the data: the planner decides from
    # their measured size whether a broadcast is possible.
    grown = (li.join(orders, li.l_orderkey == orders.o_orderkey)
               .join(part, li.l_partkey == part.p_partkey)
               .join(supplier, li.l_suppkey == supplier.s_suppkey).drop("o_orderkey", "p_partkey", "s_suppkey"))
    # line items that were shuffled to meet them are written, so that those shuffles' files go before the feed is shuffled again
    if shuffled(grown):
        grown = materialize(grown)
    return (grown.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
                 .join(region, F.col("n_regionkey") == F.col("r_regionkey")))


def _provenance(df: DataFrame) -> DataFrame:
    key = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                      F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyy-MM-dd"))
    return df.withColumn("listing_id", F.md5(key)).withColumn("_h", hash_bucket(F.col("listing_id")))


def _common_columns(h: Column) -> dict[str, Column]:
    age = F.lit(None).cast("string")
    for prio, label in PRIORITY_TO_AGE.items():
        age = F.when(F.col("o_orderpriority") == prio, F.lit(label)).otherwise(age)
    balcony_pick = F.pmod(F.floor(h / 7), F.lit(6))
    balcony = (F.when(balcony_pick == 0, "0").when(balcony_pick == 1, "1")
                .when(balcony_pick == 2, "2").when(balcony_pick == 3, "3")
                .when(balcony_pick == 4, "3+"))
    no_flags = F.col("l_discount") == 0
    area_type_pick = F.pmod(h, F.lit(4))
    area_type = (F.when(F.pmod(h, F.lit(17)) == 0, F.lit(None).cast("string"))
                  .when(area_type_pick <= 1, AREA_TYPE_LABELS[0])
                  .when(area_type_pick == 2, AREA_TYPE_LABELS[1])
                  .otherwise(AREA_TYPE_LABELS[2]))
    return {
        "city_key": F.col("_r_lower"),
        "sector": F.col("_n_lower"),
        "society": F.when(F.pmod(h, F.lit(13)) == 0, F.lit(None).cast("string")).otherwise(F.col("s_name")),
        "property_type": F.when(F.col("l_linestatus") == "F", "house").otherwise("flat"),
        "area": F.col("l_quantity") * 100.0,
        "bedrooms": (F.pmod(F.col("p_size"), F.lit(5)) + 1).cast("int"),
        "bathrooms": F.col("l_linenumber").cast("int"),
        "balcony": balcony,
        "furnishing_type": F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
                            .when(F.col("l_returnflag") == "R", 2).cast("int"),
        "age_possession": F.when(F.pmod(h, F.lit(11)) == 0, F.lit("Undefined")).otherwise(age),
        "luxury_score": (F.col("p_size") * 3).cast("int"),
        "lift": F.when(no_flags, -1).otherwise(F.pmod("l_partkey", F.lit(2))).cast("int"),
        "parking": F.when(no_flags, -1).otherwise(F.pmod("l_suppkey", F.lit(2))).cast("int"),
        "gym": F.when(no_flags, -1).otherwise(F.pmod("l_linenumber", F.lit(2))).cast("int"),
        "is_resale": F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int"),
        "area_type": area_type,
    }


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw feed (camel-case names as delivered), exact copies included.

    Rows whose hash is a multiple of 50 appear twice, as a scraped feed
    repeats listings.  ``listing_id`` is the provenance key of the source row;
    it is not part of the feed's own columns (dedup ignores it).
    """
    df = _provenance(_joined(spark, sf_dir))
    h = F.col("_h")
    c = _common_columns(h)
    price = F.when(F.pmod(h, F.lit(97)) == 0, F.lit(None).cast("double")).otherwise(F.col("l_extendedprice") / 1e4)
    area_int = (F.col("l_quantity") * 100).cast("int")
    area_text = (F.when(F.pmod(h, F.lit(10)) == 0,
                        F.concat((area_int - 100).cast("string"), F.lit(" - "), (area_int + 100).cast("string")))
                  .when(F.pmod(h, F.lit(23)) == 0,
                        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("Sq. Meter")))
                  .otherwise(area_int.cast("string")))
    locality_pick = F.pmod(h, F.lit(3))
    locality_raw = (F.when(locality_pick == 0, F.concat(F.lit("  "), "_n_upper"))
                     .when(locality_pick == 1, F.concat(F.col("n_name"), F.lit("\t  ")))
                     .otherwise(F.col("_n_lower")))
    size_label = F.when(F.pmod(h, F.lit(19)) == 0, F.lit("studio")).otherwise(
        F.concat(c["bedrooms"].cast("string"), F.lit(" BHK")))
    out = df.select(
        "listing_id",
        c["city_key"].alias("city_key"),
        c["property_type"].alias("property_type"),
        c["society"].alias("society"),
        c["sector"].alias("sector"),
        price.alias("price"),
        (F.col("l_extendedprice") * 1e3 / (F.col("l_quantity") * 100.0)).alias("price_per_sqft"),
        c["area"].alias("area"),
        c["bedrooms"].alias("bedRoom"),
        c["bathrooms"].alias("bathroom"),
        c["balcony"].alias("balcony"),
        c["age_possession"].alias("agePossession"),
        c["furnishing_type"].alias("furnishing_type"),
        c["luxury_score"].alias("luxury_score"),
        c["lift"].alias("lift"), c["parking"].alias("parking"), c["gym"].alias("gym"),
        c["is_resale"].alias("is_resale"),
        c["area_type"].alias("area_type"),
        locality_raw.alias("locality_raw"),
        area_text.alias("area_text"),
        size_label.alias("size_label"),
        (price * 100).alias("price_lakh"),
        # rows whose hash is a multiple of 50 are delivered twice
        F.explode(F.when(F.pmod(h, F.lit(50)) == 0, F.array(F.lit(0), F.lit(1)))
                   .otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return out.drop("_copy")


def signal_listings(spark: SparkSession, sf_dir: str, bedroom_effect: bool = True,
                    society_effect: bool = True) -> DataFrame:
    """Cleaned-shape listings whose price is learnable.

    ppsf = nation rate x bedroom premium x building factor x small noise.
    Dropping the bedroom and building factors leaves a market the locality
    median already prices up to the noise (the "rule wins" case).
    """
    df = _provenance(_joined(spark, sf_dir))
    h = F.col("_h")
    c = _common_columns(h)
    ppsf = (F.lit(6000.0) + 500.0 * F.col("n_nationkey"))
    if bedroom_effect:
        ppsf = ppsf * (1 + 0.18 * (c["bedrooms"] - 3))
    if society_effect:
        ppsf = ppsf * (0.8 + 0.4 * F.pmod("l_suppkey", F.lit(100)) / 100.0)
    ppsf = ppsf * (1 + (F.pmod(F.floor(h / 5), F.lit(2001)) - 1000) / 20000.0)
    area = c["area"]
    furn = F.when(c["furnishing_type"] == 0, "unfurnished").when(c["furnishing_type"] == 1, "semi-furnished") \
            .when(c["furnishing_type"] == 2, "furnished")
    return df.select(
        "listing_id",
        c["city_key"].alias("city_key"),
        c["property_type"].alias("property_type"),
        c["society"].alias("society"),
        c["sector"].alias("sector"),
        (area * ppsf / 1e7).alias("price"),
        ppsf.alias("price_per_sqft"),
        area.alias("area"),
        c["bedrooms"].alias("bedrooms"),
        c["bathrooms"].alias("bathrooms"),
        c["balcony"].alias("balcony"),
        F.nullif(c["age_possession"], F.lit("Undefined")).alias("age_possession"),
        furn.alias("furnishing_type"),
        c["luxury_score"].alias("luxury_score"),
    )
