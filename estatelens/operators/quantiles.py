"""Exact grouped quantiles by rank selection, and ranks by one distributed sort.

``percentile`` in Spark keeps a value -> count map per group and merges it in
a single task, so one city holding a third of all listings would put a third
of all distinct prices into one task's memory.  Here no value is sorted but the
few near a wanted rank:

1. one aggregate with a map-side part takes, of every group, the number of rows
   and a bounded sketch, whose values a little below and a little above each
   wanted rank bound an interval that holds it;
2. a second one counts, exactly, the rows below each interval and passes on the rows
   inside; that the interval holds the rank is checked, not assumed;
3. those are counted by value; intervals with more than ``MOST_INSIDE`` values are cut again, between
   sampled splitters, until every one is small, and the values at ranks
   ``floor((n-1)p)`` and ``ceil((n-1)p)`` are picked, interpolated linearly as
   pandas, numpy and DuckDB's ``quantile_cont`` do.

The plan is the same for every size.  Ranks (``rank_within``, ``running_count``) use a
range sort of whole rows, written once.  Nulls and NaN have no rank.  Groups
with no value produce no row; callers left-join and fill.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.session import Passing, materialize


ACCURACY = 2_000         # of the sketch: ranks are within a two-thousandth of the group; a task's sketches grow with it
MOST_INSIDE = 200_000    # values of an interval that are ranked in one task
SPLITTERS = 64


def _same(keys: Sequence[str], prefix: str) -> list[Column]:
    """NULL-safe equality of each key with its copy of another name."""
    return [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)]


def _offsets(held: DataFrame, keys: list[str], name: str, count: Column) -> DataFrame:
    """``held`` (with its partition in ``_pid``) plus the sum ``_off_<name>`` of ``count`` over the group's earlier partitions."""
    seg = held.groupBy("_pid", *keys).agg(F.sum(count).alias("_p"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select(F.col("_pid").alias("_sp"), *[F.col(k).alias(f"_sk{i}") for i, k in enumerate(keys)],
                     F.coalesce(F.sum("_p").over(before), F.lit(0)).alias(f"_off_{name}"))
    cond = [F.col("_pid") == F.col("_sp"), *_same(keys, "_sk")]
    return held.join(seg, cond).drop("_sp", *[f"_sk{i}" for i in range(len(keys))])


def _interpolate(vlo, vhi, d):
    # numpy's linear interpolation (what pandas' quantile uses), written from
    # the nearer end so that it is monotone and exact at d = 0 / 1
    return F.when(d == 0, vlo).when(d >= 0.5, vhi - (vhi - vlo) * (1 - d)).otherwise(vlo + (vhi - vlo) * d)


def key_join(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of the one row of ``small`` that has their keys (NULL keys are equal)."""
    named = small.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys])
    cond = _same(keys, "_k") or [F.lit(True)]
    return rows.join(named, cond).drop(*[f"_k{i}" for i in range(len(keys))])


def is_scan(df: DataFrame) -> bool:
    """Whether reading ``df`` again is only a scan of files."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Relation" in plan and not any(x in plan for x in ("Join", "Aggregate", "Window", "Sort", "Repartition", "Distinct", "Deduplicate", "MapIn"))


def _refined(values: DataFrame, group: list[str]) -> DataFrame:
    """Values of intervals (``_v``, its rows ``_c``, wanted ranks ``_lo`` and ``_hi``) cut down until none has more than ``MOST_INSIDE``."""
    while True:
        size = materialize(values.groupBy(*group).agg(
            F.count("*").alias("_n"), F.array_distinct(F.percentile_approx("_v", [i / SPLITTERS for i in range(SPLITTERS + 1)], 20 * SPLITTERS)).alias("_cuts")))
        if size.where(F.col("_n") > MOST_INSIDE).isEmpty():
            return values
        # rows up to each splitter, from the rows between neighbouring ones
        held = key_join(values, size.select(*group, "_cuts"), group)
        held = held.withColumn("_slot", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
        counts = held.groupBy(*group, "_slot").agg(F.sum("_c").alias("_rows"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        upto = counts.withColumn("_upto", F.sum("_rows").over(Window.partitionBy(*group).orderBy("_slot")))
        before = F.col("_upto") - F.col("_rows")
        # the slots that hold the two ranks
        bounds = upto.where((F.col("_upto") > F.col("_lo")) & (before <= F.col("_hi"))).groupBy(*group).agg(
            F.min("_slot").alias("_from"), F.max("_slot").alias("_to"), F.min(before).alias("_off"))
        kept = key_join(held, bounds, group).where((F.col("_slot") >= F.col("_from")) & (F.col("_slot") <= F.col("_to")))
        values = materialize(kept.select(*group, "_v", "_c", (F.col("_lo") - F.col("_off")).alias("_lo"), (F.col("_hi") - F.col("_off")).alias("_hi")))


def weighted_quantiles(df: DataFrame, keys: Sequence[str], value: str, weights: Mapping[str, Column],
                       probs: Mapping[str, float], moments: bool = False) -> DataFrame:
    """One row per group: for every weight ``w`` a struct column with the
    quantiles of ``value`` (named as in ``probs``) and ``n``, over the rows
    whose ``w`` is 1 (it is 0 for the others); with ``moments`` also ``mean`` and ``std`` (sample).

    Several weights share the passes: leaving out each of k folds in turn costs
    k sketches and k counts, not k copies of the rows.  Where the values had to be copied, the result is written and the copy deleted.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"), *[w.alias(f"_w_{t}") for t, w in weights.items()])
    with Passing(df.sparkSession) as copy:
        if not is_scan(df):
            base = materialize(base)
    # how far from a wanted share the ends of its interval lie: two ranks at least, beside the sketch's error
    margins = [2 / ACCURACY]
    while margins[-1] < 1:
        margins.append(8 * margins[-1])
    ends = sorted({e for p in probs.values() for m in margins for e in (p - m, p + m) if 0 < e < 1}) or [0.5]
    aggs = []
    for t in weights:
        own = F.when(F.col(f"_w_{t}") > 0, F.col("_v"))
        aggs += [F.count(own).alias(f"_n_{t}"), F.percentile_approx(own, ends, ACCURACY).alias(f"_q_{t}"), F.min(own).alias(f"_min_{t}"), F.max(own).alias(f"_max_{t}")]
        if moments:
            aggs += [F.avg(own).alias(f"_mean_{t}"), F.when(F.count(own) > 1, F.stddev_samp(own)).alias(f"_std_{t}")]
    about = materialize(base.groupBy(*keys).agg(*aggs))

    # one interval for each weight and probability, as plain columns
    names = list(probs)
    places = [(t, i) for t in weights for i in range(len(names))]
    ranges, ranks = [], []
    for j, (t, i) in enumerate(places):
        n, p = F.col(f"_n_{t}"), float(probs[names[i]])
        a, b = F.col(f"_min_{t}"), F.col(f"_max_{t}")
        for m in reversed(margins):  # the narrowest that is wide enough
            a = F.when(n * m >= 2, F.col(f"_q_{t}")[ends.index(p - m)] if p - m in ends else F.col(f"_min_{t}")).otherwise(a)
            b = F.when(n * m >= 2, F.col(f"_q_{t}")[ends.index(p + m)] if p + m in ends else F.col(f"_max_{t}")).otherwise(b)
        ranges += [a.alias(f"_a{j}"), b.alias(f"_b{j}")]
        ranks.append(F.struct(F.floor((n - 1) * p).alias("lo"), F.ceil((n - 1) * p).alias("hi")))
    rows = key_join(base, about.select(*keys, *ranges), keys)
    mine = [F.col(f"_w_{t}") > 0 for t, _ in places]
    below = [F.count_if(w & (F.col("_v") < F.col(f"_a{j}"))) for j, w in enumerate(mine)]
    under = rows.groupBy(*keys).agg(F.array(*below).alias("_below"))
    held = [w & F.col("_v").between(F.col(f"_a{j}"), F.col(f"_b{j}")) for j, w in enumerate(mine)]
    near = rows.where(functools.reduce(operator.or_, [F.coalesce(h, F.lit(False)) for h in held]))
    near = near.select(*keys, "_v", F.explode(F.array_compact(F.array(*[F.when(h, F.lit(j)) for j, h in enumerate(held)]))).alias("_j"))
    which = lambda part: F.array(*[F.lit(place[part]) for place in places])[F.col("_j")]
    near = near.select(*keys, which(0).alias("_t"), which(1).alias("_i"), "_j", "_v")
    group = [*keys, "_t", "_i", "_j"]
    # a value that many rows share is one row from here on
    inside = near.groupBy(*group, "_v").agg(F.count("*").alias("_c"))
    inside = key_join(inside, key_join(under, about.select(*keys, F.array(*ranks).alias("_ranks")), keys), keys)
    off = F.col("_below")[F.col("_j")]
    inside = inside.select(*group, "_v", "_c", *[(F.col("_ranks")[F.col("_j")][r] - off).alias(f"_{r}") for r in ("lo", "hi")])
    counted = _refined(materialize(inside), group)

    # the values at the two ranks
    counted = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*group).orderBy("_v")))
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_c") <= F.col(rank)) & (F.col(rank) < F.col("_upto")), F.col("_v")))
    picked = counted.groupBy(*group).agg(F.struct(at("_lo").alias("lo"), at("_hi").alias("hi")).alias("_p"))
    # an interval that does not hold its ranks has no values there: the query fails rather than return another value
    sure = F.when(F.col("_p.lo").isNull() | F.col("_p.hi").isNull(), F.raise_error(F.lit("a rank lies outside its interval")).cast("double"))
    picked = picked.select(*group, F.struct(F.coalesce(sure, F.col("_p.lo")).alias("lo"), F.col("_p.hi")).alias("_p"))
    picked = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_j", "_p"))).alias("_picked"))  # weights x probs a group
    out = []
    for t in weights:
        n, fields = F.col(f"_n_{t}"), []
        for i, name in enumerate(names):
            pos, p = (n - 1) * float(probs[name]), F.col("_picked")[places.index((t, i))]
            fields.append(_interpolate(p["lo"], p["hi"], pos - F.floor(pos)).alias(name))
        if moments:
            fields += [F.col(f"_mean_{t}").alias("mean"), F.col(f"_std_{t}").alias("std")]
        out.append(F.when(n > 0, F.struct(*fields, n.alias("n"))).alias(t))
    found = key_join(about, picked, keys).select(*keys, *out)
    found = found.where(F.coalesce(*[F.col(f"{t}.n") for t in weights]).isNotNull())
    if copy.paths:
        found = materialize(found)
        copy.drop()
    return found


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float], count_col: str | None = None) -> DataFrame:
    """One row per group: ``keys``, one column per ``probs`` entry, and the
    number of non-null values when ``count_col`` is given."""
    q = weighted_quantiles(df, keys, value, {"_q": F.lit(1)}, probs)
    cols = [F.col(f"_q.{name}").alias(name) for name in probs]
    if count_col:
        cols.append(F.col("_q.n").alias(count_col))
    return q.select(*keys, *cols)


def multi_quantiles(df: DataFrame, keys: Sequence[str], spec: Mapping[str, Mapping[str, float]],
                    count_prefix: str | None = None) -> DataFrame:
    """Quantiles of several columns per group with one distributed sort.

    ``spec`` maps a column to ``{output name: probability}``.  The columns
    are stacked into ``(keys, column, value)`` rows, ranked together, and
    pivoted back to one row per group.  With ``count_prefix`` a
    ``<prefix><column>`` count of non-null values is added per column.
    """
    keys = list(keys)
    stacked = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_val")) for c in spec])).alias("_s")) \
        .select(*keys, "_s._col", "_s._val")
    # ranks are per (keys, column); every probability is asked of every column
    # and the unwanted pairs are dropped after the pivot.
    all_probs = {f"_p{i}": p for i, p in enumerate(sorted({p for named in spec.values() for p in named.values()}))}
    q = exact_quantiles(stacked, keys + ["_col"], "_val", all_probs, count_col="_n")
    by_p = {p: name for name, p in all_probs.items()}
    aggs = []
    for c, named in spec.items():
        for name, p in named.items():
            aggs.append(F.max(F.when(F.col("_col") == c, F.col(by_p[p]))).alias(name))
        if count_prefix is not None:
            aggs.append(F.coalesce(F.max(F.when(F.col("_col") == c, F.col("_n"))), F.lit(0)).alias(f"{count_prefix}{c}"))
    return q.groupBy(*keys).agg(*aggs)


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence, flag: Column, name: str) -> DataFrame:
    """Add how many rows with ``flag`` (0 or 1) stand before each row of its
    ``keys`` group under ``order`` (columns or sort expressions; make it a
    total order, e.g. end with a unique id)."""
    keys = list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    held = materialize(df.withColumn("_f", flag).repartitionByRange(*[F.col(k) for k in keys], *order)
                       .withColumn("_pid", F.spark_partition_id()))
    rows = _offsets(held, keys, "f", F.col("_f"))
    here = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.col("_off_f") + F.sum("_f").over(here) - F.col("_f")).drop("_pid", "_f", "_off_f")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence, rank_col: str = "_rank") -> DataFrame:
    """Add the 0-based position of every row inside its ``keys`` group under ``order`` (a total order)."""
    return running_count(df, keys, order, F.lit(1), rank_col)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, k: int,
                    rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group under ``order`` with a 1-based rank.

    Spark cuts every partition to ``k`` rows a group before the shuffle
    (WindowGroupLimit), so the last task of a group sees partitions x k rows.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank_col, rank).where(F.col(rank_col) <= k)
