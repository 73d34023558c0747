"""Mixing sources to target weights.

The words of a source, document after document in a fixed order, are packed
into blocks of ``BLOCK_WORDS``.  Each source has a target number of words, and
with it a number of slots in the output.  For every output shard the sources'
counts are drawn from a multinomial; a source's n-th slot over all shards is
mapped through pseudorandom permutations of its block indices (a Feistel
network on the index range, one permutation for each pass over the source), and
slots are joined with blocks by index.  A block comes a second time only when
all others of its source have come once, and no source has more than two
passes, so no document is taken more than twice.

What the draws give a source beyond its slots goes to the sources that the
draws left short, slot for slot, so that the totals are exact to a block.

The document order is (source, hash of the id, id, size), found by a range sort
of sizes, so neither partitions nor cluster change a rerun.  Prefix sums take
one count a partition.  Sources are handled by number; their totals, one row a
source, are the only thing the driver sees.

A null text has size 0; a null source is a source of its own, last; documents
of size 0 are never taken; repeated rows are rows of their own; a table without
words takes nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm import words as W
from estatelens.llm.frames import plain_names
from estatelens.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 128
SHARD_BLOCKS = 4_096
SLOTS_PER_TASK = 100_000
SEED = 20


def targets(sizes: dict, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Target of each source: its share by weight of ``share`` times all sizes, at most ``most`` times its size.

    What a source cannot take is shared among the others by weight, until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)  # Python orders text by code point
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not over:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return {s: max(0.0, out[s]) for s in order}


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Image of each index under a keyed permutation of range(size): a Feistel network, walked until inside the range."""
    half = np.array([max(1, math.ceil(math.log2(max(2, s)) / 2)) for s in np.unique(size).tolist()], np.uint64)
    half = half[np.searchsorted(np.unique(size), size)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(rounds):
            left, right = right, left ^ (W.mix(right + k + np.uint64(r * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _sizes(batches):
    for batch in batches:
        n = [np.diff(c.words()[2]) for c in W.chunks(batch.column("text"))]
        yield batch.drop_columns(["text"]).append_column("size", pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64()))


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row."""
    return docs.select("doc_id", "source", "text").mapInArrow(_sizes, "doc_id long, source string, size long")


def _number(sources: list) -> F.Column:
    """Number of the row's source in the order of the targets."""
    known = [s for s in sources if s is not None]
    if not known:
        return F.lit(0)
    m = F.create_map(*[F.lit(x) for i, s in enumerate(known) for x in (s, i)])
    return F.when(F.col("source").isNull(), len(known)).otherwise(F.element_at(m, F.col("source")))


def _running(batches):
    part, total = TaskContext.get().partitionId(), {}
    for pdf in batches:
        pdf["part"] = part
        pdf["start"] = pdf.groupby("no")["size"].cumsum() - pdf["size"] + pdf["no"].map(total).fillna(0).astype(np.int64)
        for no, n in pdf.groupby("no")["size"].sum().items():
            total[no] = total.get(no, 0) + int(n)
        yield pdf


class Mix:
    """A mix of ``docs``: ``placed`` (rows with their place in their source) and ``takes`` (blocks taken, by pass)."""

    def __init__(self, docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS):
        spark = docs.sparkSession
        self.block_words = block_words
        sized = materialize(word_counts(docs))
        self.sizes = {r[0]: int(r[1]) for r in sized.groupBy("source").agg(F.sum("size")).collect()}  # one row a source
        self.targets = targets(self.sizes)
        self.sources = list(self.targets)
        blocks = [-(-self.sizes[s] // block_words) for s in self.sources]
        slots = [min(MOST * b, round(self.targets[s] * b / self.sizes[s])) if b else 0 for s, b in zip(self.sources, blocks)]
        self.placed = self._place(sized)
        self.takes = self._draw(spark, blocks, slots, seed)

    def _place(self, sized: DataFrame) -> DataFrame:
        rows = sized.withColumn("no", _number(self.sources).cast("int")).withColumn("h", F.xxhash64("doc_id"))
        order = ["no", "h", "doc_id", "size"]
        parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        fields = "doc_id long, source string, size long, no int, h long, part int, start long"
        run = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(_running, fields))
        before = run.groupBy("part", "no").agg(F.sum("size").alias("n"))
        before = before.select("part", "no", (F.sum("n").over(Window.partitionBy("no").orderBy("part")) - F.col("n")).alias("before"))
        return run.join(before, ["part", "no"]).select("doc_id", "source", "size", "no", (F.col("start") + F.col("before")).alias("start"))

    def _draw(self, spark, blocks: list[int], slots: list[int], seed: int) -> DataFrame:
        """(no, block, epoch): one row for each slot."""
        total = sum(slots)
        shards = max(1, -(-total // SHARD_BLOCKS))
        p = np.array(slots, np.float64) / max(total, 1)

        def draw(batches):
            for pdf in batches:
                for shard in pdf["id"].tolist():
                    m = (shard + 1) * total // shards - shard * total // shards
                    n = np.random.default_rng([seed, shard]).multinomial(m, p) if total else np.zeros(len(p), np.int64)
                    yield pd.DataFrame({"shard": shard, "no": np.arange(len(p)), "n": n.astype(np.int64)})

        drawn = materialize(spark.range(shards).mapInPandas(draw, "shard long, no int, n long"))
        ends = drawn.withColumn("hi", F.sum("n").over(Window.partitionBy("no").orderBy("shard")))
        got = {r[0]: int(r[1]) for r in drawn.groupBy("no").agg(F.sum("n")).collect()}  # one row a source
        # ranges of slots: those a source may keep, and the surplus, numbered through, for those left short
        surplus, short = np.zeros(len(slots), np.int64), []
        spare = room = 0
        for no, k in enumerate(slots):
            g = got.get(no, 0)
            surplus[no] = spare - k
            spare += max(0, g - k)
            if g < k:
                short.append((room, no, g))
                room += k - g
        limit, base = np.array(slots, np.int64), surplus

        def spread(batches):
            starts = np.array([x[0] for x in short], np.int64)
            for pdf in batches:
                for no, n, hi, shard in zip(pdf["no"].tolist(), pdf["n"].tolist(), pdf["hi"].tolist(), pdf["shard"].tolist()):
                    if not n:
                        continue
                    j = np.arange(hi - n, hi)
                    own = j < limit[no]
                    src, at = np.full(len(j), no, np.int64), j.copy()
                    if not own.all():
                        rank = j[~own] + base[no]
                        i = np.searchsorted(starts, rank, "right") - 1
                        src[~own] = np.array([x[1] for x in short])[i]
                        at[~own] = np.array([x[2] for x in short])[i] + rank - starts[i]
                    size = np.array(blocks, np.int64)[src]
                    epoch, index = at // size, at % size
                    key = W.mix(src.astype(np.uint64) * np.uint64(64) + epoch.astype(np.uint64) + np.uint64(seed << 32))
                    yield pd.DataFrame({"no": src.astype(np.int32), "block": permute(index, size, key), "epoch": epoch.astype(np.int32),
                                        "shard": shard})

        # a shard's few counts become thousands of slots: dealt by the number of slots, not by the size of the counts
        parts = max(1, -(-total // SLOTS_PER_TASK))
        return ends.repartition(parts, "shard").mapInPandas(spread, "no int, block long, epoch int, shard long")

    def pieces(self) -> DataFrame:
        """(no, start, doc_id, block, lo, hi): words [lo, hi) of a row's text that lie in a block."""
        b = self.block_words
        rows = self.placed.where("size > 0").withColumn(
            "block", F.explode(F.expr(f"sequence(start div {b}, (start + size - 1) div {b})")))
        return rows.select("no", "start", "doc_id", "size", "source", "block",
                           F.greatest(F.col("block") * b - F.col("start"), F.lit(0)).alias("lo"),
                           F.least((F.col("block") + 1) * b - F.col("start"), F.col("size")).alias("hi"))

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every row."""
        times = self.takes.groupBy("no", "block").agg(F.count("*").alias("times"))
        # (a merge join is asked for: what made the slots looks small to the planner, which would broadcast them)
        got = self.pieces().join(times.hint("merge"), ["no", "block"]).groupBy("no", "start").agg(
            F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("taken"))
        size = F.element_at(F.array(*[F.lit(int(self.sizes[s])) for s in self.sources]), F.col("no") + 1)
        target = F.element_at(F.array(*[F.lit(float(t)) for t in self.targets.values()]), F.col("no") + 1)
        rows = self.placed.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
        got = got.withColumnRenamed("start", "at")
        if not self.sources:
            return rows.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
        return rows.join(got, ["no", "at"], "left").select(
            "doc_id", "size", size.cast("long").alias("source_size"), target.alias("target"),
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: one row for each unbroken stretch of a text taken in one pass, columns as in ``docs``.

    ``text`` is the stretch, from its first to its last word as it stands, and
    ``n_chars``, if there, its length.  A whole text comes as it is.  Other
    columns are passed on.
    """
    names, docs = docs.columns, plain_names(docs)
    m = Mix(docs, seed, block_words)
    got = m.pieces().join(m.takes.select("no", "block", "epoch").hint("merge"), ["no", "block"])
    runs = got.groupBy("no", "start", "doc_id", "source", "size", "epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    taken = runs.groupBy("no", "start", "doc_id", "source", "size").agg(F.collect_list("runs").alias("passes"))  # two at most
    # rows with one id are told apart by size; rows alike in both may stand for each other
    taken = taken.select("doc_id", F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), "start", "passes")
    by = Window.partitionBy("doc_id").orderBy(F.col("_mix_source"), F.col("_mix_size"), F.col("start"))
    places = m.placed.select("doc_id", F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), "start")
    places = places.withColumn("_mix_row", F.row_number().over(by)).where("_mix_size > 0")
    same = [places["doc_id"].eqNullSafe(taken["doc_id"]), places["start"] == taken["start"],
            places["_mix_source"].eqNullSafe(taken["_mix_source"]), places["_mix_size"] == taken["_mix_size"]]
    plan = places.join(taken.hint("merge"), same).select(places["doc_id"].alias("_mix_doc"), "_mix_row", F.col("passes").alias("_mix_passes"))
    fields = docs.schema
    sized = docs.mapInArrow(_with_size, _plus(fields, "_mix_size"))
    text_by = Window.partitionBy("doc_id").orderBy(F.col("source"), F.col("_mix_size"))
    sized = sized.withColumn("_mix_row", F.row_number().over(text_by))
    both = sized.join(plan.hint("merge"), [sized["doc_id"].eqNullSafe(plan["_mix_doc"]), sized["_mix_row"] == plan["_mix_row"]])
    return both.select(*docs.columns, "_mix_passes").mapInArrow(_stretches(docs.columns), fields).toDF(*names)


def _plus(fields, name: str):
    from pyspark.sql import types as T
    return T.StructType([*fields.fields, T.StructField(name, T.LongType())])


def _with_size(batches):
    for batch in batches:
        n = [np.diff(c.words()[2]) for c in W.chunks(batch.column("text"))]
        yield batch.append_column("_mix_size", pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64()))


def _stretches(columns: list[str]):
    def run(batches):
        for batch in batches:
            passes, rows, texts = batch.column("_mix_passes").to_pylist(), [], []
            for chunk in W.chunks(batch.column("text")):
                start, end, first = chunk.words()
                for i in range(len(chunk)):
                    s, e = start[first[i]:first[i + 1]], end[first[i]:first[i + 1]]
                    for runs in passes[chunk.lo + i]:
                        merged: list[list[int]] = []
                        for r in runs:
                            if merged and merged[-1][1] == r["lo"]:
                                merged[-1][1] = r["hi"]
                            else:
                                merged.append([r["lo"], r["hi"]])
                        for lo, hi in merged:
                            whole = lo == 0 and hi == len(s)
                            a, b = (chunk.off[i], chunk.off[i + 1]) if whole else (s[lo], e[hi - 1])
                            rows.append(chunk.lo + i)
                            texts.append(chunk.data[a:b].tobytes().decode("utf-8", "replace"))
            out = batch.take(pa.array(rows, pa.int64())).select(columns)
            at = out.schema.get_field_index("text")
            out = out.set_column(at, "text", pa.array(texts, out.schema.field(at).type))
            if "n_chars" in columns:
                at = out.schema.get_field_index("n_chars")
                out = out.set_column(at, "n_chars", pa.array([len(t) for t in texts]).cast(out.schema.field(at).type))
            yield out
    return run
