"""Ranked lexical search by Block-Max MaxScore over sharded inverted lists.

``build_index`` cuts the documents into shards of about ``SHARD_BYTES`` of text and writes one row for each shard and
term: postings in blocks of ``BLOCK`` documents, compressed (gaps and occurrences as variable-length bytes), and beside
them, uncompressed, each block's last document and greatest impact and the list's greatest impact.  A shard's documents
(ids and lengths) are one more row, without a term.

``search`` joins the terms of a block of queries with the index and runs every query on every shard:

* lists are ordered by bound (weight times greatest impact); the longest run of small lists whose bounds together stay
  below the score of the k-th document found so far is non-essential, the others are essential;
* documents of a range of ``RANGE`` that stand in an essential list are scored on those lists;
* the non-essential lists follow from the greatest bound on: a document goes on only if what it has and the bounds left can
  reach the k-th score, and a block is decompressed only if, with the block's own greatest impact, one of its documents still can.

The k best of every shard are merged by a ranking that Spark cuts to k rows a query in each task first.  All arithmetic but
the weights' logarithm is on 64-bit integers, so scores are exact whatever the shards.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, with only A-Z lower-cased.  A null or empty
text has none, and such a document is not counted.  Rows with one id, equal or not, are documents of their own; a null id
comes last among equal scores.  Queries with one id are one query with the terms of all its texts; a query without terms, or
whose terms no document holds, has no rows.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm import words as W
from estatelens.session import materialize

K = 10
SHARD_BYTES = 16 << 20
BLOCK = 128
RANGE = 4096
#: terms of the queries that go over the index together; what is broadcast holds no more
QUERY_TERMS = 100_000

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = ("shard string, term string, df long, bound long, last binary, top binary, off binary, data binary, ids array<long>")


def _chunk(data: np.ndarray, off: np.ndarray) -> W.Chunk:
    chunk = W.Chunk(0, len(off) - 1, data, off, lower=True)
    chunk.space = ~_TERM[chunk.data]  # what separates terms
    return chunk


def _sizes(batches):
    for batch in batches:
        n, terms = 0, 0
        for c in W.chunks(batch.column("text")):
            size = np.diff(_chunk(c.data, c.off).words()[2])
            n, terms = n + int((size > 0).sum()), terms + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([terms])], ["n", "terms"])


def length_term(size: np.ndarray, n: int, terms: int) -> np.ndarray:
    """What a document's length adds to the denominator of its impacts."""
    return 100 - 90 + (90 * size * n) // terms


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def pack_numbers(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each number and the end): seven bits a byte, the top bit where another follows."""
    v = v.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        size += v >> np.uint64(bits) > 0
    off = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(off[-1], np.uint8)
    for j in range(int(size.max()) if len(v) else 0):
        has = size > j
        out[off[:-1][has] + j] = ((v[has] >> np.uint64(7 * j)) & np.uint64(127)) | (np.uint64(128) * (size[has] > j + 1))
    return out, off


def unpack_numbers(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    at = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * at), first) if len(data) else np.zeros(0, np.int64)


def _slices(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """One binary value for the values between two cuts."""
    off = (cut * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))])


def _shard_rows(shard: str, ids: pa.Array, texts: pa.Array, n: int, terms: int) -> pa.RecordBatch:
    """The index rows of one shard: its documents, then a row a term."""
    chunk = _chunk(*W.text_buffer(texts))
    start, end, first = chunk.words()
    size = np.diff(first)
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    all_terms = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(chunk.data[~chunk.space])])
    coded = all_terms.dictionary_encode()
    doc = np.repeat(np.arange(len(size)), size)
    place, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * max(1, len(size)) + doc, return_counts=True)
    term, doc = place // max(1, len(size)), place % max(1, len(size))
    value = impact(tf.astype(np.int64), length_term(size, n, terms)[doc])
    # where lists and their blocks begin
    lists = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    df = np.diff(np.append(lists, len(term)))
    within = np.arange(len(term)) - np.repeat(lists, df)
    block = np.flatnonzero(within % BLOCK == 0)
    gap = np.diff(doc, prepend=0)
    gap[block] = doc[block]
    data, byte = pack_numbers(np.stack([gap, tf], 1).ravel())
    block_cut = np.concatenate([[0], np.cumsum((df + BLOCK - 1) // BLOCK)])
    ends = np.append(block[1:], len(term)) - 1
    top = np.maximum.reduceat(value, block).astype(np.int32) if len(block) else np.zeros(0, np.int32)
    from_byte = byte[2 * block] - np.repeat(byte[2 * lists], np.diff(block_cut))
    best = np.maximum.reduceat(value, lists) if len(lists) else np.zeros(0, np.int64)
    k = len(lists)
    head = _slices(size.astype(np.int64), np.array([0, len(size)]))

    def column(values: pa.Array, own: pa.Array) -> pa.Array:
        return pa.concat_arrays([own, values])

    none = pa.nulls(1, pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array([shard] * (k + 1)), column(coded.dictionary.take(pa.array(term[lists])).cast(pa.string()), pa.nulls(1, pa.string())),
        column(pa.array(df.astype(np.int64)), pa.array([len(size)], pa.int64())), column(pa.array(best.astype(np.int64)), pa.nulls(1, pa.int64())),
        column(_slices(doc[ends].astype(np.int32), block_cut), none), column(_slices(top, block_cut), none),
        column(_slices(from_byte.astype(np.uint32), block_cut), none), column(_slices(data, np.append(byte[2 * lists], len(data))), head),
        pa.concat_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64()))])],
        ["shard", "term", "df", "bound", "last", "top", "off", "data", "ids"])


def _index(n: int, terms: int):
    def run(batches):
        task, shard, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            return _shard_rows(f"{task}-{shard}", table.column("doc_id").combine_chunks(), table.column("text"), n, terms)

        for batch in batches:
            lo, data = 0, W.text_buffer(batch.column("text"))[1]
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(data, data[lo] + SHARD_BYTES - size, "right")) - 1)
                held.append(batch.slice(lo, hi - lo))
                size += int(data[hi] - data[lo])
                lo = hi
                if lo < batch.num_rows:
                    yield flush()
                    shard, held, size = shard + 1, [], 0
            if size >= SHARD_BYTES:
                yield flush()
                shard, held, size = shard + 1, [], 0
        if held:
            yield flush()
    return run


class Index:
    """A written index: ``rows`` (see ``INDEX``), the number ``n`` of documents with a term and of all their ``terms``."""

    def __init__(self, rows: DataFrame, n: int, terms: int):
        self.rows, self.n, self.terms = rows, n, terms


def build_index(docs: DataFrame) -> Index:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, terms = docs.select("text").mapInArrow(_sizes, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    n, terms = n or 0, terms or 0
    return Index(materialize(docs.mapInArrow(_index(n, max(1, terms)), INDEX)), n, terms)


class _List:
    """One term's postings in a shard; blocks are decompressed when asked for, once."""

    def __init__(self, bound: int, last: bytes, top: bytes, off: bytes, data: bytes, m: np.ndarray):
        self.bound, self.m = bound, m
        self.last, self.top = np.frombuffer(last, np.int32), np.frombuffer(top, np.int32).astype(np.int64)
        self.off, self.data = np.append(np.frombuffer(off, np.uint32).astype(np.int64), len(data)), np.frombuffer(data, np.uint8)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of block ``i``."""
        if i not in self.open:
            pairs = unpack_numbers(self.data[self.off[i]:self.off[i + 1]]).reshape(-1, 2)
            docs = np.cumsum(pairs[:, 0])
            self.open[i] = docs, impact(pairs[:, 1], self.m[docs])
        return self.open[i]

    def blocks(self, which) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(i) for i in which]
        return parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def max_score(lists: list[tuple[int, _List]], ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` best documents of a shard with a score above 0, best first, ties by ``ids``; ``lists`` holds
    (weight, list)."""
    lists = sorted((x for x in lists if x[0] * x[1].bound > 0), key=lambda x: x[0] * x[1].bound)
    upto = np.concatenate([[0], np.cumsum([w * p.bound for w, p in lists])])  # bounds of the lists before
    best, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for lo in range(0, len(ids) if lists else 0, RANGE):
        split = int(np.searchsorted(upto[1:], least, "left"))  # lists before it cannot reach the k-th score by themselves
        if split == len(lists):
            break
        score = np.zeros(min(RANGE, len(ids) - lo), np.int64)
        for w, p in lists[split:]:
            a, b = np.searchsorted(p.last, [lo, lo + RANGE - 1])
            if a < len(p.last):
                docs, value = p.blocks(range(int(a), int(min(b + 1, len(p.last)))))
                x, y = np.searchsorted(docs, [lo, lo + RANGE])
                score[docs[x:y] - lo] += w * value[x:y]
        live = np.flatnonzero(score)
        for i in range(split - 1, -1, -1):
            live = live[score[live] + upto[i + 1] >= least]
            if not len(live):
                break
            w, p = lists[i]
            at = np.searchsorted(p.last, live + lo)
            has = at < len(p.last)
            top = np.zeros(len(live), np.int64)
            top[has] = w * p.top[at[has]]
            can = score[live] + top + upto[i] >= least
            live, at = live[can], at[can]
            look = at < len(p.last)
            if look.any():
                docs, value = p.blocks(np.unique(at[look]).tolist())
                spot = np.minimum(np.searchsorted(docs, live + lo), len(docs) - 1)
                found = docs[spot] == live + lo
                score[live[found]] += w * value[spot[found]]
        live = live[score[live] >= least]
        best, scores = np.concatenate([best, live + lo]), np.concatenate([scores, score[live]])
        order = np.lexsort((ids[best], -scores))[:k]
        best, scores = best[order], scores[order]
        if len(best) == k:
            least = int(scores[-1])  # an equal score may still win by its id
    return best, scores


def _search(queries: list[tuple[int, list[tuple[str, int]]]], n: int, terms: int, k: int):
    """Search of one shard: ``queries`` holds (number, [(term, weight)])."""
    def run(table: pa.Table) -> pa.Table:
        place, found = [], []
        heads = table.filter(pc.is_null(table.column("term"))).to_pylist()
        if heads:
            ids = [2**63 - 1 if i is None else i for i in heads[0]["ids"]]
            raw, ids = heads[0]["ids"], np.array(ids, np.int64)
            m = length_term(np.frombuffer(heads[0]["data"], np.int64), n, terms)
            columns = [table.column(c).to_pylist() for c in ("term", "bound", "last", "top", "off", "data")]
            lists = {r[0]: _List(*r[1:], m) for r in zip(*columns) if r[0] is not None}
            for number, weights in queries:
                docs, scores = max_score([(w, lists[t]) for t, w in weights if t in lists], ids, k)
                place += [number] * len(docs)
                found += zip([raw[d] for d in docs.tolist()], scores.tolist())
        return pa.table({"query": pa.array(place, pa.int32()), "doc_id": pa.array([d for d, _ in found], pa.int64()),
                         "score": pa.array([s for _, s in found], pa.int64())})
    return run


def _query_blocks(queries: DataFrame, key: str):
    """Blocks of [(key, terms)] with at most ``QUERY_TERMS`` terms (a longer query alone)."""
    plain = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    found = queries.select(F.col(key).alias("key"), F.regexp_extract_all(F.coalesce(plain, F.lit("")), F.lit(_PATTERN), F.lit(0)).alias("terms"))
    found = found.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where("size(terms) > 0")
    block, size = [], 0
    for r in found.toLocalIterator():
        if block and size + len(r["terms"]) > QUERY_TERMS:
            yield block
            block, size = [], 0
        block.append((r["key"], r["terms"]))
        size += len(r["terms"])
    if block:
        yield block


def search(index: Index, queries: DataFrame, key: str = "item_id", k: int = K) -> DataFrame:
    """The ``k`` best documents of each query (columns ``key`` and ``text``): key, rank, doc_id, score."""
    spark = index.rows.sparkSession
    kind = queries.schema[key].dataType
    out = spark.createDataFrame([], f"query int, doc_id long, score long, {key} {kind.simpleString()}")
    for block in _query_blocks(queries, key):
        if not index.n:
            break
        asked = spark.createDataFrame(sorted({(t,) for _, terms in block for t in terms}), "term string")
        # at most QUERY_TERMS terms, or those of one query
        rows = index.rows.join(F.broadcast(asked), "term", "left_semi")
        df = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * index.n + 2) / (2 * d + 1))) for t, d in df.items()}
        ask = [(i, [(t, weight[t]) for t in terms if weight.get(t, 0) > 0]) for i, (_, terms) in enumerate(block)]
        shards = rows.unionByName(index.rows.where("term is null")).groupBy("shard")
        found = shards.applyInArrow(_search(ask, index.n, index.terms, k), "query int, doc_id long, score long")
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"query int, {key} {kind.simpleString()}")
        out = out.unionByName(found.join(F.broadcast(names), "query"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "doc_id", "score")
