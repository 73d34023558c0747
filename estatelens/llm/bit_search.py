"""Nearest neighbours by randomly rotated one-bit codes.

A vector is centred, normalised and turned by a random rotation into a higher
dimension (``BITS_PER_DIM`` bits a component); the signs are its code, packed
64 to a word.  Two scalars go with it: its distance from the centre and the
inner product of the vector with its own code, which corrects the estimate.
Queries are turned the same way and rounded to four bits, so that an inner
product is a few AND and bit-count operations on packed words.  The error bound
of each estimate gives a lower bound of the distance; a vector is compared in
double precision with the query only if that bound does not exceed the tenth
best distance known.

Every row is indexed; only the centre is fitted on a bounded sample
(``CENTRE_SAMPLE`` vectors with the smallest hash of their id).  Index rows are
dealt into blocks of about ``BLOCK_ROWS`` by a hash, queries into blocks of
``QUERY_ROWS``; each pair of blocks is one bounded task, so equal vectors in
any number spread evenly.  The scan is over all codes: on vectors without
clusters no partition of space can leave out rows and keep the recall.

Vectors that are null, all zero, or hold a null or non-finite component take no
part; vectors of different length never meet; ties go to the smaller id; of
repeated ids each row counts; a query row that stands twice is one query, and
different vectors under one query id are ranked each for itself; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS_PER_DIM = 4
QUERY_BITS = 4
EPSILON = 3.0
CENTRE_SAMPLE = 4_096
BLOCK_ROWS = 8_192
QUERY_ROWS = 1_024
SEED = 11
NEAREST = 10


def rotation(dim: int) -> np.ndarray:
    """(dim, bits) with orthonormal rows, bits a multiple of 64; the same in every task."""
    bits = -(-dim * BITS_PER_DIM // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


def pack(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans -> rows of 64-bit words."""
    return np.packbits(signs, axis=1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """(code words, distance from the centre, inner product with the own code, set bits)."""
    d = x - centre
    r = np.sqrt((d * d).sum(1))
    o = (d / np.where(r > 0, r, 1)[:, None]) @ turn
    fit = np.abs(o).sum(1) / np.sqrt(turn.shape[1])
    code = pack(o > 0)
    return code, r, np.where(r > 0, fit, 1), np.bitwise_count(code).sum(1)


class Query:
    """A query turned and rounded for the code index of one block."""

    def __init__(self, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, noise: np.random.Generator):
        d = q - centre
        self.q, self.norm = q, float(np.sqrt((d * d).sum()))
        t = (d / self.norm if self.norm > 0 else d) @ turn
        self.low = float(t.min())
        self.step = max(float(t.max()) - self.low, 1e-12) / (2**QUERY_BITS - 1)
        u = np.floor((t - self.low) / self.step + noise.random(len(t))).clip(0, 2**QUERY_BITS - 1).astype(np.uint8)
        self.planes = [pack(((u >> j) & 1).astype(bool)[None])[0] for j in range(QUERY_BITS)]
        self.total = float((self.low + self.step * u).sum())

    def bounds(self, code, r, fit, ones) -> tuple[np.ndarray, np.ndarray]:
        """(estimated squared distance, its lower bound) to each code."""
        bits = code.shape[1] * 64
        dot = np.zeros(len(code))
        for j, plane in enumerate(self.planes):
            dot += np.bitwise_count(code & plane).sum(1) * float(1 << j)
        root = np.sqrt(bits)
        est = (2 * (self.step * dot + self.low * ones) - self.total) / root / fit
        # of the code, and of the rounded query (a component's error is below a step, its deviation below half of one)
        err = (np.sqrt(np.maximum(1 - fit * fit, 0)) / np.sqrt(bits - 1) + self.step / 2) / fit * EPSILON
        both = r * r + self.norm**2
        return both - 2 * r * self.norm * est, both - 2 * r * self.norm * (est + err)


def _valid(batches):
    for batch in batches:
        ids, dims, vecs = [], [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
            if i is None or v is None or len(v) == 0 or any(c is None for c in v):
                continue
            x = np.asarray(v, np.float64)
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                dims.append(len(x))
                vecs.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())],
                                         ["vec_id", "dim", "vec"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean of the sample, for each length of vector."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CENTRE_SAMPLE).select("dim", "vec").toPandas()
    return {int(d): _matrix(sorted(g["vec"])).mean(0) for d, g in rows.groupby("dim")}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of ``vectors`` to each of ``queries``, both (vec_id, embedding)."""
    schema = "vec_id long, dim int, vec binary"
    rows = vectors.select("vec_id", "embedding").mapInArrow(_valid, schema)
    asked = queries.select("vec_id", "embedding").mapInArrow(_valid, schema).distinct()
    centre = centres(rows)
    n, m = rows.count(), asked.count()
    blocks, parts = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // QUERY_ROWS))

    def coded(batches):
        turns = {}
        for pdf in batches:
            for dim, g in pdf.groupby("dim"):
                d = int(dim)
                turn = turns.setdefault(d, rotation(d))
                code, r, fit, ones = encode(_matrix(g["vec"]), centre.get(d, np.zeros(d)), turn)
                yield pd.DataFrame({"vec_id": g["vec_id"], "dim": g["dim"], "vec": g["vec"], "code": [c.tobytes() for c in code],
                                    "r": r, "fit": fit, "ones": ones.astype(np.int64)})

    index = rows.mapInPandas(coded, schema + ", code binary, r double, fit double, ones long")
    index = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("side", F.lit(0)).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).withColumn("side", F.lit(1)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = index.unionByName(asked, allowMissingColumns=True)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        have, ask = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out = []
        if len(have) and len(ask):
            dim = int(have["dim"].iat[0])
            x, ids = _matrix(have["vec"]), have["vec_id"].to_numpy(np.int64)
            code = np.frombuffer(b"".join(have["code"]), np.uint64).reshape(len(have), -1)
            r, fit, ones = (have[c].to_numpy(np.float64) for c in ("r", "fit", "ones"))
            turn, mid = rotation(dim), centre.get(dim, np.zeros(dim))
            for qid, packed in zip(ask["vec_id"].to_numpy(np.int64), ask["vec"]):
                q = Query(np.frombuffer(packed, np.float64), mid, turn, np.random.default_rng(abs(int(qid))))
                est, low = q.bounds(code, r, fit, ones)
                own = ids == qid
                est[own] = low[own] = np.inf
                left = len(ids) - int(own.sum())
                if left == 0:
                    continue
                exact = lambda at: np.sqrt(((x[at] - q.q) ** 2).sum(1))
                limit = np.inf
                if left > k:
                    limit = exact(np.argpartition(est, k - 1)[:k]).max() ** 2
                at = np.flatnonzero((low <= limit * (1 + 1e-9)) & ~own)
                dist = exact(at)
                best = at[o := np.lexsort((ids[at], dist))[:k]]
                key = int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True)
                out.append(pd.DataFrame({"query_id": qid, "query": key, "vec_id": ids[best], "score": dist[o]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype=np.int64), "query": pd.Series(dtype=np.int64), "vec_id": pd.Series(dtype=np.int64),
                                                         "score": pd.Series(dtype=np.float64)})

    found = both.groupBy("dim", "block", "part").applyInPandas(search, "query_id long, query long, vec_id long, score double")
    w = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")  # k rows a block for each query
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
