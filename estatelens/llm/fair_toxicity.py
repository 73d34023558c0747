"""Toxicity: a counterfactual-regularised classifier.

A document is a bag of its words (runs of letters, lower case) and of their
first four and six letters, which stand for a word's inflections.  For each
chosen token there are two features: whether it occurs, and how densely
(occurrences against one in ``DENSITY`` words).  Tokens are chosen by how much
their document frequency among toxic and other training rows tells; identity
terms are always among them.  A logistic regression scores the features.

Its loss has a second part: every training text with an identity term is paired
with copies in which the term is swapped for others of its group, and squared
changes of the score are penalised.  So a group's name gains no weight of its
own, and neutral mentions of a group are not marked.

Frequencies of every token are counted over all training rows, in one aggregate.
The fit runs on a bounded sample of distinct rows (``SAMPLE_DOCS``, all if fewer),
chosen by a hash of id and text.

Learning skips rows whose crc32(doc_id as text) mod 4 is 2.  Null and empty
texts have no words and get the score of the intercept; without toxic and other
labelled rows the score is 0 everywhere; several labels of one document count
as toxic if any is; repeated rows get equal rows; an empty table gives an empty
table.  A score reads the text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm import words as W
from estatelens.session import materialize

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
PREFIXES = (4, 6)
DENSITY = 200
HELD_TOKENS = 1_000_000
FEATURES = 400
SAMPLE_DOCS = 40_000
COUNTERFACTUAL = 5.0

# Identity terms by group; those of one group may stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys", "females", "males"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer", "heterosexual"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "réfugiés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "refugiados"),
)

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[65:91] = _NO_LETTER[97:123] = False
_NO_LETTER[128:] = False


def tokens(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of every word and prefix of a chunk, and words of each text."""
    chunk.space = _NO_LETTER[chunk.data]
    start, end, first = chunk.words()
    sums = chunk.prefix()
    text = np.repeat(np.arange(len(chunk)), np.diff(first))
    lead = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    at = np.searchsorted(lead, start)  # place of the word among code points
    found, owner = [chunk.span_hash(start, end, sums)], [text]
    for n in PREFIXES:
        stop = np.append(lead, np.full(n, len(chunk.data)))[at + n]
        longer = stop < end
        found.append(chunk.span_hash(start[longer], stop[longer], sums) ^ np.uint64(n))
        owner.append(text[longer])
    return np.concatenate(found), np.concatenate(owner), np.diff(first)


def word_hash(word: str) -> int:
    h, _, _ = tokens(next(W.chunks(pa.array([word]), lower=True)))
    return int(h.view(np.int64)[0])


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


class Lookup:
    """Places of hashes in a sorted vocabulary; a small table turns most away first."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.table = np.zeros(1 << 20, bool)
        self.table[vocabulary & np.uint64((1 << 20) - 1)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``h`` are known, their places)."""
        which = np.flatnonzero(self.table[h & np.uint64((1 << 20) - 1)])
        at = np.searchsorted(self.vocabulary, h[which])
        at[at == len(self.vocabulary)] = 0
        ok = self.vocabulary[at] == h[which] if len(self.vocabulary) else np.zeros(len(which), bool)
        return which[ok], at[ok]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by token, added up."""
    token, bad, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(token, kind="stable")
    token = token[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    return token[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in (bad, n))


def _frequencies(batches):
    """Document frequencies of every token of a task: in toxic rows and in all; more than ``HELD_TOKENS`` go out in parts."""
    parts, size = [], 0

    def out():
        token, bad, n = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(bad), pa.array(n)], ["token", "bad", "n"])

    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for chunk in W.chunks(batch.column("text"), lower=True):
            h, text, _ = tokens(chunk)
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
            token, which, n = np.unique(h[new], return_inverse=True, return_counts=True)
            bad = np.bincount(which, toxic[chunk.lo:chunk.hi][text[new]], len(token)).astype(np.int64)
            parts.append((token, bad, n.astype(np.int64)))
            size += len(token)
            if size > 4 * HELD_TOKENS:
                parts = [_merged(parts)]
                size = len(parts[0][0])
                if size > HELD_TOKENS:
                    yield out()
                    parts, size = [], 0
    if parts:
        yield out()


def vectors(chunk: W.Chunk, look: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of a chunk: presence features first, then density features."""
    k = len(look.vocabulary)
    h, text, words = tokens(chunk)
    which, at = look(h)
    pair, count = np.unique(text[which] * k + at, return_counts=True)
    text, at = pair // k, pair % k
    dense = count / (count + words[text] / DENSITY)
    return np.concatenate([text, text]), np.concatenate([at, at + k]), np.concatenate([np.ones(len(at)), dense])


class Sparse:
    """A matrix by its non-zero entries."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.value, self.shape = row, col, value, shape

    @classmethod
    def of(cls, x: np.ndarray) -> Sparse:
        row, col = np.nonzero(x)
        return cls(row, col, x[row, col], x.shape)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def tdot(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * e[self.row], self.shape[1])

    def column(self, j: int) -> np.ndarray:
        at = self.col == j
        return np.bincount(self.row[at], self.value[at], self.shape[0])


def swaps(x: Sparse, groups: list[list[int]]) -> Sparse:
    """Change of the features for every identity term of a text swapped for each other term of its group, a row each."""
    k, row, col, value, n = x.shape[1] // 2, [], [], [], 0
    for g in groups:
        block = {t + o: x.column(t + o) for t in g for o in (0, k)}
        for a in g:
            have = np.flatnonzero(block[a])
            for b in g:
                if a != b and len(have):
                    for i, j in ((a, b), (a + k, b + k)):
                        for c, v in ((i, -block[i][have]), (j, np.maximum(block[i][have], block[j][have]) - block[j][have])):
                            row.append(np.arange(n, n + len(have)))
                            col.append(np.full(len(have), c))
                            value.append(v)
                    n += len(have)
    if not n:
        return Sparse(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), (0, x.shape[1]))
    return Sparse(np.concatenate(row), np.concatenate(col), np.concatenate(value), (n, x.shape[1]))


def fit_weights(x: Sparse | np.ndarray, y: np.ndarray, groups: list[list[int]], strength: float = COUNTERFACTUAL, l2: float = 0.3,
                steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept; the counterfactual part is ``strength`` times the mean squared change of the log odds."""
    x = x if isinstance(x, Sparse) else Sparse.of(x)
    n, k = x.shape
    change = swaps(x, groups)
    p = min(max(y.mean(), 1e-6), 1 - 1e-6)
    theta = np.append(np.zeros(k), np.log(p / (1 - p)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, steps + 1):
        e = 1 / (1 + np.exp(-(x.dot(theta[:k]) + theta[k]))) - y
        grad = np.append(x.tdot(e) + l2 * theta[:k], e.sum()) / n
        if change.shape[0]:
            grad[:k] += 2 * strength * change.tdot(change.dot(theta[:k])) / change.shape[0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:k], float(theta[k])


def _choose(train: DataFrame, share: float, features: int) -> list[int]:
    """The ``features`` tokens of the greatest gain: likelihood ratio between a token's share of toxic documents and of all."""
    counts = train.select("toxic", "text").mapInArrow(_frequencies, "token long, bad long, n long").groupBy("token").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    q = (F.col("bad") + share) / (F.col("n") + 1)
    gain = F.col("bad") * F.log(q / share) + (F.col("n") - F.col("bad")) * F.log((1 - q) / (1 - share))
    return [r["token"] for r in counts.where(q > share).select("token", gain.alias("gain")).orderBy(F.desc("gain"), "token").limit(features).collect()]


def fit(docs: DataFrame, labels: DataFrame, features: int = FEATURES, sample_docs: int = SAMPLE_DOCS,
        strength: float = COUNTERFACTUAL) -> dict | None:
    """Vocabulary (hashes), weights and intercept; None if there is nothing to tell apart."""
    marked = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(
        F.max("toxic").cast("long").alias("toxic"))
    # a merge join at every size: labels grow with the documents
    train = materialize(docs.where(~held_out()).select("doc_id", "text").join(marked.hint("merge"), "doc_id").select("doc_id", "toxic", "text"))
    totals = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rows, bad = int(totals[0]), int(totals[1])
    if bad == 0 or bad == rows:
        return None
    chosen = _choose(train, bad / rows, features)
    terms = {t: word_hash(t) for g in IDENTITY for t in g}
    vocabulary = np.unique(np.array([*chosen, *terms.values()], np.int64).view(np.uint64))
    k = len(vocabulary)

    def featured(batches):
        look = Lookup(vocabulary)
        for batch in batches:
            own = [batch.column(c) for c in ("doc_id", "key", "toxic")]
            for chunk in W.chunks(batch.column("text"), lower=True):
                text, at, value = vectors(chunk, look)
                order = np.argsort(text, kind="stable")
                cut = np.searchsorted(text[order], np.arange(len(chunk) + 1))
                at, value = at[order].astype(np.int32), value[order].astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [*(c[chunk.lo:chunk.hi] for c in own),
                     pa.array([at[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["doc_id", "key", "toxic", "at", "value"])

    keyed = train.withColumn("key", F.xxhash64("text"))
    picked = keyed.select("doc_id", "key").distinct().orderBy(F.xxhash64("doc_id", "key"), "doc_id", "key").limit(sample_docs)
    got = (keyed.join(F.broadcast(picked), ["doc_id", "key"]).select("doc_id", "key", "toxic", "text")  # bounded by sample_docs
           .mapInArrow(featured, "doc_id long, key long, toxic long, at binary, value binary").dropDuplicates(["doc_id", "key"])
           .select("toxic", "at", "value").toPandas())
    got = got.sort_values(["toxic", "at", "value"])  # one order whatever the partitions
    at = np.frombuffer(b"".join(got["at"]), np.int32)
    x = Sparse(np.repeat(np.arange(len(got)), [len(b) // 4 for b in got["at"]]), at.astype(np.int64),
               np.frombuffer(b"".join(got["value"]), np.float32).astype(np.float64), (len(got), 2 * k))
    place = {t: int(np.searchsorted(vocabulary, np.array([h], np.int64).view(np.uint64))[0]) for t, h in terms.items()}
    w, b = fit_weights(x, got["toxic"].to_numpy(np.float64), [[place[t] for t in g] for g in IDENTITY], strength)
    return {"vocabulary": vocabulary, "weights": w, "intercept": b}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    def run(batches):
        look = Lookup(model["vocabulary"]) if model else None
        for batch in batches:
            parts = []
            for chunk in W.chunks(batch.column("text"), lower=True):
                if model is None:
                    parts.append(np.zeros(len(chunk)))
                    continue
                text, at, value = vectors(chunk, look)
                z = np.bincount(text, model["weights"][at] * value, len(chunk))
                parts.append(1 / (1 + np.exp(-(z + model["intercept"]))))
            if parts:
                s = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s),
                                                  pa.array((s >= THRESHOLD).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
