"""Quality rules: base counts, then line sequence labelling with a linear-chain CRF.

Every line of a text is a step of a sequence with two states, content and
boilerplate.  A conditional random field scores the states from line features
(symbols, bars, capitals, repeated lines and words, length, punctuation) and
from the state of the line before; Viterbi decoding gives the best sequence,
and the share of words in content lines decides whether a document stays.

The field is fitted on a bounded sample of labelled documents
(``sample_docs``, those with the smallest hash of their id): lines of good
documents are content; lines of bad ones start as boilerplate and are decoded
anew between rounds of fitting, so that plain lines inside them may change
side.  Training sequences are pieces of 32 lines, of one document 40 at
most; decoding runs over all lines
of the whole text.

Defined results: a null or empty text has no words and fails the base rule;
without labels of both kinds the field is neutral and the base rule decides
alone; repeated rows get equal rows; an empty table gives an empty table; only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm import words as W
from estatelens.llm.frames import plain_names

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
MIN_CONTENT_SHARE = 0.5
PIECE_LINES = 32
MOST_PIECES = 40  # of one training document
FEATURES = ("bias", "blank", "short", "long", "symbols", "bars", "capitals", "exclaims", "dup_line", "repeats",
            "echo", "digits", "sentence_end", "first", "last")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[0xC3:0xCB] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"'")] = True


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _again(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order: does (group, value) occur earlier; how often does it occur in all."""
    key = W.mix(value + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(k)))
    earlier, times = np.empty(len(k), bool), np.empty(len(k), np.int64)
    earlier[order] = ~new
    times[order] = np.repeat(count, count)
    return earlier, times


def analyse(chunk: W.Chunk) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """(base counts per text, features per line, words per line, first line of each text)."""
    data, off, n = chunk.data, chunk.off, len(chunk)
    prefix = chunk.prefix()
    start, end, first = chunk.words()
    h = chunk.span_hash(start, end, prefix)
    doc_of_word = np.repeat(np.arange(n), np.diff(first))
    points = _sums(((data & 0xC0) != 0x80) & ~chunk.space)
    symbols = _sums(_SYMBOL[data])

    pos, win = W.windows(h, first, WINDOW)
    _, times = _again(doc_of_word[pos], win)
    mark = np.zeros(len(h) + 1, np.int64)
    twice = pos[times > 1]
    np.add.at(mark, twice, 1)
    np.add.at(mark, np.minimum(twice + WINDOW, len(h)), -1)
    repeated = _sums(np.cumsum(mark[:-1]) > 0)

    lb, le, lfirst = chunk.lines()
    w0, w1 = np.searchsorted(start, lb), np.searchsorted(start, le)
    words = w1 - w0
    full = words > 0
    doc_of_line = np.repeat(np.arange(n), np.diff(lfirst))
    dup = np.zeros(len(lb), bool)
    dup[full] = _again(doc_of_line[full], chunk.span_hash(lb[full], le[full], prefix))[0]

    base = {"n_words": np.diff(first), "word_chars": points[off[1:]] - points[off[:-1]],
            "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
            "n_dup_lines": np.diff(_sums(dup)[lfirst]), "n_repeat_words": repeated[first[1:]] - repeated[first[:-1]]}

    echo = np.zeros(len(h), bool)
    if len(h):
        echo[1:] = (h[1:] == h[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
    latin_capital = np.zeros(len(data), bool)
    if len(data):
        latin_capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    per_word = np.maximum(words, 1)
    at = lambda c: c[le] - c[lb]
    letters = np.maximum(at(_sums(_LETTER[data])), 1)
    x = np.zeros((len(lb), len(FEATURES)), np.float32)
    x[:, 0] = 1
    x[:, 1] = ~full
    x[:, 2] = full & (words <= 3)
    x[:, 3] = words >= 20
    x[:, 4] = np.minimum(at(symbols) / per_word, 1.5)
    x[:, 5] = np.minimum(at(_sums(data == 0x7C)) / per_word, 1)
    x[:, 6] = at(_sums(_UPPER[data] | latin_capital)) / letters
    x[:, 7] = np.minimum(at(_sums(data == 0x21)) / per_word, 1)
    x[:, 8] = dup
    rep, ech = repeated, _sums(echo)
    x[:, 9] = (rep[w1] - rep[w0]) / per_word
    x[:, 10] = (ech[w1] - ech[w0]) / per_word
    x[:, 11] = at(_sums(_DIGIT[data])) / letters.clip(1)
    x[:, 11] = np.minimum(x[:, 11], 1)
    if len(data):
        x[full, 12] = _END[data[end[w1[full] - 1] - 1]]
    x[lfirst[:-1], 13] = 1
    x[lfirst[1:] - 1, 14] = 1
    return base, x, words, lfirst


def _pad(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index matrix (sequence, step) and its mask."""
    n = np.diff(first)
    step = np.arange(n.max() if len(n) else 0)
    mask = step[None, :] < n[:, None]
    return np.where(mask, first[:-1, None] + step[None, :], 0), mask


def viterbi(unary: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best state of every step; ``unary`` is (steps, 2), sequences start at ``first``.  Ties go to state 0.

    Sequences run side by side, the longest first, so a step costs what is still running.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    out = np.zeros(len(unary), np.int8)
    if not len(n) or n[0] == 0:
        return out
    back = np.zeros((len(unary), 2), np.int8)
    score = unary[begin[n > 0]].astype(np.float64)
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right")  # sequences with at least t steps
    last = score.copy()
    for t in range(1, int(n[0])):
        k = active[t]
        score = score[:k]
        via = score[:, :, None] + trans[None]
        pick = (via[:, 1] > via[:, 0]).astype(np.int8)
        back[begin[:k] + t] = pick
        score = np.maximum(via[:, 0], via[:, 1]) + unary[begin[:k] + t]
        last[:k] = score
    state = (last[:, 1] > last[:, 0]).astype(np.int8)
    for t in range(int(n[0]) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        out[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return out


def _posterior(u: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and pair marginals of padded sequences, (step, sequence, state), by the scaled forward-backward recursions."""
    a = np.exp(trans - trans.max())
    psi = np.exp(u - u.max(2, keepdims=True))
    f, b = np.empty_like(psi), np.ones_like(psi)
    f[0] = psi[0] / psi[0].sum(1, keepdims=True)
    for t in range(1, len(u)):
        x = (f[t - 1] @ a) * psi[t]
        f[t] = np.where(mask[t][:, None], x / x.sum(1, keepdims=True), f[t - 1])
    for t in range(len(u) - 2, -1, -1):
        x = (psi[t + 1] * b[t + 1]) @ a.T
        b[t] = np.where(mask[t + 1][:, None], x / x.sum(1, keepdims=True), 1)
    state = f * b
    state *= (mask / state.sum(2))[:, :, None]
    pair = f[:-1][:, :, :, None] * a * (psi[1:] * b[1:])[:, :, None, :]
    return state, (pair * (mask[1:] / pair.sum((2, 3)))[:, :, None, None]).sum((0, 1))


def _fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, weights, trans, rounds: int, l2: float = 1e-3):
    """Maximum likelihood by Adam; weights are of state 1 against state 0."""
    index, mask = _pad(x, first)
    index, mask = index.T, mask.T
    xs, ys = x[index] * mask[:, :, None], y[index]
    n = mask.sum()
    pairs = mask[1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (ys[:-1][pairs], ys[1:][pairs]), 1)
    target = (x * (y == 1)[:, None]).sum(0)
    theta = np.concatenate([weights, trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    flat = xs.reshape(-1, x.shape[1])
    u = np.zeros((*mask.shape, 2))
    for step in range(1, rounds + 1):
        w, a = theta[:len(weights)], theta[len(weights):].reshape(2, 2)
        u[:, :, 1] = xs @ w
        state, pair = _posterior(u, a, mask)
        grad = np.concatenate([state[:, :, 1].ravel() @ flat - target, (pair - seen).ravel()]) / n + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:len(weights)], theta[len(weights):].reshape(2, 2)


def neutral() -> dict:
    """A field that calls every line content."""
    w = np.zeros(len(FEATURES))
    w[0] = -1
    return {"weights": w.tolist(), "trans": [[0.0, 0.0], [0.0, 0.0]]}


def _sampled(x: np.ndarray) -> np.ndarray:
    """At most ``MOST_PIECES`` pieces of the lines of one text, chosen over the whole text by a hash of their place."""
    pieces = -(-len(x) // PIECE_LINES)
    if pieces <= MOST_PIECES:
        return x
    chosen = np.sort(np.argsort(W.mix(np.arange(1, pieces + 1, dtype=np.uint64)), kind="stable")[:MOST_PIECES])
    return np.concatenate([x[p * PIECE_LINES:(p + 1) * PIECE_LINES] for p in chosen.tolist()])


def _line_features(batches):
    for batch in batches:
        quality = batch.column("quality").to_pylist()
        for chunk in W.chunks(batch.column("text")):
            _, x, _, first = analyse(chunk)
            yield pa.RecordBatch.from_arrays(
                [pa.array(quality[chunk.lo:chunk.hi], pa.int64()),
                 pa.array([_sampled(x[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())], ["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 3_000) -> dict:
    """Fit the field on at most ``sample_docs`` labelled documents (half of each kind), chosen by a hash of the id."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    ids = None
    for q in (0, 1):
        part = marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs // 2)
        ids = part if ids is None else ids.unionByName(part)
    rows = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by sample_docs
            .select("quality", "text").mapInArrow(_line_features, "quality long, x binary").collect())
    rows.sort(key=lambda r: (r[0], bytes(r[1])))  # equal fits whatever the order of arrival
    if len({r[0] for r in rows}) < 2:
        return neutral()
    xs, bad, first = [], [], [0]
    for q, packed in rows:
        x = np.frombuffer(packed, np.float32).reshape(-1, len(FEATURES))
        for lo in range(0, len(x), PIECE_LINES):
            xs.append(x[lo:lo + PIECE_LINES])
            bad.append(q == 0)
            first.append(first[-1] + len(xs[-1]))
    x, first = np.concatenate(xs).astype(np.float64), np.array(first)
    bad = np.repeat(np.array(bad), np.diff(first))
    y = bad.astype(np.int8)
    w, a = np.zeros(len(FEATURES)), np.zeros((2, 2))
    for rounds in (100, 50, 50):  # the later fits start from the one before
        w, a = _fit(x, first, y, w, a, rounds)
        u = np.zeros((len(x), 2))
        u[:, 1] = x @ w
        y = np.where(bad, viterbi(u, a, first), 0).astype(np.int8)
        if not y.any():
            return neutral()
    return {"weights": w.tolist(), "trans": a.tolist()}


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, content_share double")


def verdicts(column: pa.Array, model: dict) -> dict[str, np.ndarray]:
    """All result columns for a column of texts."""
    w, a = np.array(model["weights"]), np.array(model["trans"])
    parts = []
    for chunk in W.chunks(column):
        base, x, words, first = analyse(chunk)
        u = np.zeros((len(x), 2))
        u[:, 1] = x @ w
        state = viterbi(u, a, first)
        content = _sums(np.where(state == 0, words, 0))[first]
        n = base["n_words"]
        base["content_share"] = np.diff(content) / np.maximum(n, 1)
        base["base_failed"] = (n < MIN_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * n)
        base["kept"] = ~base["base_failed"] & (base["content_share"] >= MIN_CONTENT_SHARE)
        parts.append(base)
    names = [*_COUNTS, "base_failed", "kept", "content_share"]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in names}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row per row of ``docs``: base counts, verdict, share of words in content lines."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                got = verdicts(batch.column("text"), model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v) for v in got.values())],
                                                 ["doc_id", *got])
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were."""
    plain = plain_names(docs)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(verdicts(batch.column("text"), model)["kept"]))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
