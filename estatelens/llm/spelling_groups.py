"""Spelling variant grouping: Bloom-guided neighbourhoods.

Two words are near if one inserted, deleted or replaced letter turns one into the other.

1. Words are counted over all texts (a count a task first, then a sum).
2. The vocabulary goes into blocked Bloom filters, one for each word length (words of ``LONG`` letters or more share one): a
   block is 256 bits, a word sets one bit in each of its eight parts.  Filters are built by tasks, some blocks each.
3. Every word generates its edits: the deletions, and the replacements of a letter by a later one (an insertion is the
   deletion seen from the other word, so each pair is generated from one side, once).  An edit's hash is the word's
   with one term changed.  Edits that the filter of their length rejects are in no text; only the others are spelled out.
4. Those shuffle to an exact join with the vocabulary, which removes the filters' false positives.
5. Every word takes the most frequent word near it as its form, if that is frequent enough, and the last form of the chain
   as its root, found by doubling the steps.

The filters that go to the tasks at once hold at most ``FILTER_BYTES``.  A greater vocabulary is probed in several passes, each
with some lengths or, of a length that is too large alone, some part of its words by hash: every edit meets the one part that could
hold it, so the result is the same.

A null or empty text has no words.  With ``seeded_typos`` a null id counts as the empty string.  Runs of letters of any length are
taken whole.  Rows that stand twice count twice.  An empty table gives an empty table.  Columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm import words as W
from estatelens.session import materialize

LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
TYPO_EVERY = 97
LONG = 64
BITS = 16
FILTER_BYTES = 32 << 20
PROBE_WORDS = 20_000
_CHUNK = 4 << 20
_BATCH = 1 << 20
_PART_BLOCKS = 256
_U = np.uint64
_VALUE = np.random.default_rng(20250211).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_SALT = np.random.default_rng(7).integers(1, 1 << 31, 8, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of each byte span, carried on from a crc32."""
    crc, size = ~state, end - start
    short = np.flatnonzero(size <= 64)
    short = short[np.argsort(-size[short], kind="stable")]
    lengths = -size[short]
    for j in range(int(size[short[0]]) if len(short) else 0):
        now = short[:np.searchsorted(lengths, -j, "left")]  # spans with more than j bytes
        crc[now] = _CRC[(crc[now] ^ data[start[now] + j]) & np.uint32(255)] ^ (crc[now] >> np.uint32(8))
    crc = ~crc
    for i in np.flatnonzero(size > 64).tolist():
        crc[i] = zlib.crc32(data[start[i]:end[i]].tobytes(), int(state[i]))
    return crc


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters: a-z, A-Z and U+00C0 to U+00FF (lead byte C3 and what follows it)."""
    lead = data == 0xC3
    out = lead | ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90))
    out[1:] |= lead[:-1]
    return out


def _count(seeded_typos: bool):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for chunk in W.chunks(batch.column("text"), lower=True, size=_CHUNK):
                chunk.space = ~_letters(chunk.data)
                start, end, first = chunk.words()
                plain, more = np.ones(len(start), bool), []
                if seeded_typos:
                    seed = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids[chunk.lo:chunk.hi].to_pylist()], np.uint32)
                    h = _crc32(chunk.data, start, end, np.repeat(seed, np.diff(first)))
                    plain = h % np.uint32(TYPO_EVERY) != 0
                    for i in np.flatnonzero(~plain).tolist():
                        word = chunk.data[start[i]:end[i]].tobytes().decode()
                        at = int(h[i]) % len(word)
                        more.append(word[:at] + word[at + 1:])
                # the bytes of the words left as they are, one after the other
                depth = np.zeros(len(chunk.data) + 1, np.int8)
                np.add.at(depth, start[plain], 1)
                np.add.at(depth, end[plain], -1)
                data = chunk.data[np.cumsum(depth, dtype=np.int8)[:-1] > 0]
                off = np.concatenate([[0], np.cumsum(end[plain] - start[plain])]).astype(np.int64)
                words = pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])
                words = pa.concat_arrays([words, pa.array(more, pa.large_string())]).dictionary_encode()
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                long = pc.greater_equal(pc.utf8_length(words.dictionary), LEAST_LETTERS)
                yield pa.RecordBatch.from_arrays([words.dictionary.filter(long).cast(pa.string()), pa.array(n).filter(long)], ["word", "n"])
    return run


def vocabulary(docs: DataFrame, seeded_typos: bool = False) -> DataFrame:
    """(word, n): lower-cased runs of at least ``LEAST_LETTERS`` letters that stand at least ``LEAST_COUNT`` times.  With ``seeded_typos``
    one in ``TYPO_EVERY`` (by the crc32 of id and run) loses a letter first."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = docs.mapInArrow(_count(seeded_typos), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


class _Matrix:
    """Words of one length as a matrix of letters (one byte each) and their hashes' parts."""

    def __init__(self, letters: np.ndarray):
        self.letters, n = letters, letters.shape[1]
        power, inverse = np.ones(n, _U), _U(pow(_BASE, -1, 1 << 64))
        power[1:] = _U(_BASE)
        self.power, self.inverse = np.cumprod(power, dtype=_U), inverse
        self.upto = np.cumsum(_VALUE[letters] * self.power, axis=1, dtype=_U)
        self.total = self.upto[:, -1]


def _by_length(column: pa.Array):
    """(rows, matrix) of the words of each length, in pieces of about ``_BATCH`` letters."""
    data, off = W.text_buffer(column)
    follows = (data >= 0x80) & (data < 0xC0)  # second byte of a letter beyond ASCII
    lead = np.flatnonzero(data == 0xC3)
    codes = data.copy()
    codes[lead] = data[lead + 1] | 0x40
    codes = codes[~follows]
    off = np.concatenate([[0], np.cumsum(~follows)])[off]
    size = np.diff(off)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        step = max(1, _BATCH // max(1, length))
        for i in range(0, len(rows), step):
            part = rows[i:i + step]
            yield part, _Matrix(codes[off[part][:, None] + np.arange(length)])


def _spell(letters: np.ndarray) -> pa.Array:
    """Strings from a matrix of letters."""
    flat = letters.ravel()
    size = 1 + (flat >= 0x80)
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.uint8)
    wide = flat >= 0x80
    out[at[:-1][~wide]] = flat[~wide]
    out[at[:-1][wide]] = 0xC3
    out[at[:-1][wide] + 1] = (flat[wide] & 0x3F) | 0x80
    off = at[::letters.shape[1]].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(letters), [None, pa.py_buffer(off), pa.py_buffer(out)]).cast(pa.string())


class Plan:
    """Sizes of the filters: by length the number of parts and the blocks of a part, and the passes that probe them."""

    def __init__(self, counts: dict[int, int], most_bytes: int = FILTER_BYTES):
        most = max(1, most_bytes // 32)
        self.shape = {}
        for length, n in counts.items():
            blocks = n * BITS // 256 + 1
            parts = -(-blocks // most)
            self.shape[length] = (parts, -(-blocks // parts))
        self.passes, room = [], 0
        for length, (parts, blocks) in sorted(self.shape.items()):
            for part in range(parts):
                if not self.passes or blocks > room:
                    self.passes.append([])
                    room = most
                self.passes[-1].append((length, part))
                room -= blocks

    def place(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part, block) of each hash."""
        parts, blocks = self.shape[length]
        part = (W.mix(h ^ _U(0x5851F42D4C957F2D)) % _U(parts)).astype(np.int64) if parts > 1 else np.zeros(len(h), np.int64)
        return part, (((h >> _U(32)) * _U(blocks)) >> _U(32)).astype(np.int64)


def _bits(h: np.ndarray, i: int) -> np.ndarray:
    return np.uint32(1) << ((h.astype(np.uint32) * _SALT[i]) >> np.uint32(27))


def _hashes(plan: Plan):
    def run(batches):
        for batch in batches:
            for rows, m in _by_length(batch.column("word")):
                length = min(LONG, m.letters.shape[1])
                h = W.mix(m.total)
                part, block = plan.place(length, h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), length, np.int32)), pa.array(part.astype(np.int32)), pa.array(block // _PART_BLOCKS), pa.array(h.view(np.int64))],
                    ["length", "part", "piece", "h"])
    return run


def _piece(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        length, part, piece = (table.column(c)[0].as_py() for c in ("length", "part", "piece"))
        h = table.column("h").to_numpy().view(np.uint64)
        block = plan.place(length, h)[1] - piece * _PART_BLOCKS
        out = np.zeros((min(_PART_BLOCKS, plan.shape[length][1] - piece * _PART_BLOCKS), 8), np.uint32)
        for i in range(8):
            np.bitwise_or.at(out[:, i], block, _bits(h, i))
        return pa.table({"length": pa.array([length], pa.int32()), "part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int64()),
                         "bits": pa.array([out.tobytes()], pa.binary())})
    return run


def _probe(plan: Plan, filters, alphabet: list[int]):
    def run(batches):
        held = {k: np.frombuffer(v, np.uint32) for k, v in filters.value.items()}

        def passes(length: int, h: np.ndarray) -> np.ndarray:
            """Numbers of the hashes that the filters of this pass let through."""
            if length not in plan.shape or not any(k[0] == length for k in held):
                return np.zeros(0, np.int64)
            part, block = plan.place(length, h)
            out = []
            for p in range(plan.shape[length][0]):
                if (length, p) in held:
                    live = np.flatnonzero(part == p)
                    for i in range(8):
                        live = live[held[length, p][block[live] * 8 + i] & _bits(h[live], i) != 0]
                    out.append(live)
            return np.concatenate(out)

        for batch in batches:
            for rows, m in _by_length(batch.column("word")):
                n, near, source = m.letters.shape[1], [], []
                if n > LEAST_LETTERS:
                    for i in range(n):
                        once = np.flatnonzero(m.letters[:, i] != m.letters[:, i - 1]) if i else np.arange(len(rows))
                        before = m.upto[once, i - 1] if i else _U(0)
                        live = once[passes(min(LONG, n - 1), W.mix(before + (m.total[once] - m.upto[once, i]) * m.inverse))]
                        near.append(_spell(np.delete(m.letters[live], i, axis=1)))
                        source.append(rows[live])
                for letter in alphabet:
                    row, at = np.nonzero(m.letters < letter)
                    h = W.mix(m.total[row] + (_VALUE[letter] - _VALUE[m.letters[row, at]]) * m.power[at])
                    live = passes(min(LONG, n), h)
                    edited = m.letters[row[live]]
                    edited[np.arange(len(live)), at[live]] = letter
                    near.append(_spell(edited))
                    source.append(rows[row[live]])
                take = pa.array(np.concatenate(source) if source else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("word").take(take), batch.column("n").take(take), pa.concat_arrays(near)],
                                                 ["word", "n", "near"])
    return run


def _alphabet(batches):
    for batch in batches:
        seen = set()
        for _, m in _by_length(batch.column("word")):
            seen.update(np.unique(m.letters).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], ["letter"])


def near_pairs(words: DataFrame, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n): every pair of near words of a written table (word, n), once."""
    spark = words.sparkSession
    size = F.least(F.char_length("word"), F.lit(LONG))
    counts = {r["length"]: r["c"] for r in words.groupBy(size.alias("length")).agg(F.count("*").alias("c")).collect()}  # at most LONG rows
    out = spark.createDataFrame([], "word string, n long, near string")
    if not counts:
        return out.withColumn("near_n", F.lit(0).cast("long"))
    plan = Plan(counts, most_bytes)
    tasks = max(spark.sparkContext.defaultParallelism, sum(counts.values()) // PROBE_WORDS + 1)
    words = words.repartition(tasks)
    alphabet = sorted(r["letter"] for r in words.mapInArrow(_alphabet, "letter int").distinct().collect())  # at most 90 letters
    pieces = materialize(words.mapInArrow(_hashes(plan), "length int, part int, piece long, h long").groupBy("length", "part", "piece")
                         .applyInArrow(_piece(plan), "length int, part int, piece long, bits binary"))
    for keys in plan.passes:
        held = {k: np.zeros(plan.shape[k[0]][1] * 8, np.uint32) for k in keys}
        wanted = spark.createDataFrame(keys, "length int, part int")
        for r in pieces.join(F.broadcast(wanted), ["length", "part"], "left_semi").collect():  # FILTER_BYTES at most
            bits = np.frombuffer(bytes(r["bits"]), np.uint32)
            at = r["piece"] * _PART_BLOCKS * 8
            held[r["length"], r["part"]][at:at + len(bits)] = bits
        filters = spark.sparkContext.broadcast({k: v.tobytes() for k, v in held.items()})
        out = out.unionByName(words.mapInArrow(_probe(plan, filters, alphabet), "word string, n long, near string"))
    return out.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form) whose chains end: the last form of each chain.  Steps double, so the rounds are the
    logarithm of the longest chain."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(ahead, "root", "left"))
        if after.where("next is not null").isEmpty():
            return now
        now = after.select("word", F.coalesce("next", "root").alias("root"))


def group_spellings(docs: DataFrame, seeded_typos: bool = False, most_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per word of the vocabulary: word, n, n_near, form, form_n, root."""
    words = materialize(vocabulary(docs, seeded_typos))
    both = near_pairs(words, most_bytes).select(F.inline(F.array(
        F.struct("word", F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form")).alias("best")),
        F.struct(F.col("near").alias("word"), F.struct((-F.col("n")).alias("rank"), F.col("word").alias("form")).alias("best")))))
    near = both.groupBy("word").agg(F.min("best").alias("best"), F.count("*").alias("n_near"))
    taken = -F.col("best.rank") >= RATIO * F.col("n")
    out = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.rank")).cast("long").alias("form_n")))
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
