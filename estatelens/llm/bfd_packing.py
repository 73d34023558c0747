"""Packing token pieces into fixed windows by best-fit decreasing.

Documents become token ids with an end mark; a document longer than a window is
first cut into full windows, each a sequence of its own.  The remainders are
placed longest first, each into the open window with the least room that still
holds it.

Windows with equal room are alike, and so are pieces of equal length, so the
packing is decided on counts: how many pieces there are of each length, at most
``window`` numbers however large the corpus.  A segment tree over the remaining
capacities finds the tightest open window; a run of equal pieces is placed into
a run of equal windows in one step.  The outcome says, for every range of ranks
within a length, which sequences take it and where.  Each piece's rank comes
from its rank in its task plus the counts of the tasks before, so no piece is
collected anywhere.

Null texts count as empty and give one piece, the end mark.  Repeated rows are
packed as they come.  An empty table gives an empty table; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm import words as W
from estatelens.session import materialize

WINDOW = 2048
END_ID = 1


class SegmentTree:
    """Which remaining capacities have open windows; ``tightest(n)`` is the least of at least ``n``."""

    def __init__(self, top: int):
        self.size = 1
        while self.size <= top:
            self.size *= 2
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, value: bool) -> None:
        i = self.size + capacity
        self.open[i] = value
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, n: int) -> int | None:
        i = self.size + n
        if i >= 2 * self.size:
            return None
        while not self.open[i]:
            # up to the first ancestor that is a left child, over to its sibling
            while i % 2 and i > 1:
                i //= 2
            if i <= 1:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def plan(count: dict[int, int], window: int = WINDOW) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Best-fit decreasing on counts of lengths.

    Returns for each length the runs (first rank, first sequence, offset), by
    rank, and the number of sequences.
    """
    tree = SegmentTree(window)
    held: dict[int, list[list[int]]] = {}  # capacity -> runs [first sequence, number]
    runs: dict[int, list[tuple[int, int, int]]] = {}
    made = 0
    for n in sorted((k for k, c in count.items() if c > 0), reverse=True):
        left, rank = count[n], 0
        out = runs.setdefault(n, [])
        while left:
            c = tree.tightest(n)
            # equal pieces fill a window one after another before the next: it stays the tightest while it holds them
            if c is None:
                c, per = window, window // n
                first, have = made, -(-left // per)
                made += have
            else:
                per = c // n
                first, have = held[c].pop()
                if not held[c]:
                    tree.set(c, False)
            use = min(have, -(-left // per))
            placed = min(left, use * per)
            full, rest = divmod(placed, per)
            for j in range(per):
                k = full + (j < rest)
                if k:
                    out.append((rank, first, window - c + j * n))
                    rank += k
            left -= placed
            for room, at, num in ((c - per * n, first, full), (c - rest * n, first + full, int(rest > 0)), (c, first + use, have - use)):
                if room and num:
                    held.setdefault(room, []).append([at, num])
                    tree.set(room, True)
    return runs, made


# ---- token ids ----

_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^\sa-z0-9\xDF-\xF6\xF8-\xFF]+")
CHUNK_BYTES = 1 << 20
_LETTER, _SPACE, _SIGN, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[0x61:0x7B] = _LETTER
_KIND[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE


class _Words:
    """The word parts of a chunk of texts, found in its bytes.

    A part is a run of letters or a run of anything else between spaces; a word with an apostrophe stays whole.  Upper
    case goes.  ``whole`` marks the texts that hold other than plain and Latin-1 characters, or a special token's mark: those have no parts.
    """

    def __init__(self, chunk: W.Chunk):
        data, off = chunk.data.copy(), chunk.off
        n = len(data)
        data[(data >= 65) & (data <= 90)] += np.uint8(32)
        lead = np.flatnonzero(data == 0xC3)
        second = data[lead + 1]
        kind = _KIND[data]
        letter = (second != 0x97) & (second != 0xB7)  # not the signs of times and division
        kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
        upper = letter & (second < 0x9F)
        data[lead[upper] + 1] += np.uint8(0x20)
        mark = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        odd = np.concatenate([np.flatnonzero(kind == _OTHER), mark])
        self.whole = np.zeros(len(chunk), bool)
        self.whole[np.searchsorted(off, odd, "right") - 1] = True
        for i in np.flatnonzero(self.whole).tolist():
            kind[off[i]:off[i + 1]] = _SPACE
        space = kind == _SPACE
        begin = np.ones(n + 1, bool)
        begin[1:] = np.append(space[:-1], True) if n else True
        begin[off] = True  # a text begins
        begin = begin[:n] & ~space
        change = np.zeros(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        stroke = np.flatnonzero(data == 0x27)
        if len(stroke):
            word = np.cumsum(begin)
            tied = np.zeros(int(word[-1]) + 1, bool)
            tied[word[stroke]] = True
            change &= ~tied[word]
        first = ~space & (begin | change)
        start = np.flatnonzero(first)
        size = np.diff(np.append(np.cumsum(~space)[start] - 1, int((~space).sum())))
        cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cut), pa.py_buffer(data[~space])]).dictionary_encode()
        self.parts, self.which = parts.dictionary.to_pylist(), parts.indices.to_numpy()
        self.first = np.searchsorted(start, off)  # first part of each text


class TokenBytes:
    """Token ids of texts as little-endian 32-bit numbers; of every distinct word part the tokenizer is asked once.

    The vocabulary is lower case, drops white space and ends every word part with
    a marked token, so the ids of a text are the ids of its parts in order.  That
    holds for texts of plain and Latin-1 letters without the special tokens'
    marks; any other text goes to the tokenizer whole.  At most ``most`` parts are kept.
    """

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.off, self.ids = np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, many words a call: every part of a word ends with a marked token."""
        out = []
        for lo in range(0, len(words), 4096):
            some = words[lo:lo + 4096]
            parts = [max(1, len(_PARTS.findall(w))) for w in some]
            ids = self._ids([" ".join(some)])[0]
            cut = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
            if len(cut) == sum(parts) + 1 and cut[-1] == len(ids):
                at = cut[np.append(0, np.cumsum(parts))].tolist()
                out += [ids[a:b] for a, b in zip(at, at[1:])]
            else:
                out += self._ids(some)
        return out

    def _learn(self, words: list[bytes]) -> None:
        found = self._ask([w.decode() for w in words])
        at = len(self.place)
        self.place.update(zip(words, range(at, at + len(words))))
        sizes = np.array([len(f) for f in found], np.int64)
        self.off = np.append(self.off, self.off[-1] + np.cumsum(sizes))
        self.ids = np.concatenate([self.ids, *found])

    def chunk(self, chunk: W.Chunk, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a chunk, first of each text and the end); ``texts`` gives a text by its number in the chunk."""
        w = _Words(chunk)
        new = [p for p in w.parts if p not in self.place]
        if len(self.place) + len(new) > self.most:
            self.clear()
            new = w.parts
        if new:
            self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, w.parts), np.int64, len(w.parts))[w.which]
        size = self.off[place + 1] - self.off[place]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.off[place] - before[:-1], size) + np.arange(before[-1])]
        cut = before[w.first]
        whole = np.flatnonzero(w.whole).tolist()
        if whole:
            each = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            for i, found in zip(whole, self._ids([texts(i) for i in whole])):
                each[i] = found
            ids, cut = np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])])
        return ids, cut

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for c in W.chunks(pa.array(texts, pa.large_string()), size=CHUNK_BYTES):
            ids, cut = self.chunk(c, lambda i, lo=c.lo: texts[lo + i])
            out += [ids[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return out


_CODERS: dict[str, TokenBytes] = {}


def coder_of(path: str) -> TokenBytes:
    """The tokenizer of a vocabulary file, read once a worker; the parts it has learned are a task's."""
    if path not in _CODERS:
        _CODERS[path] = TokenBytes(path)
    _CODERS[path].clear()
    return _CODERS[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"


def _pieces(path: str, window: int, with_ids: bool):
    def run(batches):
        coder, part = coder_of(path), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for c in W.chunks(texts, size=CHUNK_BYTES):
                ids, cut = coder.chunk(c, lambda i, lo=c.lo: texts[lo + i].as_py())
                cut, rows = cut.tolist(), []
                for i in range(len(c)):
                    tokens = np.append(ids[cut[i]:cut[i + 1]], np.uint32(END_ID))
                    total, raw = len(tokens), tokens.astype("<u4").tobytes()
                    for start in range(0, total, window):
                        some = raw[4 * start:4 * (start + window)]
                        n = len(some) // 4
                        row = (doc_ids[c.lo + i], start, n, zlib.crc32(some), total, part, int(seen[n]))
                        rows.append((*row, some) if with_ids else row)
                        seen[n] += 1
                cols = list(zip(*rows))
                types = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "place"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        coder.clear()  # an idle worker holds no words
    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked for)."""
    schema = PIECES + (", ids binary" if with_ids else "")
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, window, with_ids), schema))
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    count = {int(r[0]): int(r[1]) for r in per_task.groupBy("length").agg(F.sum("n")).collect()}  # at most one row a length
    runs, _ = plan(count, window)
    table = {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}

    def place(batches):
        for batch in batches:
            n = batch.column("length").to_numpy()
            rank = batch.column("before").to_numpy() + batch.column("place").to_numpy()
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for length in np.unique(n).tolist():
                at = np.flatnonzero(n == length)
                first, sequence, offset = table[length]
                i = np.searchsorted(first, rank[at], "right") - 1
                seq[at], off[at] = sequence[i] + rank[at] - first[i], offset[i]
            out = [batch.column(c) for c in keep] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(out, [*keep, "sequence_id", "offset"])

    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    ranked = pieces.join(before.select("part", "length", "before"), ["part", "length"])
    fields = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in keep)
    return ranked.select(*keep, "place", "before").mapInArrow(place, fields + ", sequence_id long, offset long")
