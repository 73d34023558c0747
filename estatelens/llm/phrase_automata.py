"""Substring dedup: automata of repeated phrases.

A phrase is ``width`` words in a row, as they stand.  Every word that a phrase covers goes, if the same phrase also
starts in a document with a smaller id; phrases are judged on the input, never on what is left.

Documents are dealt into blocks of about ``BLOCK_BYTES`` by a hash of id and text; the texts are shuffled once, and the
three steps that read them read that one exchange.

1. Candidates.  The least hash of the ``gram``-word runs of a phrase is its print; neighbouring phrases mostly share it.
   A block sends its distinct prints, dealt by their hash, and gets back those that stand in two documents or more.
2. Confirmation.  A block sends a 96-bit digest of each phrase whose print came back, with the smallest id that holds
   it, and gets back those that start under a smaller id in another block.  A phrase of very many documents is one
   entry a block, so nothing here grows with a group of copies but by the number of blocks.
3. Automata.  A block compiles its confirmed phrases into Aho-Corasick automata of at most ``SHARD_PHRASES`` phrases,
   and streams all its documents through them.  The letters of the automaton are words (two symbols each), so a match
   is one of whole words.  Each match starts a phrase; its words go where the document's id is greater than the
   phrase's first.

Nulls: a null text has no words; a null id counts as greater than all others (two null ids are equal).  A text of fewer
than ``width`` words stays as it is.  Rows equal in id and text stay alike; rows under one id never remove each other's
words.  Texts of any length are read whole, in pieces of ``PIECE_WORDS`` words an automaton.  An empty table gives an
empty table.  Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm import words as W

WIDTH, GRAM = 13, 7
BLOCK_BYTES = 2 << 20
TASK_BYTES = 32 << 20
SHARD_PHRASES = 40_000
PIECE_WORDS = 400_000
LAST = 2**63 - 1
_LOW, _HIGH = 0x0100, 0x8000  # first symbols of the two halves of a word's number; both ranges hold 0x5000


class Block:
    """The words of the documents of one block, in the order of their ids."""

    def __init__(self, table: pa.Table, width: int):
        ids = table.column("doc_id").to_numpy() if not table.column("doc_id").null_count else \
            table.column("doc_id").fill_null(LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.table = table = table.take(pa.array(order))
        self.doc_id, self.ids, self.width = table.column("doc_id"), ids[order], width
        data, off = W.text_buffer(table.column("text"))
        self.chunk = W.Chunk(0, len(order), data, off)
        self.start, self.end, self.first = self.chunk.words()
        self.text = np.repeat(np.arange(len(order)), np.diff(self.first))  # of each word
        h = self.chunk.span_hash(self.start, self.end)
        self.hashes, self.total = h, self._sums(h)
        n = max(0, len(h) - width + 1)
        self.at = np.flatnonzero(np.arange(n) + width <= self.first[1:][self.text[:n]])  # where a phrase starts

    @staticmethod
    def _sums(h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * W._powers(len(h) + 1)[0][:len(h)], out=out[1:])
        return out

    def _runs(self, k: int, total: np.ndarray) -> np.ndarray:
        """Hash of every run of ``k`` words, from prefix sums over word hashes."""
        return W.mix((total[k:] - total[:-k]) * W._powers(len(total))[1][:len(total) - k])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of every phrase."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        other = self._sums(W.mix(self.hashes ^ np.uint64(0x6A09E667F3BCC909)))
        return self._runs(self.width, self.total)[self.at], self._runs(self.width, other)[self.at] >> np.uint64(32)

    def prints(self, gram: int) -> np.ndarray:
        """The print of every phrase: the least hash of its runs of ``gram`` words."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        least, wide, runs = self._runs(gram, self.total), 1, self.width - gram + 1
        while 2 * wide <= runs:  # minima over twice as many runs
            least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
        if wide < runs:
            least = np.minimum(least[:wide - runs], least[runs - wide:])
        return least[self.at]


def _groups(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a place in it begins a phrase): equal pairs side by side."""
    order = np.argsort(k1)
    a, b = k1[order], k2[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # two phrases with one 64-bit hash
        order = np.lexsort((k2, k1))
        a, b = k1[order], k2[order]
        same = a[1:] == a[:-1]
    new = np.ones(len(order), bool)
    new[1:] = ~same | (b[1:] != b[:-1])
    return order, new


def _deal(bucket: np.ndarray, **values: np.ndarray) -> tuple[np.ndarray, dict[str, list[bytes]]]:
    """Values by bucket, each as bytes, in their order."""
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    ends = np.append(begin[1:], len(order))
    return found, {k: [v[order[a:b]].tobytes() for a, b in zip(begin.tolist(), ends.tolist())] for k, v in values.items()}


def _joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all values, the row of each) of a column of packed values."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    if not parts:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


def _send_prints(width: int, gram: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        b = Block(table, width)
        prints, text = b.prints(gram), b.text[b.at]
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (text[1:] != text[:-1])
        prints, text = prints[new], text[new]
        order = np.lexsort((text, prints))
        prints, text = prints[order], text[order]
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (text[1:] != text[:-1])
        distinct, documents = np.unique(prints[new], return_counts=True)
        found, out = _deal(distinct % np.uint64(buckets), prints=distinct, many=documents > 1)
        return pa.table({"bucket": pa.array(found.astype(np.int64)), "block": pa.array(np.full(len(found), table.column("block")[0].as_py(), np.int64)),
                         "prints": pa.array(out["prints"], pa.binary()), "many": pa.array(out["many"], pa.binary())})
    return run


def _return_prints(table: pa.Table) -> pa.Table:
    prints, row = _joined(table.column("prints"), np.uint64)
    many, _ = _joined(table.column("many"), bool)
    distinct, which = np.unique(prints, return_inverse=True)
    hot = np.bincount(which, minlength=len(distinct)) > 1
    hot[which[many]] = True
    keep = hot[which]
    rows, out = _deal(row[keep], prints=prints[keep])
    return pa.table({"block": table.column("block").take(pa.array(rows)).combine_chunks(), "prints": pa.array(out["prints"], pa.binary())})


def _send_phrases(width: int, gram: int, buckets: int):
    def run(docs: pa.Table, hot: pa.Table) -> pa.Table:
        if hot.num_rows and docs.num_rows:
            b = Block(docs, width)
            of = np.isin(b.prints(gram), _joined(hot.column("prints"), np.uint64)[0])
            k1, k2 = (k[of] for k in b.digests())
            text = b.text[b.at[of]]
            order, new = _groups(k1, k2)
            # of each phrase its place under the smallest id (documents are in the order of theirs), in page order
            first = np.sort(np.minimum.reduceat(order, np.flatnonzero(new))) if len(order) else order
            k1, k2, ids = k1[first], k2[first].astype(np.uint32), b.ids[text[first]]
            found, out = _deal(k1 % np.uint64(buckets), k1=k1, k2=k2, ids=ids)
            block = docs.column("block")[0].as_py()
        else:
            found, out, block = np.zeros(0, np.int64), {"k1": [], "k2": [], "ids": []}, 0
        return pa.table({"bucket": pa.array(found.astype(np.int64)), "block": pa.array(np.full(len(found), block, np.int64))}
                        | {c: pa.array(out[c], pa.binary()) for c in ("k1", "k2", "ids")})
    return run


def _return_phrases(table: pa.Table) -> pa.Table:
    k1, row = _joined(table.column("k1"), np.uint64)
    k2, _ = _joined(table.column("k2"), np.uint32)
    ids, _ = _joined(table.column("ids"), np.int64)
    order, new = _groups(k1, k2.astype(np.uint64))
    least = np.empty(len(order), np.int64)
    least[order] = (np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(order) else ids)[np.cumsum(new) - 1]
    keep = least < ids
    rows, out = _deal(row[keep], k1=k1[keep], k2=k2[keep], ids=least[keep])
    return pa.table({"block": table.column("block").take(pa.array(rows)).combine_chunks()}
                    | {c: pa.array(out[c], pa.binary()) for c in ("k1", "k2", "ids")})


def confirmed(b: Block, found: pa.Table, within: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of the block that stand under a smaller id too (``within``: or twice in the block): (a phrase's number for each window or
    -1, a place of each phrase, the smallest id of each phrase)."""
    (q1, _), (q2, _), (first, _) = (_joined(found.column(c), t) for c, t in (("k1", np.uint64), ("k2", np.uint32), ("ids", np.int64)))
    n = len(b.at)
    own1, own2 = b.digests()
    ids = np.concatenate([b.ids[b.text[b.at]], first])
    order, new = _groups(np.concatenate([own1, q1]), np.concatenate([own2, q2.astype(np.uint64)]))
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(order) else ids
    later = np.zeros(len(least), bool)
    here = order < n
    later[group[here][ids[order][here] > least[group[here]]]] = True
    if within:
        later |= np.bincount(group[here], minlength=len(least)) > 1
    number = np.full(len(least), -1)
    number[later] = np.arange(int(later.sum()))
    place = np.zeros(int(later.sum()), np.int64)
    own = order[here]
    mine = number[group[here]]
    place[mine[mine >= 0]] = b.at[own[mine >= 0]]
    of = np.full(n, -1)
    of[own] = mine
    return of, place, least[later]


def _symbols(b: Block) -> str:
    """The words of a block as a string of two symbols a word; equal words, and only those, are equal symbols."""
    data = b.chunk.data[~b.chunk.space]
    off = np.concatenate([[0], np.cumsum(b.end - b.start)]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])
    number = texts.dictionary_encode().indices.to_numpy()
    base = max(256, int(np.ceil(np.sqrt(len(number) + 1)))) if len(number) > 2**23 else 256
    pair = np.empty((len(number), 2), np.uint16)
    pair[:, 0], pair[:, 1] = _HIGH + number // base, _LOW + number % base
    return pair.tobytes().decode("utf-16-le")


def _locate(b: Block, found: pa.Table) -> np.ndarray:
    """Words of the block that go."""
    depth = np.zeros(len(b.start) + 1, np.int64)
    of, place, least = confirmed(b, found)
    if not len(place):
        return depth[:-1] > 0
    text, width = _symbols(b), b.width
    starts = np.zeros(len(b.start), bool)
    starts[b.at] = True
    for lo in range(0, len(b.start), PIECE_WORDS):
        hi = min(lo + PIECE_WORDS + width - 1, len(b.start))
        inside = (b.at >= lo) & (b.at + width <= hi)
        phrases = np.unique(of[inside])
        phrases = phrases[phrases >= 0]
        piece = text[2 * lo:2 * hi]
        for s in range(0, len(phrases), SHARD_PHRASES):
            machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, at in zip(phrases[s:s + SHARD_PHRASES].tolist(), place[phrases[s:s + SHARD_PHRASES]].tolist()):
                machine.add_word(text[2 * at:2 * (at + width)], i)
            machine.make_automaton()
            hits = np.fromiter((x for hit in machine.iter(piece) for x in hit), np.int64).reshape(-1, 2)
            at = lo + (hits[:, 0] + 1) // 2 - width
            at, phrase = at[starts[at]], hits[starts[at], 1]  # a match over the border of two texts is none
            at = np.unique(at[b.ids[b.text[at]] > least[phrase]])
            # pieces overlap by less than a phrase, so a start is found once
            np.add.at(depth, at, 1)
            np.add.at(depth, at + width, -1)
    return np.cumsum(depth)[:-1] > 0


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _clean(width: int, texts: bool):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        b = Block(docs, width)
        gone = _locate(b, found)
        lost = np.concatenate([[0], np.cumsum(gone)])
        removed = lost[b.first[1:]] - lost[b.first[:-1]]
        # kept words, each with one space if a separator follows it in its text
        data = b.chunk.data.copy()
        data[b.chunk.space] = 0x20
        edge = np.zeros(len(data) + 2, np.int32)
        kept = ~gone
        follows = (b.end[kept] < b.chunk.off[1:][b.text[kept]]).astype(np.int64)
        np.add.at(edge, b.start[kept], 1)
        np.add.at(edge, b.end[kept] + follows, -1)
        mask = np.cumsum(edge)[:len(data)] > 0
        out = data[mask].tobytes()
        off = np.concatenate([[0], np.cumsum(mask)])[b.chunk.off]
        parts = [out[x:y].removesuffix(b" ") for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
        table = {"doc_id": b.doc_id.cast(pa.int64()), "n_words": pa.array(np.diff(b.first).astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)),
                 "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string())}
        if texts:
            spans = []
            for x, y in zip(b.first[:-1].tolist(), b.first[1:].tolist()):
                d = np.flatnonzero(np.diff(np.concatenate([[0], gone[x:y].astype(np.int8), [0]])))
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(d[::2], d[1::2])])
            table |= {"kept": pa.array([x.decode() for x in parts], pa.string()), "spans": pa.array(spans, SPANS)}
        return pa.table(table)
    return run


def sizes(docs: DataFrame) -> tuple[int, int]:
    """(tasks, blocks) for the texts of ``docs``, by their bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES + 1), max(1, size // BLOCK_BYTES)


def repeated_phrases(dealt: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """(block, k1, k2, ids): for each block of documents (columns block, doc_id, text), packed, the digests of its phrases that start under
    a smaller id in another block, and that id.  Phrases within one block are the block's own to compare."""
    packed = ", ".join(f"{c} binary" for c in ("k1", "k2", "ids"))
    prints = dealt.groupBy("block").applyInArrow(_send_prints(width, gram, buckets), "bucket long, block long, prints binary, many binary")
    hot = prints.groupBy("bucket").applyInArrow(_return_prints, "block long, prints binary")
    sent = dealt.groupBy("block").cogroup(hot.groupBy("block")).applyInArrow(_send_phrases(width, gram, buckets), f"bucket long, block long, {packed}")
    return sent.groupBy("bucket").applyInArrow(_return_phrases, f"block long, {packed}")


def dedup_phrases(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space); with ``texts`` also
    those words (``kept``) and the removed runs of words (``spans``, ends exclusive)."""
    if not 0 < gram <= width:
        raise ValueError("a gram is no longer than a phrase")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks, blocks = sizes(docs)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(tasks, "block")
    found = repeated_phrases(dealt, width, gram, tasks)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if texts:
        schema += ", kept string, spans array<struct<start:long,end:long>>"
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_clean(width, texts), schema)
