"""Line dedup: winnowing over line hashes.

A text is a sequence of ``\\n``-separated lines; a line's hash is over its
words.  A window is the shortest run of lines from a given line on that holds
``min_words`` words (the whole text, if that has fewer).  The line with the
least hash in a window is its fingerprint; neighbouring windows mostly choose
the same line, so a text has few.  Two texts that share a run of at least
``min_words`` words in whole lines share a window and with it a fingerprint:
the choice depends on the window's lines alone.

1. Positions of fingerprints are joined on the line hash; only windows whose
   fingerprint stands at two positions or more go on.
2. Each such window meets the earliest position (by document id, then line) of
   a window with the same lines, never all its other positions.
3. Matches of two texts are extended line by line both ways, and the run is
   deleted from the later text; blank lines inside go with it.  A deleted line
   always stands at an earlier position, and its earliest copy is never deleted.

``dedup_passages`` also cuts repeats that begin or end inside lines: there a window
is any ``min_words`` words in a row and its fingerprint the least hash of its
runs of half as many words.  Windows whose fingerprint stands in two documents
are digested, and all words of a window go that also starts in a document with a
smaller id, or before it in the same text without overlapping it.  The windows
of a longer run cover it to its ends, so nothing is left to extend.  Both kinds
are judged on the input and cut in one pass: the texts are dealt into blocks of
documents once, and every step that reads them reads that one exchange.

Nulls stay null; empty texts and texts without a repeated run stay as they
are, byte for byte; a text whose lines all go becomes empty.  Rows equal in id
and text are one document and stay alike; texts under one id count one by one,
in the order of their hash, and do not cut each other inside lines.  An empty table gives an empty table.  Other
columns are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from estatelens.llm import phrase_automata as P
from estatelens.llm import words as W
from estatelens.llm.frames import plain_names
from estatelens.session import materialize

MIN_WORDS = 50
_BLANK = np.uint64(0x1B873593)
_MARK = ("line", "stop", "ctx", "pick", "print")


def _line_hashes(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each line's words, words of each line, first line of each text)."""
    start, end, _ = chunk.words()
    h = chunk.span_hash(start, end)
    begin, stop, first = chunk.lines()
    w0, w1 = np.searchsorted(start, begin), np.searchsorted(start, stop)
    # polynomial over word hashes, as over bytes
    powers, inverse = W._powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[:len(h)], out=total[1:])
    n = w1 - w0
    out = W.mix((total[w1] - total[w0]) * inverse[w0] + n.astype(np.uint64))
    out[n == 0] = _BLANK
    return out, n, first


def winnow(h: np.ndarray, n: np.ndarray, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """Windows of one text: (first line, end, hash of its lines, line of the minimum, hash of that line)."""
    full = np.flatnonzero(n > 0)
    if not len(full):
        return []
    words = np.cumsum(n[full])
    before = words - n[full]
    reach = np.searchsorted(words, before + min_words)  # last line of the window, in lines with words
    starts = np.flatnonzero(reach < len(full))
    if not len(starts):
        starts, reach = np.zeros(1, np.int64), np.full(1, len(full) - 1)  # the whole text
    hs, ends = h[full], reach[starts]
    powers, inverse = W._powers(len(hs) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hs * powers[:len(hs)], dtype=np.uint64)])
    ctx = W.mix((total[ends + 1] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    pick = [i + int(hs[i:e + 1].argmin()) if e > i else i for i, e in zip(starts.tolist(), ends.tolist())]
    return list(zip(full[starts].tolist(), (full[ends] + 1).tolist(), ctx.view(np.int64).tolist(), full[pick].tolist(),
                    hs[pick].view(np.int64).tolist()))


def _lines(min_words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("row")
            for chunk in W.chunks(batch.column("text")):
                h, n, first = _line_hashes(chunk)
                marks, lines = [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    marks.append([dict(zip(_MARK, w)) for w in winnow(h[a:b], n[a:b], min_words)])
                    lines.append(h[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids[chunk.lo:chunk.hi], pa.array(lines, pa.binary()),
                     pa.array(marks, pa.list_(pa.struct([(k, pa.int64()) for k in _MARK])))],
                    ["row", "lines", "marks"])
    return run


def _grow(a: np.ndarray, b: np.ndarray, matches) -> list[tuple[int, int]]:
    """Runs of lines of text ``a`` that repeat lines of ``b`` around the matches (line, stop, line in b)."""
    # equal windows are equal in their lines with words; blank lines may differ, so compare those lines only
    fa, fb = np.flatnonzero(a != _BLANK), np.flatnonzero(b != _BLANK)
    a, b = a[fa], b[fb]
    out, lo, hi = [], 0, -1
    for line, stop, at in sorted(matches):
        i, k = int(np.searchsorted(fa, line)), int(np.searchsorted(fb, at))
        n = int(np.searchsorted(fa, stop)) - i
        if lo <= i and i + n <= hi:  # inside the last run
            continue
        if not np.array_equal(a[i:i + n], b[k:k + n]):  # two windows with one hash
            continue
        m = min(i, k)
        differ = np.flatnonzero(a[i - m:i][::-1] != b[k - m:k][::-1])
        lo = i - (int(differ[0]) if len(differ) else m)
        m = min(len(a) - i - n, len(b) - k - n)
        differ = np.flatnonzero(a[i + n:i + n + m] != b[k + n:k + n + m])
        hi = i + n + (int(differ[0]) if len(differ) else m)
        out.append((int(fa[lo]), int(fa[hi - 1]) + 1))
    return out


def _extend(batches):
    for batch in batches:
        rows, lo, hi = [], [], []
        for row, found, mine, theirs in zip(*(batch.column(c).to_pylist() for c in ("row", "found", "mine", "theirs"))):
            a = np.frombuffer(mine, np.uint64)
            for x, y in _grow(a, a if theirs is None else np.frombuffer(theirs, np.uint64),
                              [(f["line"], f["stop"], f["at"]) for f in found]):
                rows.append(row)
                lo.append(x)
                hi.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                                         ["row", "lo", "hi"])


def row_key() -> F.Column:
    """Key of a row: its id, zero-padded so that text order is id order (null last), and its text's hash."""
    wide = "decimal(20,0)"
    shifted = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast(wide) + F.lit(str(2**63)).cast(wide)
    return F.concat_ws("-", F.lpad(shifted.cast(wide).cast("string"), 20, "0"), F.hex(F.xxhash64("text")))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, lo, hi): runs of lines [lo, hi) of the text of ``row`` that repeat earlier lines; runs may overlap."""
    lines = materialize(docs.select("doc_id", "text").withColumn("row", row_key()).select("row", "text").mapInArrow(
        _lines(min_words), "row string, lines binary, marks array<struct<line:long,stop:long,ctx:long,pick:long,print:long>>")
        .dropDuplicates(["row"]))
    marks = lines.select("row", F.inline("marks"))
    prints = marks.select("row", "pick", "print").distinct().groupBy("print").agg(F.count("*").alias("c")).where("c > 1").select("print")
    marks = materialize(marks.join(prints, "print", "left_semi").select("row", "line", "stop", "ctx"))
    place = F.struct("row", "line")
    first = marks.groupBy("ctx").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("ctx", "first")
    met = marks.join(first, "ctx").where(place != F.col("first")).select("row", "line", "stop", "first")
    met = met.groupBy("row", F.col("first.row").alias("other")).agg(
        F.collect_list(F.struct("line", "stop", F.col("first.line").alias("at"))).alias("found"))  # the windows of one text
    met = materialize(met)
    own = met.join(lines.select("row", F.col("lines").alias("mine")), "row")
    theirs = lines.select(F.col("row").alias("other"), F.col("lines").alias("theirs"))
    columns = ["row", "found", "mine", "theirs"]
    # adaptive execution splits the partition of an earlier text that very many later ones repeat
    grown = own.where("row != other").join(theirs, "other").select(columns).unionByName(
        own.where("row = other").withColumn("theirs", F.lit(None).cast("binary")).select(columns))
    return grown.mapInArrow(_extend, "row string, lo int, hi int")


def _later_windows(b: P.Block, found: pa.Table) -> np.ndarray:
    """Words of a block's texts in windows that start under a smaller id too, or before in the same text without overlap."""
    depth = np.zeros(len(b.start) + 1, np.int64)
    of, _, least = P.confirmed(b, found, within=True)
    at, of = b.at[of >= 0], of[of >= 0]
    text = b.text[at]
    order = np.lexsort((at, text, of))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(of[order]) != 0) | (np.diff(text[order]) != 0)
    first = np.empty(len(order), np.int64)  # of the same window in the same text
    first[order] = at[order][new][np.cumsum(new) - 1]
    at = at[(b.ids[text] > least[of]) | (at >= first + b.width)]
    np.add.at(depth, at, 1)
    np.add.at(depth, at + b.width, -1)
    return np.cumsum(depth)[:-1] > 0


def _line_ends(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of a text begin and end."""
    at = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    return np.append(0, at + 1), np.append(at, len(data))


def _without(data: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> tuple[str, int]:
    """A text (its words from ``start`` to ``end``) without the words that are ``gone``, and the lines removed; lines left without a
    word go, blank ones inside a cut too."""
    begin, stop = _line_ends(data)
    # one word more on both sides: what a blank line at the edge of a text has for neighbours
    edge = np.concatenate([[False], gone, [False]])
    w0, w1 = np.searchsorted(start, begin), np.searchsorted(start, stop)
    lost = np.concatenate([[0], np.cumsum(gone)])
    left, removed = [], 0
    for b, e, i, j in zip(begin.tolist(), stop.tolist(), w0.tolist(), w1.tolist()):
        n = int(lost[j] - lost[i])
        if n == j - i and (n or (edge[i] and edge[i + 1])):
            removed += 1
        elif n == 0:
            left.append(data[b:e])
        else:
            parts, at, k = [], b, i
            while k < j:
                if not gone[k]:
                    k += 1
                    continue
                to = k
                while to < j and gone[to]:
                    to += 1
                # the space after a cut goes with it, at the end of a line the space before
                if to < j:
                    parts.append(data[at:start[k]])
                    at = int(start[to])
                else:
                    parts.append(data[at:end[k - 1]])
                    at = int(end[j - 1])
                k = to
            left.append(b"".join(parts) + data[at:e])
    return ("" if gone.all() else b"\n".join(left).decode()), removed


def _cut_block(columns: list[str], min_words: int, schema: pa.Schema):
    """The documents of a block without the lines of their runs and the words of later windows."""
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        lines = {r["row"]: r["runs"] for r in found.filter(pc.is_valid(found.column("row"))).select(["row", "runs"]).to_pylist()}
        b = P.Block(docs, min_words)
        inside = _later_windows(b, found.filter(pc.is_valid(found.column("k1"))))
        text = b.table.column("text").combine_chunks()
        mask, new = np.zeros(len(text), bool), []
        gone_lines, gone_words = np.zeros(len(text), np.int32), np.zeros(len(text), np.int32)
        some = np.add.reduceat(np.append(inside, False), np.minimum(b.first[:-1], len(inside))) * (np.diff(b.first) > 0) if len(text) else []
        for i, row in enumerate(b.table.column("row").to_pylist()):
            if not (some[i] or row in lines) or not text[i].is_valid:
                continue
            words = slice(b.first[i], b.first[i + 1])
            off = b.chunk.off[i]
            data = b.chunk.data[off:b.chunk.off[i + 1]].tobytes()
            start, end, gone = b.start[words] - off, b.end[words] - off, inside[words].copy()
            if row in lines:
                begin, stop = _line_ends(data)
                whole = np.zeros(len(gone), bool)
                for r in lines[row]:
                    x, y = np.searchsorted(start, [begin[r["lo"]], stop[r["hi"] - 1]])
                    whole[x:y] = True
                gone_words[i] = int((gone & ~whole).sum())
                gone |= whole
            else:
                gone_words[i] = int(gone.sum())
            if gone.any():
                mask[i] = True
                cut, gone_lines[i] = _without(data, start, end, gone)
                new.append(cut)
        # texts without a cut stay in the buffer they came in
        text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
        parts = [text if c == "text" else b.table.column(c) for c in columns]
        return pa.Table.from_arrays([*parts, pa.array(gone_lines), pa.array(gone_words)], schema=schema)
    return run


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later repeats of runs of lines, nor of words inside lines; ``n_lines_removed`` counts lines that went,
    ``n_words_cut`` words cut that are in no run of whole lines (columns of those names are replaced)."""
    docs = docs.drop("n_lines_removed", "n_words_cut")
    plain = plain_names(docs)
    tasks, blocks = P.sizes(plain)
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    dealt = plain.withColumn("row", row_key()).select("*", block).repartition(tasks, "block")
    found = P.repeated_phrases(dealt, min_words, (min_words + 1) // 2, tasks)
    runs = repeated_runs(docs, min_words).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))  # of one text
    both = found.unionByName(runs.select("*", block), allowMissingColumns=True)
    schema = plain.withColumn("lines", F.lit(0)).withColumn("words", F.lit(0)).schema
    cut = dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_cut_block(plain.columns, min_words, to_arrow_schema(schema)), schema)
    return cut.toDF(*docs.columns, "n_lines_removed", "n_words_cut")


def _cut(runs_column: str, columns: list[str]):
    def run(batches):
        for batch in batches:
            text = batch.column("text")
            mask, new, gone = np.zeros(len(text), bool), [], np.zeros(len(text), np.int32)
            for i, runs in enumerate(batch.column(runs_column).to_pylist()):
                if not runs or not text[i].is_valid:
                    continue
                parts = text[i].as_py().split("\n")
                keep = np.ones(len(parts), bool)
                for r in runs:
                    keep[r["lo"]:r["hi"]] = False
                left = [p for p, k in zip(parts, keep) if k]
                new.append("\n".join(left) if any(p.strip(" \t\v\f\r") for p in left) else "")
                mask[i], gone[i] = True, len(parts) - len(left)
            # texts without a run stay in the buffer they came in
            text = pc.replace_with_mask(text, pa.array(mask), pa.array(new, text.type))
            out = batch.select(columns).set_column(columns.index("text"), batch.schema.field("text"), text)
            yield out.append_column("n_lines_removed", pa.array(gone))
    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs cut out of ``text``, and ``n_lines_removed`` (a column of that name is replaced)."""
    docs = docs.drop("n_lines_removed")
    plain = plain_names(docs)
    runs = repeated_runs(docs, min_words).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    both = plain.withColumn("row", row_key()).join(runs, "row", "left").drop("row")
    cut = both.mapInArrow(_cut("runs", plain.columns), plain.withColumn("n_lines_removed", F.lit(0)).schema)
    return cut.toDF(*docs.columns, "n_lines_removed")
