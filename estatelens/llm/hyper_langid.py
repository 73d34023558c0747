"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, derived from a hash of its code
point, so every letter of every script has its own.  A letter n-gram is the
product of its letters' vectors, each rotated by its place (binding); a text is
the sum of its n-gram vectors (bundling), and a language's prototype is the sum
over all its training texts.  A document gets the language whose prototype has
the greatest cosine with it.

N-grams are three letters long, inside one word, in lower case, with the word's
edges as letters.  Letters are the characters of a Unicode category L.  Training
bundles the n-grams of each task by language; what is added up is one vector a
task and language.

Defined results: a null text, an empty one or one without letters is ``und``
with score 0; with nothing to learn from every text is; equal cosines go to the
smaller language code; repeated rows get equal rows; an empty table gives an
empty table.  A prediction reads the text alone.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.llm import words as W

DIMENSIONS = 1024
SEED = 7
FOLDS, HELD_OUT = 5, 0
EDGE = 0
_U = np.uint64
# letter of every code point in lower case, 0 where it is none; -1: not asked for yet
_LETTERS = np.full(0x110000, -1, np.int32)


def letters(points: np.ndarray) -> np.ndarray:
    """The lower-case letter of each code point, ``EDGE`` for all that is no letter."""
    met = np.zeros(len(_LETTERS), bool)
    met[points] = True
    for p in np.flatnonzero(met & (_LETTERS < 0)).tolist():
        c = chr(p)
        low = c.lower()
        _LETTERS[p] = (ord(low) if len(low) == 1 else p) if unicodedata.category(c)[0] == "L" else EDGE
    return _LETTERS[points]


def symbols(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(letter, text) of every code point, with an edge before, between and after texts."""
    n = len(chunk.data)
    row = np.repeat(np.arange(len(chunk)), np.diff(chunk.off))
    data = np.full(n + len(chunk) + 4, 32, np.uint8)
    place = np.arange(n) + row + 1
    data[place] = chunk.data
    text = np.full(len(data), -1, np.int64)
    text[place] = row
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    lead = lead[lead < len(data) - 3]  # the last are fillers
    points = data[lead].astype(np.int64)
    wide = np.flatnonzero(points >= 0x80)
    if len(wide):
        at, b0 = lead[wide], points[wide]
        b1, b2, b3 = (data[at + i].astype(np.int64) & 0x3F for i in (1, 2, 3))
        points[wide] = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1,
                                np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
    return letters(points).astype(np.int64), text[lead]


def grams(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of every n-gram of a chunk; the middle is a letter."""
    s, text = symbols(chunk)
    mid = np.flatnonzero(s[1:-1] > 0) + 1
    return text[mid], s[mid - 1] << 42 | s[mid] << 21 | s[mid + 1]


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vector of each letter, (points, dimensions) of +1 and -1: the bits of hashes of its code point."""
    with np.errstate(over="ignore"):
        word = W.mix(points.astype(np.uint64)[:, None] * _U(0x9E3779B97F4A7C15) + W.mix(np.arange(1, (dimensions + 63) // 64 + 1, dtype=np.uint64) + _U(SEED << 32))[None, :])
    bits = np.unpackbits(np.ascontiguousarray(word).view(np.uint8), axis=1)[:, :dimensions]
    return bits.astype(np.float32) * 2 - 1


def gram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of n-grams, (codes, dimensions)."""
    place = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
    points = np.unique(np.concatenate(place))
    base = letter_vectors(points, dimensions)
    out = None
    for i, p in enumerate(place):
        v = np.roll(base, 2 - i, axis=1)[np.searchsorted(points, p)]
        out = v if out is None else np.multiply(out, v, out=out)
    return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the vectors of n-grams, each as often as it counts."""
    out = np.zeros(DIMENSIONS)
    for lo in range(0, len(codes), 8192):
        out += counts[lo:lo + 8192].astype(np.float64) @ gram_vectors(codes[lo:lo + 8192]).astype(np.float64)
    return out


def _learn(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), dtype=object)
        for chunk in W.chunks(batch.column("text")):
            text, code = grams(chunk)
            own = lang[chunk.lo:chunk.hi]
            for name in sorted(set(own.tolist())):
                part = bundle(*np.unique(code[(own == name)[text]], return_counts=True))
                total[name] = total[name] + part if name in total else part
    place = np.arange(DIMENSIONS)
    for name, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS, pa.string()), pa.array(place), pa.array(v.astype(np.int64))], ["lang", "place", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, prototypes) from the rows that are not held out and have a language."""
    train = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    rows = (train.mapInArrow(_learn, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
            .toPandas())  # one vector a language
    langs = sorted(rows["lang"].unique())
    protos = np.zeros((len(langs), DIMENSIONS))
    for i, name in enumerate(langs):
        mine = rows[rows["lang"] == name]
        protos[i, mine["place"].to_numpy()] = mine["n"].to_numpy(np.float64)
    return langs, protos


class Encoder:
    """Bundles the texts of a chunk; vectors of n-grams met are kept, up to a bound."""

    def __init__(self, most: int = 24_000):
        self.most, self.codes, self.rows = most, np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.float32)

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of sorted codes."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        if not known.all():
            fresh = gram_vectors(codes[~known])
            if len(self.codes) + len(fresh) > self.most:
                keep = np.zeros(len(self.codes), bool)
                keep[at[known]] = True
                self.codes, self.rows = self.codes[keep], self.rows[keep]
            every = np.concatenate([self.codes, codes[~known]])
            order = np.argsort(every, kind="stable")
            self.codes, self.rows = every[order], np.concatenate([self.rows, fresh])[order]
            at = np.searchsorted(self.codes, codes)
        return self.rows[at]

    def bundle(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the n-grams' vectors, whether there are any) of each text."""
        text, code = grams(chunk)
        has = np.zeros(len(chunk), bool)
        has[text] = True
        codes, own = np.unique(code, return_inverse=True)
        out = np.zeros((len(chunk), DIMENSIONS), np.float32)
        for lo in range(0, len(codes), self.most):
            vectors = self._vectors(codes[lo:lo + self.most])
            k = len(vectors)
            here = (own >= lo) & (own < lo + k)
            for d in range(0, len(chunk), 512):  # bounded count matrix
                m = min(512, len(chunk) - d)
                at = here & (text >= d) & (text < d + m)
                count = np.bincount((text[at] - d) * k + own[at] - lo, minlength=m * k).reshape(m, -1)
                out[d:d + m] += count.astype(np.float32) @ vectors
        return out, has


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    norm = np.linalg.norm(prototypes, axis=1)
    proto = (prototypes / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)

    def run(batches):
        encoder = Encoder()
        for batch in batches:
            for chunk in W.chunks(batch.column("text")):
                v, has = encoder.bundle(chunk)
                size = np.linalg.norm(v, axis=1)
                lang = np.full(len(chunk), "und", dtype=object)
                score = np.zeros(len(chunk))
                if langs:
                    cos = (v @ proto.T) / np.where(size > 0, size, 1)[:, None]
                    best = cos.argmax(1)
                    lang = np.array(langs, dtype=object)[best]
                    score = np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1)
                lang[~has] = "und"
                score[lang == "und"] = 0.0
                rows = slice(chunk.lo, chunk.hi)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[rows], batch.column("held_out")[rows], pa.array(lang, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")

