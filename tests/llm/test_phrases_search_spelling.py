"""Phrase automata, ranked search and spelling groups against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from estatelens.llm import lexical_search, phrase_automata, spelling_groups
from estatelens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
# columns named like the operators' own
SCHEMA = ("doc_id long, text string, block long, bucket string, ids array<long>, word string, n long, term string, shard int, "
          "`a.b` int, score double")
EXTRA = (1, "x", [1], "w", 2, "t", 3, 4, 0.5)


def frame(spark, rows):
    return spark.createDataFrame([r + EXTRA for r in rows], SCHEMA)


def duck(name, **tables):
    import duckdb
    con = duckdb.connect()
    for t, (columns, rows) in tables.items():
        con.execute(f"create table {t} ({columns})")
        if rows:
            con.executemany(f"insert into {t} values ({', '.join('?' * len(rows[0]))})", rows)
    out = con.execute(ORACLES[name])
    names = [c[0] for c in out.description]
    return sorted((dict(zip(names, r)) for r in out.fetchall()), key=str)


def same(df, want):
    assert sorted((r.asDict() for r in df.collect()), key=str) == want


# ---- phrases ----

def brute_phrases(rows, k=13):
    words = [WORD.findall(t or "") for _, t in rows]
    ids = [math.inf if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(ids, words):
        for j in range(len(w) - k + 1):
            p = tuple(w[j:j + k])
            first[p] = min(first.get(p, math.inf), i)
    out = []
    for (doc, _), i, w in zip(rows, ids, words):
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j:j + k])] < i:
                gone.update(range(j, j + k))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def phrases(df, **kw):
    return sorted((tuple(r) for r in phrase_automata.dedup_phrases(df, **kw).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_phrases_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_phrases([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(w[2] for w in want) > 500
    assert sorted((tuple(r) for r in QUERIES["op13_phrase_automata"](spark, SF).collect()), key=str) == want


def odd_phrases():
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "ö", "ein", "x.", "日本", "a"]) + str(rng.randrange(40))
    shared = [word() for _ in range(60)]
    rows = [(None, " ".join(shared)), (None, " ".join(shared)), (7, None), (8, ""), (9, "  \n\t "), (10, " ".join(shared[:12])), (11, " ".join(shared[:13]))]
    rows += [(3, "\n".join(shared[20:]) + "\t"), (3, " ".join(shared)), (2, "y " * 200), (4, "y " * 30 + "z"), (-5, "y\ty " * 7)]
    for i in range(30, 60):  # a passage in the middle of unlike texts, cut at different places
        a = rng.randrange(30)
        rows.append((i, " ".join([word() for _ in range(rng.randrange(20))] + shared[a:a + rng.randrange(10, 30)] + [word() for _ in range(5)])))
    rows.append((61, " ".join(word() for _ in range(20_000))))  # a long text, and a later one that holds parts of it
    rows.append((62, rows[-1][1][5_000:60_000] + " end"))
    return rows + rows[-3:-2] + rows[3:4]


def test_phrases_in_odd_rows(spark, monkeypatch):
    rows = odd_phrases()
    want = brute_phrases(rows)
    assert phrases(frame(spark, rows)) == want
    # many blocks, small pieces and small automata give the same
    monkeypatch.setattr(phrase_automata, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(phrase_automata, "PIECE_WORDS", 300)
    monkeypatch.setattr(phrase_automata, "SHARD_PHRASES", 50)
    assert phrases(frame(spark, rows)) == want
    assert phrases(frame(spark, rows), gram=3) == want
    assert phrases(frame(spark, rows).limit(0)) == []
    got = {r["doc_id"]: r for r in phrase_automata.dedup_phrases(frame(spark, [(1, "a b c d"), (2, "x a b c d y"), (3, "q")]), width=3, gram=2, texts=True).collect()}
    assert got[2]["kept"] == "x y" and [tuple(s) for s in got[2]["spans"]] == [(1, 5)] and got[3]["spans"] == [] and got[1]["kept"] == "a b c d"


# ---- search ----

def brute_search(docs, items, k=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(d, Counter(w), len(w)) for d, t in docs if (w := terms(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, t in items:
        asked.setdefault(item, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scores = []
        for d, c, size in held:
            m = 100 - 90 + (90 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def searched(index, items, **kw):
    return sorted((tuple(r) for r in lexical_search.search(index, items, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_of_the_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    got = QUERIES["op12_block_max_search"](spark, SF)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == want


def test_search_of_odd_rows_in_small_shards(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["the", "Été", "日本語", "x_y", "İ"]
    rows = [(i, " ".join(rng.choices(words, range(1, len(words) + 1), k=rng.randrange(1, 40)))) for i in range(700)]
    rows += [(None, "the w1 w2"), (5, "the w1 w2"), (5, "the w1 w2"), (900, None), (901, ""), (902, "!!"), (903, "the " * 50_000 + "w3")]
    items = [(1, "THE w1, W1; w2"), (2, None), (3, "nothing-here zzz"), (4, "日本語 été É"), (1, "w3"), (None, "w4 w5"), (7, "the"), (8, " ".join(words)), (9, "the x y")]
    docs = frame(spark, rows)
    asked = spark.createDataFrame([r + (1, "q") for r in items], "item_id long, text string, query int, term string")
    want = brute_search(rows, items)
    assert searched(lexical_search.build_index(docs), asked) == want
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 3_000)
    monkeypatch.setattr(lexical_search, "BLOCK", 4)
    monkeypatch.setattr(lexical_search, "RANGE", 16)
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", 3)
    small = lexical_search.build_index(docs)
    assert small.rows.where("term is null").count() > 5
    assert searched(small, asked) == want
    assert searched(small, asked, k=3) == [r for r in want if r[1] <= 3]
    assert searched(lexical_search.build_index(docs.limit(0)), asked) == searched(small, asked.limit(0)) == []


def test_blocks_are_rejected_before_they_are_opened():
    rng = np.random.default_rng(1)
    m = np.full(4_000, 100)

    def plist(docs, tf):
        value = lexical_search.impact(tf, m[docs])
        block = np.arange(0, len(docs), 128)
        gap = np.diff(docs, prepend=0)
        gap[block] = docs[block]
        data, byte = lexical_search.pack_numbers(np.stack([gap, tf], 1).ravel())
        return lexical_search._List(int(value.max()), docs[np.append(block[1:], len(docs)) - 1].astype(np.int32).tobytes(),
                                    np.maximum.reduceat(value, block).astype(np.int32).tobytes(), byte[2 * block].astype(np.uint32).tobytes(), data.tobytes(), m)

    common = plist(np.arange(4_000), np.ones(4_000, np.int64))
    rare = plist(np.sort(rng.choice(4_000, 40, False)), rng.integers(1, 9, 40))
    docs, scores = lexical_search.max_score([(50, common), (9_000, rare)], np.arange(4_000))
    whole = np.zeros(4_000, np.int64)
    for w, p in ((50, common), (9_000, rare)):
        d, v = p.blocks(range(len(p.last)))
        whole[d] += w * v
    order = np.lexsort((np.arange(4_000), -whole))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
    numbers = np.array([0, 1, 127, 128, 16_383, 16_384, 2**31, 2**40])
    assert lexical_search.unpack_numbers(lexical_search.pack_numbers(numbers)[0]).tolist() == numbers.tolist()


# ---- spelling ----

def brute_spelling(rows):
    counts = Counter()
    for doc, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    lengths = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    form, count = {}, {}
    for w, n in words.items():
        close = [v for k in (len(w) - 1, len(w), len(w) + 1) for v in lengths.get(k, ()) if near(w, v)]
        count[w] = len(close)
        best = min(close, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        r = w
        while r in form:
            r = form[r]
        out.append((w, n, form.get(w), r, count[w], words[form[w]] if w in form else None))
    return sorted(out, key=str)


COLUMNS = ("word", "n", "form", "root", "n_near", "form_n")


def spelled(df, **kw):
    return sorted((tuple(r[c] for c in COLUMNS) for r in spelling_groups.group_spellings(df, seeded_typos=True, **kw).collect()), key=str)


def odd_spellings():
    rng = random.Random(11)
    base = ["house", "houses", "éclair", "straße", "naïvely", "aaaaa", "aaaaaa", "abcde", "ÿÿÿÿÿ", "über×mut", "zebra" * 30]
    rows = []
    for i in range(400):
        text = []
        for _ in range(rng.randrange(1, 30)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w[at:at + rng.randrange(2)] = rng.choice(["", "é", "s", "a", "ÿ"])
            text.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((None if i % 50 == 0 else i, rng.choice([" ", "-", "7", "’", "ł"]).join(text)))
    return rows + [(1_000, None), (1_001, ""), (1_002, "12 ++"), (1_003, "q" * 30_000)] + [(2_000, "mouse mouse house")] * 40


def test_spelling_of_odd_rows_in_one_and_many_passes(spark):
    rows = odd_spellings()
    want = brute_spelling(rows)
    assert sum(w[2] is not None for w in want) > 50
    assert spelled(frame(spark, rows)) == want
    assert spelled(frame(spark, rows), most_bytes=64) == want
    assert spelled(frame(spark, rows).limit(0)) == []


def test_spelling_of_the_table_and_its_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_bloom_spelling"](spark, SF).collect()), key=str)
    assert got == brute_spelling(rows)


def test_sql_on_odd_rows(spark):
    """The SQL of the three contracts on rows with nulls, repeats and empty texts."""
    rows = odd_phrases()[:-4]
    same(phrase_automata.dedup_phrases(frame(spark, rows)), duck("op13_phrase_automata", documents=("doc_id bigint, text varchar", rows)))
    rows = odd_spellings()[::4]
    same(spelling_groups.group_spellings(frame(spark, rows), True), duck("op11_bloom_spelling", documents=("doc_id bigint, text varchar", rows)))


def test_filter_plan_covers_every_word():
    plan = spelling_groups.Plan({5: 10_000, 6: 3, 64: 700}, most_bytes=4_096)
    keys = [k for p in plan.passes for k in p]
    assert sorted(keys) == sorted((n, p) for n, (parts, _) in plan.shape.items() for p in range(parts)) and len(set(keys)) == len(keys)
    for keys in plan.passes:
        assert sum(plan.shape[n][1] for n, _ in keys) * 32 <= 4_096
    h = np.random.default_rng(0).integers(0, 2**63, 5_000, dtype=np.uint64)
    part, block = plan.place(5, h)
    assert set(part) == set(range(plan.shape[5][0])) and 0 <= block.min() and block.max() < plan.shape[5][1]
