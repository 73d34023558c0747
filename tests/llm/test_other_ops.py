"""Search, mixing, packing, language, toxicity and page extraction."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from estatelens.llm import bfd_packing, fair_toxicity, html_mincut, hyper_langid, source_mix
from estatelens.llm.bit_search import nearest
from estatelens.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, start string, score int, part int, block int"


def odd_docs(spark):
    texts = [None, "", "  ", "one two three", "a " * 5_000, "ÄÖ ß “quoted” <|endoftext|> x'll 12 ,,", "12 34 !!", "ab́ ñ", "repeat me", "repeat me"]
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None, 1, "x", 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:], SCHEMA)


# ---- search ----

def brute_nearest(rows, k=10):
    ok = [(i, np.asarray(v, np.float64)) for i, v in rows
          if v is not None and len(v) and not any(c is None for c in v) and np.isfinite(np.asarray(v, np.float64)).all() and np.any(np.asarray(v))]
    out = {}
    for i, q in ok:
        if i % 100 == 0:
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i and len(v) == len(q))
            out[i] = d[:k]
    return out


def test_nearest_recall_and_scores(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute_nearest([(r[0], r[1]) for r in v.select("vec_id", "embedding").collect()])
    got = {}
    for r in QUERIES["op1_one_bit_nearest"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert got.keys() == want.keys()
    found = sum(len({j for _, j in want[q]} & {j for _, j in got[q].values()}) for q in want)
    assert found >= 0.95 * sum(map(len, want.values()))
    for q, x in got.items():
        assert sorted(x) == list(range(1, len(x) + 1)) and [x[i] for i in sorted(x)] == sorted(x.values())


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
            (7, [0.5, 0.5]), (8, []), (9, [1.0, 2.0, 3.0]), (100, [0.9, 0.1]), (200, [3.0, 2.0, 1.0]), (300, [float("inf"), 0.0]), (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 100, 7, 7], 100: [0, 1, 2, 7, 7], 200: [9]}
    assert nearest(df.limit(0), df.limit(0)).count() == 0


# ---- mixing ----

def test_nearest_repeated_queries(spark):
    """A query that stands twice has its ten neighbours once; two vectors under one query id have ten each."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 60)]
    asked = [(100, rows[0][1]), (100, rows[0][1]), (200, rows[1][1]), (200, rows[2][1])]
    schema = "vec_id long, embedding array<double>"
    got = nearest(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema)).collect()

    def want(q):
        return sorted(rows, key=lambda r: (np.sqrt(((np.array(r[1]) - q) ** 2).sum()), r[0]))[:10]

    for qid, vectors in ((100, [rows[0][1]]), (200, [rows[1][1], rows[2][1]])):
        found = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == qid)
        assert found == sorted((n, r[0]) for v in vectors for n, r in enumerate(want(np.array(v)), 1))


def test_targets():
    t = source_mix.targets({"a": 100, "b": 100, "c": 100, None: 100})
    # shares 5:2:1:5 of 600; a and the null source stop at 200, the rest is shared 2:1
    assert t == {"a": 200.0, "b": pytest.approx(400 / 3), "c": pytest.approx(200 / 3), None: 200.0}
    assert source_mix.targets({}) == {} and source_mix.targets({"a": 0}) == {"a": 0.0}


def test_permutation():
    n = 1_000
    for size in (1, 2, 3, 1_000):
        i = np.arange(size)
        p = source_mix.permute(i, np.full(size, size), np.full(size, 77, np.uint64))
        assert sorted(p.tolist()) == i.tolist()
    p = source_mix.permute(np.arange(n), np.full(n, n), np.full(n, 78, np.uint64))
    assert (p != np.arange(n)).mean() > 0.9


@pytest.mark.parametrize("which", ["table", "odd", "empty"])
def test_mix(spark, which):
    docs = {"table": lambda: spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "odd": lambda: odd_docs(spark),
            "empty": lambda: odd_docs(spark).limit(0)}[which]()
    rows = source_mix.Mix(docs).taken().collect()
    assert len(rows) == docs.count()
    text = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    sizes = {}
    for r in rows:
        t, s = text[r["doc_id"]]
        assert r["size"] == len(brute.WORD.findall(t or "")) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
    want, got = source_mix.targets(sizes), {}
    for r in rows:
        s = text[r["doc_id"]][1]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        got[s] = got.get(s, 0) + r["taken"]
    for s in want:
        assert abs(got[s] - want[s]) <= 2 * source_mix.BLOCK_WORDS
    again = source_mix.Mix(docs.repartition(7)).taken().collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mix_rows_hold_the_words_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in source_mix.Mix(docs).taken().collect()}
    got, text = {}, {r["doc_id"]: r["text"] for r in docs.collect()}
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(brute.WORD.findall(r["text"]))
        assert r["text"] in text[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert got == {d: n for d, n in taken.items() if n}


# ---- packing ----

def plain_bfd(lengths, window):
    """Room left in each window, by best-fit decreasing one piece at a time."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in open_ if r >= n]
        if fit:
            open_.remove(min(fit))
            open_.append(min(fit) - n)
        else:
            open_.append(window - n)
    return sorted(open_)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(60):
        window = rng.choice([10, 37, 64])
        lengths = [min(window, max(1, int(rng.expovariate(4 / window)))) for _ in range(rng.randrange(1, 200))]
        count = {n: lengths.count(n) for n in set(lengths)}
        runs, made = bfd_packing.plan(count, window)
        used = {}
        for n, c in count.items():
            firsts = [r[0] for r in runs[n]]
            for rank in range(c):
                first, seq, off = runs[n][int(np.searchsorted(firsts, rank, "right")) - 1]
                used.setdefault(seq + rank - first, []).append((off, n))
        assert sorted(used) == list(range(made))
        room = []
        for pieces in used.values():
            at = 0
            for off, n in sorted(pieces):
                assert off == at
                at += n
            assert at <= window
            room.append(window - at)
        assert sorted(room) == plain_bfd(lengths, window)


@pytest.mark.parametrize("which", ["table", "odd", "empty"])
def test_packing_round_trip(spark, which):
    from tokenizers import Tokenizer
    docs = {"table": lambda: spark.read.parquet(f"{SF}/documents.parquet"), "odd": lambda: odd_docs(spark).dropDuplicates(["doc_id"]),
            "empty": lambda: odd_docs(spark).limit(0)}[which]()
    rows = bfd_packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.select("doc_id", "text").collect()}
    by_doc, by_seq = {}, {}
    for r in rows:
        cut = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        raw = np.array(cut, "<u4").tobytes()
        assert bytes(r["ids"]) == raw and r["ids_crc32"] == zlib.crc32(raw) and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == ids.keys()
    for d, x in by_doc.items():
        assert [a for a, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] and sum(n for _, n in x) == len(ids[d])
    for x in by_seq.values():
        assert [a for a, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 2048


def test_token_cache_bounds():
    coder = bfd_packing.TokenBytes(tokenizer_path(), most=50)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeé'X,.!1") for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(40)]
    got = [x for i in range(0, 40, 5) for x in coder.encode(texts[i:i + 5])]
    assert got == [np.array(coder.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


# ---- language ----

def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op7_hyperdimensional_langid"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", F.length("text").alias("k")), "doc_id")
    rows = got.where("held_out and k >= 100").select("lang", "lang_pred").collect()
    assert len(rows) > 100 and np.mean([a == b for a, b in rows]) > 0.95
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_odd_rows(spark):
    docs = odd_docs(spark)
    langs, protos = hyper_langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r["lang_pred"] for r in hyper_langid.predict(docs, langs, protos).collect()}
    assert [got[i] for i in (0, 1, 2, 6)] == ["und"] * 4 and all(got[i] in langs for i in (3, 5, 7, 8))
    langs, protos = hyper_langid.fit(docs.limit(0))
    assert langs == [] and {r["lang_pred"] for r in hyper_langid.predict(docs, langs, protos).collect()} == {"und"}
    assert hyper_langid.predict(docs.limit(0), langs, protos).count() == 0


def test_bundle_is_sum_of_bound_vectors():
    import pyarrow as pa
    from estatelens.llm import words as W
    texts = ["ab", "ba ab", "", "Жук жук 汉字", "² ½ 12 ①", "É\u0301é"]
    got, has = hyper_langid.Encoder(most=4).bundle(next(W.chunks(pa.array(texts))))
    base = lambda c: hyper_langid.letter_vectors(np.array([ord(c) if c else 0]))[0]
    gram = lambda x, y, z: np.roll(base(x), 2) * np.roll(base(y), 1) * base(z)
    import unicodedata
    for t, v in zip(texts, got):
        s = ["", *[c.lower() if unicodedata.category(c)[0] == "L" else "" for c in t], ""]
        assert (v == sum((gram(*s[i - 1:i + 2]) for i in range(1, len(s) - 1) if s[i]), np.zeros(1024))).all()
    assert has.tolist() == [True, True, False, True, False, True]
    rows = hyper_langid.letter_vectors(np.arange(0x400, 0x460))
    assert len(np.unique(rows, axis=0)) == 0x60 and abs((rows @ rows.T - 1024 * np.eye(0x60)) / 1024).max() < 0.2


def test_language_prediction_is_the_nearest_prototype(spark):
    """Plain sums of plain vectors, and the greatest cosine, on a few short texts of three scripts."""
    import unicodedata
    import zlib
    train = [("en", "the cat and the hat"), ("en", "that thing there"), ("ru", "жук и жаба"), ("ru", "живой уж"), ("zh", "汉字 和 汉语"), (None, "no language")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train * 4)], "doc_id long, text string, lang string")

    def vector(t):
        s = [0, *[ord(c.lower()) if unicodedata.category(c)[0] == "L" else 0 for c in t], 0]
        v = hyper_langid.letter_vectors(np.array(s)).astype(np.float64)
        return sum((np.roll(v[i - 1], 2) * np.roll(v[i], 1) * v[i + 1] for i in range(1, len(s) - 1) if s[i]), np.zeros(1024))

    proto = {}
    for r in docs.collect():
        if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            proto[r["lang"]] = proto.get(r["lang"], 0) + vector(r["text"])
    langs, protos = hyper_langid.fit(docs)
    assert langs == sorted(proto) and np.array_equal(protos, np.array([proto[x] for x in langs]))
    asked = [(100, "THE HAT"), (101, "жаба"), (102, "语"), (103, "²"), (104, "½ 12"), (105, "١٢"), (106, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in hyper_langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), langs, protos).collect()}
    for d, t in asked:
        v = vector(t or "")
        if not v.any():
            assert got[d] == ("und", 0.0)
        else:
            cos = {x: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for x, p in proto.items()}
            best = max(sorted(cos), key=cos.get)
            assert got[d][0] == best and got[d][1] == pytest.approx(max(0.0, cos[best]), abs=1e-5)


# ---- toxicity ----

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_counterfactual_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    rows = got.select("toxic", "predicted", "score").toPandas()
    hit, false = rows[rows.toxic == 1].predicted.mean(), rows[rows.toxic == 0].predicted.mean()
    assert hit > 0.9 and false < 0.03, (hit, false)
    assert rows.score.between(0, 1).all()


def brute_choice(rows, features):
    """Tokens (words, and their first four and six letters) of the greatest gain, by plain counting."""
    import math
    import re
    bags = []
    for text, toxic in rows:
        words = re.findall(r"[A-Za-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        bags.append(({(0, w) for w in words} | {(n, w[:n]) for w in words for n in (4, 6) if len(w) > n}, toxic))
    share = sum(t for _, t in bags) / len(bags)
    gain = {}
    for token in {t for b, _ in bags for t in b}:
        n, bad = sum(token in b for b, _ in bags), sum(token in b for b, t in bags if t)
        q = (bad + share) / (n + 1)
        if q > share:
            gain[token] = bad * math.log(q / share) + (n - bad) * math.log((1 - q) / (1 - share))
    return sorted(gain.items(), key=lambda x: -x[1])[:features], gain


def token_hash(kind, word):
    """The hash of a word (kind 0) or of its first letters."""
    if kind == 0:
        return fair_toxicity.word_hash(word)
    h, _, _ = fair_toxicity.tokens(next(fair_toxicity.W.chunks(fair_toxicity.pa.array([word + "x" * 9]), lower=True)))
    return int(h.view(np.int64)[1 + fair_toxicity.PREFIXES.index(kind)])


@pytest.mark.parametrize("held", [1_000_000, 3])
def test_toxicity_choice_is_that_of_plain_counting(spark, monkeypatch, held):
    """All tokens are counted in all training rows, also those of a single toxic row, whatever a task may hold."""
    monkeypatch.setattr(fair_toxicity, "HELD_TOKENS", held)
    rng = random.Random(3)
    words = ["common", "stand", "Überall", "vile", "nasty", "nastily", "once", "straße", "x"]
    rows = [(i, " ".join(rng.choices(words, range(9, 0, -1), k=rng.randrange(1, 9))), int(rng.random() < 0.3)) for i in range(150)] + [(500, "unique toxic", 1), (501, None, 0), (502, "", 1)]
    train = spark.createDataFrame([(t, x) for _, x, t in rows], "toxic long, text string")
    share = sum(t for _, _, t in rows) / len(rows)
    want, gain = brute_choice([(x, t) for _, x, t in rows], 6)
    got = fair_toxicity._choose(train, share, 6)
    by_hash = {token_hash(*k): g for k, g in gain.items()}
    assert [by_hash[h] for h in got] == pytest.approx([g for _, g in want])


def test_toxicity_sample_is_bounded_by_rows(spark):
    """One id that stands 3,000 times, with one text or with many, brings no more rows to the fit than the bound."""
    seen = []
    docs = spark.createDataFrame([(1, "vile words" if i % 2 else f"vile number{i}") for i in range(3_000)] + [(i, "plain words") for i in range(2, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 200)], "doc_id long, toxic int")
    keep = fair_toxicity.fit_weights
    fair_toxicity.fit_weights = lambda x, y, *a: seen.append(len(y)) or keep(x, y, *a)
    try:
        fair_toxicity.fit(docs, labels, sample_docs=50)
        fair_toxicity.fit(docs, labels)
    finally:
        fair_toxicity.fit_weights = keep
    train = docs.where(~fair_toxicity.held_out())
    assert seen == [50, train.distinct().count()]


def test_toxicity_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fair_toxicity.fit(docs, labels) is None
    assert {(r["score"], r["predicted"]) for r in fair_toxicity.score(docs, None).collect()} == {(0.0, 0)}
    assert fair_toxicity.score(docs.limit(0), None).count() == 0
    # a fitted model on the same rows: nulls, empty, very long and odd texts, rows that stand twice
    train = spark.createDataFrame([(i, "vile words here" if i % 3 == 0 else "plain words here") for i in range(300)], "doc_id long, text string")
    model = fair_toxicity.fit(train, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(0, 0), (None, 1)], "doc_id long, toxic int"))
    long = spark.createDataFrame([(90, "vile " * 200_000), (91, "a" * 1_000_000), (92, "\x00 \U0001f600 \u200b")], "doc_id long, text string")
    got = [(r["doc_id"], r["score"]) for r in fair_toxicity.score(docs.select("doc_id", "text").unionByName(long), model).collect()]
    score = dict(got)
    base = 1 / (1 + np.exp(-model["intercept"]))
    assert len(got) == docs.count() + 3 and all(0 <= x <= 1 for x in score.values())
    assert score[0] == score[1] == score[2] == score[91] == pytest.approx(base) and score[90] > 0.5 and len({x for d, x in got if d == 9}) == 1


def test_counterfactual_part_removes_the_group_effect():
    """Identity term 0 goes with toxic texts in the sample; with the penalty its weight nears its group's other term."""
    rng = np.random.default_rng(1)
    y = (rng.random(2_000) < 0.3).astype(float)
    x = np.zeros((2_000, 6))  # presence of three tokens; no densities
    x[:, 0] = rng.random(2_000) < np.where(y == 1, 0.5, 0.05)
    x[:, 1] = rng.random(2_000) < 0.1
    x[:, 2] = rng.random(2_000) < np.where(y == 1, 0.9, 0.02)
    free, _ = fair_toxicity.fit_weights(x, y, [[0, 1]], strength=0.0)
    fair, _ = fair_toxicity.fit_weights(x, y, [[0, 1]], strength=50.0)
    assert abs(fair[0] - fair[1]) < 0.2 * abs(free[0] - free[1]) and fair[2] > 2


# ---- pages ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href='/b'>News > today</a></li></ul></nav><div class="ad">Buy this great thing now.</div>
<div id="cookie-notice"><p>We use cookies to make this site better for you and for us all.</p></div>
<article><header><h1>Head &amp; line</h1></header><p><b>First   paragraph, with a
<a href="x">link</a> and enough words to read on.<br><p>Second&nbsp;paragraph &lt;here&gt; has a few words as well.</p><!-- no -->
<aside class="related"><p>Related: <a href="/c">Other story that you may like</a></p></aside><p>Short end.</p></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I really liked this long and well written article, thank you for it.</p></div></section>
<form><p>Your name</p><input name=a></form><aside><p>Side text about something that is not the story.</p></aside>
<footer>&copy; example.com &middot; Words of a footer.</footer></body></html>"""


def test_page_text():
    assert html_mincut.main_text(PAGE) == ("Head & line\nFirst paragraph, with a link and enough words to read on.\n"
                                           "Second paragraph <here> has a few words as well.\nShort end.")


def test_min_cut_is_minimal():
    rng = np.random.default_rng(8)
    for _ in range(30):
        n = 7
        s, t = rng.random(n).tolist(), rng.random(n).tolist()
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda keep: (sum(t[i] if keep[i] else s[i] for i in range(n))
                             + sum(c for a, b, c in edges if keep[a] != keep[b]))
        best = min(cost(k) for k in np.ndindex(*[2] * n))
        assert cost(html_mincut.min_cut(s, t, edges)) == pytest.approx(best)


@pytest.mark.parametrize("wrap", ['<div class="layout sidebar-left">', '<div class="content-with-sidebar">', '<div class="page has-ads">', "<form>",
                                  '<div id="menu-page"><div class="comment-enabled promo">'])
def test_wrappers_of_the_whole_page_keep_its_text(wrap):
    """A name or tag that speaks against content does not when the whole page lies under it."""
    texts = [f"Paragraph {i} of a plain page that says one thing after the other, with a hundred characters or so, as articles do." for i in range(4)]
    page = f"<html><body>{wrap}{''.join(f'<p>{t}</p>' for t in texts)}<div class='ad'>Buy now</div><nav><a href=x>Home</a> <a href=y>News</a></nav></body></html>"
    assert html_mincut.main_text(page) == "\n".join(texts)
    # not so where the article lies elsewhere
    beside = f"<article>{''.join(f'<p>{t}</p>' for t in texts[:1])}</article><div class='sidebar'>{''.join(f'<p>{t}</p>' for t in texts[1:])}</div>"
    assert html_mincut.main_text(beside) == texts[0]


@pytest.mark.parametrize("page", ["".join(f"<div><p>Sentence number {i} of a long page, with words.</p><p><a href=x>link {i}</a></p></div>" for i in range(9_000)),
                                  "<button>" * 60_000 + "x", "".join(f"<li><a href=x>{i}</a> text {i}" for i in range(30_000))])
def test_long_pages_take_time_in_proportion(page):
    import time
    assert len(page) > 450_000
    t = time.time()
    html_mincut.main_text(page)
    assert time.time() - t < 20


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = html_mincut.extract(pages).collect()
    assert len(rows) == pages.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
    import re
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        page = html[r["page_id"]] or ""
        m = re.search(r"<article>(.*)</article>", page, re.S)
        inner = re.sub(r"<(?!/?(p|h1|br)\b)[^>]*>", "", m[1]) if m else ""
        want = [" ".join(re.sub(r"<br>", " ", x).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        import html as H
        assert r["text"] == "\n".join(H.unescape(x) for x in want if x), r["page_id"]


def test_pages_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text without any tag that goes on for a while, like this."), (4, "u", "<<<>&bogus;</p></div><p"),
            (5, "u", "<p>" * 3_000 + "deep"), (None, "u", "<article><p>x y z.</article>"), (6, "u", "<script>never closed <p>a</p>"), (6, "u", "<div hidden><p>a b c d</p></div>")]
    got = html_mincut.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got}[1] == ""
    assert html_mincut.extract(spark.createDataFrame([], "page_id long, url string, html string, text int")).count() == 0
