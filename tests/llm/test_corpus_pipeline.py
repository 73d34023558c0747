"""The pipeline, stage by stage, against plain versions."""

import brute
import corpus_pipeline as P
from estatelens.llm import line_quality, source_mix
from estatelens.session import materialize

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = rows(docs)

    kept = materialize(P.quality_rules(spark, docs, SF))
    model = line_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in line_quality.score(docs, model).collect() if r["kept"]}
    assert kept.columns == docs.columns and rows(kept) == {d: r for d, r in before.items() if d in good}
    assert all(not brute.base_counts(before[d]["text"])[5] for d in good)

    cut = materialize(P.dedup(spark, kept, SF))
    left = brute.dedup_passages([(d, before[d]["text"]) for d in good])
    got = rows(cut)
    assert cut.columns == docs.columns
    assert any(len(left[d]) < len(brute.WORD.findall(before[d]["text"])) for d in good)
    for d in good:
        if left[d] == brute.WORD.findall(before[d]["text"]):
            assert got[d] == before[d]
        elif left[d]:
            assert brute.WORD.findall(got[d]["text"]) == left[d] and got[d]["n_chars"] == len(got[d]["text"])
        else:
            assert d not in got

    single = materialize(P.near_copies(spark, cut, SF))
    group = brute.jaccard_components([(d, r["text"]) for d, r in got.items()])
    assert single.columns == docs.columns and rows(single) == {d: r for d, r in got.items() if group[d][1] == d}

    mixed = materialize(P.mix_sources(spark, single, SF))
    assert mixed.columns == docs.columns
    want = {r["doc_id"]: r["taken"] for r in source_mix.Mix(single).taken().collect() if r["taken"]}
    found = {}
    for r in mixed.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + len(brute.WORD.findall(r["text"]))
    assert found == want

    packed = P.packing(spark, mixed, SF).collect()
    used = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and sum(used.values()) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    # one stretch at least is open in a best fit: all others hold more than half a window
    assert sum(v <= 1024 for v in used.values()) <= 1

    assert sorted(map(tuple, P.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(
        tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in packed)


def test_passage_inside_lines_goes(spark):
    """60 words that two unlike texts share in the middle of a line are gone from the later one after the stage."""
    p = " ".join(f"p{i}" for i in range(60))
    rows_ = [(1, f"one two {p} three"), (2, f"four five {p} six")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.dedup(spark, docs, SF).collect()} == {1: (rows_[0][1], len(rows_[0][1])), 2: ("four five six", 13)}


def test_copies_go_by_row(spark):
    """An id on two unlike texts, one of them a copy of another document's: only the copy goes."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b + " z"), (None, a)], "doc_id long, text string")
    assert sorted(map(tuple, P.near_copies(spark, docs, SF).collect()), key=str) == sorted([(1, a), (5, b), (None, a)], key=str)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_odd_rows_and_clashing_columns(spark):
    """Nulls anywhere, empty and long texts, repeated rows, and columns named like those the stages use."""
    names = ["row", "runs", "kept", "size", "start", "passes", "key", "n", "rep", "component_id", "no", "lo", "found", "mix_size", "x.y"]
    words = [f"w{i}" for i in range(50)]
    long = " ".join(words[(i * i) % 50] + str(i) for i in range(20_000))
    texts = [None, "", " \n ", "few words", long, long, long + " end", " ".join(words), " ".join(words[1:]) + " z",
             "head line of this text\n" + "\n".join(" ".join(words[i:] + words[:i]) for i in range(4))]
    rows = [(None if i == 7 else i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", None if i == 4 else 1, *["q"] * len(names))
            for i, t in enumerate(texts)]
    rows += rows[4:5]  # a row that stands twice
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert [f.simpleString() for f in docs.schema] == [f.simpleString() for f in spark.createDataFrame([], schema).schema]
        assert docs.count() > 0 and all(r["row"] == "q" and r["x.y"] == "q" for r in docs.collect())
    packed = P.packing(spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
