"""The registered queries of this subpackage: ``opN_<name>`` on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estatelens.llm.oracle import JACCARD_SQL, PHRASES_SQL, SEARCH_SQL, SPELLING_SQL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_ngram_jaccard_join", JACCARD_SQL)
def q_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm.jaccard_join import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op5_line_crf_quality")
def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm import line_quality as Q
    docs = table(spark, sf_dir, "documents")
    return Q.score(docs, Q.fit(docs, table(spark, sf_dir, "labels")))


@query("op8_blob_ledger_secrets")
def q_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm import secret_ledger as S
    from estatelens.session import ensure_checkpoint_dir
    return S.digest(S.scan(table(spark, sf_dir, "documents"), S.new_ledger(ensure_checkpoint_dir(spark))))


@query("op7_hyperdimensional_langid")
def q_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm import hyper_langid as L
    docs = table(spark, sf_dir, "documents")
    return L.predict(docs, *L.fit(docs))


@query("op1_one_bit_nearest")
def q_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm.bit_search import nearest
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query("op2_line_winnowing")
def q_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm.line_dedup import dedup_passages
    return dedup_passages(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_removed")


@query("op3_mincut_html")
def q_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm.html_mincut import extract
    return extract(table(spark, sf_dir, "pages"))


@query("op4_source_mix")
def q_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm.source_mix import Mix
    return Mix(table(spark, sf_dir, "documents")).taken()


@query("op6_bfd_packing")
def q_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm.bfd_packing import pack
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op10_counterfactual_toxicity")
def q_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm import fair_toxicity as T
    docs = table(spark, sf_dir, "documents")
    return T.score(docs, T.fit(docs, table(spark, sf_dir, "labels")))


@query("op11_bloom_spelling", SPELLING_SQL)
def q_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm.spelling_groups import group_spellings
    return group_spellings(table(spark, sf_dir, "documents"), seeded_typos=True)


@query("op12_block_max_search", SEARCH_SQL)
def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm.lexical_search import build_index, search
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


@query("op13_phrase_automata", PHRASES_SQL)
def q_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from estatelens.llm.phrase_automata import dedup_phrases
    return dedup_phrases(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The public vocabulary that the packing query uses."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("pipeline")
def q_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
