"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netweave.llm import oracles
from netweave.session import ensure_checkpoint_dir, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf):
            ensure_checkpoint_dir(spark)
            return fn(spark, sf)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("op4_token_files")
def q_token_files(spark, sf):
    """All documents as ids of the byte-level vocabulary, written and mapped."""
    from netweave.llm import token_files as T
    folder = scratch_path(spark, "token_files")
    files = T.write_token_files(table(spark, sf, "documents"), folder,
                                T.vocabulary("byte_bpe_50k.json"), end_id=2)
    return T.read_token_files(spark, folder, files)


@register("op8_best_fit_packing")
def q_best_fit_packing(spark, sf):
    """All documents packed into sequences of 2048 ids."""
    from netweave.llm import packing as P
    from netweave.llm.token_files import vocabulary
    cut = P.pieces(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), end_id=0)
    return P.pack(spark, cut)


@register("op1_substring_dedup", oracles.SUBSTRING)
def q_substring_dedup(spark, sf):
    """Windows of 50 words that also start in a smaller doc_id, removed."""
    from netweave.llm import substring_dedup as S
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return S.strip_spans(docs, S.repeated_spans(docs)).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op2_sharding")
def q_sharding(spark, sf):
    """All documents in 40 shards of even counts, copies together."""
    from netweave.llm import sharding as H
    return H.shard(table(spark, sf, "documents"))


@register("op3_near_duplicates", oracles.NEAR_DUPLICATES)
def q_near_duplicates(spark, sf):
    """Components of documents that share 80 % of their two-word shingles."""
    from netweave.llm import neardup as N
    return N.near_duplicates(table(spark, sf, "documents"), shingle=2)


@register("op10_license_scan")
def q_license_scan(spark, sf):
    """Licence phrases and covered licence templates of all documents."""
    from netweave.llm import licenses as L
    return L.scan_licenses(table(spark, sf, "documents")).drop("spans")


@register("op9_decontamination")
def q_decontamination(spark, sf):
    """Benchmark items that stand in documents, substituted words allowed."""
    from netweave.llm import decontaminate as D
    return D.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op6_language_id")
def q_language_id(spark, sf):
    """Language of every document, learned outside the held-out fold."""
    from netweave.llm import langid as G
    docs = table(spark, sf, "documents")
    return G.predict(docs, *G.training_rows(docs))


@register("op7_quality_classifier")
def q_quality_classifier(spark, sf):
    """Junk and toxicity of every document, and whether it is kept."""
    from netweave.llm import quality as Q
    return Q.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op5_hash_prefix_forest")
def q_hash_prefix_forest(spark, sf):
    """The five nearest vectors of every fiftieth one."""
    from pyspark.sql import functions as F

    from netweave.llm import hash_forest as A
    return A.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@register("op11_secret_scan", oracles.secret_scan())
def q_secret_scan(spark, sf):
    """Secrets of all documents, scanned blob by blob into a ledger."""
    from netweave.llm import secret_scan as S
    return S.digest(S.scan(table(spark, sf, "documents"), scratch_path(spark, "secret_ledger"), ["doc_id"]))


@register("op12_spelling_variants", oracles.SPELLING)
def q_spelling_variants(spark, sf):
    """Words of all documents with their more frequent near form and root."""
    from netweave.llm import spelling as V
    return V.group_variants(table(spark, sf, "documents"))


@register("op13_cross_tokenizer_alignment")
def q_cross_tokenizer_alignment(spark, sf):
    """All documents aligned between two vocabularies, with counts of token pairs."""
    from netweave.llm import align as X
    from netweave.llm.token_files import vocabulary
    return X.align(table(spark, sf, "documents"), scratch_path(spark, "align"),
                   vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
