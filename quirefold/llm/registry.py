"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from quirefold.llm import bpe, chat, exact_dedup, media, merkle, minhash, mixing, ngram_join, quality, spelling, substrings, token_files, toxicity
from quirefold.llm.common import table


def _op9(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def _op10(spark, sf_dir):
    found = media.media_features(media.to_media(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "seconds", "frames", "crc_bad", "seek_offsets")


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _op1(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def _op2(spark, sf_dir):
    return chat.repaired(table(spark, sf_dir, "conversations"))


def _rendered(spark, sf_dir):
    return chat.rendered(table(spark, sf_dir, "conversations"))


def _op3(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def _op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def _op5(spark, sf_dir):
    path = _tokenizer_file("byte_bpe_50k.json")
    found = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _op7(spark, sf_dir):
    return substrings.digest(substrings.without_repeats(table(spark, sf_dir, "documents")))


def _op8(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), _tokenizer_file("word_bpe_49k.json"), end_id=1)


def _op11(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def _op12(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.every_seventh())


def _op13(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"), percent=85)


def queries() -> dict:
    return {"op1_minhash": _op1, "op2_chat": _op2, "chat_rendered": _rendered, "op3_mixing": _op3, "op4_quality": _op4, "op5_bpe": _op5, "op6_toxicity": _op6, "op7_substrings": _op7, "op8_token_files": _op8, "op9_exact_dedup": _op9, "op10_media": _op10, "op11_spelling": _op11, "op12_merkle": _op12, "op13_ngram_join": _op13, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {"op1_minhash": minhash.oracle(85), "op7_substrings": substrings.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE, "op11_spelling": spelling.ORACLE, "op12_merkle": merkle.ORACLE, "op13_ngram_join": minhash.oracle(85, ngram_join.WORDS, kept=False)}
