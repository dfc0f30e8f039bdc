"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers

from loomspark.llm import exact, media, neardup, packing, pieces, pii, records, repeats, toxicity
from loomspark.sources.tables import table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def op1_token_records(spark, sf_dir):
    return records.digest(spark, _documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2)


def op2_token_counts(spark, sf_dir):
    return pieces.token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op3_repeats(spark, sf_dir):
    return repeats.digest(_documents(spark, sf_dir), repeats.WORDS)


def op4_media(spark, sf_dir):
    return media.digest(_documents(spark, sf_dir))


def op5_toxicity(spark, sf_dir):
    return toxicity.digest(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_packing(spark, sf_dir):
    return packing.digest(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_near_duplicates(spark, sf_dir):
    return neardup.group(_documents(spark, sf_dir), 4)


def op8_exact_dedup(spark, sf_dir):
    return exact.digest(_documents(spark, sf_dir))


def op9_sentencepiece(spark, sf_dir):
    return pieces.encoding_digest(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_pii(spark, sf_dir):
    return pii.digest(_documents(spark, sf_dir))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_token_records, op2_token_counts, op3_repeats, op4_media, op5_toxicity, op6_packing, op7_near_duplicates, op8_exact_dedup, op9_sentencepiece, op10_pii)
    return {f.__name__: f for f in (*ops, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": exact.ORACLE}
