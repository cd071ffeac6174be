"""Registered queries and DuckDB statements of the training-data operators."""

from __future__ import annotations

from lumen.llm import bpe, classifier, collocations, decontam, dedup, lm, pii, quality, secrets, sharding, spelling, tokens, warc

QUERIES = {
    "op1_quality_ledger": quality.op1_quality_ledger,
    "op2_feistel_shards": sharding.op2_feistel_shards,
    "op3_revisits": warc.op3_revisits,
    "op4_semi_markov_pii": pii.op4_semi_markov_pii,
    "op5_near_duplicates": dedup.op5_near_duplicates,
    "op6_context_mixing": lm.op6_context_mixing,
    "op7_token_parquet": tokens.op7_token_parquet,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_benchmark_passages": decontam.op9_benchmark_passages,
    "op10_secret_forest": secrets.op10_secret_forest,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_phrase_collocations": collocations.op12_phrase_collocations,
    "op13_quality_classifier": classifier.op13_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {**quality.ORACLE_SQL, **warc.ORACLE_SQL, **collocations.ORACLE_SQL, **spelling.ORACLE_SQL}
