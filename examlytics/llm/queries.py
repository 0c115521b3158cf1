"""The queries of this package and their SQL, for the driver's entry module."""

from __future__ import annotations

from examlytics.llm import (
    html_text,
    latent_decontamination,
    mixing,
    ngram_join,
    quality_rules,
    secret_forest,
    sharding,
    suffix_dedup,
    token_alignment,
    token_codes,
    toxicity,
    warc,
    whitening,
)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_html_text": html_text.query,
    "op3_warc": warc.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_mixing": mixing.query,
    "op6_ngram_join": ngram_join.query,
    "op7_latent_decontamination": latent_decontamination.query,
    "op8_sharding": sharding.query,
    "op9_secret_forest": secret_forest.query,
    "op10_quality_rules": quality_rules.query,
    "op11_whitening": whitening.query,
    "op12_token_alignment": token_alignment.query,
    "op13_token_codes": token_codes.query,
}

ORACLE: dict[str, str] = {
    "op3_warc": warc.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
}
