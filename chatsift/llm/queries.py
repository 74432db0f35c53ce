"""Registered queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from chatsift.llm import decontam, fourier, jaccard, pii, prefixtrie, quality, resampling, secrets, sentencepiece, sharding, tokenfile, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_token_files": tokenfile.op2_token_files,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sentencepiece": sentencepiece.op4_sentencepiece,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_sharding": sharding.op7_sharding,
    "op8_personal_data": pii.op8_personal_data,
    "op9_quality": quality.op9_quality,
    "op10_secrets": secrets.op10_secrets,
    "op11_resample": resampling.op11_resample,
    "op12_quality_scores": fourier.op12_quality_scores,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
}

ORACLE = {
    "op5_decontaminate": decontam.OP5_SQL,
    "op6_jaccard_join": jaccard.OP6_SQL,
    "op1_warc": warc.OP1_SQL,
    "op9_quality": quality.OP9_SQL,
    "op11_resample": resampling.OP11_SQL,
    "op13_prefix_trie": prefixtrie.OP13_SQL,
}
