"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from tracewell.llm.chat import OP8_SQL, op8_chat_format
from tracewell.llm.divergence import OP11_SQL, op11_source_divergence
from tracewell.llm.licenses import OP12_SQL, op12_license_scan
from tracewell.llm.mixing import OP3_SQL, op3_mix_sources
from tracewell.llm.ngram_join import OP4_SQL, op4_ngram_jaccard_join
from tracewell.llm.packing import op1_best_fit_packing
from tracewell.llm.secrets import op6_secret_scan
from tracewell.llm.spelling import op13_spelling_variants
from tracewell.llm.token_counts import op5_token_counts
from tracewell.llm.toxicity import op2_toxicity
from tracewell.llm.vectors import OP9_SQL, OP10_SQL, op9_embedding_dedup, op10_exact_topk
from tracewell.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_mix_sources": op3_mix_sources,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_token_counts": op5_token_counts,
    "op6_secret_scan": op6_secret_scan,
    "op7_warc": op7_warc,
    "op8_chat_format": op8_chat_format,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_exact_topk": op10_exact_topk,
    "op11_source_divergence": op11_source_divergence,
    "op12_license_scan": op12_license_scan,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": OP3_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op7_warc": OP7_SQL,
    "op8_chat_format": OP8_SQL,
    "op9_embedding_dedup": OP9_SQL,
    "op10_exact_topk": OP10_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_license_scan": OP12_SQL,
}
