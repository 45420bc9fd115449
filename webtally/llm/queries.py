"""Queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from webtally.llm import bpe, crf, fim, html, jaccard, katz, kdtree, lines, merkle, onebit, packing, quality, warc

QUERIES = {
    "op1_exact_top_k": kdtree.op1,
    "op2_ngram_jaccard_join": jaccard.op2,
    "op3_best_fit_packing": packing.op3,
    "op4_quality_classifier": quality.op4,
    "op5_one_bit_neighbours": onebit.op5,
    "op6_html_extraction": html.op6,
    "op7_line_dedup": lines.op7,
    "op8_warc": warc.op8,
    "op9_katz_language_model": katz.op9,
    "op10_byte_bpe": bpe.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_fill_in_middle": fim.op12,
    "op13_quality_rules": crf.op13,
}

ORACLES = {
    "op1_exact_top_k": kdtree.OP1_SQL,
    "op8_warc": warc.OP8_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
}
