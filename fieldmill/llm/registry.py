"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from fieldmill.llm import bpe, chat, collocations, exact_dedup, html_text, packing, pii, quality, simhash, substring_dedup, token_output, topk, whitening


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_pii": pii.op1_pii,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality": quality.op5_quality,
    "op6_packing": packing.op6_packing,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_simhash": simhash.op8_simhash,
    "op9_topk": topk.op9_topk,
    "op10_token_output": token_output.op10_token_output,
    "op11_collocations": collocations.op11_collocations,
    "op12_whitening": whitening.op12_whitening,
    "op13_chat": chat.op13_chat,
}

SQL = {
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op9_topk": topk.OP9_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_chat": chat.OP13_SQL,
}
