"""The registered queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from . import bpe, decontaminate, fim, html, langid, quality, secretscan, simhash, tokencounts, topk, toxicity, variants, warc

QUERIES = {
    "op1_simhash": simhash.query,
    "op2_token_rollup": tokencounts.query,
    "op2_token_rollup_bpe": tokencounts.bpe_query,
    "op3_language": langid.query,
    "op4_quality": quality.query,
    "op5_html": html.query,
    "op6_topk": topk.query,
    "op7_decontaminate": decontaminate.query,
    "op8_toxicity": toxicity.query,
    "op9_bpe": bpe.query,
    "op10_warc": warc.query,
    "op11_variants": variants.query,
    "op12_secrets": secretscan.query,
    "op13_fim": fim.query,
}
ORACLES: dict[str, str] = {"op2_token_rollup": tokencounts.ORACLE, "op6_topk": topk.ORACLE, "op10_warc": warc.ORACLE, "op11_variants": variants.ORACLE, "op13_fim": fim.ORACLE}
