"""The registered queries of this subpackage and their SQL."""

from . import compression, decontaminate, langid, linededup, maintext, mixing, qualityrules, ranked, simhash, tokencount, turntrie, urlfilter

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_quality_rules": qualityrules.op3_quality_rules,
    "op4_toxicity": compression.op4_toxicity,
    "op5_mixing": mixing.op5_mixing,
    "op6_quality": compression.op6_quality,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_simhash": simhash.op8_simhash,
    "op9_language_id": langid.op9_language_id,
    "op10_token_counts": tokencount.op10_token_counts,
    "op11_ranked_search": ranked.op11_ranked_search,
    "op12_conversation_trie": turntrie.op12_conversation_trie,
    "op13_html_extraction": maintext.op13_html_extraction,
}

ORACLES = {**linededup.ORACLE, **mixing.ORACLE, **decontaminate.ORACLE, **ranked.ORACLE, **turntrie.ORACLE}
