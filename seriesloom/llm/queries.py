"""Queries of this folder by name, and the SQL that states the same rows where SQL can."""

from seriesloom.llm import chats, credentials, decontam, language, licenses, lines, packing, patterns, repair, search, simhash, toxicity, vectors

QUERIES = {
    "op1_language": language.op1_language,
    "op2_pack_documents": packing.op2_pack_documents,
    "op3_site_lines": lines.op3_site_lines,
    "op4_near_vectors": vectors.op4_near_vectors,
    "op5_licenses": licenses.op5_licenses,
    "op6_benchmark_templates": decontam.op6_benchmark_templates,
    "op7_simhash_groups": simhash.op7_simhash_groups,
    "op8_secrets": credentials.op8_secrets,
    "op9_chats": chats.op9_chats,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_lexical_search": search.op11_lexical_search,
    "op12_pattern_packing": patterns.op12_pattern_packing,
    "op13_conversation_repair": repair.op13_conversation_repair,
}
ORACLES: dict[str, str] = {"op3_site_lines": lines.OP3_SQL, "op11_lexical_search": search.OP11_SQL, "op13_conversation_repair": repair.OP13_SQL}
