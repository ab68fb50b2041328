"""The queries of this subpackage, and their SQL."""

from quartzloom.llm import chat, classifier, decontam, divergence, licenses, linededup, packing, quality, secrets, sharding, simhash, tokencount

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_quality": quality.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_secrets": secrets.op4_secrets,
    "op5_decontam": decontam.op5_decontam,
    "op6_linededup": linededup.op6_linededup,
    "op7_packing": packing.op7_packing,
    "op8_tokencount": tokencount.op8_tokencount,
    "op9_licenses": licenses.op9_licenses,
    "op10_sharding": sharding.op10_sharding,
    "op11_classifier": classifier.op11_classifier,
    "op12_divergence": divergence.op12_divergence,
}
ORACLES = {"op1_chat": chat.OP1_SQL, "op2_quality": quality.OP2_SQL, "op4_secrets": secrets.OP4_SQL, "op5_decontam": decontam.OP5_SQL, "op6_linededup": linededup.OP6_SQL, "op12_divergence": divergence.OP12_SQL}
