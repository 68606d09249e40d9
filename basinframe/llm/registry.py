"""The queries of this subpackage and their SQL twins."""

from . import chat, decontaminate, fixity, language, manifest, minhash, mixing, phrases, pieces, pseudo, sharding, simhash, urlfilter

QUERIES = {
    "op1_fixity": fixity.op1_fixity,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_minhash": minhash.op3_minhash,
    "op4_language": language.op4_language,
    "op5_pieces": pieces.op5_pieces,
    "op6_chat": chat.op6_chat,
    "op7_sharding": sharding.op7_sharding,
    "op8_simhash": simhash.op8_simhash,
    "op9_pseudo": pseudo.op9_pseudo,
    "op10_urlfilter": urlfilter.op10_urlfilter,
    "op11_mixing": mixing.op11_mixing,
    "op12_manifest": manifest.op12_manifest,
    "op13_phrases": phrases.op13_phrases,
}
ORACLE_SQL: dict[str, str] = {
    "op1_fixity": fixity.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op6_chat": chat.ORACLE,
    "op7_sharding": sharding.ORACLE,
    "op10_urlfilter": urlfilter.ORACLE,
    "op11_mixing": mixing.ORACLE,
    "op12_manifest": manifest.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
