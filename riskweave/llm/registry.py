"""The queries of this subpackage, by name, and their SQL where SQL can say them."""

from __future__ import annotations

from riskweave.llm import bpe_op, chat, importance, langid, licences, manifest, merkle, neighbours, packing, pii, simhash, toxicity, urls

_QUERIES = {
    "op1_urls": urls.op1_urls,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii.op3_pii,
    "op4_packing": packing.op4_packing,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_bpe": bpe_op.op6_bpe,
    "op7_langid": langid.op7_langid,
    "op8_merkle": merkle.op8_merkle,
    "op9_simhash": simhash.op9_simhash,
    "op10_licences": licences.op10_licences,
    "op11_chat": chat.op11_chat,
    "op12_manifest": manifest.op12_manifest,
    "op13_resample": importance.op13_resample,
}
_SQL: dict[str, str] = {
    "op11_chat": chat.SQL,
    "op12_manifest": manifest.SQL,
    "op13_resample": importance.SQL,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
