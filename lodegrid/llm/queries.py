"""Queries of this subpackage for __spark_entry__.py."""

from __future__ import annotations

from . import chat, decontaminate, fingerprints, language_id, manifest, media, mixing, pieces, repair, secrets, simhash_dedup, substring_dedup, url_filter


def queries() -> dict:
    return {f.__name__: f for f in (url_filter.op1_url_filter, language_id.op2_language_id, fingerprints.op3_simhash_fingerprint, substring_dedup.op4_substring_dedup, media.op5_image_copies, mixing.op6_source_mix, pieces.op7_piece_codec, simhash_dedup.op8_simhash_dedup, secrets.op9_secret_scan, chat.op10_chat_format, decontaminate.op11_decontaminate, repair.op12_conversation_repair, manifest.op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mix": mixing.OP6_SQL, "op11_decontaminate": decontaminate.OP11_SQL, "op12_conversation_repair": repair.OP12_SQL, "op13_merkle_manifest": manifest.OP13_SQL}
