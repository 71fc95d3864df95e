"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from . import align, bpe, chat, infill, jaccard, lines, media, mixing, packing, quality, secrets, tokens, wrappers


def queries() -> dict:
    return {
        "op1_mpeg_audio": media.op1_mpeg_audio,
        "op2_fair_mix": mixing.op2_fair_mix,
        "op3_edit_counts": tokens.op3_edit_counts,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
        "op8_reply_chat": chat.op8_reply_chat,
        "op7_page_text": wrappers.op7_page_text,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_best_fit_pack": packing.op10_best_fit_pack,
        "op11_fill_in_middle": infill.op11_fill_in_middle,
        "op12_token_alignment": align.op12_token_alignment,
        "op13_forced_boundary_bpe": bpe.op13_forced_boundary_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality.OP4_SQL,
        "op6_ngram_jaccard": jaccard.OP6_SQL,
        "op8_reply_chat": chat.OP8_SQL,
        "op11_fill_in_middle": infill.OP11_SQL,
    }
