"""The registered queries of the corpus operators, and SQL for those it can express."""

from __future__ import annotations

from . import bpe, chat, decontam, jaccard, mpeg_audio, secrets, substring, token_counts, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mpeg_audio": mpeg_audio.op2_mpeg_audio,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_warc": warc.op4_warc,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_chat_format": chat.op6_chat_format,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_jaccard": jaccard.op10_jaccard,
}
SQL = {"op4_warc": warc.OP4_SQL, "op6_chat_format": chat.OP6_SQL, "op9_decontamination": decontam.OP9_SQL}
