"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import bitplane, bpe, chat, exact_dedup, mixing, quality, secrets, simhash, superkmer, warc

QUERIES = {
    "op1_bitplane": bitplane.op1_bitplane,
    "op2_quality": quality.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_chat": chat.op4_chat,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_bpe": bpe.op6_bpe,
    "op7_mixing": mixing.op7_mixing,
    "op8_warc": warc.op8_warc,
    "op9_secrets": secrets.op9_secrets,
    "op10_superkmer": superkmer.op10_superkmer,
}

ORACLE_SQL = {
    "op4_chat": chat.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op9_secrets": secrets.ORACLE_SQL,
    "op10_superkmer": superkmer.ORACLE_SQL,
}
