"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, langid, line_dedup, lmscore, minhash, mixing, packing, quality, tokenbin, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_langid": langid.op2_langid,
    "op3_mixing": mixing.op3_mixing,
    "op4_minhash": minhash.op4_minhash,
    "op5_quality": quality.op5_quality,
    "op6_tokens": tokenbin.op6_tokens,
    "op7_lmscore": lmscore.op7_lmscore,
    "op8_ann": ann.op8_ann,
    "op9_warc": warc.op9_warc,
    "op10_packing": packing.op10_packing,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op9_warc": warc.OP9_SQL,
}
