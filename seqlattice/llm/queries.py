"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import alignment, bpe, collocations, decontam, langid, license_scan, packing, pii, quality, sharding, simhash, toxicity, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_simhash": simhash.op2_simhash,
    "op3_warc": warc.op3_warc,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": pii.op5_pii,
    "op6_langid": langid.op6_langid,
    "op7_decontam": decontam.op7_decontam,
    "op8_bpe": bpe.op8_bpe,
    "op9_license": license_scan.op9_license,
    "op10_quality": quality.op10_quality,
    "op11_collocations": collocations.op11_collocations,
    "op12_alignment": alignment.op12_alignment,
    "op13_packing": packing.op13_packing,
}

ORACLES: dict[str, str] = {"op3_warc": warc.OP3_SQL, "op11_collocations": collocations.OP11_SQL}
