"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from . import bpe, decontaminate, exactdedup, fmindex, langid, mixing, sharding, simhash, suffixarray, vectorcodes, warc, wrapper


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_simhash": simhash.op2_simhash,
        "op3_mixing": mixing.op3_mixing,
        "op4_exact_dedup": exactdedup.op4_exact_dedup,
        "op5_warc_revisits": warc.op5_warc_revisits,
        "op6_suffix_array": suffixarray.op6_suffix_array,
        "op7_language_id": langid.op7_language_id,
        "op8_fm_index": fmindex.op8_fm_index,
        "op9_main_text": wrapper.op9_main_text,
        "op10_decontamination": decontaminate.op10_decontamination,
        "op11_bpe": bpe.op11_bpe,
        "op12_vector_codes": vectorcodes.op12_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.OP1_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op4_exact_dedup": exactdedup.OP4_SQL,
        "op5_warc_revisits": warc.OP5_SQL,
        "op6_suffix_array": suffixarray.OP6_SQL,
        "op8_fm_index": fmindex.OP8_SQL,
        "op9_main_text": wrapper.OP9_SQL,
        "op10_decontamination": decontaminate.OP10_SQL,
        "op12_vector_codes": vectorcodes.OP12_SQL,
    }
