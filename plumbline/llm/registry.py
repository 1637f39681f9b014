"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from . import decontaminate, langid, licenses, minhash, neighbours, pieces, quality, substrings, suffixes, warc

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_warc_round_trip": warc.op2_warc_round_trip,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_minhash": minhash.op4_minhash,
    "op5_substrings": substrings.op5_substrings,
    "op6_quality": quality.op6_quality,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_suffixes": suffixes.op9_suffixes,
    "op10_neighbours": neighbours.op10_neighbours,
}
ORACLE_SQL = {"op2_warc_round_trip": warc.SQL, "op4_minhash": minhash.SQL, "op5_substrings": substrings.SQL, "op8_decontaminate": decontaminate.SQL, "op9_suffixes": suffixes.SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE_SQL)
