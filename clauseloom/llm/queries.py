"""The queries over whole tables, one for each operator, and their SQL where there is one."""

from __future__ import annotations

from . import bpe, ctph, decontaminate, funnels, linededup, nearby, neighbours, phrases, pii, quality, secrets, warc, wordpiece

QUERIES = {
    "op1_line_dedup": linededup.query,
    "op2_pii": pii.query,
    "op3_warc": warc.query,
    "op4_near_duplicates": nearby.query,
    "op5_secrets": secrets.query,
    "op6_decontamination": decontaminate.query,
    "op7_token_counts": wordpiece.query,
    "op8_quality": quality.query,
    "op9_fingerprints": ctph.query,
    "op10_byte_bpe": bpe.query,
    "op11_phrases": phrases.query,
    "op12_funnels": funnels.query,
    "op13_neighbours": neighbours.query,
}
SQL = {"op1_line_dedup": linededup.SQL, "op3_warc": warc.SQL, "op4_near_duplicates": nearby.SQL, "op5_secrets": secrets.SQL, "op11_phrases": phrases.SQL, "op12_funnels": funnels.SQL}
