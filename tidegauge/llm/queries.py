"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from . import alignment, centroids, language_id, license_scan, media, near_dups, nearest, packing, piece_codec, repeats, secret_scan, token_counts, vector_dups


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_repeats": repeats.op2_repeats,
        "op3_piece_codec": piece_codec.op3_piece_codec,
        "op4_media": media.op4_media,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_nearest": nearest.op6_nearest,
        "op7_near_dups": near_dups.op7_near_dups,
        "op8_language_id": language_id.op8_language_id,
        "op9_packing": packing.op9_packing,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_centroids": centroids.op11_centroids,
        "op12_vector_dups": vector_dups.op12_vector_dups,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    """Of the operators on numbers. Tokenizers, sketches, models and byte ranges are beyond
    SQL: the tests hold each of those queries against brute force, the libraries, round trips
    or held-out accuracy."""
    return {"op11_centroids": centroids.op11_sql(), "op12_vector_dups": vector_dups.op12_sql()}
