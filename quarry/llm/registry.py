"""Queries of this subpackage for __spark_entry__.py, and SQL for those that DuckDB can express."""

from __future__ import annotations

from . import audit, divergence, fingerprints, html, licenses, lines, media, mixing, packing, perplexity, simhash, suffixes, whitening

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_distribution_divergence": divergence.op2_distribution_divergence,
    "op3_suffix_array_dedup": suffixes.op3_suffix_array_dedup,
    "op4_license_digests": licenses.op4_license_digests,
    "op5_quality_classifier": perplexity.op5_quality_classifier,
    "op6_site_templates": html.op6_site_templates,
    "op7_canonical_digest": fingerprints.op7_canonical_digest,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_simhash_components": simhash.op10_simhash_components,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_media_columns": media.op12_media_columns,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

SQL = {"op1_source_mixing": mixing.OP1_SQL, "op3_suffix_array_dedup": suffixes.OP3_SQL, "op4_license_digests": licenses.OP4_SQL, "op8_line_dedup": lines.OP8_SQL, "op11_filter_audit": audit.OP11_SQL}
