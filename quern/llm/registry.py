"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from quern.llm import arc_to_warc, compression_bands, html_crf, license_scan, line_dedup, ngram_join, pattern_packing, pii_crf, template_decontamination, token_counts

MODULES = (token_counts, line_dedup, pii_crf, html_crf, template_decontamination, license_scan, compression_bands, ngram_join, pattern_packing, arc_to_warc)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
