"""Queries and SQL of this subpackage: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from . import decontaminate, licences, lines, lm, manifest, mixing, phrases, quality, repair, simhash, suffixes, tokens, warc

MODULES = (lines, quality, tokens, mixing, lm, decontaminate, suffixes, simhash, warc, phrases, licences, repair, manifest)
QUERIES = {name: pair for m in MODULES for name, pair in m.QUERIES.items()}
