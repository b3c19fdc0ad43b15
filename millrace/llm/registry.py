"""The queries of the corpus operators and their SQL."""

from . import queries_chat, queries_language, queries_leaks, queries_licenses, queries_negatives, queries_packing, queries_phrases, queries_quality, queries_similarity, queries_tokens, queries_web

MODULES = [queries_chat, queries_tokens, queries_leaks, queries_similarity, queries_quality, queries_language, queries_licenses, queries_web, queries_phrases, queries_negatives, queries_packing]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
