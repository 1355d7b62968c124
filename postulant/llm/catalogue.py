"""Registered queries of the operators and their SQL counterparts."""

from __future__ import annotations

from postulant.llm import bpe, embeddings, lexical, minhash, mixing, periods, pii, quality_classifier, quality_rules, suffixes, token_files, toxicity, warc

MODULES = (embeddings, warc, quality_rules, quality_classifier, pii, mixing, bpe, suffixes, minhash, toxicity, periods, token_files, lexical)


def all_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
