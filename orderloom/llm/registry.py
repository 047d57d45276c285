"""All queries of this subpackage, and the SQL of those that SQL can express."""

from . import decontamination, fill_in_middle, html_text, language_id, media, merkle_log, mixing, ngram_join, quality_rules, sharding, token_files, toxicity, url_filters

MODULES = [toxicity, decontamination, token_files, sharding, url_filters, language_id, mixing, ngram_join, media, html_text, quality_rules, merkle_log, fill_in_middle]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}
