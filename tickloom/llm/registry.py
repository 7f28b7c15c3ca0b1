"""All queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontam, fertility, line_dedup, near_dedup, pii, search, secrets, sharding, token_files, toxicity, url_rules, whitening

MODULES = [decontam, fertility, token_files, line_dedup, toxicity, near_dedup, sharding, bpe, pii, url_rules, whitening, secrets, search]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
