"""The registered queries of the training-data operators, and SQL for those that SQL can state."""

from __future__ import annotations

from loomwork.llm import audit, hamming, infill, jaccard, knn, language, mixing, packing, quality, secrets, sharding, tokens, urls

MODULES = [secrets, language, tokens, mixing, urls, jaccard, sharding, quality, knn, packing, infill, audit, hamming]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
