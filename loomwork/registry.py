"""All queries by name, with the SQL that states the same rows."""

from __future__ import annotations

from loomwork import core
from loomwork.plans import aggregates, evaluation, filters, joins, mutations, ngrams, numbers, ordering, scans, sets, state, texts, understanding, windows  # noqa: F401  they register themselves

QUERIES = core.QUERIES
ORACLES = core.ORACLES
