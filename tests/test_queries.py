"""Every query of the engine's own operators: against its SQL where it has some, else that it runs."""

from __future__ import annotations

import pytest
from compare import same

from loomwork import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        same(df, sf_dir, registry.ORACLES[name])
    else:
        assert df.count() > 0
