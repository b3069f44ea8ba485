import pytest

import edges
from pitloom.llm.queries import QUERIES


@pytest.mark.parametrize("kind", edges.KINDS)
def test_queries(spark, base, tmp_path, kind):
    edges.run(spark, base, edges.write(spark, base, kind, tmp_path), kind, QUERIES)
