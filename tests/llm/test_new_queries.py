import pytest

from tests.llm.oracle import same
from turnweave.llm import queries


@pytest.mark.parametrize("name", ["op11_ball_tree_clusters", "op12_exponion_codes", "html_main_text_derived"])
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_matches_sql(spark, name, sf):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], f"/root/testdata/sf{sf}")
