from tablewright.operators.rootcause import TOP_CONTRIBUTORS
from tablewright.plans import catalog


def test_a_query_gives_the_whole_list_of_the_operator(spark):
    found = catalog.QUERIES["root_cause_all_top_contributors"](spark, "/root/testdata/sf0.001")
    assert found.count() == TOP_CONTRIBUTORS == 10
