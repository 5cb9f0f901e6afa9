from arborgrid.llm import registry


def test_every_problem_has_queries():
    names = set(registry.QUERIES)
    assert {"p2_subset", "p3_found", "p4_found", "p5_found", "p6_ids", "p7_found", "p8_found"} <= names
    assert set(registry.ORACLES) <= names
