from tessella.llm.components import components


def test_null_and_repeated_labels(spark):
    nodes = spark.createDataFrame([(10, 5), (11, None), (12, 3), (20, None), (21, None), (30, 3), (31, 1), (40, None), (50, 9)], "node long, label long")
    edges = spark.createDataFrame([(10, 11), (11, 12), (20, 21), (30, 31), (31, 30)], "a long, b long")
    got = dict(map(tuple, components(nodes, edges).collect()))
    assert got == {10: 3, 11: 3, 12: 3, 20: None, 21: None, 30: 1, 31: 1, 40: None, 50: 9}
