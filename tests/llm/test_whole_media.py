"""Descriptors meet over the whole radius that the votes were made for."""

from lodegrid.llm import media


def test_a_group_of_tests_apart(spark):
    schema = "image_id long, x double, y double, scale double, angle int, code array<long>"
    one = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0, [5, 6, 7, 8])], schema)
    far = spark.createDataFrame([(2, 0.0, 0.0, 1.0, 0, [5, 6, 7, 8 ^ (2**12 - 1)]), (3, 0.0, 0.0, 1.0, 0, [5, 6, 7, 8 ^ (2**13 - 1)])], schema)
    assert [r["d"]["image_id"] for r in media.matches(one, far).collect()] == [2]
