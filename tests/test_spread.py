"""Work that is large beside its input goes to many tasks."""

import pytest

from borgata.plans.base import spread
from borgata.plans.catalogue import QUERIES
from conftest import SF


@pytest.mark.parametrize("name", ["html_card_extract", "listing_cards", "item_cards"])
def test_cards_are_cut_by_as_many_tasks_as_a_shuffle_has(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = QUERIES[name](spark, SF)
        assert df.rdd.getNumPartitions() >= 7 and df.count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_spread_keeps_rows_and_many_tasks(spark):
    df = spark.range(100, numPartitions=1).selectExpr("id % 9 AS a", "IF(id % 2 = 0, 'x', NULL) AS b")
    out = spread(df)
    assert out.rdd.getNumPartitions() == 2 and sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
    many = spark.range(10, numPartitions=5)
    assert spread(many) is many
