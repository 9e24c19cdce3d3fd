import pytest


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    """The package on the workers, and few partitions: the fixtures are small."""
    from haze.llm.common import ship
    ship(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
