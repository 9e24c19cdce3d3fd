from haze.session import sizing_conf


def test_sizing_conf_waves_and_floor():
    big = sizing_conf(100 * 2**40, 8000)
    n = int(big["spark.sql.shuffle.partitions"])
    assert n % 8000 == 0 and n >= 100 * 2**40 // (256 << 20)
    small = sizing_conf(1 << 20, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"        # at least 2 tasks per core
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
