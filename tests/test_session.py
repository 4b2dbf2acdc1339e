"""Session helpers: shuffle sizing and settings left alone."""

from patronage.session import RECOMMENDED_CONF, cluster_conf, configure


def test_cluster_conf_sizes_partitions():
    tb = 1024**4
    conf = cluster_conf(100 * tb)
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * tb // (256 * 1024**2)
    assert conf["spark.sql.adaptive.enabled"] == "true"
    assert cluster_conf(1024)["spark.sql.shuffle.partitions"] == "200"
    for key in RECOMMENDED_CONF:
        assert key in conf


def test_configure_fills_only_unset_settings(spark):
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "1234")
    spark.conf.unset("spark.sql.parquet.pushdown.inFilterThreshold")
    try:
        configure(spark)
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "1234"
        assert spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold") == "1000"
    finally:
        for key, value in RECOMMENDED_CONF.items():
            spark.conf.set(key, value)
