from curbwatch.plans import REPORT_CONF, configure_reports, restore


def test_configure_and_restore(spark):
    before = {key: spark.conf.get(key, None) for key in REPORT_CONF}
    previous = configure_reports(spark, **{"spark.sql.shuffle.partitions": "3"})
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == REPORT_CONF["spark.sql.files.maxPartitionBytes"]
    restore(spark, previous)
    assert {key: spark.conf.get(key, None) for key in REPORT_CONF} == before
