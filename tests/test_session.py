from tidewater.session import DEFAULT_CONF, checkpoint_root, get_spark, shared_dir


def test_defaults_fill_only_unset(spark):
    again = get_spark("other-name")
    assert again is spark or again.sparkContext is spark.sparkContext
    # set explicitly when the test session was created: untouched
    assert again.conf.get("spark.sql.shuffle.partitions") == "8"
    for key, value in DEFAULT_CONF.items():
        assert again.conf.get(key) is not None
    assert again.conf.get("spark.sql.sources.fileCompressionFactor") == "4.0"


def test_shared_dir_under_checkpoint_root(spark):
    root = checkpoint_root(spark)
    assert root == (spark.conf.get("spark.checkpoint.dir") or "").rstrip("/")
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a != b and a.startswith(root + "/tidewater/x-")
