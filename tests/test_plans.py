"""Physical-plan properties that matter at scale: filters reach the scan,
columns are pruned, the catalogue is broadcast, hot keys are split."""

from pyspark.sql import functions as F

from tidemark.operators.catalog import match_catalog
from tidemark.operators.scan import ordered_scan
from tidemark.sources.catalog import load_catalog
from tidemark.sources.listing import clean_listing, read_listing
from tidemark.sources.manifest import read_inventory


def _plan(df, capsys, mode="formatted"):
    capsys.readouterr()
    df.explain(mode)
    return capsys.readouterr().out


def _listing(spark, tmp_path):
    d = str(tmp_path / "listing")
    spark.sql("SELECT 'b' AS bucket, concat('2026/', cast(id AS string), '.nsq') AS key, id AS size, "
              "'x' AS etag, 'junk' AS extra FROM range(1000)").write.parquet(d)
    return d


def test_listing_prefix_pushed_and_columns_pruned(spark, tmp_path, capsys):
    d = _listing(spark, tmp_path)
    plan = _plan(clean_listing(read_listing(spark, d), "2026/", "*", "1*").select("key", "md5"), capsys)
    assert "StringStartsWith(key,2026/)" in plan
    assert "extra" not in plan.split("ReadSchema:")[1].splitlines()[0]


def test_catalogue_is_broadcast(spark, tmp_path, capsys):
    d = _listing(spark, tmp_path)
    cat = load_catalog(spark, "public_data:\n  nt:\n    s3_url: s3://b/2026/\n    description: x\n"
                              "    database_type: folder\n    exclude: '*'\n    include: '1*'\n")
    m = match_catalog(cat, read_listing(spark, d))
    assert "BroadcastHashJoin" in _plan(m, capsys, "simple")
    assert m.count() == 111  # 1, 10-19, 100-199


def test_inventory_never_reads_content(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("x")
    plan = _plan(read_inventory(spark, str(tmp_path)), capsys)
    schema = plan.split("ReadSchema:")[1].splitlines()[0]
    assert "content" not in schema and "length" in schema


def test_ordered_scan_split_partitions_by_piece(spark, capsys):
    df = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    plan = _plan(ordered_scan(df, ["k"], ["t"], sums={"rs": F.col("v")}, split=8), capsys, "simple")
    # the range split is written once (a scan of that table) and windows
    # are partitioned by (piece, key)
    assert "FileScan parquet" in plan and "Range (" not in plan and "_pid" in plan
    got = ordered_scan(df, ["k"], ["t"], sums={"rs": F.col("v")}, split=8).agg(F.max("rs")).first()[0]
    assert got == 2000


def test_hot_key_detection(spark):
    from tidemark.operators.scan import has_hot_key, hot_pieces
    df = spark.range(3000).select(F.when(F.col("id") < 2000, F.lit("hot")).otherwise(F.col("id").cast("string"))
                                  .alias("k"))
    spark.conf.set("spark.tidemark.scan.hotKeyRows", "100")
    try:
        assert hot_pieces(df, ["k"]) == 30            # 3000 rows in pieces of 100
        assert not has_hot_key(df.where(F.col("k") != "hot"), ["k"])
        spark.conf.set("spark.tidemark.scan.hotKeyRows", "1999")
        assert has_hot_key(df, ["k"])                 # the limit is absolute, whatever the other keys hold
        spark.conf.set("spark.tidemark.scan.split", "never")
        assert not has_hot_key(df, ["k"])
    finally:
        spark.conf.unset("spark.tidemark.scan.hotKeyRows")
        spark.conf.unset("spark.tidemark.scan.split")
    assert not has_hot_key(df, ["k"])                 # default limit: 1,000,000 rows
