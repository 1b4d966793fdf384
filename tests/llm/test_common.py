import pytest
from pyspark.sql import functions as F

from lithoscope.llm import common
from lithoscope.llm.exact_dedup import exact_dedup
from lithoscope.llm.near_dedup import near_dedup


@pytest.fixture
def uncombined(spark):
    """Many shuffle partitions, which Spark does not combine."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_only_scans_of_few_tasks_are_dealt_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(9).write.parquet(f"{tmp_path}/nine")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        one, nine = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("one", "nine"))
        cores = spark.sparkContext.defaultParallelism
        assert common.spread(one).rdd.getNumPartitions() == cores and sorted(r.id for r in common.spread(one).collect()) == list(range(100))
        assert common.spread(nine) is nine
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_hot_keys_are_joined_apart(spark):
    rows = spark.range(1000).selectExpr("if(id < 900, 0, id) as k", "id")
    index = rows.groupBy("k").count().withColumnRenamed("count", "n")
    joined = common.join_hot(rows, index, ["k"], "n", 1000)
    assert joined.count() == 1000 and joined.where("k = 0 and n = 900").count() == 900


def test_folders_go_when_the_session_ends(spark):
    path = common.shared_dir(spark)
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(spark._jvm.org.apache.hadoop.fs.Path(path)) and files.cancelDeleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    common.remove(spark, path)
    assert not files.exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def test_narrow_tables_take_few_files_where_partitions_are_not_combined(uncombined, tmp_path):
    rows = uncombined.range(2000).groupBy((F.col("id") % 500).alias("k")).count()
    found = common.stored_narrow(rows, f"{tmp_path}/narrow")
    assert len(list(tmp_path.glob("narrow/part-*"))) <= uncombined.sparkContext.defaultParallelism
    assert sorted((r.k, r["count"]) for r in found.collect()) == [(k, 4) for k in range(500)]
    uncombined.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert common.few_parts(rows) is rows


@pytest.mark.parametrize("operator", [near_dedup, exact_dedup])
def test_duplicates_are_found_with_few_files(uncombined, docs, tmp_path, monkeypatch, operator):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    text = lambda k: " ".join(f"w{(k * 31 + j * j) % 9973}" for j in range(60))
    rows = [(2 * k + again, text(k)) for k in range(300) for again in (0, 1)]
    out = {r.doc_id: r.kept for r in operator(docs(rows)).collect()}
    assert out == {i: i % 2 == 0 for i, _ in rows}
    files = {p.name: len(list(p.glob("part-*"))) for p in tmp_path.rglob("*") if p.is_dir()}
    most = uncombined.sparkContext.defaultParallelism
    assert files and {n: k for n, k in files.items() if k > most} == {}
