"""Lineage cuts, spreading and shipping."""

from pyspark.sql import functions as F

from trajecta.session import cut, parallelism, ship, spread


def test_cut_is_reliable(spark):
    df = spark.range(10).withColumn("x", F.rand())
    kept = cut(df)
    assert kept.collect() == kept.collect()
    assert "LocalCheckpoint" not in kept._jdf.queryExecution().toString()
    assert spark.sparkContext.getCheckpointDir() is not None


def test_spread_deals_out_small_scans_only(spark):
    n = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == n
    many = spark.range(100, numPartitions=n + 3)
    assert spread(many) is many
    shuffled = spark.range(100).groupBy("id").count()
    assert spread(shuffled) is shuffled
    assert parallelism(spark) >= n


def test_workers_import_the_package(spark):
    ship(spark)

    def run(batches):
        import trajecta.operators.turns as t

        for b in batches:
            yield b.assign(x=t.fit([("human", "a")], 10)[0][1])

    assert spark.range(1).mapInPandas(run, "id long, x string").first()["x"] == "a"
