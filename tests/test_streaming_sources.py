import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators.decomposition import PCA
from latticework.sources import tables
from latticework.streaming.incremental import IncrementalMoments, IncrementalPCA, windowed


def test_stream_models(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", F.col("l_extendedprice").alias("p"))
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    pca, moments = IncrementalPCA(["l_quantity", "p"], 2), IncrementalMoments(["l_quantity", "p"])

    def both(batch, k):
        pca.update(batch, k)
        moments.update(batch, k)
        moments.update(batch, k)  # delivered again

    stream.writeStream.foreachBatch(both).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    x = np.array(rows.collect())
    assert moments.n == len(x)
    assert np.allclose(moments.covariance(), np.cov(x.T, ddof=0))
    assert np.allclose(pca.model.explained_variance, PCA.fit(rows, ["l_quantity", "p"], 2).explained_variance)


def test_windows(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    ev.write.parquet(f"{tmp_path}/in")
    stream = windowed(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in"), "ts", "value", ["event_type"], "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("lw_windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM lw_windows").first()[0] == ev.count()


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_tables(spark, tmp_path, format):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    tables.write(df, f"{tmp_path}/t", format)
    back = tables.read(spark, f"{tmp_path}/t", format, "k long, v string")
    assert sorted(back.collect(), key=lambda r: r.k) == sorted(df.collect(), key=lambda r: r.k)
    with pytest.raises(ValueError):
        tables.read(spark, "x", "csv")


def test_folder(spark, sf):
    assert tables.read_folder(spark, sf, ["region"])["region"].count() == spark.sql("SELECT * FROM region").count()
