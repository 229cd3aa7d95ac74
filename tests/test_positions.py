from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.operators.positions import with_position, with_previous


def rows(spark):
    return spark.range(500).select((F.col("id") % 7 == 0).cast("int").alias("k"), F.pmod(F.col("id") * 37, F.lit(501)).alias("o"), "id")


def test_position_equals_plain_window(spark):
    df = rows(spark).unionByName(spark.createDataFrame([(None, 1, 900), (None, 0, 901)], "k int, o bigint, id bigint"))
    got = {r["id"]: r["pos"] for r in with_position(df, ["k"], F.floor(F.col("o") / 10), [F.col("o")], null_safe=True).collect()}
    want = {r["id"]: r["p"] - 1 for r in df.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("o"))).collect()}
    assert got == want


def test_null_keys_are_left_out(spark):
    df = rows(spark).unionByName(spark.createDataFrame([(None, 1, 900)], "k int, o bigint, id bigint"))
    assert with_position(df, ["k"], F.floor(F.col("o") / 10), [F.col("o")]).count() == 500


def test_previous_equals_lag(spark):
    df = rows(spark)
    got = {r["id"]: r["prev"] for r in with_previous(df, ["k"], F.floor(F.col("o") / 3), "o", "id").collect()}
    want = {r["id"]: r["p"] for r in df.withColumn("p", F.lag("id").over(Window.partitionBy("k").orderBy("o"))).collect()}
    assert got == want


def test_empty(spark):
    assert with_position(rows(spark).limit(0), ["k"], F.col("o"), [F.col("o")]).count() == 0
