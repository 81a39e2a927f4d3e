"""Randomised checks of the distributed numbering and running aggregates
against single-window Spark results."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from gradewell.operators import rowindex

ROWS = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(-50, 50)),
                min_size=1, max_size=120)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, width=st.integers(1, 15))
def test_row_index_any_bucket_width(spark, rows, width):
    data = [(i, s, o, v) for i, (s, o, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, s int, o int, v int")
    got = rowindex.global_row_index(df, ["o", "id"], strata=["s"], bucket=F.floor(F.col("o") / width))
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy("o", "id")))
    assert sorted(map(tuple, got.select("id", "rn").collect())) == \
        sorted(map(tuple, ref.select("id", "rn").collect()))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, width=st.integers(1, 15), inclusive=st.booleans())
def test_bucketed_running_any_bucket_width(spark, rows, width, inclusive):
    data = [(i, s, o, v) for i, (s, o, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, s int, o int, v int") \
        .withColumn("b", F.floor(F.col("o") / width))
    got = rowindex.bucketed_running(df, ["s"], ["o", "id"], "b",
                                    {"sm": ("sum", "v"), "mn": ("min", "v"), "mx": ("max", "v")},
                                    inclusive=inclusive)
    end = 0 if inclusive else -1
    w = Window.partitionBy("s").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, end)
    ref = df.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("sm"),
                    F.min("v").over(w).alias("mn"), F.max("v").over(w).alias("mx"))
    assert sorted(map(tuple, got.select("id", "sm", "mn", "mx").collect())) == \
        sorted(map(tuple, ref.collect()))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, width=st.integers(1, 15), desc=st.booleans())
def test_ordered_row_index(spark, rows, width, desc):
    data = [(i, s, o, v) for i, (s, o, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, s int, o int, v int")
    got = rowindex.ordered_row_index(df, "o", ["id"], bucket=F.floor(F.col("id") / width), descending=desc)
    lead = F.col("o").desc() if desc else F.col("o").asc()
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy(lead, F.col("id"))))
    assert sorted(map(tuple, got.select("id", "rn").collect())) == \
        sorted(map(tuple, ref.select("id", "rn").collect()))
