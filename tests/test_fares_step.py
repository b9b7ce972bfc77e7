"""The step that every fares query starts with: exact duplicates, clock texts, cleaning that runs once."""

from pyspark.sql import functions as F

from farelake.functions import labels as L
from farelake.operators import clean as C
from farelake.plans import datasets as D
from tests.conftest import SF_SMALL


def test_duplicates_are_dealt_before_they_are_aggregated(spark):
    rows = [("a", 0.0, None), ("a", -0.0, None), ("b", 1.5, 2), (None, None, None), (None, None, None), ("a", 0.0, 3)]
    df = spark.createDataFrame(rows, "x string, `odd name` double, n int")
    out = C.drop_exact_duplicates(df)
    assert sorted(map(str, out.collect())) == sorted(map(str, df.dropDuplicates().collect())) and out.count() == 4
    plan = C.drop_exact_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")
    numbers = spark.createDataFrame([(1.0,), (1.0,), (0.0,), (-0.0,)], "v double")
    assert C.drop_exact_duplicates(numbers).count() == 2


def test_clock_texts(spark):
    texts = ["5 7:00", "12:30 5:10", "1 2 3:00", ":05", "dep :05", "-1:00", "24:00", "+5:00", "1.5:00", "a_b", "99999999999:0", "", None, " 03:59\t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(L.normalize_time_bin(F.col("t"))).collect()]
    assert got == ["Early Morning", "Afternoon", "1 2 3:00", ":05", "Dep :05", "Night", "Night", "Early Morning", "1.5:00", "A B", "99999999999:0", "", None, "Late Night"]


def test_fares_are_made_from_tickets_cleaned_once(spark):
    plan = D.fares_lazy(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # duplicates are gone from the written tickets


def test_queries_keep_their_methods_compiled(spark):
    from farelake.plans.registry import load_all

    name, old = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit", None)
    spark.conf.unset(name)
    load_all()["d1_airport_dimension"].build(spark, SF_SMALL)
    assert spark.conf.get(name) == "8000"
    spark.conf.set(name, "9000")
    load_all()["d1_airport_dimension"].build(spark, SF_SMALL)
    assert spark.conf.get(name) == "9000"
    spark.conf.set(name, old or "8000")


def test_fares_are_written_without_sorting_whole_rows(spark):
    D._FARES.clear()
    files = D.fares(spark, SF_SMALL).inputFiles()
    assert files and not any("class=" in f for f in files)  # a table by class would be sorted by it in every task


def test_cities_that_differ_are_settled_before_the_array_of_reasons(spark):
    rows = [("A", "B", 1.0, 2.0), ("A", "A", 1.0, 2.0), (None, "A", 1.0, 2.0), (None, None, 1.0, 2.0), ("A", "B", None, 2.0), ("A", "B", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "source_city string, destination_city string, duration double, price double")
    kept = df.filter(C.is_valid())
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.filter(F.size(C.rejection_reasons(df)) == 0).collect())) and kept.count() == 3
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "OR" in plan and plan.index("NOT coalesce((source_city") < plan.index("size(")  # the left side of OR comes first
