"""What a query leaves on disk: no shuffle files of written tables, and rows are not shuffled to meet small tables."""

from pyspark.sql import functions as F

from farelake.operators import calibrate as CAL
from farelake.operators import splits as SP
from farelake.operators import training as TR
from farelake.session import CLEAN_UP, written_table


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in files.apply(i).getName() for i in range(files.size()))


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


def test_a_written_table_leaves_no_shuffle_files(spark):
    sums = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s"))
    sums.collect()
    mine, setting = _shuffle_files(spark), spark.conf.get(CLEAN_UP, None)
    assert mine > 0
    assert written_table(sums, "sums").agg(F.sum("s")).first()[0] == 499500
    assert _shuffle_files(spark) <= mine + 8  # of the sum that was just read, a file and an index a task
    for _ in range(6):
        written_table(sums, "sums")
    assert _shuffle_files(spark) <= mine + 8 and spark.conf.get(CLEAN_UP, None) == setting
    assert sums.count() == 10


def test_observations_are_not_shuffled_to_meet_their_folds(spark):
    rows = [(f"A{i % 4} -> B", f"A{i % 4}_B", "X", "Economy", i % 40, 3000.0 + i, 500.0 + i % 4, 4000.0 + 2 * i) for i in range(60)]
    obs = spark.createDataFrame(rows, "route string, corridor string, airline string, cabin string, days_left int, hist_pred double, distance_km double, market_fare double")
    of = CAL.with_features(obs)
    oof = CAL.out_of_fold(of, CAL.loro_coefficients(of, "route", CAL.LOG_HIST_FEATURES), "route", CAL.LOG_HIST_FEATURES)
    assert oof.count() == 60 and not _joins(oof)
    alone = {r.candidate: r.mae for r in CAL.candidate_table(obs, CAL.LOG_HIST_FEATURES).collect()}
    report = {(r["section"], r["item"], r["metric"]): r["value"] for r in CAL.report(obs, CAL.LOG_HIST_FEATURES).collect()}
    assert all(abs(report["candidates", c, "mae"] - mae) < 1e-9 for c, mae in alone.items())


def test_fares_are_not_shuffled_to_meet_held_out_groups_and_means(spark):
    rows = [("Economy", f"A{i % 9}", "B", f"A{i % 9} → B", "X" if i % 2 else "Y", "zero", 500.0 + i % 9, 3000.0 + i) for i in range(90)]
    fares = spark.createDataFrame(rows, "class string, source_city string, destination_city string, route string, airline string, stops string, distance_km double, price double")
    split = SP.group_holdout(fares, F.col("source_city"))
    assert not _joins(split) and split.where("split = 'test'").select("source_city").distinct().count() == 2
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    for name, add in TR.class_mean_models(train).items():
        if name != "Distance Log-Linear":
            scored = add(test)
            assert not _joins(scored) and scored.where("pred IS NULL").count() == 0
