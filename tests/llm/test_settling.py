"""What the driver and the shuffles are spared."""

import gc
import weakref

from lindwurm.llm import linkage
from lindwurm.runtime import Scratch


def test_finished_plans_are_let_go(spark):
    df = spark.range(3).selectExpr("id + 1 as n")
    df.me, gone = df, weakref.ref(df)
    gc.disable()
    del df
    Scratch(spark, "settling").settle()
    gc.enable()
    assert gone() is None


def test_candidates_are_made_distinct_once(spark):
    told = spark.createDataFrame([(i, "m", 7, ["varstann", "varstann"], [("2012-01-01", 60), ("2012-01-01", 90)]) for i in range(3)], "no bigint, muni string, place bigint, title_words array<string>, days array<struct<day:string,start:int>>")
    found = linkage.candidates(told)
    assert sorted(map(tuple, found.collect())) == [(0, 1), (0, 2), (1, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
