import os

from lociflow.session import cut, forget


def test_cut_and_forget(spark):
    df = cut(spark.createDataFrame([(1, [1.0], None), (2, None, "x")], "a int, b array<double>, c string"))
    assert sorted(r.a for r in df.collect()) == [1, 2] and df.schema["b"].dataType.simpleString() == "array<double>"
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    forget(df, None)
    assert not os.path.exists(folder)
    assert cut(df.sparkSession.createDataFrame([], "a int")).count() == 0
