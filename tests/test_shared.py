"""Tables of the shared folder: what stays and what goes."""

import os

from plumbline.sources import shared as S


def files(df):
    return [f.removeprefix("file:").replace("//", "/") for f in df.inputFiles()]


def test_scratch_keeps_results_only(spark):
    with S.scratch(spark) as outer:
        with S.scratch(spark) as keep:
            inner = S.written(spark.range(5).toDF("a"))
            kept = keep(inner.selectExpr("a * 2 AS a"))
            gone = files(inner)
        assert not any(map(os.path.exists, gone)) and kept.count() == 5
        result = outer(kept)
    assert not any(map(os.path.exists, files(kept))) and sorted(r.a for r in result.collect()) == [0, 2, 4, 6, 8]


def test_discard(spark):
    one = S.written(spark.range(0).toDF("a"))
    assert one.collect() == []
    gone = files(one)
    S.discard(one)
    assert gone and not any(map(os.path.exists, gone))
    S.discard(spark.range(3).toDF("a"))
