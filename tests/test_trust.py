"""Labels of trust on columns."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidegauge.functions import trust
from tidegauge.plans import queries as q


def test_labels_go_with_columns(spark, tmp_path):
    a = trust.label(spark.createDataFrame([("t", 1, 2.0)], "team string, n int, lead double"), "weak", "lead")
    a = trust.label(a, "sound", "n")
    b = trust.label(spark.createDataFrame([("t", 5)], "team string, cycle int"), "bounded", "cycle")
    j = a.join(b, "team", "left").where("n > 0").withColumn("made", F.col("n") + 1)
    want = {"n": "sound", "lead": "weak", "cycle": "bounded"}
    assert trust.labels(j) == want and trust.unlabelled(j) == ["made"]
    j.repartition(2).write.parquet(f"{tmp_path}/t")
    assert trust.labels(spark.read.parquet(f"{tmp_path}/t")) == want
    with pytest.raises(ValueError):
        trust.label(a, "certain", "n")


def test_every_published_figure_has_one(spark, tmp_path):
    for name, f in q.queries().items():
        df = f(spark, SF)
        assert not trust.unlabelled(df), name
        assert set(trust.EXCEPT.get(name, {})) <= {*df.columns, "*"}, name
    df = q.queries()["sprint_length"](spark, SF)
    df.write.parquet(f"{tmp_path}/t")
    assert trust.labels(spark.read.parquet(f"{tmp_path}/t")) == trust.labels(df) == {"median_days": "sound"}
