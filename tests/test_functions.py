from datetime import date
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floorledger.functions import days, money, rounding, text
from floorledger.session import scratch_folder


def column(spark, values, type_, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {type_}")
    return [row.out for row in frame.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_gaming_day_cut(spark):
    stamps = ["01-02-2024 08:59", "01-02-2024 09:00", "1-2-2024 3:04", "2024-02-01 10:00", "x", None, "31-02-2024 10:00"]
    found = column(spark, stamps, "STRING", lambda c: days.gaming_day(days.parse_minute(c)))
    assert found == [date(2024, 1, 31), date(2024, 2, 1), date(2024, 1, 31), None, None, None, None]


def test_parse_day(spark):
    texts = ["2024-02-01", "2024-02-01 23:10:00", "2024-2-1", "2024-02-30", "45000", "Fecha", None]
    first = date(2024, 2, 1)
    assert column(spark, texts, "STRING", days.parse_day) == [first] * 3 + [None] * 4


def test_order_of_numbered_days(spark):
    texts = ["03/04/2024", "3-4-2024", "13/04/2024", "04/13/2024"]
    april, march = date(2024, 4, 3), date(2024, 3, 4)
    assert column(spark, texts, "STRING", days.parse_day) == [march, march, None, date(2024, 4, 13)]
    found = column(spark, texts, "STRING", lambda c: days.parse_day(c, day_first=True))
    assert found == [april, april, date(2024, 4, 13), None]


def test_id_marks(spark):
    assert column(spark, ["xx12x", " x 7 x", "x", None], "STRING", text.without_marks) == ["12", " 7 ", "", None]


def test_float_tail(spark):
    assert column(spark, ["17.0", "17", "1.05", None], "STRING", text.without_float_tail) == ["17", "17", "1.05", None]


def test_numbers(spark):
    texts = ["abc", None, "12.5", " 7 ", "-3", "1e3", "12x", "1d", "NaN", "Infinity", "1e999", ".5", "5."]
    found = column(spark, texts, "STRING", text.number_or_zero)
    assert found == [0.0, 0.0, 12.5, 7.0, -3.0, 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 5.0]


def test_labels(spark):
    levels = ["DREAMS GOLD", "DREAMSBLACK", "GOLD", None]
    assert column(spark, levels, "STRING", text.level_label) == ["D.GOLD", "D.BLACK", "GOLD", None]
    assert column(spark, ["03", "12", "", "99"], "STRING", days.month_name) == ["Marzo", "Diciembre", "", "99"]
    assert column(spark, [date(2024, 1, 1), date(2024, 1, 7), None], "DATE", days.weekday_name) == ["Lunes", "Domingo", ""]


def test_period_label(spark):
    frame = spark.createDataFrame([("1997", "03"), ("", "03"), ("1997", ""), (None, None)], "a STRING, m STRING")
    found = [r[0] for r in frame.select(days.period_label(F.col("a"), F.col("m"))).collect()]
    assert found == ["1997-Marzo", "Todos-Marzo", "1997-Todos", "Todos-Todos"]


def test_half_even_is_exact(spark):
    assert column(spark, [6.25, 18.75, 12.35], "DOUBLE", lambda c: rounding.round_half_even(c, 1)) == [6.2, 18.8, 12.3]


def test_half_up_forgives_division(spark):
    # Recorded results of the report engine's ROUND(x, 4).
    values = [16745.62175, 99461.42175, 122982.84424999998, 22342.99325, 0.03125, -0.03125, 0.0]
    found = column(spark, values, "DOUBLE", lambda c: rounding.round_half_up(c, 4))
    assert found == [16745.6218, 99461.4218, 122982.8443, 22342.9933, 0.0313, -0.0313, 0.0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=200))
def test_half_even_matches_python(spark, values):
    for places in (1, 3):
        found = column(spark, values, "DOUBLE", lambda c, p=places: rounding.round_half_even(c, p))
        assert found == [round(v, places) for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cents=st.lists(st.integers(-(10**13), 10**13), min_size=1, max_size=200))
def test_total_is_exact(spark, cents):
    frame = spark.createDataFrame([(c / 100.0,) for c in cents], "v DOUBLE")
    assert frame.agg(money.amount(money.total("v"))).first()[0] == sum(cents) / 100.0


def test_total_of_nothing_is_null(spark):
    assert spark.createDataFrame([], "v DOUBLE").agg(money.total("v")).first()[0] is None


@pytest.mark.parametrize(("master", "folder", "fits"), [
    ("local[8]", None, True), ("local", None, True), ("local-cluster[2,1,1024]", None, False), ("spark://host:1", None, False),
    ("yarn", "hdfs:///scratch", True),
])
def test_scratch_on_a_cluster_is_a_shared_folder(master, folder, fits):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))
    if fits:
        assert scratch_folder(session).startswith(folder or made[0])
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_folder(session)
