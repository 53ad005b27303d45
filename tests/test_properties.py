"""Property checks against plain-Python models of the reference's conversions."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.functions import parsing

TEXT = st.text(alphabet=" +-0123456789a.", max_size=8)


def _py_int(x):
    """Python ``int()`` as the reference applies it (underscores excluded by design)."""
    try:
        v = int(x)
    except ValueError:
        return None
    return v if -2**31 <= v < 2**31 else None


@settings(max_examples=1, deadline=None)
@given(st.lists(TEXT, min_size=50, max_size=50))
def test_safe_int_matches_python_int(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = [r[0] for r in df.select(parsing.safe_int(F.col("x"))).collect()]
    assert got == [_py_int(v) for v in values]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab+ ", max_size=6), st.integers(-3, 300)), min_size=30, max_size=30))
def test_watch_parser_round_trips_generated_lines(spark, items):
    lines = [f"2025-01-02T03:04:05,{i},GET /data/m/{t}/{m}.mpg" for i, (t, m) in enumerate(items)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = sorted((int(r.user_id), r.movie_title_id, r.watched_minutes) for r in parsing.parse_watch(df).collect())
    want = sorted((i, t, m) for i, (t, m) in enumerate(items) if "," not in t and "/" not in t)
    assert got == want
