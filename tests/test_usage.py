"""Hidden APIs: what is shuffled, and that both ways of joining agree."""

from appfacts.operators.setops import corpus_diff
from appfacts.operators.studies import hidden_api_usage

UNITS = [
    (1, 1, 'x "android.A"\ny "run"\nz "stop"'),
    (1, 2, 'x "android.B"\ny "run"'),
    (2, 3, 'x "android.A"\ny "none"\nconstclass @type ^`Landroid/B;` "'),
    (2, 4, 'y "stop"\nconstclass @type ^`Landroid/B;`'),
    (3, 5, None),
]
APIS = [("hidden", "android.A", "run"), ("nonpublic", "android.A", "run"), ("hidden", "android.A", "stop"), ("hidden", "android.B", "stop"), ("hidden", "android.B", None)]
WANT = [(1, "hidden", "android.A.run"), (1, "hidden", "android.A.stop"), (1, "nonpublic", "android.A.run"), (2, "hidden", "android.B.stop")]


def tables(spark):
    units = spark.createDataFrame(UNITS, "app_id bigint, unit_id bigint, code string")
    return units, spark.createDataFrame(APIS, "kind string, class_name string, method string")


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_short_and_long_lists_agree(spark, rows):
    for max_list in (200_000, 0):
        assert rows(hidden_api_usage(*tables(spark), max_list=max_list)) == WANT


def test_names_of_units_stay_in_place(spark):
    """With a short list only the list itself and what is found are shuffled."""
    found = hidden_api_usage(*tables(spark))
    assert not [x for x in exchanges(found) if "unit_id" in x]


def test_corpora_are_compared_in_one_shuffle(spark, rows):
    schema = "kind string, api string"
    a = spark.createDataFrame([("h", "x"), ("h", "x"), ("h", "y"), (None, "z"), ("n", None)], schema)
    b = spark.createDataFrame([("h", "y"), ("h", "w"), ("h", "w"), ("n", None)], schema)
    assert len(exchanges(corpus_diff(a, b))) == 1
    assert rows(corpus_diff(a, b)) == sorted([("a", "h", "x"), ("a", None, "z"), ("b", "h", "w")], key=repr)
