"""Facts and results that few tasks would make are spread over more of them, with the same rows."""

from pyspark.sql import functions as F

from appfacts.operators import hierarchy as H
from appfacts.plans import facts
from appfacts.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_facts_of_small_files_are_made_by_many_tasks(spark, rows, monkeypatch):
    """A table of one file split gave one task all rows of a fact."""
    for name in ("fx_app_classes", "fx_listener_methods", "fx_filter_fields", "fx_listener_calls", "fx_register_calls"):
        plain = facts.Facts(spark, SF)[name]
        with monkeypatch.context() as m:
            m.setattr(facts, "DEALT_ROWS", 40)
            dealt = facts.Facts(spark, SF)[name]
            assert rows(dealt) == rows(plain)
            read = facts.Facts(spark, SF)._input("part" if "calls" not in name else "orders", name)
            assert read.select(F.spark_partition_id()).distinct().count() > 3


def test_a_listener_type_with_most_classes_is_expanded_by_many_tasks(spark, rows):
    """One (app, listener) with all callbacks: components and callbacks meet, and are compared, in more than one task."""
    uses = spark.createDataFrame([(1, c, 0) for c in range(3)] + [(1, 0, 9)], "app_id int, component int, listener_id int")
    callbacks = spark.createDataFrame(
        [(1, listener, c, c % 5, "m") for c in range(200) for listener in (0, 9)],
        "app_id int, listener_id int, class_id int, declaring_id int, sub_sig string",
    )
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = H.RegistrationCallbacks(cut_lineage(uses), callbacks).expand()
        assert rows(found) == sorted({(1, k, c, c % 5, "m") for k in range(3) for c in range(200)}, key=repr)
        # Rows go to the tasks that compare them as they are made.
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
