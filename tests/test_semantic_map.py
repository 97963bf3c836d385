"""Every template's rows get its cluster, past the hundred most frequent ones too."""

from pyspark.sql import functions as F

from faultline.catalog import fixtures, queries


def test_rows_of_rare_templates_get_a_label(spark, monkeypatch):
    rows = [(i, f"template {k}") for i, k in enumerate([*range(150), *range(100)])]
    df = spark.createDataFrame(rows, "line_id long, event_template string")
    monkeypatch.setattr(fixtures, "parsed", lambda *_: df)
    # The clusters have tests of their own: here each template is one.
    monkeypatch.setattr(
        queries.clusters, "semantic_clusters", lambda t: t.select("text", F.col("first_line").cast("int").alias("label"))
    )
    found = queries.semantic_map_all(spark, "").collect()
    assert {r.line_id: r.semantic_cluster for r in found} == {i: int(t.split()[1]) for i, t in rows}
