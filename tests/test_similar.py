"""Every query row gets its own k hits, over several blocks."""

from lociflow.operators import embeddings as E


def test_all_queries_are_answered(spark):
    v = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(30)], "id bigint, v array<double>")
    got = E.most_similar(v, v.where("id % 10 = 0"), 3, block=4).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {0: 3, 10: 3, 20: 3}
