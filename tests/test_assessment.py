"""What an assessment stores is worked out once."""


def test_edges_are_computed_once(spark, sf, monkeypatch):
    from checks import all_queries

    query = all_queries()["W7_assessment_record"]
    from checks import q_flow

    seen = spark.sparkContext.accumulator(0)
    whole = q_flow.edges(spark, sf)
    n = whole.count()

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(q_flow, "edges", lambda spark, sf: whole.mapInArrow(counted, whole.schema))
    assert query(spark, sf).first()["regulation_count"] > 0
    assert seen.value == n > 0
