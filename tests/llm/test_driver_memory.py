from siltworks.llm import common


def test_a_stored_table_has_the_driver_give_back_what_ended_queries_left(spark, monkeypatch):
    given_back = []
    monkeypatch.setattr(common, "IN_USE", 0.0)
    monkeypatch.setattr(common, "_trim", given_back.append)
    assert sorted(r.id for r in common.stored(spark.range(3)).collect()) == [0, 1, 2]
    assert given_back


def test_a_driver_with_room_is_left_alone(spark):
    assert not common.relieve(spark, 1.0)
    assert common.relieve(spark, 0.0)


def test_native_memory_is_trimmed(spark):
    assert "native heap" in common._trim(spark)
