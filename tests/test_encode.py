"""One-hot slots by a dictionary: unseen and null values are all zeros."""

from farelake.operators import encode as EN


def test_slots_of_seen_unseen_and_null_values(spark):
    train = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", None), (None, "z")], "p string, q string")
    slots = EN.dictionary(train, ["p", "q"])
    assert sorted((r.slot, r.col, r.value) for r in slots.collect()) == [(0, "p", "a"), (1, "p", "b"), (2, "q", "x"), (3, "q", "z")]
    rows = spark.createDataFrame([(1, "b", "z"), (2, "never", "x"), (3, None, None), (4, "a", "never"), (4, "a", "never")], "id int, p string, q string")
    got = sorted((r.id, r.slots) for r in EN.one_hot(rows, slots, ["p", "q"]).collect())
    assert got == [(1, [1, 3]), (2, [2]), (3, []), (4, [0]), (4, [0])]
    assert EN.one_hot(rows, EN.dictionary(train.limit(0), ["p", "q"]), ["p", "q"]).filter("size(slots) > 0").count() == 0
