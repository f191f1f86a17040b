import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quaestor.cdc.diff import Mismatch, diff, patch, revert, same, summary, under, without_nulls
from quaestor.cdc.history import as_of, changes, not_empty, snapshot_diff, upserted

leaf = st.none() | st.booleans() | st.integers(-3, 3) | st.sampled_from(["", "a", "b", " c"])
value = st.recursive(leaf, lambda v: st.lists(v, max_size=5) | st.dictionaries(st.sampled_from("abcd"), v, max_size=4), max_leaves=20)


@settings(max_examples=400, deadline=None)
@given(value, value)
def test_round_trip(a, b):
    a, b = without_nulls(a), without_nulls(b)
    found = diff(a, b)
    assert same(patch(a, found), b)
    assert same(revert(b, found), a)


def test_scalar_and_none():
    assert diff({"a": 1}, {"a": 2, "b": 3}) == [{"type": "changed", "path": ["a"], "data": [1, 2]}, {"type": "added", "path": ["b"], "data": 3}]
    assert diff({"a": None}, {}) == []
    assert diff({"a": True}, {"a": 1})[0]["type"] == "changed"


@pytest.mark.parametrize(
    "a, b",
    [
        ([{"k": 1, "v": 1}, {"k": 2, "v": 2}], [{"k": 2, "v": 2}, {"k": 1, "v": 1}]),
        ([1, 1, 2], [2, 1, 1, 1]),
        ([{"k": 1, "v": 1}, {"k": 2, "v": 2}], [{"k": 2, "v": 3}, {"k": 1, "v": 1}]),
        ({"x": [[1, 2], [3]]}, {"x": [[3], [1, 2, 4]]}),
    ],
)
def test_lists(a, b):
    found = diff(a, b)
    assert patch(a, found) == b and revert(b, found) == a


def test_an_element_with_one_inner_change_is_compared_inside():
    assert diff([{"k": 1, "v": 1, "w": 5}], [{"k": 1, "v": 2, "w": 5}]) == [{"type": "changed", "path": [0, "v"], "data": [1, 2]}]


def test_foreign_changes_are_refused():
    with pytest.raises(Mismatch):
        patch({"a": 5}, diff({"a": 1}, {"a": 2}))


def test_paths():
    found = diff({"a": [{"b": 1}], "c": 1}, {"a": [{"b": 2}], "c": 2})
    assert summary(found) == "a.b, c" and under(found, ["a", "b"]) == found[:1]


def test_drop_empty():
    assert not_empty({"a": 0, "b": False, "c": "", "d": None, "e": []}) == {"a": 0, "b": False}


def test_upsert_preserves_fields_but_not_empty_ones():
    doc, found = upserted({"a": 1, "b": [1]}, {"a": 1}, "t2")
    assert doc is None and not found
    doc, found = upserted({"a": 1, "b": [1]}, {"a": 1}, "t2", nopreserve=["b"])
    assert "b" not in doc and found[0]["type"] == "deleted"
    doc, found = upserted({"a": 1, "b": []}, {"a": 1}, "t2")
    assert [c["type"] for c in found] == ["deleted"] and doc["changes"]["t2"] == found


def history():
    doc, _ = upserted(None, {"a": 1}, "2020-01-01T00:00:00")
    for i, ts in enumerate(("2020-02-01T00:00:00", "2020-03-01T00:00:00", "2020-04-01T00:00:00"), 2):
        doc, _ = upserted(doc, {"a": i}, ts)
    return doc


def test_time_travel():
    doc = history()
    assert as_of(doc, "2020-03-15")[0]["a"] == 3
    assert as_of(doc, "2020-04-01")[0]["a"] == 3  # a day sorts before its instants
    back, failed, log = as_of(doc, "2019-01-01")
    assert back["a"] == 2 and failed is None and len(log) == 1  # the oldest change stays


def test_failed_time_travel_is_reported():
    doc = history()
    doc["a"] = 77
    back, failed, _ = as_of(doc, "2020-03-15")
    assert failed == "2020-04-01T00:00:00" and back["a"] == 77


def test_changes_in_spark(spark):
    df = spark.createDataFrame([("x", json.dumps({"a": [1]}), json.dumps({"a": [1, 2]})), ("y", None, json.dumps({"a": 1}))], "k string, old string, new string")
    got = {r.k: r.changes for r in changes(df, "old", "new").collect()}
    assert got["x"][0].path == ["a", "#1"] and got["y"][0].type == "added"


def test_snapshot_diff(spark):
    a = spark.createDataFrame([(1, "x", 2), (2, "y", 3)], "k int, s string, n int")
    b = spark.createDataFrame([(1, "x", 5), (3, "z", 3)], "k int, s string, n int")
    got = {(r.k, r.field, r.type) for r in snapshot_diff(a, b, "k", ["s", "n"]).collect()}
    assert got == {(1, "n", "changed"), (2, "s", "deleted"), (2, "n", "deleted"), (3, "s", "added"), (3, "n", "added")}


def test_list_rules():
    change = lambda t, p, d: {"type": t, "path": p, "data": d}
    assert diff(["a", "b"], ["b", "c"]) == [change("added", [1], "c"), change("deleted", [0], "a")]
    assert diff(["a", "b"], ["b", "a"]) == [change("changed", [0], ["a", "b"]), change("changed", [1], ["b", "a"])]
    assert diff(["a", "a"], ["a", "b", "c"]) == [change("changed", [1], ["a", "b"]), change("added", [2], "c")]
    one, other = {"k": 1, "v": 1, "w": 1}, {"k": 2, "v": 2, "w": 2}
    assert diff([one], [{**one, "v": 9}]) == [change("changed", [0, "v"], [1, 9])]
    assert diff([one], [{**one, "v": 9, "w": 9}]) == [change("added", [0], {**one, "v": 9, "w": 9}), change("deleted", [0], one)]
    moved = diff([one, other], [other, {**one, "v": 9}])
    assert moved == [change("deleted", [0], one), change("added", [1], one), change("changed", [1, "v"], [1, 9])]
    assert patch([one, other], moved) == [other, {**one, "v": 9}] and revert([other, {**one, "v": 9}], moved) == [one, other]
    # a log as published dumps have it: deletions by old indexes, inner paths by new ones
    log = [change("deleted", [0], {"a": 1}), change("added", [1], {"a": 1}), change("added", [1, "b"], 2), change("deleted", [2], "x")]
    assert patch([{"a": 1}, "y", "x"], log) == ["y", {"a": 1, "b": 2}] and revert(["y", {"a": 1, "b": 2}], log) == [{"a": 1}, "y", "x"]
