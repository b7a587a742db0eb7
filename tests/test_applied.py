"""Logged batches of canonical values and row transforms under a contract."""

import pytest

from clauseloom.operators import contracts as C
from clauseloom.operators.applied import CanonicalLog, group_keys

GROUPS = "g string, v string, k long"


def test_batches_apply_once_and_follow_each_other(spark, tmp_path):
    log = CanonicalLog(spark, f"file://{tmp_path}/log")
    assert log.reviewed().count() == 0 and log.values().count() == 0
    first = spark.createDataFrame([("a", "x", 1), ("a", "xx", 2), ("a", "yy", 3), ("a", "xx", 9), ("b", None, 4), (None, "q", 5)], GROUPS)
    assert log.bulk_apply(first, "g", "v", "k", "p") == 1
    assert log.bulk_apply(first, "g", "v", "k", "p") == 0 and len(log.commits()) == 1
    # The same values under another name and in another order are the same group; xx moves on, with x and yy behind it; x alone is gone.
    second = spark.createDataFrame([("z", "yy", 7), ("z", "xx", 8), ("z", "x", 6), ("c", "xx", 1), ("c", "longer", 2), ("d", "x", 1), ("d", "the longest", 2)], GROUPS)
    assert log.bulk_apply(second, "g", "v", "k", "p") == 2
    assert {(r.value, r.canonical) for r in log.values().collect()} == {("x", "longer"), ("xx", "longer"), ("yy", "longer"), ("longer", "longer"), ("the longest", "the longest")}
    assert sorted(r.batch for r in log.reviewed().collect()) == [1, 2, 2]
    rows = spark.createDataFrame([(1, "x", "other"), (2, None, "yy"), (3, "none", None)], "id long, one string, two string")
    assert {tuple(r) for r in log.apply(rows, ["one", "two"]).select("id", "one", "two", "pool").collect()} == {(1, "longer", "other", "p"), (2, None, "longer", "p"), (3, "none", None, None)}


def test_crash_before_commit_and_a_lost_race(spark, tmp_path):
    log = CanonicalLog(spark, f"file://{tmp_path}/log")
    a = spark.createDataFrame([("a", "x", 1), ("a", "xx", 2)], GROUPS)
    b = spark.createDataFrame([("b", "xx", 1), ("b", "xxx", 2)], GROUPS)

    def crash():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        log.bulk_apply(a, "g", "v", "k", "p", before_commit=crash)
    assert log.commits() == [] and log.values().count() == 0
    turns = []

    def other_first():
        turns.append(1)
        if len(turns) == 1:
            assert log.bulk_apply(b, "g", "v", "k", "p") == 1

    assert log.bulk_apply(a, "g", "v", "k", "p", before_commit=other_first) == 1
    assert len(turns) == 2 and len(log.commits()) == 2
    # As if b had come first: xx is xxx by then, so only x follows its group.
    assert {(r.value, r.canonical) for r in log.values().collect()} == {("x", "xx"), ("xx", "xxx"), ("xxx", "xxx")}


def test_group_keys_depend_on_values_only(spark):
    rows = [("a", "1", 0), ("a", "2", 0), ("b", "2", 0), ("b", "1", 0), ("b", "1", 0), ("c", "1", 0)]
    keys = {r.g: r.group_key for r in group_keys(spark.createDataFrame(rows, GROUPS), "g", "v").collect()}
    assert keys["a"] == keys["b"] != keys["c"]


def test_contract_levels_and_dead_letters(spark):
    asked, answered = C.Contract(("id", "text"), ("note",)), C.Contract(("out",))
    answers = {"1": {"out": "fine"}, "2": "```json\n{\"out\": \"fenced\"}\n```", "3": {"out": 5}, "4": {"out": "x", "more": "y"}, "5": ["out"], "6": {}, "7": "{", "8": {"out": " "}}
    first = lambda r: answers[r["id"]]
    second = lambda r: {"out": r["text"] + r.get("note", "")} if r["id"] != "8" else 1 / 0
    rows = [(i, "t", None if i % 2 else "n", "old", i) for i in range(1, 9)] + [(None, "t", None, "old", 9), (10, "  ", None, "old", 10), (11, "t", "n", "old", 11)]
    df = spark.createDataFrame(rows, "id long, text string, note string, level string, extra long")
    out = C.transform_rows(df, {"id": "id", "text": "text", "note": "note"}, asked, [("first", first), ("second", second)], answered)
    got = {r.extra: (r.level, r.out, r.faults) for r in out.collect()}
    assert got[1] == ("first", "fine", []) and got[2] == ("first", "fenced", [])
    assert got[3] == ("second", "t", ["first: out is no text"]) and got[4] == ("second", "tn", ["first: more is unknown"])
    assert got[5] == ("second", "t", ["first: not an object"]) and got[6] == ("second", "tn", ["first: out is missing"])
    assert got[7] == ("second", "t", ["first: JSONDecodeError"]) and got[8] == (None, None, ["first: out is blank", "second: ZeroDivisionError"])
    assert got[9] == (None, None, ["request: id is missing"]) and got[10] == (None, None, ["request: text is blank"])
    assert got[11] == ("second", "tn", ["first: KeyError"])
    assert C.accepted(out).count() == 8 and {r.extra for r in C.dead_letters(out).collect()} == {8, 9, 10}
    assert C.transform_rows(df.limit(0), {"id": "id"}, asked, [], answered).count() == 0
