"""Stored states: merges rewrite what changed, repeat without effect, and lose nothing to another writer."""

import os

import pytest
from pyspark.sql import functions as F

from pagewarden.operators import approvals
from pagewarden.sources import versioned

ROWS = [(f"k{i}", "pending" if i % 3 else "auto", "R") for i in range(200)] + [(None, "pending", "R")]


@pytest.fixture
def plans(spark, tmp_path):
    path = str(tmp_path / "plans")
    approvals.store_plans(spark.createDataFrame(ROWS, "finding_key string, approval_status string, rule_id string"), path, 16)
    return path


def keys(spark, names, **columns):
    df = spark.createDataFrame([(n,) for n in names], "finding_key string")
    return df.withColumns({c: F.lit(v).cast("timestamp") if c == "applied_at" else F.lit(v) for c, v in columns.items()})


def states(spark, path, version=None):
    return {r["finding_key"]: (r["approval_status"], r["applied_at"] is not None, r["finding_status"]) for r in versioned.read(spark, path, version).collect()}


def test_approve_apply_roll_back(spark, plans):
    at = {"applied_at": "2024-02-01", "backup": "b"}
    some = ["k1", "k2", "k3", "nowhere"]
    assert len(states(spark, plans)) == 200
    assert approvals.decide(spark, plans, keys(spark, some, decision="approved"), "d1") == 1
    assert approvals.decide(spark, plans, keys(spark, ["k4"], decision="rejected"), "d2") == 2
    assert approvals.apply(spark, plans, keys(spark, [*some, "k4", "k5"], **at), "a1") == 3
    assert approvals.rollback(spark, plans, keys(spark, ["k2", "k5"]), "r1") == 4
    want = {"k1": ("approved", True, "fixed"), "k2": ("approved", False, "reverted"), "k3": ("auto", True, "fixed"), "k4": ("rejected", False, "open"), "k5": ("pending", False, "open"), "k6": ("auto", False, "open")}
    assert {k: v for k, v in states(spark, plans).items() if k in want} == want
    assert states(spark, plans, 2)["k1"] == ("approved", False, "open")
    # A job that is run again repeats nothing, and does not take the rollback back.
    before = states(spark, plans)
    assert approvals.apply(spark, plans, keys(spark, some, **at), "a1") == 4 and approvals.decide(spark, plans, keys(spark, ["k5"], decision="approved"), "d1") == 4
    assert states(spark, plans) == before
    # A second decision on the same rows changes none, so no partition is written.
    folders = versioned.manifest(spark, plans).folders
    assert approvals.decide(spark, plans, keys(spark, some, decision="rejected"), "d3") == 5
    assert versioned.manifest(spark, plans).folders == folders and states(spark, plans) == before


def test_only_partitions_that_change_are_written(spark, plans):
    before = versioned.manifest(spark, plans).folders
    approvals.decide(spark, plans, keys(spark, ["k1"], decision="approved"), "d")
    after = versioned.manifest(spark, plans).folders
    assert sum(before[p] != after[p] for p in before) == 1 and set(before) == set(after)


def test_another_writer_goes_first(spark, plans):
    """While a merge is computed another one is committed: both decisions are there at the end."""
    calls = []

    def change(old, new):
        if not calls:
            approvals.decide(spark, plans, keys(spark, ["k2"], decision="rejected"), "other")
        calls.append(1)
        from pagewarden.operators import remediation

        return remediation.decide(old, new).drop("changed")

    m = versioned.merge(spark, plans, keys(spark, ["k1", "k2"], decision="approved"), change, "mine")
    assert m.version == 2 and len(calls) == 2 and m.merges == ["other", "mine"]
    got = states(spark, plans)
    assert got["k1"][0] == "approved" and got["k2"][0] == "rejected"


def test_failed_merges_leave_the_table(spark, plans):
    before = states(spark, plans)
    with pytest.raises(ZeroDivisionError):
        versioned.merge(spark, plans, keys(spark, ["k1"]), lambda old, new: 1 / 0, "x")
    strange = keys(spark, ["k1"])
    with pytest.raises(ValueError, match="did not read"):
        versioned.merge(spark, plans, strange, lambda old, new: old.unionByName(spark.createDataFrame([(f"z{i}",) for i in range(40)], "finding_key string"), allowMissingColumns=True), "y")
    assert states(spark, plans) == before and versioned.versions(spark, plans) == [0]
    with pytest.raises(FileExistsError):
        versioned.create(keys(spark, ["a"]), plans, ["finding_key"])
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, plans + "-none")


def test_vacuum_drops_what_no_version_has(spark, plans):
    for i in range(4):
        approvals.decide(spark, plans, keys(spark, [f"k{i + 1}"], decision="approved"), f"d{i}")
    before = states(spark, plans)
    assert versioned.vacuum(spark, plans, 2) > 0
    assert versioned.versions(spark, plans) == [3, 4] and states(spark, plans) == before and len(states(spark, plans, 3)) == 200
    used = {f for v in (3, 4) for f in versioned.manifest(spark, plans, v).folders.values()}
    there = {f"data/{b}/{p}" for b in os.listdir(f"{plans}/data") for p in os.listdir(f"{plans}/data/{b}") if p.startswith("__p=")}
    assert there == used


def test_tables_without_rows_and_of_other_kinds(spark, tmp_path):
    path = str(tmp_path / "requests")
    versioned.create(spark.createDataFrame([], "id long, state string"), path, ["id"], 4)
    assert versioned.read(spark, path).count() == 0
    add = lambda old, new: old.unionByName(new.join(old.select("id"), "id", "left_anti"))
    versioned.merge(spark, path, spark.createDataFrame([(1, "open"), (2, "merged"), (3, "open")], "id long, state string"), add, "add")
    approvals.update_requests(spark, path, spark.createDataFrame([(1, "closed"), (2, "closed"), (9, "closed")], "id long, new_state string"), "close")
    assert {r["id"]: r["state"] for r in versioned.read(spark, path).collect()} == {1: "closed", 2: "merged", 3: "open"}
    assert versioned.merge(spark, path, spark.createDataFrame([], "id long, new_state string"), lambda old, new: old, "none").version == 3
