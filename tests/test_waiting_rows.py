"""Rows that wait lie in the order of their key, and only files that may hold a batch's keys are looked at."""

import pytest

from retail_spark.schemas import PRIMARY_KEYS, STORE_SCHEMAS
from retail_spark.sources import store
from retail_spark.sources.snapshots import Snapshot


@pytest.fixture
def held(spark, tmp_path, monkeypatch):
    fields = STORE_SCHEMAS["reviews"].fieldNames()
    draft = store.open_store(spark, str(tmp_path))
    looked = []
    read = Snapshot.read

    def noted(self, table, column=None, wanted=None):
        looked.append(len([f for f in self.files.get(table, ()) if wanted is None or f.may_hold(column, wanted)]))
        return read(self, table, column, wanted)

    def hold(*keys):
        rows = [tuple(k if f == PRIMARY_KEYS["reviews"] else "p1" if f == "product_id" else None for f in fields) for k in keys]
        monkeypatch.setattr(Snapshot, "read", noted)
        looked.clear()
        store.hold_back(draft, "reviews", spark.createDataFrame(rows, STORE_SCHEMAS["reviews"]))
        monkeypatch.setattr(Snapshot, "read", read)
        waiting = store.waiting_rows(draft, "reviews").select("review_id").collect()
        return sorted((r[0] or "" for r in waiting)), list(looked)

    return hold


def test_only_files_with_the_keys_are_looked_at(held):
    assert held("a1", "a2", "a2") == (["a1", "a2"], [])
    assert held("b1", "b2") == (["a1", "a2", "b1", "b2"], [0])
    waiting, (files,) = held("a2", "a3")
    assert waiting == ["a1", "a2", "a3", "b1", "b2"] and files > 0


def test_rows_without_a_key_wait_once(held):
    assert held(None, None)[0] == [""]
    assert held("a1")[0] == ["", "a1"]
    assert held(None, "a1", "a2")[0] == ["", "a1", "a2"]


def test_a_table_without_files_is_known_to_be_empty(spark, tmp_path):
    plan = store.open_store(spark, str(tmp_path)).read("orders")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("LocalRelation <empty>")
