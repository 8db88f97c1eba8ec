"""Node tables take many times their files' size in memory: no join may broadcast one, however small its files."""

import pytest

import __spark_entry__
from xylem.session import Workspace
from xylem.sources import corpora

SF = "/root/testdata/sf0.001"
QUERIES = ["edit_copy", "json", "edit_insert", "canonical_exclusive", "test_node", "serialize", "edit_remove", "edit_remove_attribute", "edit_remove_children", "edit_prepend", "canonical_inclusive_prefixes", "namespace_of_element", "edit_set_text"]


@pytest.mark.parametrize("name", QUERIES)
def test_no_broadcast(spark, name, monkeypatch):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"  # far above these tables
    for corpus in ("orders", "parts", "notes"):
        corpora.shredded(spark, SF, corpus)
    save, frames = Workspace.save, []
    monkeypatch.setattr(Workspace, "save", lambda self, df, *name: (frames.append(df), save(self, df, *name))[1])
    frames.append(__spark_entry__.queries()[name](spark, SF))
    assert not [p for p in (f._jdf.queryExecution().executedPlan().toString() for f in frames) if "Broadcast" in p]
