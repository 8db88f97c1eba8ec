from types import SimpleNamespace

import pytest

from xylem import session


def made(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder or default), sparkContext=SimpleNamespace(master=master))


def test_only_local_sessions_make_a_folder_of_their_own():
    assert session.shared_dir(made("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert session.shared_dir(made("local[4]")).startswith("file://")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(made(master))


def test_release_removes_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_OPEN", [])
    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}")
    work = session.Workspace(spark, "w")
    assert work.save(spark.range(3)).count() == 3 and len(list(tmp_path.iterdir())) == 1
    session.release()
    assert not list(tmp_path.iterdir()) and work.released
