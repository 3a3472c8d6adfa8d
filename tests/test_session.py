"""The shared folder where nothing names one."""

import types

import pytest

from cloudstrata import session


def fake(master, where=None):
    def refuse(*_):
        raise RuntimeError("the setting can't be changed")

    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, default=None: where or default, set=refuse), sparkContext=types.SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_shared_folder():
    one = session.shared_folder(fake("local[4]"))
    assert one == session.shared_folder(fake("local[4]")) and one.startswith("file:///") and one != session.shared_folder(fake("local[2]"))
    assert session.shared_folder(fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_folder(fake("yarn"))


def test_scratch(spark):
    """Folders made within are gone afterwards, also after an error; what was made before stays."""
    from cloudstrata.session import cut, new_folder
    from cloudstrata.sources.documents import exists

    before = new_folder(spark, "test")
    spark.range(2).write.parquet(before)
    with session.scratch(spark) as made:
        assert cut(spark.range(5), "test").count() == 5 and len(made) == 1 and exists(spark, made[0])
        with pytest.raises(ZeroDivisionError), session.scratch(spark) as inner:
            cut(spark.range(1), "test")
            1 / 0  # noqa: B018
        assert not exists(spark, inner[0]) and exists(spark, made[0])
    assert not exists(spark, made[0]) and exists(spark, before)
    session.drop_folder(spark, before)
