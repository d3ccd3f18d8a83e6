"""Intermediate tables need a shared folder."""

import pytest

from tricklake.sources import folders


class Session:
    """A session without any folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:  # noqa: N801
        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Context:
                    @staticmethod
                    def getCheckpointDir():
                        class Option:
                            @staticmethod
                            def isDefined():
                                return False

                        return Option

                return Context


def test_without_a_shared_folder_nothing_is_written():
    with pytest.raises(ValueError):
        folders.shared_folder(Session, "x")


def test_folders_are_new_and_can_be_removed(spark):
    a, b = folders.shared_folder(spark, "x"), folders.shared_folder(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))
    spark.range(3).write.parquet(a)
    assert spark.read.parquet(a).count() == 3
    folders.remove(spark, a)
    with pytest.raises(Exception):
        spark.read.parquet(a).count()
    folders.remove(spark, b)  # not there: nothing happens
