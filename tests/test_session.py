import pytest

from labelloom import session


def test_written_tables_are_released(spark, tmp_path):
    session.release(spark)
    df = session.written(spark.range(5), "some")
    assert df.count() == 5 and session.release(spark) == 1
    with pytest.raises(Exception):
        df.count()
    assert session.release(spark) == 0


def test_shared_folder_is_the_session_s(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
