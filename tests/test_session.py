import os

from swayrank.session import freeze, scratch, shared_folder


def test_frozen_tables_go_with_their_scope(spark, tmp_path):
    outside = freeze(spark.range(3))
    with scratch(spark) as folder:
        inside = freeze(spark.range(5))
        local = folder.removeprefix("file:")
        assert len(os.listdir(local)) == 1 and folder.startswith(shared_folder(spark))
        inside.write.parquet(str(tmp_path / "kept"))
    assert not os.path.exists(local)
    assert outside.count() == 3 and spark.read.parquet(str(tmp_path / "kept")).count() == 5
