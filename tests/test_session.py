import os

from ledgerwind import session


def test_release_removes_the_tables_between_two_marks(spark):
    before = session.materialise(spark.range(3), "kept")
    since = session.written()
    gone = session.materialise(spark.range(4), "gone")
    until = session.written()
    after = session.materialise(spark.range(5), "after")
    paths = [os.path.dirname(f.inputFiles()[0].removeprefix("file://")) for f in (before, gone, after)]
    session.release(spark, since, until)
    session.release(spark, since, until)
    assert [os.path.exists(p) for p in paths] == [True, False, True]
    assert before.count() == 3 and after.count() == 5
