import pytest

from cohesia.sources import readers


def test_points_and_labels(spark, tmp_path):
    (tmp_path / "a.data").write_text("  1.0e+00 2\n3 4\n\n5\t6\n")
    (tmp_path / "a.labels0").write_text("1\n2\n\n2\n")
    got = {r["row_id"]: (r["x"], r["label"]) for r in readers.read_points(spark, str(tmp_path / "a.data"), str(tmp_path / "a.labels0")).collect()}
    assert got == {0: ([1.0, 2.0], 1), 1: ([3.0, 4.0], 2), 2: ([5.0, 6.0], 2)}
    (tmp_path / "a.labels0").write_text("1\n2\n")
    with pytest.raises(Exception, match="different numbers"):
        readers.read_points(spark, str(tmp_path / "a.data"), str(tmp_path / "a.labels0")).collect()


def test_arff_and_csv(spark, tmp_path):
    (tmp_path / "a.arff").write_text("@RELATION a\n% note\n@ATTRIBUTE x REAL\n@ATTRIBUTE CLASS {2,10}\n@DATA\n1.5,2\n2.5,10\n\n3.5,2\n")
    got = {r["row_id"]: (r["x"], r["label"]) for r in readers.read_arff(spark, str(tmp_path / "a.arff")).collect()}
    assert got == {0: ([1.5], 1), 1: ([2.5], 0), 2: ([3.5], 1)}
    (tmp_path / "a.csv").write_text("1,2,0\n3,4,1\n")
    assert {tuple(r["x"]): r["label"] for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()} == {(1.0, 2.0): 0, (3.0, 4.0): 1}
