"""Archives are judged by their directories, and experiments by their models."""

import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import runs
from gaugeworks.sources import archives


def archive(path, *names, link=(), size=10):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            info = zipfile.ZipInfo(n)
            info.external_attr = (stat.S_IFLNK if n in link else stat.S_IFREG) << 16
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, b"0" * size)
    return str(path)


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_archives(spark, tmp_path):
    paths = {
        "good": archive(tmp_path / "good.zip", "b.json", "a.csv", "other.txt"), "nested": archive(tmp_path / "nested.zip", "a.csv", "x/b.json"), "dots": archive(tmp_path / "dots.zip", "..", "a.csv"),
        "link": archive(tmp_path / "link.zip", "a.csv", "b.json", link=("b.json",)), "twice": archive(tmp_path / "twice.zip", "a.csv", "a.csv"), "lacks": archive(tmp_path / "lacks.zip", "b.json"),
        "large": archive(tmp_path / "large.zip", "a.csv", size=5000), "bomb": archive(tmp_path / "bomb.zip", "a.csv", "b.json", size=2 << 20), "many": archive(tmp_path / "many.zip", "a.csv", *(f"x{k}" for k in range(9))),
    }
    files = spark.createDataFrame([(p,) for p in paths.values()], "path string")
    rows = archives.members(files)
    assert rows.where(F.col("archive") == paths["good"]).orderBy("at").select("name", "size").collect() == [("b.json", 10), ("a.csv", 10), ("other.txt", 10)]
    judge = lambda most: {r["archive"]: r for r in archives.verdicts(rows, ["a.csv"], ["b.json"], 9, most).collect()}
    got = {k: judge(4000)[p] for k, p in paths.items()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "good": None, "nested": "unsafe_name", "dots": "unsafe_name", "link": "not_a_file", "twice": "duplicate", "lacks": "missing_fields", "large": "over_budget", "bomb": "over_budget", "many": "too_many_members",
    }
    assert (got["good"]["chosen"], got["good"]["expanded"]) == (["a.csv", "b.json"], 20) and got["lacks"]["chosen"] == []
    assert judge(1 << 30)[paths["bomb"]]["reason"] == "suspicious_ratio" and judge(1 << 30)[paths["large"]]["reason"] is None


def test_experiments(spark):
    models = spark.createDataFrame([("m-1", "0"), ("m_2", None)], "id string, gpu string")
    got = [tuple(r) for r in runs.experiment_matrix(models, "t").orderBy("model", "batch").collect()]
    assert got[:3] == [("t-m-1-blind", "m-1", "blind", "0", 0), ("t-m-1-memory", "m-1", "memory", "0", 1), ("t-m-1-oracle", "m-1", "oracle", "0", 2)] and len(got) == 6
    for rows in ([("a b", None)], [("a", None), ("a", "1")], [("a", "1"), ("b", "1")], [("a", "x")]):
        with pytest.raises(ValueError):
            runs.experiment_matrix(spark.createDataFrame(rows, "id string, gpu string"), "t")
    for tracks in ([], ["blind", "blind"], ["seeing"]):
        with pytest.raises(ValueError):
            runs.experiment_matrix(models, "t", tracks)
    with pytest.raises(ValueError):
        runs.experiment_matrix(models, "a b")
