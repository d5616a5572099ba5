"""Archives are listed by tasks, in sub-folders too; the driver keeps no list of files."""

import zipfile

from kotonoha.plans import archives
from kotonoha.sources import banks


def test_archives_of_all_folders_are_read(spark, tmp_path, monkeypatch):
    for i, name in enumerate(["a.zip", "x/b.zip", "x/y/c.zip", "_hidden/d.zip", ".e.zip", "notes.txt"]):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(file, "w") as archive:
            archive.writestr(f"term_bank_{i}.json", "[]")
    # as Spark's own listing names them
    top = {r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(f"{tmp_path}/a.zip").select("path").collect()}
    got = banks.read_bank_documents(spark, str(tmp_path))
    assert "binaryFile" not in banks.archive_members(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.archive, r.title, r.name) for r in got.collect()}
    assert {r[1:] for r in rows} == {("a", "term_bank_0.json"), ("b", "term_bank_1.json"), ("c", "term_bank_2.json")}
    assert top <= {r[0] for r in rows}


def test_many_archives_share_folders(tmp_path):
    import pandas as pd

    list(archives.landing(str(tmp_path))([pd.DataFrame({"name": [f"n{i}" for i in range(4000)], "content": [b"x"] * 4000})]))
    counts = [len(list(f.iterdir())) for f in tmp_path.iterdir()]
    assert sum(counts) == 4000 and max(counts) < 40
