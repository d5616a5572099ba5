"""Archives are written member by member."""

import zipfile

import pandas as pd

from kotonoha.plans import archives


def test_archives_are_written_batch_by_batch(tmp_path):
    rows = [(f"d{i // 1000}", f"term_bank_{i:06d}.json", f'[["{i}か"]]' * (i % 7)) for i in range(3000)]
    batches = (pd.DataFrame(rows[i : i + 70], columns=["title", "name", "text"]) for i in range(0, len(rows), 70))
    names = pd.concat(archives.landing_members(str(tmp_path))(archives.deflated(batches)))["name"]
    assert list(names) == ["d0", "d1", "d2"]
    for title in names:
        with zipfile.ZipFile(tmp_path / f"{title}.zip") as archive:
            assert archive.testzip() is None
            got = [(title, n, archive.read(n).decode()) for n in archive.namelist()]
        assert got[:-2] == [r for r in rows if r[0] == title]
        assert got[-2:] == [(title, "index.json", f'{{"title": "{title}"}}'), (title, "notes.txt", "not a bank")]


def test_more_members_than_a_plain_end_record_counts(tmp_path):
    many = pd.DataFrame({"title": "d", "name": [f"term_bank_{i}.json" for i in range(70_000)], "text": "[]"})
    list(archives.landing_members(str(tmp_path))(archives.deflated([many])))
    with zipfile.ZipFile(tmp_path / "d.zip") as archive:
        assert len(archive.namelist()) == 70_002
