"""File sources."""

import json

import pytest

from terrano.sources import files


def test_csv_and_ids(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name\n1,"x, ""y"""\n2,\n2,z\nq,z\n', encoding="utf-8")
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "name"] and df.first()["name"] == 'x, "y"'
    assert sorted(r[0] for r in files.read_ids(spark, str(tmp_path / "a.csv")).collect()) == [1, 2]
    with pytest.raises(ValueError):
        files.require(df, ["id", "web"])


def test_captures(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"url": "u", "props": [{"titulo": " ", "title": "T"}, {"titulo": "B"}]}))
    (tmp_path / "a.metadata.json").write_text(json.dumps({"url": "m", "props": [{"titulo": "no"}]}))
    got = files.read_captures(spark, str(tmp_path)).select("source_url", "pos", files.first_of("prop", "titulo", "title")).collect()
    assert sorted(map(tuple, got)) == [("u", 0, "T"), ("u", 1, "B")]
