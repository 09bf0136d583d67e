from __future__ import annotations

import pytest

from loomtext import cli
from loomtext.sources.dictionaries import Dictionaries, load


def test_convert(spark, tmp_path):
    (tmp_path / "in.txt").write_text("說“話”", encoding="utf-8")
    (tmp_path / "own.txt").write_text("甲\t乙\n", encoding="utf-8")
    args = ["convert", "-i", str(tmp_path / "in.txt"), "-o", str(tmp_path / "out"), "-c", "T2HK", "-p", "--custom", f"hk_variants:append:{tmp_path}/own.txt"]
    assert cli.main(args) == 0
    assert [f.read_text(encoding="utf-8") for f in (tmp_path / "out").iterdir()] == ["説「話」"]


def test_pages(spark, tmp_path):
    spark.createDataFrame([(1, 1, "說話說話說話，"), (1, 2, "說完了。")], "doc_id long, page_no int, text string").write.parquet(str(tmp_path / "in"))
    assert cli.main(["pages", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-c", "t2hk", "-r"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).first().text == "説話説話説話，説完了。"


def test_dictgen(tmp_path):
    assert cli.main(["dictgen", "-o", str(tmp_path / "d.json")]) == 0
    assert Dictionaries.load(tmp_path / "d.json").slots == load().slots


def test_failures(tmp_path, capsys):
    assert cli.main(["convert", "-i", "same", "-o", "same", "-c", "s2t"]) == 1
    assert "same" in capsys.readouterr().err
    assert cli.main(["dictgen", "-o", str(tmp_path / "d.xyz")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["convert", "-i", "a", "-o", "b", "-c", "nope"])
