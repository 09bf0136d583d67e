"""Every query against its DuckDB counterpart on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import rows_of

from loomtext import queries as Q
from loomtext.plans import corpus


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = Q.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got)
    if name in Q.ORACLES:
        want = duck.sql(Q.ORACLES[name]()).df()
        assert set(got.columns) == set(want.columns)
        assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", ["convert_s2t", "convert_t2s", "convert_t2tw", "convert_tw2t", "convert_t2hk", "convert_hk2t", "convert_t2hkp", "convert_hk2tp", "convert_t2twp", "convert_t2tw_punct"])
def test_conversion_changes_something(spark, sf_dir, name):
    from loomtext.plans import corpus

    config = name.split("_")[1]
    src = corpus.phrase_corpus(spark, sf_dir, Q._keys(config))
    out = Q.QUERIES[name](spark, sf_dir)
    assert src.join(out, "doc_id").where("src <> out").count() > 0


@pytest.mark.parametrize("name,src,want", [("t2jp", "惡", "悪"), ("jp2t", "弁護士", "辯護士"), ("t2twp", "鼠標", "滑鼠"), ("tw2tp", "滑鼠", "鼠標"), ("s2twp", "鼠標", "滑鼠"), ("tw2sp", "滑鼠", "鼠标")])
def test_configs_of_empty_slots_run_on_seeds(spark, sf_dir, name, src, want):
    rows = corpus.phrase_corpus(spark, sf_dir, Q._keys(name)).join(Q.QUERIES[f"convert_{name}"](spark, sf_dir), "doc_id")
    hit = rows.where(rows.src.contains(src)).collect()
    assert hit and all(want[0] in r.out for r in hit)
    assert rows.where("src <> out").count() > 0


@pytest.mark.parametrize("name", ["t2jp", "jp2t"])
def test_japanese_without_characters_is_an_error(spark, name):
    from loomtext.operators.convert import convert
    from loomtext.sources.dictionaries import Dictionaries

    with pytest.raises(ValueError, match="is empty"):
        convert("s", name, dicts=Dictionaries({}))


def test_ids_of_whole_texts(spark, tmp_path):
    """Characters and sequences behind the twentieth character count."""
    from loomtext.operators.convert import Converter
    from loomtext.operators.matcher import ids_split

    texts = ["", "x" * 19, "-" * 30 + "e h ⿰氵漢 漢 ⿱艹⿰日月 " * 3 + "⿱艹", "m" * 5000 + "⿲木木木e", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    src = {r.doc_id: r.src for r in corpus.letter_corpus(spark, str(tmp_path)).collect()}
    convert = Converter("t2s", preserve_ids=True).text
    got = {r.doc_id: (r.out, r.n_parts) for r in Q.QUERIES["convert_ids"](spark, str(tmp_path)).collect()}
    whole = {i: s if s is None else f"⿰氵漢{s}（⿱艹⿰日月）漢⿰" for i, s in src.items()}
    assert {i: x[0] for i, x in got.items()} == {i: convert(t) for i, t in whole.items()}
    assert {i: x[1] for i, x in got.items() if whole[i]} == {i: len(ids_split(t)) for i, t in whole.items() if t}


def test_partition_count_does_not_matter(spark, sf_dir):
    from loomtext.operators.convert import convert
    from loomtext.plans import corpus

    docs = corpus.phrase_corpus(spark, sf_dir, Q._keys("t2hkp"))
    one, many = (docs.repartition(n).select("doc_id", convert("src", "t2hkp").alias("o")).toPandas() for n in (1, 13))
    assert rows_of(one) == rows_of(many)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "convert_t2hkp" in e.queries()
