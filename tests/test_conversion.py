from __future__ import annotations

import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.operators import matcher
from loomtext.operators.convert import Converter, convert
from loomtext.operators.matcher import DELIMITERS, Pipeline, Round, ids_end, ids_split, is_split_sensitive, merged
from loomtext.plans.configs import CONFIGS, is_valid_config, parse_config, supported_configs
from loomtext.plans.slots import CustomSpec, Mode, Slot
from loomtext.sources.dictionaries import load

FULL = pytest.mark.skipif(not os.environ.get("LOOMTEXT_DICTS"), reason="needs the full dictionaries (LOOMTEXT_DICTS)")


def text(config, src, punctuation=False, preserve_ids=False, dicts=None):
    return Converter(config, dicts, punctuation, preserve_ids).text(src)


GOLDEN = [
    ("t2hkp", False, "別隨便錄影侵犯個人隱私權", "別隨便錄影侵犯個人私隱權"),
    ("hk2tp", False, "別隨便錄影侵犯個人私隱權", "別隨便錄影侵犯個人隱私權"),
    ("t2tw", False, "娘惹糉子", "娘惹粽子"),
    ("tw2t", False, "針核裡才吃著灶煙", "針核裡才吃著灶煙"),
    ("hk2t", False, "針核裡才吃著灶煙", "針核裡才吃著灶煙"),
    ("t2hkp", True, "但有舉出“懶惰”與“欲速”，說是小品文和短篇小說發達的原因，那卻是不夠的。", "但有舉出「懶惰」與「欲速」，説是小品文和短篇小説發達的原因，那卻是不夠的。"),
    ("t2tw", False, "喫茶小舖", "喫茶小舖"),
    ("s2t", False, "动态切换转换方式", "動態切換轉換方式"),
    ("t2s", False, "動態切換轉換方式", "动态切换转换方式"),
]


@pytest.mark.parametrize("config,punct,src,want", GOLDEN)
def test_golden(config, punct, src, want):
    if config in ("tw2t", "hk2t") and not os.environ.get("LOOMTEXT_DICTS"):
        src = want = "著灶煙" if config == "tw2t" else "灶煙"
    assert text(config, src, punct) == want


@FULL
@pytest.mark.parametrize("config,src,want", [("t2hk", "喫茶小舖", "喫茶小舖"), ("jp2t", "弁当と悪", "辨當與惡".replace("與", "と"))])
def test_golden_full(config, src, want):
    assert text(config, src) == want


def test_punctuation_of_all_families():
    assert text("s2t", "“汉”", True) == "「漢」"
    assert text("t2s", "「漢」", True) == "“汉”"
    assert text("tw2t", "“裡”", True)[0] == "「"


def test_override_of_a_slot():
    d = load().with_custom(CustomSpec(Slot.JPS_CHARACTERS_REV, Mode.OVERRIDE, pairs={"惡": "悪"}))
    assert text("t2jp", "惡德", dicts=d) == "悪德"


def naive(table, s):
    out, i = "", 0
    longest = max(map(len, table), default=0)
    while i < len(s):
        for n in range(min(longest, len(s) - i), 0, -1):
            if s[i : i + n] in table:
                out += table[s[i : i + n]]
                i += n
                break
        else:
            out += s[i]
            i += 1
    return out


def test_matcher_against_naive():
    rng = random.Random(3)
    for _ in range(300):
        abc = "abc𠀀d"
        table = {"".join(rng.choices(abc, k=rng.randint(1, 4))): "".join(rng.choices("xyz", k=rng.randint(0, 3))) for _ in range(rng.randint(1, 12))}
        s = "".join(rng.choices(abc + "e", k=rng.randint(0, 30)))
        assert Round(merged([table])).apply(s) == naive(table, s)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="說臺裏麪線隱私權諾蘭·羅得島州“”，。A1\n", max_size=60))
def test_native_form_tokens(s):
    import re

    from loomtext.operators.convert import token_pattern

    table = merged([load()[x] for x in CONFIGS["t2hkp"].plan()[0]])
    assert "".join(table.get(x, x) for x in re.findall(token_pattern(table), s)) == Round(table).apply(s)


def test_native_and_arrow_agree(spark):
    rng = random.Random(5)
    keys = list(merged([load()[x] for x in CONFIGS["t2hkp"].plan()[0]]))
    docs = ["".join(rng.choices([*keys, "天", "地", "，", "\n", "𠀀"], k=20)) for _ in range(200)] + ["", None]
    df = spark.createDataFrame([(d,) for d in docs], "s string")
    got = df.select(convert("s", "t2hkp").alias("a"), convert("s", "t2hkp", native=True).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert [r.a for r in got] == [text("t2hkp", d) for d in docs]


def test_precedence_is_length_then_order():
    assert merged([{"ab": "1"}, {"ab": "2", "abc": "3"}]) == {"ab": "1", "abc": "3"}
    assert Round(merged([{"ab": "1"}, {"abc": "3"}])).apply("abcab") == "31"


def test_identity_phrases_shield():
    assert Round(merged([{"ab": "ab"}, {"a": "x"}])).apply("aba") == "abx"


def test_long_keys_never_match():
    assert merged([{"x" * 65: "y", "x" * 64: "z"}]) == {"x" * 64: "z"}


def test_empty_value_deletes(spark):
    d = load().with_custom(CustomSpec(Slot.TW_VARIANTS, pairs={"甲": None}))
    assert text("t2tw", "甲乙", dicts=d) == "乙"
    df = spark.createDataFrame([("甲乙",)], "s string")
    d = load().with_custom(CustomSpec(Slot.JPS_CHARACTERS_REV, Mode.OVERRIDE, pairs={"甲": None, "乙": "丙"}))
    assert df.select(convert("s", "t2jp", dicts=d).alias("o")).first().o == "丙"


def test_delimiter_keys_change_only_long_texts():
    table = merged([{"a,b": "X", "c": "d"}])
    assert is_split_sensitive(table) and not is_split_sensitive({"a,": "x"}) and is_split_sensitive({",": "x"})
    assert Round(table).apply("a,bc") == "Xd"
    assert Round(table).apply("a,bc" * 3000) == "a,bd" * 3000


def test_delimiters():
    assert len(DELIMITERS) == 92 and not set("`“”‘’「」『』·‧・") & set(DELIMITERS)


@pytest.mark.parametrize("s,end", [("⿰氵漢", 3), ("⿰氵", -1), ("⿱艹⿰日月x", 5), ("⿾漢", 2), ("⿲一二三", 4), ("⿰𠀀漢", 2), ("漢", 1)])
def test_ids_end(s, end):
    assert ids_end(s, 0) == end


def test_ids_are_kept():
    assert text("t2s", "⿰氵漢") == "⿰氵汉"
    assert text("t2s", "⿰氵漢", preserve_ids=True) == "⿰氵漢"
    assert text("t2s", "漢語⿰氵漢（漢）", preserve_ids=True) == "汉语⿰氵漢（汉）"
    assert text("t2s", "漢⿰", preserve_ids=True) == "汉⿰"
    assert [p for _, p in ids_split("a⿰bc⿰d")] == ["a", "⿰bc", "⿰d"]


def test_deep_ids_are_no_sequence():
    assert ids_end("⿾" * 16 + "漢", 0) == 17
    assert ids_end("⿾" * 17 + "漢", 0) == -1


def test_configs():
    assert len(supported_configs()) == 20 and is_valid_config(" S2TWP ") and not is_valid_config("x") and not is_valid_config(None)
    with pytest.raises(ValueError):
        parse_config("nope")
    c = Converter.create("nope")
    assert c.config == "s2t" and "nope" in c.last_error
    assert Converter.create("t2s").with_config("s2hk").config == "s2hk"
    assert CONFIGS["s2twp"].plan(True) == [("st_phrases", "st_characters", "st_punctuations"), ("tw_phrases", "tw_variants_phrases", "tw_variants")]
    assert CONFIGS["tw2t"].plan(True)[1] == ("st_punctuations",)


def test_custom_replaces_earlier_custom():
    a = Converter.create("t2tw").with_custom(CustomSpec(Slot.TW_VARIANTS, pairs={"甲": "乙"}))
    b = a.with_custom(CustomSpec(Slot.TW_VARIANTS, pairs={"丙": "丁"}))
    assert a.text("甲丙") == "乙丙" and b.text("甲丙") == "甲丁"


def test_frozen():
    with pytest.raises(AttributeError):
        Converter().config = "t2s"
    with pytest.raises(TypeError):
        load()["tw_variants"]["甲"] = "乙"


def test_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("臺",)], "s string")
    assert [r.o for r in df.select(convert("s", "t2hkp").alias("o")).collect()] == [None, "", "台"]
    assert [r.o for r in df.select(convert("s", "t2hkp", null_as_empty=True).alias("o")).collect()] == ["", "", "台"]


def test_scalar_rounds_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("惡",)], "s string")
    d = load().with_custom(CustomSpec(Slot.JPS_CHARACTERS_REV, pairs={"惡": "悪"}))
    plan = df.select(convert("s", "t2jp", dicts=d))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "translate" in plan


def test_units():
    assert matcher.units("a𠀾") == 3


def test_pipeline_rounds_chain():
    assert Pipeline([{"a": "b"}, {"b": "c"}])("ab") == "cc"


def test_texts_together():
    """Texts that go through the rounds together come out as each alone; one holds what stands between them."""
    r = random.Random(9)
    alphabet = "abcd漢字國學𠀾𬴂，。 "
    for _ in range(300):
        table = {"".join(r.choice(alphabet[:10]) for _ in range(r.choice([1, 1, 2, 3, 4]))): "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 1, 1, 2]))) for _ in range(6)}
        plan = Pipeline([merged([table]), merged([{v: k for k, v in table.items() if v}])])
        texts = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 3, 70, 200]))) for _ in range(6)] + [None, "", matcher.BETWEEN * r.randint(0, 1)]

        def plain(text):
            for table in (x.table for x in plan.rounds):
                out, i = [], 0
                while i < len(text):
                    size = next((n for n in range(4, 0, -1) if text[i : i + n] in table and i + n <= len(text)), 0)
                    out.append(table[text[i : i + size]] if size else text[i])
                    i += size or 1
                text = "".join(out)
            return text

        assert plan.all(texts) == [x if x is None else plain(x) for x in texts] == [plan(x) for x in texts]


def test_char_class():
    for chars in ("abcx-z]^[", DELIMITERS, "a", "漢-字"):
        assert set(re.findall(f"[{matcher.char_class(chars)}]", "".join(map(chr, range(0x10000))) + "𠀾")) == set(chars)
