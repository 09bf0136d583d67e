"""The engine's operators as queries over the test tables, with DuckDB counterparts where SQL can express them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from .functions import tables
from .operators import convert as C
from .operators import detect, detofu, dictbuild, normalize, office, reflow, segment
from .operators.pipeline import convert_pipeline, page_pipeline
from .plans import corpus, oracle
from .plans.configs import CONFIGS, supported_configs
from .plans.slots import CustomSpec, Mode, Slot
from .sources import text as text_source
from .sources.dictionaries import Dictionaries, decode_surrogate_pairs, load

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def query(name: str, sql: Callable[[], str] | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


# ---- conversions


#: Stand in for slots that would leave a config's text as it is while no directory fills them.
_SEEDS = {
    Slot.JPS_CHARACTERS_REV: tables.pairs("惡 悪|國 国|學 学|櫻 桜|澤 沢|邊 辺|廣 広|氣 気|德 徳|辨 弁|辯 弁|當 当"),
    Slot.JPS_CHARACTERS: tables.pairs("悪 惡|国 國|学 學|桜 櫻|沢 澤|辺 邊|広 廣|気 氣|徳 德|弁 辨|当 當"),
    Slot.JPS_PHRASES: tables.pairs("弁護士 辯護士|弁論 辯論"),
    Slot.TW_PHRASES: tables.pairs("鼠標 滑鼠|硬盤 硬碟|軟件 軟體|操作系統 作業系統|文件夾 資料夾"),
    Slot.TW_PHRASES_REV: tables.pairs("滑鼠 鼠標|硬碟 硬盤|軟體 軟件|作業系統 操作系統|資料夾 文件夾"),
}


def _given() -> Dictionaries:
    """What is loaded, with seeds in the slots that it leaves empty."""
    own = load()
    return own.with_custom(*[CustomSpec(slot, pairs=pairs) for slot, pairs in _SEEDS.items() if not own[slot]])


def _keys(config: str, dicts: Dictionaries | None = None) -> list[str]:
    """Keys of all rounds, each once, with some plain text between."""
    found = {k for table in C.rounds_of(config, True, dicts or _given()) for k in table}
    return corpus.phrase_keys(found | {"天地玄黃", "春眠不覺曉", "OK"})


def _conversion(config: str, punctuation: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = corpus.phrase_corpus(spark, sf_dir, _keys(config))
        return docs.select("doc_id", C.convert("src", config, punctuation, dicts=_given()).alias("out"))

    def sql() -> str:
        return f"SELECT doc_id, {oracle.rounds_sql('src', C.rounds_of(config, punctuation, _given()))} AS out FROM ({corpus.phrase_sql(_keys(config))})"

    query(f"convert_{config}" + "_punct" * punctuation, sql)(run)


for _config in CONFIGS:
    _conversion(_config, False)
    _conversion(_config, True)


@query("convert_native_t2twp", lambda: ORACLES["convert_t2twp"]())
def _native(spark, sf_dir):
    docs = corpus.phrase_corpus(spark, sf_dir, _keys("t2twp"))
    return docs.select("doc_id", C.convert("src", "t2twp", dicts=_given(), native=True).alias("out"))


_CUSTOM = (CustomSpec(Slot.TW_VARIANTS, Mode.APPEND, pairs={"春眠": "早晨", "玄": "元"}), CustomSpec(Slot.TW_VARIANTS_PHRASES, Mode.OVERRIDE, pairs={"天地": "乾坤"}))


@query("custom_instance", lambda: f"SELECT doc_id, {oracle.rounds_sql('src', C.rounds_of('t2tw', False, load().with_custom(*_CUSTOM)))} AS out FROM ({corpus.phrase_sql(_keys('t2tw'))})")
def _custom(spark, sf_dir):
    converter = C.Converter.create("t2tw").with_custom(*_CUSTOM)
    return corpus.phrase_corpus(spark, sf_dir, _keys("t2tw")).select("doc_id", converter.column("src").alias("out"))


@query("convert_sql_function", lambda: ORACLES["convert_t2hkp"]())
def _registered(spark, sf_dir):
    C.register(spark)
    corpus.phrase_corpus(spark, sf_dir, _keys("t2hkp")).createOrReplaceTempView("loom_docs")
    return spark.sql("SELECT doc_id, loom_t2hkp(src) AS out FROM loom_docs")


def _ids_text():
    return F.concat(F.lit("⿰氵漢"), F.col("src"), F.lit("（⿱艹⿰日月）漢⿰"))


#: Rows of an Arrow batch of whole texts, which lies in the JVM and in Python with its parts at the same time.
_BATCH_ROWS = 500


def _ids_sql() -> str:
    rounds = C.rounds_of("t2s")
    around = lambda x: oracle.rounds_sql(x, rounds)
    return f"SELECT doc_id, '⿰氵漢' || {around("(src || '（')")} || '⿱艹⿰日月' || {around("'）漢⿰'")} AS out, CASE WHEN src IS NOT NULL THEN CAST(4 AS INT) END AS n_parts FROM ({corpus.letter_sql()})"


@query("convert_ids", _ids_sql)
def _ids(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= _BATCH_ROWS:
        spark.conf.set(key, str(_BATCH_ROWS))
    docs = corpus.letter_corpus(spark, sf_dir)
    return docs.select("doc_id", C.convert(_ids_text(), "t2s", preserve_ids=True).alias("out"), F.size(segment.ids_parts(_ids_text())).alias("n_parts"))


@query("supported_configs", lambda: "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(supported_configs())) + ") AS t(id, config)")
def _configs(spark, sf_dir):
    return C.configs_table(spark)


# ---- detection and single characters


def _letters(expr: str, table: str = "documents") -> str:
    return f"SELECT doc_id, {expr} FROM ({corpus.letter_sql(table)})"


@query("st_chars", lambda: _letters(f"{oracle.translate('src', detect.st_table())} AS out"))
def _st(spark, sf_dir):
    return corpus.letter_corpus(spark, sf_dir).select("doc_id", detect.st(F.col("src")).alias("out"))


@query("ts_chars", lambda: _letters(f"{oracle.translate('src', detect.ts_table())} AS out"))
def _ts(spark, sf_dir):
    return corpus.letter_corpus(spark, sf_dir).select("doc_id", detect.ts(F.col("src")).alias("out"))


@query("conversion_changes_text", lambda: _letters(f"{oracle.translate('src', detect.ts_table())} <> src AS changed"))
def _changes(spark, sf_dir):
    return corpus.letter_corpus(spark, sf_dir).select("doc_id", detect.conversion_changes_text(F.col("src"), detect.ts(F.col("src"))).alias("changed"))


def _zho_sql() -> str:
    pattern = "[!-/:-@\\[-`{-~\\t\\n\\x0B\\f\\r 0-9A-Za-z_著]"
    # the corpus holds single-character graphemes, and the clamp is taken in units
    cut = f"CASE WHEN {oracle.units_sql('left(src, 500)')} <= 500 THEN left(src, 500) ELSE array_to_string(list_transform(list_filter(range(1, 501), lambda i: {oracle.units_sql('src[1:i]')} <= 500), lambda i: src[i]), '') END"
    head = f"left(regexp_replace({cut}, {oracle.text(pattern)}, '', 'g'), 100)"
    return f"SELECT doc_id, CASE WHEN {oracle.translate('h', detect.ts_table())} <> h THEN 1 WHEN {oracle.translate('h', detect.st_table())} <> h THEN 2 ELSE 0 END AS kind FROM (SELECT doc_id, {head} AS h FROM ({corpus.letter_sql('conversations')}))"


@query("zho_check", _zho_sql)
def _zho(spark, sf_dir):
    return corpus.letter_corpus(spark, sf_dir, "conversations").select("doc_id", detect.zho_check(F.col("src")).alias("kind"))


# ---- normalisation and fallbacks


def _table_query(name: str, table: Callable[[], dict[str, str]], column) -> None:
    query(name, lambda: _letters(f"{oracle.translate('src', table())} AS out"))(lambda spark, sf_dir: corpus.letter_corpus(spark, sf_dir).select("doc_id", column(F.col("src")).alias("out")))


_USER_COMPAT = "\uf900\t其\n\uf901\t改\n"
_table_query("normalize_compat", normalize.compat_table, normalize.normalize_compat)
_table_query("normalize_unicode_compat", normalize.extended_table, normalize.normalize_unicode_compat)
_table_query("normalize_compat_extended", normalize.full_table, lambda c: normalize.normalize_compat(c, extended=True))
_table_query("normalize_user_table", lambda: normalize.compat_from_text(_USER_COMPAT), lambda c: normalize.normalize_compat(c, table=normalize.compat_from_text(_USER_COMPAT)))
_PAIRS = {"台": "臺", "𠀾": "亮"}
for _level in detofu.Level:
    _table_query(f"detofu_ext_{_level.name.lower()}", lambda x=_level: dict(detofu.DeTofu.builtin(x).table), lambda c, x=_level: detofu.detofu(c, x))
_table_query("detofu_custom_pairs", lambda: dict(detofu.DeTofu.builtin("all").with_pairs(_PAIRS).table), lambda c: detofu.detofu(c, "all", _PAIRS))
_TOFU_TEXT = "𬴂\t骑\tE\n𠀾\t亮\tB\n"
_table_query("detofu_custom_file", lambda: dict(detofu.DeTofu.builtin("ext-c").with_text(_TOFU_TEXT).table), lambda c: detofu.DeTofu.builtin("ext-c").with_text(_TOFU_TEXT).column(c))


@query("normalize_scalar", lambda: f"SELECT doc_id, {oracle.translate('src[1]', normalize.compat_table())} AS out FROM ({corpus.letter_sql()}) WHERE length(src) > 0")
def _scalar(spark, sf_dir):
    return corpus.letter_corpus(spark, sf_dir).where("length(src) > 0").select("doc_id", normalize.normalize_scalar(F.substring("src", 1, 1)).alias("out"))


def _pipeline_sql() -> str:
    expr = oracle.translate("src", normalize.full_table())
    expr = oracle.rounds_sql(expr, C.rounds_of("t2hk", True))
    return _letters(f"{oracle.translate(expr, dict(detofu.DeTofu.builtin('all').table))} AS out")


@query("pipeline_norm_convert_detofu", _pipeline_sql)
def _pipeline(spark, sf_dir):
    docs = corpus.letter_corpus(spark, sf_dir)
    return docs.select("doc_id", convert_pipeline(F.col("src"), "t2hk", punctuation=True, norm_compat=True, extended=True, tofu="all").alias("out"))


# ---- dictionaries as tables


def _dicts(spark):
    return load().to_df(spark)


def _meta_sql(rows: str) -> str:
    size = oracle.units_sql("key")
    return f"""SELECT slot, CAST(min(n) AS INT) AS min_len, CAST(max(n) AS INT) AS max_len, coalesce(bit_or(CASE WHEN n <= 64 THEN 1::BIGINT << (n - 1) END), 0) AS len_mask, count(*) AS n_keys
    FROM (SELECT slot, CAST({size} AS INT) AS n FROM {rows}) GROUP BY slot"""


@query("dict_metadata", lambda: _meta_sql(oracle.dict_rows(load().slots)))
def _metadata(spark, sf_dir):
    return dictbuild.metadata(_dicts(spark)).select("slot", "min_len", "max_len", "len_mask", "n_keys")


def _starter_sql(keys: str) -> str:
    return f"SELECT {keys}key[1] AS starter, bit_or(1::BIGINT << (CAST({oracle.units_sql('key')} AS INT) - 1)) AS mask, CAST(max({oracle.units_sql('key')}) AS INT) AS max_len FROM {oracle.dict_rows(load().slots)} GROUP BY ALL"


@query("dict_starters", lambda: _starter_sql("slot, "))
def _starters(spark, sf_dir):
    return dictbuild.starters(_dicts(spark))


@query("starter_union", lambda: _starter_sql(""))
def _starter_union(spark, sf_dir):
    return dictbuild.starters(_dicts(spark), by_slot=False)


_MORE = {"tw_variants": {"臺": "台", "祕": "密", "𠀾": "亮"}}


def _more(spark):
    return spark.createDataFrame([(s, k, v, i) for s, own in _MORE.items() for i, (k, v) in enumerate(own.items())], "slot string, key string, value string, ord long")


@query(
    "dict_append_late_wins",
    lambda: f"SELECT slot, key, arg_max(value, t) AS value FROM (SELECT slot, key, value, 0 AS t FROM {oracle.dict_rows(load().slots)} UNION ALL SELECT slot, key, value, 1 FROM {oracle.dict_rows(_MORE)}) GROUP BY slot, key",
)
def _append(spark, sf_dir):
    return dictbuild.append(_dicts(spark), _more(spark)).select("slot", "key", "value")


@query("dict_override_slot", lambda: f"SELECT slot, key, value FROM {oracle.dict_rows(load().slots)} WHERE slot <> 'tw_variants' UNION ALL SELECT slot, key, value FROM {oracle.dict_rows(_MORE)}")
def _override(spark, sf_dir):
    return dictbuild.override(_dicts(spark), _more(spark)).select("slot", "key", "value")


_ROUND = ["hk_phrases", "tw_variants", "hk_variants"]


@query("dict_merge_round", lambda: f"SELECT key, arg_min(value, list_position(['hk_phrases', 'tw_variants', 'hk_variants'], slot)) AS value FROM {oracle.dict_rows(load().slots)} WHERE slot IN ('hk_phrases', 'tw_variants', 'hk_variants') GROUP BY key")
def _merge(spark, sf_dir):
    return dictbuild.merge(_dicts(spark), _ROUND)


@query("dict_json_roundtrip", lambda: f"SELECT slot, key, value FROM {oracle.dict_rows(load().slots)}")
def _json(spark, sf_dir):
    return dictbuild.from_json(dictbuild.to_json(_dicts(spark))).select("slot", "key", "value")


@query("dict_forms_roundtrip", lambda: f"SELECT form, slot, key, value FROM (SELECT unnest(['json', 'zstd', 'cbor']) AS form) CROSS JOIN {oracle.dict_rows(load().slots)}")
def _forms(spark, sf_dir):
    own = load()
    forms = {"json": Dictionaries.from_json(own.to_json()), "zstd": Dictionaries.from_zstd(own.to_zstd()), "cbor": Dictionaries.from_cbor(own.to_cbor())}
    parts = [d.to_df(spark).select(F.lit(f).alias("form"), "slot", "key", "value") for f, d in forms.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Escapes that are no pair, in whole texts after their pairs.
_LONE = "\\uD842x\\u4e00\\uDC00\\uD842\\u0041\\ud8"


@query("decode_json_surrogates", lambda: f"SELECT doc_id, src || {oracle.text(_LONE)} AS out FROM ({corpus.letter_sql('conversations')})")
def _surrogates(spark, sf_dir):
    @arrow_udf("string")
    def decode(a: pa.Array) -> pa.Array:
        return pa.array([x if x is None else decode_surrogate_pairs(x) for x in a.to_pylist()], pa.string())

    src = F.col("src")
    for c in filter(lambda c: c > "\uffff", corpus.LETTERS):
        high, low = divmod(ord(c) - 0x10000, 0x400)
        src = F.replace(src, F.lit(c), F.lit(f"\\u{0xD800 + high:04X}\\u{0xDC00 + low:04x}"))
    docs = corpus.letter_corpus(spark, sf_dir, "conversations")
    return docs.select("doc_id", decode(F.concat(src, F.lit(_LONE))).alias("out"))


# ---- segments


def _segments(name: str, inclusive: bool) -> None:
    sql = lambda: f"SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS pos, unnest(s) AS segment FROM (SELECT doc_id, {oracle.segments_sql('src', inclusive)} AS s FROM ({corpus.letter_sql()}))"
    query(name, sql)(lambda spark, sf_dir: segment.segments(corpus.letter_corpus(spark, sf_dir), "src", inclusive))


_segments("split_inclusive", True)
_segments("split_exclusive", False)


@query("segment_ranges", lambda: f"SELECT doc_id, CAST(len(s) AS INT) AS n, CAST(list_sum(list_transform(s, lambda x: {oracle.units_sql('x')})) AS INT) AS units FROM (SELECT doc_id, {oracle.segments_sql('src', True)} AS s FROM ({corpus.letter_sql('conversations')}))")
def _ranges(spark, sf_dir):
    docs = corpus.letter_corpus(spark, sf_dir, "conversations").withColumn("r", segment.segment_ranges(F.col("src")))
    end = F.try_element_at("r", F.lit(-1))
    return docs.select("doc_id", F.size("r").alias("n"), (end["start"] + end["length"]).alias("units"))


# ---- pages and paragraphs

_LINE_KEYS = ["書名", "作者", "譯者", "ISBN", "無關", "出版社", "系列"]
_LINE_SEPS = ["：", ":", "　", "-", "·"]
_LINE_VALUES = ["紅樓夢", "“引文”", "", " 曹雪芹", "一二三四五六七八九十一二三四五六七八九十一二三四五六七八九十"]


def _pick(values, key: str, step: int):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) * step % len(values) + 1).cast("int"))


def _pick_sql(values, key: str, step: int) -> str:
    return "[" + ", ".join(map(oracle.text, values)) + f"][CAST({key} * {step} % {len(values)} + 1 AS INT)]"


def _metadata_sql() -> str:
    key, sep, value = (_pick_sql(v, "o_orderkey", s) for v, s in ((_LINE_KEYS, 3), (_LINE_SEPS, 7), (_LINE_VALUES, 11)))
    known = ", ".join(oracle.text(k) for k in sorted(tables.METADATA_KEYS))
    return f"""SELECT o_orderkey, line, CASE WHEN {oracle.units_sql('line')} <= 30 AND sep <> '-' AND trim(value) <> '' AND NOT starts_with(trim(value), '“') AND key IN ({known}) THEN key END AS meta_key
    FROM (SELECT o_orderkey, {key} AS key, {sep} AS sep, {value} AS value, {key} || {sep} || {value} AS line FROM orders)"""


@query("metadata_lines", _metadata_sql)
def _metadata_lines(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat(_pick(_LINE_KEYS, "o_orderkey", 3), _pick(_LINE_SEPS, "o_orderkey", 7), _pick(_LINE_VALUES, "o_orderkey", 11)).alias("line"))
    return rows.select("o_orderkey", "line", reflow.metadata_key(F.col("line")).alias("meta_key"))


_DIVIDERS = ["-----", "===", "--", "★ ☆ *", "─━┃", "-*-", "文---", "～～～～"]


@query("visual_dividers", lambda: f"SELECT o_orderkey, regexp_matches(replace({_pick_sql(_DIVIDERS, 'o_orderkey', 5)}, ' ', ''), '^(?:[\\x{{2500}}-\\x{{257F}}]{{3,}}|[-=_~～]{{3,}}|[*＊★☆]{{3,}})$') AS divider FROM orders")
def _dividers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", reflow.is_divider_line(_pick(_DIVIDERS, "o_orderkey", 5)).alias("divider"))


_UNITS = ["第一章節", "哈哈", "麒麟傳說外", "abcdefghij", "字"]


def _repeat_sql() -> str:
    unit, n = _pick_sql(_UNITS, "o_orderkey", 3), "CAST(o_orderkey % 5 + 1 AS INT)"
    # the smallest unit of 4 to 10 characters that fills the token three times or more
    size = "list_filter(range(4, 11), lambda s: length(w) % s = 0 AND length(w) // s >= 3 AND w = repeat(left(w, s), CAST(length(w) // s AS INT)))[1]"
    return f"SELECT o_orderkey, CASE WHEN length(w) BETWEEN 4 AND 100 AND {size} IS NOT NULL THEN left(w, {size}) ELSE w END AS out FROM (SELECT o_orderkey, repeat({unit}, {n}) AS w FROM orders)"


@query("collapse_repeat_token", _repeat_sql)
def _repeat(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    word = F.repeat(_pick(_UNITS, "o_orderkey", 3), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return rows.select("o_orderkey", reflow.collapse_token(word).alias("out"))


_CJK_SQL = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


@query(
    "cjk_class_counts",
    lambda: "SELECT doc_id, CAST(cjk AS INT) AS cjk, CAST(l AS INT) AS ascii_letters, CAST(d AS INT) AS digits, CAST(length(src) - cjk - l - d AS INT) AS other FROM ("
    + f"SELECT doc_id, src, len(regexp_extract_all(src, '{_CJK_SQL}')) AS cjk, len(regexp_extract_all(src, '[A-Za-z]')) AS l, len(regexp_extract_all(src, '[0-9０-９]')) AS d FROM ({corpus.letter_sql()}))",
)
def _counts(spark, sf_dir):
    return corpus.letter_corpus(spark, sf_dir).select("doc_id", reflow.cjk_counts(F.col("src")).alias("c")).select("doc_id", "c.*")


def _pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", corpus.LETTERS).alias("text"))


def _assembly_sql() -> str:
    body = "trim(text, ' ' || chr(13) || chr(10))"
    page = f"'=== [Page ' || row_number() OVER w || '/' || count(*) OVER (PARTITION BY conv_id) || '] ===' || chr(10) || CASE WHEN {body} = '' THEN chr(10) ELSE {body} || chr(10) || chr(10) END"
    src = f"SELECT conv_id, turn, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{corpus.LETTERS}') AS text FROM conversations"
    return f"SELECT conv_id AS doc_id, string_agg(p, '' ORDER BY n) AS text FROM (SELECT conv_id, row_number() OVER w AS n, {page} AS p FROM ({src}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, {body})) GROUP BY conv_id"


@query("page_assembly", _assembly_sql)
def _assembly(spark, sf_dir):
    return text_source.assemble_pages(_pages(spark, sf_dir), header=True)


@query("reflow")
def _reflow(spark, sf_dir):
    docs = text_source.assemble_pages(_pages(spark, sf_dir))
    return reflow.reflow_rows(docs, "text")


@query("page_pipeline")
def _page_pipeline(spark, sf_dir):
    return page_pipeline(_pages(spark, sf_dir), "t2hk", punctuation=True, norm_compat=True)


@query("text_encodings", lambda: "SELECT doc_id, encoding, src AS out FROM (" + corpus.letter_sql("conversations") + ") CROSS JOIN (SELECT unnest(['utf-8', 'utf-16', 'utf-16be', 'utf-32', 'gb18030']) AS encoding)")
def _encodings(spark, sf_dir):
    docs = corpus.letter_corpus(spark, sf_dir, "conversations")
    parts = [docs.select("doc_id", F.lit(e).alias("encoding"), text_source.decode(text_source.encode(F.col("src"), e), e).alias("out")) for e in ("utf-8", "utf-16", "utf-16be", "utf-32", "gb18030")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- packages

_NAMES = ["word/document.xml", "word/styles.xml", "xl/sharedStrings.xml", "xl\\worksheets\\sheet1.xml", "ppt/slides/slide1.xml", "ppt/slideLayouts/slideLayout2.xml", "ppt/media/image1.png", "content.xml", "META-INF/content.xml", "OEBPS/ch1.XHTML", "toc.ncx", "mimetype", "ppt/notesSlides/notesSlide1.xml"]


def _entry_sql() -> str:
    name = "lower(replace(" + _pick_sql(_NAMES, "p_partkey", 5) + r", '\', '/'))"
    fmt = _pick_sql(list(office.FORMATS), "p_partkey", 3)
    when = " ".join(f"WHEN '{f}' THEN regexp_matches(name, {oracle.text(p)})" for f, p in office.ENTRIES.items())
    return f"SELECT p_partkey, CASE fmt {when} END AS selected FROM (SELECT p_partkey, {name} AS name, {fmt} AS fmt FROM part)"


@query("office_entry_selection", _entry_sql)
def _entries(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", office.is_text_entry(_pick(_NAMES, "p_partkey", 5), _pick(list(office.FORMATS), "p_partkey", 3)).alias("selected"))


#: Entries of a package of each format, with the text at {}: what is to be converted, beside fonts and entries that are not.
_ENTRIES = {
    "docx": {"word/document.xml": '<w:document><w:rFonts w:ascii="麪體"/><w:t>{}</w:t></w:document>', "word/styles.xml": "<w:styles>麪</w:styles>"},
    "xlsx": {"xl/sharedStrings.xml": '<rFont val="麪體"/><si><t>{}</t></si>', "xl/worksheets/sheet1.xml": '<c t="inlineStr"><is><t>{}</t></is></c><c><v>麪</v></c>'},
    "pptx": {"ppt/slides/slide1.xml": '<a:latin typeface="麪體"/><a:t>{}</a:t>', "ppt/media/image1.png": "麪"},
    "odt": {"content.xml": "<style:style style:name='麪體'/><text:p>{}</text:p>", "META-INF/manifest.xml": "麪"},
    "ods": {"content.xml": '<style:style svg:font-family="麪體"/><text:p>{}</text:p>', "styles.xml": "麪"},
    "odp": {"settings.xml": "麪", "content.xml": '<text:p style:font-name-asian="麪體">{}</text:p>'},
    "epub": {"OEBPS/ch1.xhtml": '<p style="font-family: 麪體;">{}</p>', "mimetype": "application/epub+zip", "toc.ncx": "<text>{}</text>", "cover.css": "麪"},
}


@pandas_udf(T.BinaryType())
def _package(fmt: pd.Series, text: pd.Series) -> pd.Series:
    def build(f: str, body: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, entry in _ENTRIES[f].items():
                z.writestr(zipfile.ZipInfo(name), entry.replace("{}", body))
        return out.getvalue()

    return pd.Series([build(f, (x or "").replace("&", "").replace("<", "")) for f, x in zip(fmt, text)])


def _packages(spark, sf_dir):
    docs = corpus.letter_corpus(spark, sf_dir, "conversations").withColumn("format", _pick(list(office.FORMATS), "doc_id", 1))
    return docs.select(F.concat_ws("-", "doc_id", F.sha2("src", 256)).alias("path"), "format", _package("format", "src").alias("content"))


def _office_sql() -> str:
    rows = []
    for fmt, entries in _ENTRIES.items():
        names = sorted(entries, key=lambda n: n != "mimetype")  # an EPUB's mimetype comes first
        for i, name in enumerate(names):
            before, hole, after = entries[name].partition("{}")
            rows.append(f"({oracle.text(fmt)}, {i}, {oracle.text(name)}, {oracle.text(before)}, {bool(hole)}, {oracle.text(after)}, {name == 'mimetype'})")
    body = oracle.rounds_sql("replace(replace(coalesce(src, ''), '&', ''), '<', '')", C.rounds_of("t2hk"))
    return f"""SELECT concat_ws('-', doc_id, sha256(src)) AS path, CAST(idx AS INT) AS idx, name, before || CASE WHEN hole THEN body ELSE '' END || after AS text, stored
    FROM (SELECT doc_id, src, {body} AS body, {_pick_sql(list(office.FORMATS), "doc_id", 1)} AS fmt FROM ({corpus.letter_sql("conversations")}))
    JOIN (VALUES {", ".join(rows)}) AS e(fmt, idx, name, before, hole, after, stored) USING (fmt)"""


@query("office_convert", _office_sql)
def _office(spark, sf_dir):
    done = office.convert_packages(_packages(spark, sf_dir), "t2hk", keep_font=True)
    rows = office.explode_entries(done.where("success"))
    return rows.select("path", "idx", "name", F.decode("content", "UTF-8").alias("text"), "stored")


def oracle_sql() -> dict[str, str]:
    return {name: build() for name, build in ORACLES.items()}
