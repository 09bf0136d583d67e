"""Script conversion as columns.

Rounds of single characters become `translate`, inside whole-stage code. Others run all rounds of a config in one
Arrow function; a regular expression with a map lookup is the same in plain SQL functions (`native=True`), slower,
for use where Python workers are unwanted and as a cross-check.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..plans.configs import DEFAULT, Config, parse_config, supported_configs
from ..plans.slots import CustomSpec
from ..sources.dictionaries import Dictionaries, load
from .matcher import Pipeline, merged, pipeline_for

BUCKETS = 1024
#: Slots without which a config would leave every text as it is.
NEEDED = {"t2jp": ("jps_characters_rev",), "jp2t": ("jps_characters",)}


def rounds_of(config: str | Config, punctuation: bool = False, dicts: Dictionaries | None = None) -> list[dict[str, str]]:
    """The merged dictionary of each round."""
    dicts = dicts or load()
    config = parse_config(config) if isinstance(config, str) else config
    return [merged([dicts[s] for s in slots]) for slots in config.plan(punctuation)]


def translate(col: Column, table: dict[str, str]) -> Column:
    """Single characters by a map; characters mapped to nothing go."""
    keys = sorted(table, key=lambda k: (table[k] == "", k))
    return F.translate(col, "".join(keys), "".join(table[k] for k in keys)) if keys else col


def _escape(k: str) -> str:
    return re.sub(r"([\\.^$|()\[\]{}*+?\-])", r"\\\1", k)


def token_pattern(table: dict[str, str]) -> str:
    """Keys from longest to shortest, then any character; alternatives are tried in order."""
    return "(?s)(" + "|".join([*map(_escape, sorted(table, key=lambda k: (-len(k), k))), "."]) + ")"


def native_round(col: Column, table: dict[str, str]) -> Column:
    """One round in SQL functions: cut into tokens, look each up in a bucketed map."""
    if not table:
        return col
    by_bucket: dict[int, dict[str, str]] = {}
    for k, v in table.items():
        by_bucket.setdefault(ord(k[0]) % BUCKETS, {})[k] = v
    lit = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    empty = F.lit(None).cast("map<string,string>")
    maps = F.array(*[lit(by_bucket[i]) if i in by_bucket else empty for i in range(BUCKETS)])
    tokens = F.regexp_extract_all(col, F.lit(token_pattern(table)), F.lit(1))
    # ascii() is the code point of the first character
    out = F.transform(tokens, lambda t: F.coalesce(F.element_at(F.get(maps, F.ascii(t) % BUCKETS), t), t))
    return F.when(col.isNotNull(), F.array_join(out, ""))


def apply_rounds(col: Column, rounds: list[dict[str, str]], preserve_ids: bool = False, native: bool = False) -> Column:
    rounds = [r for r in rounds if r]
    if not rounds:
        return col
    plan = Pipeline(rounds, preserve_ids)
    if plan.scalar:
        for r in rounds:
            col = translate(col, r)
        return col
    if native:
        if preserve_ids or any(r.sensitive for r in plan.rounds):
            raise ValueError("description sequences and keys with delimiters need the Arrow form")
        for r in plan.rounds:
            col = translate(col, r.table) if r.scalar else native_round(col, r.table)
        return col
    frozen = tuple(tuple(r.items()) for r in rounds)

    return _together(frozen, preserve_ids)(col)


def _together(rounds: tuple, preserve_ids: bool):
    """Rounds as an Arrow function over whole batches."""

    @arrow_udf("string")
    def run(a: pa.Array) -> pa.Array:
        return pa.array(pipeline_for(rounds, preserve_ids).all(a.to_pylist()), pa.string())

    return run


def convert(col: Column | str, config: str = DEFAULT, punctuation: bool = False, preserve_ids: bool = False, dicts: Dictionaries | None = None, native: bool = False, null_as_empty: bool = False) -> Column:
    """The column converted; null stays null unless null_as_empty. Raises where a config's only dictionary is empty."""
    (dicts or load()).require(*NEEDED.get(parse_config(config).name, ()))
    col = F.col(col) if isinstance(col, str) else col
    if null_as_empty:
        col = F.coalesce(col, F.lit(""))
    return apply_rounds(col, rounds_of(config, punctuation, dicts), preserve_ids, native)


@dataclass(frozen=True)
class Converter:
    """An immutable session: config, dictionaries and options. Changes give a new converter."""

    config: str = DEFAULT
    dicts: Dictionaries | None = None
    punctuation: bool = False
    preserve_ids: bool = False
    last_error: str | None = None

    @classmethod
    def create(cls, config: str = DEFAULT, *specs: CustomSpec, on_invalid: str = "default", **more) -> Converter:
        """An invalid config falls back to s2t and says so in last_error, or raises."""
        try:
            name, error = parse_config(config).name, None
        except ValueError as e:
            if on_invalid != "default":
                raise
            name, error = DEFAULT, str(e)
        return cls(name, load().with_custom(*specs) if specs else None, last_error=error, **more)

    def with_config(self, config: str) -> Converter:
        return replace(self, config=parse_config(config).name, last_error=None)

    def with_custom(self, *specs: CustomSpec) -> Converter:
        """From the built-in dictionaries: it replaces earlier custom specs."""
        return replace(self, dicts=load().with_custom(*specs))

    def column(self, col: Column | str, native: bool = False) -> Column:
        return convert(col, self.config, self.punctuation, self.preserve_ids, self.dicts, native)

    def text(self, text: str | None) -> str | None:
        return Pipeline(rounds_of(self.config, self.punctuation, self.dicts), self.preserve_ids)(text)

    def transform(self, df: DataFrame, col: str, out: str | None = None) -> DataFrame:
        return df.withColumn(out or col, self.column(col))


def configs_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(supported_configs())], "id int, config string")


def register(spark: SparkSession, dicts: Dictionaries | None = None) -> list[str]:
    """SQL functions loom_<config> and loom_<config>_punct for spark.sql."""
    names = []
    for config in supported_configs():
        for punctuation in (False, True):
            rounds = tuple(tuple(r.items()) for r in rounds_of(config, punctuation, dicts) if r)

            name = f"loom_{config}" + "_punct" * punctuation
            spark.udf.register(name, _together(rounds, False))
            names.append(name)
    return names
