"""The command line's compositions: plain conversion, page text, packages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dictionaries import Dictionaries
from ..sources.text import assemble_pages
from .convert import convert
from .detofu import detofu
from .normalize import normalize_compat, normalize_unicode_compat
from .reflow import reflow_joined


def convert_pipeline(
    col: Column, config: str, punctuation: bool = False, preserve_ids: bool = False, norm_compat: bool = False, extended: bool = False, tofu: str | None = None, tofu_pairs: Mapping[str, str] | None = None, dicts: Dictionaries | None = None
) -> Column:
    """Normalise, convert, then replace rare characters."""
    if norm_compat:
        col = normalize_compat(col, extended)
    col = convert(col, config, punctuation, preserve_ids, dicts)
    return detofu(col, tofu, tofu_pairs) if tofu else col


def page_pipeline(pages: DataFrame, config: str | None, punctuation: bool = False, reflow: bool = True, header: bool = False, compact: bool = False, norm_compat: bool = False, dicts: Dictionaries | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, page_no, text): assembled, normalised, reflowed and converted; without a config
    the text is only extracted."""
    docs = assemble_pages(pages, header=header)
    text = normalize_unicode_compat(F.col("text"))
    if reflow:
        text = reflow_joined(text, header, compact)
    if norm_compat:
        text = normalize_compat(text)
    if config:
        text = convert(text, config, punctuation, dicts=dicts)
    return docs.select("doc_id", text.alias("text"))
