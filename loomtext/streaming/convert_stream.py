"""Streams: conversions keep no state, reflow keeps an open paragraph for each document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.tables import SPACES
from ..operators.convert import convert
from ..operators.reflow import Line, Paragraphs, take


def convert_stream(stream: DataFrame, col: str, config: str, out: str | None = None, **options) -> DataFrame:
    """A batch or streaming frame with the column converted; nothing is kept between batches."""
    return stream.withColumn(out or col, convert(F.col(col), config, **options))


def reflow_stream(lines: DataFrame, header: bool = False, idle: str = "10 minutes") -> DataFrame:
    """(doc_id, para) of a stream (doc_id, line_no, line): a paragraph is emitted when a later line ends it, the
    last one after `idle` without new lines. Lines of one batch are put in order of line_no."""
    schema, state = "doc_id long, para string", "text string, quotes string"
    wait = pd.Timedelta(idle).value // 1_000_000

    def run(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        p = Paragraphs()
        if kept.exists:
            p.resume(*kept.get)
        if kept.hasTimedOut:
            p.end()
            kept.remove()
        else:
            for raw in pd.concat(list(parts)).sort_values("line_no")["line"]:
                raw = raw or ""
                take(p, Line(raw, raw.rstrip(SPACES).lstrip(" ")), header)
            kept.update((p.text, "".join(p.quotes.elements())))
            kept.setTimeoutDuration(int(wait))
        yield pd.DataFrame({"doc_id": [key[0]] * len(p.done), "para": p.done})

    return lines.groupBy("doc_id").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.ProcessingTimeTimeout)
