"""The subpackage's queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from .bpe import op8_bpe
from .decontaminate import OP1_SQL, op1_decontaminate
from .langid import op10_langid
from .line_dedup import OP2_SQL, op2_line_dedup
from .near_dedup import OP7_SQL, op7_near_dedup
from .quality import op6_quality
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .suffix_dedup import OP3_SQL, op3_suffix_dedup
from .tokencount import op9_token_counts
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_warc": op4_warc,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality": op6_quality,
    "op7_near_dedup": op7_near_dedup,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_langid": op10_langid,
}

ORACLES = {
    "op1_decontaminate": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op3_suffix_dedup": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op7_near_dedup": OP7_SQL,
}
