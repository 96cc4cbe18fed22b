"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import minhash, mixing, substring_dedup, suffix_dedup, url_filter
from .decontaminate import op5_decontaminate
from .language import op7_language
from .line_dedup import op1_line_dedup
from .minhash import op3_minhash
from .mixing import op2_mixing
from .quality import op6_quality
from .sharding import op8_sharding
from .substring_dedup import op9_substring_dedup
from .suffix_dedup import op4_suffix_dedup
from .url_filter import op10_url_filter

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_minhash": op3_minhash,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_sharding": op8_sharding,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_url_filter": op10_url_filter,
}
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op3_minhash": minhash.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
