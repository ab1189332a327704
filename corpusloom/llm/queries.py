"""Queries of this subpackage and their SQL; __spark_entry__ adds them when it can import them."""

from __future__ import annotations

from .chat import OP3_SQL, op3_chat_formatting
from .decontaminate import OP4_SQL, op4_decontamination
from .language import op6_language_id
from .lengths import op8_token_counts
from .licenses import op5_license_scan
from .media import op1_media_columns
from .neighbours import OP2_SQL, op2_ngram_jaccard_join
from .pii import op7_pii
from .warc import OP9_SQL, op9_warc_revisits
from .packing import op10_best_fit_packing, packing_under_limits

QUERIES = {f.__name__: f for f in (op1_media_columns, op2_ngram_jaccard_join, op3_chat_formatting, op4_decontamination, op5_license_scan, op6_language_id, op7_pii, op8_token_counts, op9_warc_revisits, op10_best_fit_packing, packing_under_limits)}
SQL: dict[str, str] = {"op2_ngram_jaccard_join": OP2_SQL, "op3_chat_formatting": OP3_SQL, "op4_decontamination": OP4_SQL, "op9_warc_revisits": OP9_SQL}
