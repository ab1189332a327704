"""Column functions."""

from .classify import classify, code_score
from .scoring import (
    call_cost, combined_score, compression_ratio, cosine, dot, fact_overlap, hashed_vector, is_equivalent,
    judge_or_partial, parse_judge, reduction_percent, task_score, text_cost, text_fact_overlap, verdict_score,
)
from .text import (
    atomic_facts, clean_generated, clean_marks, lexical_overlap, logical_lines, normalize_for_comparison,
    normalize_space, strip, strip_code, strip_frontmatter, strip_tags, token_set,
)
from .tokens import cache_key, char_codes, masked_example, pair_hash, prompt_and_completion, regex_token_count, text_hash, token_counts
