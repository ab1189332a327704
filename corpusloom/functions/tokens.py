"""Tokens: an offline counter, counts by tokenizer, hashes and cache keys, and loss-masked token examples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZERS = ("openai", "claude", "gemini")


def regex_token_count(x: Column) -> Column:
    """Offline stand-in for a BPE tokenizer: runs of ASCII letters and digits of at most four characters, and any other
    character that is not white space. An approximation; exact tokenizers come in by `seams.count_tokens`."""
    rest = F.regexp_replace(x, "[A-Za-z0-9]{1,4}", "a")  # a character for each run; regexp_count makes a list of all matches
    for space in " \t\n\r\f":
        rest = F.replace(rest, F.lit(space), F.lit(""))
    return F.coalesce(F.length(rest), F.lit(0))


def token_counts(x: Column, count=regex_token_count) -> Column:
    """A count for each tokenizer name; all three share one vocabulary."""
    return F.create_map(*(y for name in TOKENIZERS for y in (F.lit(name), count(x))))


def rank_encoder(path: str, pattern: str) -> Callable[[], Callable[[list], list]]:
    """Makes a byte-level BPE encoder from a file of ranks (base64 and number a line) and a split pattern, for the seams:
    a list of texts to a list of ids each, null being empty."""

    def make() -> Callable[[list], list]:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [encode(t) if t else [] for t in texts]

    return make


def text_hash(x: Column) -> Column:
    return F.substring(F.md5(x), 1, 16)


def pair_hash(domain: Column, verbose: Column, compressed: Column) -> Column:
    """A null part counts as empty, in its place."""
    return F.substring(F.sha2(F.concat_ws(":", *(F.coalesce(x, F.lit("")) for x in (domain, verbose, compressed))), 256), 1, 16)


def cache_key(prefix: str, content: Column, **params) -> Column:
    """prefix:hash, and parameters sorted by name."""
    tail = [F.lit("_".join(f"{k}={v}" for k, v in sorted(params.items())))] if params else []
    return F.concat_ws(":", F.lit(prefix), F.substring(F.sha2(content, 256), 1, 32), *tail)


def prompt_and_completion(messages: Column) -> tuple[Column, Column]:
    """All contents but the last, joined by newlines, and the last; an empty conversation raises."""
    known = F.when(F.size(messages) > 0, messages).otherwise(F.raise_error(F.lit("messages must not be empty")))
    contents = F.transform(known, lambda m: m.content)
    return F.array_join(F.slice(contents, 1, F.size(contents) - 1), "\n"), F.element_at(contents, -1)


def char_codes(x: Column) -> Column:
    """A toy tokenizer for tests: code points."""
    return F.transform(F.filter(F.split(x, ""), lambda c: c != ""), F.ascii)


def masked_example(prompt_ids: Column, completion_ids: Column) -> Column:
    """struct(tokens, target_tokens, weights): next-token shift, weight 0 on the prompt and 1 on the completion."""
    ids = F.concat(prompt_ids, completion_ids)
    weights = F.concat(F.array_repeat(F.lit(0), F.size(prompt_ids)), F.array_repeat(F.lit(1), F.size(completion_ids)))
    most = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.struct(F.slice(ids, F.lit(1), most).alias("tokens"), F.slice(ids, F.lit(2), most).alias("target_tokens"), F.slice(weights, F.lit(2), most).alias("weights"))
