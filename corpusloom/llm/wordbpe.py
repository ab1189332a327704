"""Ids of a word-level BPE vocabulary (lower case, white space dropped), word by word.

The vocabulary's own library drops white space, splits a text into words and merges inside each, so the ids of a text
are those of its words in order. Words repeat, so each is given to the library once and then looked up; Arrow splits
the texts and numbers the distinct words of a batch, so Python sees each of these once a batch. This holds for texts of
plain ASCII and Latin-1 letters without control strings; any other text goes to the library whole.
"""

from __future__ import annotations

from functools import cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A text in which this finds nothing is split by PARTS as the library splits it.
OTHER = r"[^\t-\r -~À-ÖØ-öø-ÿ]|<\|"
#: The vocabulary's own split pattern but for runs of letters, for the lower-case characters that OTHER leaves.
PARTS = r"'(?:[stmd]|re|ve|ll)|[0-9]|[^a-zß-öø-ÿ0-9\t-\r ]+"
#: Words that one process keeps, and how many of the first it keeps when there are more: frequent ones come early.
KEPT, ROOTS = 600_000, 200_000


@cache
def shared(path: str) -> WordBpe:
    """One encoder for each process, which outlives a task."""
    return WordBpe(path)


class WordBpe:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library, self.split = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.split.normalizer = None  # words are lower-case, composed and split already
        self.split.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.library.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)  # ids that end a word
        self.closes[[i for x, i in names.items() if x.endswith("</w>")]] = True
        self.slot: dict[str, int] = {"": 0}  # beside white space at a text's ends
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def learn(self, words: list[str]) -> None:
        """Ids of words: the library reads them as one text, each ends with its closing id."""
        ids = np.array(self.split.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.closes[ids]) + 1
        if len(stops) != len(words):
            raise RuntimeError(f"{len(words)} words became {len(stops)}")
        sizes = np.diff(np.append(0, stops))
        first, last, total = len(self.slot), len(self.slot) + len(words), len(ids)
        while last > len(self.start):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while self.used + total > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.start[first:last], self.size[first:last] = self.used + stops - sizes, sizes
        self.ids[self.used : self.used + total] = ids
        self.used += total
        self.slot.update(zip(words, range(first, last), strict=True))

    def forget(self) -> None:
        self.slot = dict(islice(self.slot.items(), ROOTS))
        n = len(self.slot)
        self.used = int((self.start[:n] + self.size[:n]).max(initial=0))

    def slots(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        array = array.cast(pa.large_string()).fill_null("")
        other = pc.match_substring_regex(array, OTHER)
        rest = np.flatnonzero(other.to_numpy(zero_copy_only=False))
        out: list = [None] * len(array)
        if len(rest):
            for i, x in zip(rest.tolist(), self.library.encode_batch_fast(array.take(pa.array(rest)).to_pylist(), add_special_tokens=False), strict=True):
                out[i] = np.array(x.ids, np.uint32)
            array = array.filter(pc.invert(other))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(array), PARTS, r" \0 "))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = self.slots(words)
        gaps = np.flatnonzero(found < 0)
        if len(self.slot) + len(gaps) > KEPT:
            self.forget()
            found = self.slots(words)
            gaps = np.flatnonzero(found < 0)
        if len(gaps):
            found[gaps] = np.arange(len(self.slot), len(self.slot) + len(gaps))
            self.learn([words[j] for j in gaps.tolist()])
        slots = found[coded.indices.to_numpy()]
        sizes = self.size[slots]
        ends = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.repeat(self.start[slots] - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[np.append(0, np.cumsum(split.value_lengths().to_numpy()))].tolist()
        plain = np.flatnonzero(~other.to_numpy(zero_copy_only=False)).tolist()
        for i, a, b in zip(plain, bounds, bounds[1:], strict=False):
            out[i] = ids[a:b]
        return out
