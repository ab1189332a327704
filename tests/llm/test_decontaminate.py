import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm.common import as_bytes
from corpusloom.llm.decontaminate import decontaminate, drop_contaminated, op4_decontamination
from corpusloom.llm.words import shingles, split

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(len(v), 13)
        for i in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit.update(range(p, p + n))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def dropped(text, items):
    """A full window anywhere in the text, or a share of it."""
    joined = lambda x: " " + " ".join(x) + " "
    w = joined(words(text))
    return any(joined(v[i : i + 13]) in w for _, item in items for v in [words(item)] for i in range(len(v) - 12)) or brute(text, items)[-1]


def case(seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Été", "a1", "x", "ÿß", "zero", "Nine", "ten", "9"]
    passage = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, passage(40)), (2, passage(13)), (10, passage(14)), (3, "the zero nine"), (4, None), (5, ""), (6, "..."), (2, passage(20)), (7, "of")]
    docs = [(None), "", "...", passage(5), passage(2000)]
    for _, item in items[:4]:
        docs += [passage(20) + ", " + item.upper().replace("É", "É") + "! " + passage(300), item, (item + " ") * 3]
    docs.append(docs[-1])
    return docs, items


@pytest.mark.parametrize("part", [16 << 20, 700])
def test_against_brute_force(spark, part):
    docs, items = case()
    left = spark.createDataFrame([(i, t, "n") for i, t in enumerate(docs)], "doc_id long, text string, hit string")
    right = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate(left, right, part_bytes=part).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(docs[r.doc_id], items), docs[r.doc_id]


def test_empty_tables(spark, tables):
    empty = ([], "doc_id long, text string")
    d = tables(documents=empty, benchmark=([], "item_id long, text string"))
    assert op4_decontamination(spark, d).count() == 0
    d = tables(documents=([(1, "some words"), (None, None)], empty[1]), benchmark=([], "item_id long, text string"))
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in op4_decontamination(spark, d).collect()) == [(0, 0, False), (2, 0, False)]


def test_stage_keeps_columns(spark, tables):
    docs, items = case(2)
    d = tables(benchmark=(items, "item_id long, text string"))
    frame = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in enumerate(docs)], "doc_id long, text string, lang string, scanned string, contaminated string")
    out = drop_contaminated(spark, frame, d)
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, t in enumerate(docs) if not dropped(t, items)]


@pytest.mark.parametrize("part", [16 << 20, 700])
def test_stage_finds_a_window_in_a_long_text(spark, part):
    """One window in 3,000 words is far under the share that op4 calls contaminated; a short item there is not enough."""
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    items = [(i, prose(30)) for i in range(40)] + [(40, "just three words")]
    docs = [prose(3000), prose(1500) + " " + " ".join(items[7][1].split()[9:22]) + " " + prose(1500), prose(1000) + " just three words " + prose(9)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), part_bytes=part).collect()}
    assert [(got[i].n_hit, got[i].full_window, got[i].contaminated) for i in range(3)] == [(0, False, False), (13, True, False), (3, False, False)]


def test_words_and_shingles():
    rng = random.Random(4)
    texts = ["".join(rng.choice("aB9é .,\n") for _ in range(rng.randrange(60))) for _ in range(200)] + ["w" * 5000 + " v", None, "é"]
    data, offs = as_bytes(pa.array(texts, pa.string()))
    w = split(data, offs)
    low = lambda b: b.decode().translate(LOWER)
    for i, t in enumerate(texts):
        own = [low(data[a:b].tobytes()) for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
        assert own == words(t)
    by = {}
    for h, a, b in zip(w.hashes.tolist(), w.starts, w.ends):
        assert by.setdefault(h, low(data[a:b].tobytes())) == low(data[a:b].tobytes())
    assert len(by) == len({x for t in texts for x in words(t)})
    s, first = shingles(w, 5)
    want = [{tuple(x[i : i + 5]) for i in range(max(len(x) - 4, min(len(x), 1)))} for x in map(words, texts)]
    assert [len(np.unique(s[a:b])) for a, b in zip(first, first[1:])] == [len(x) for x in want]
