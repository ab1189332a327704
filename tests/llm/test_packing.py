import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from corpusloom.llm import wordbpe
from corpusloom.llm.packing import LIMITED, TOKENS, best_fit, op10_best_fit_packing, pack, pack_stage, packing_under_limits, sequence_ids, token_pieces
from corpusloom.llm.wordbpe import WordBpe

TEXTS = [None, "", "   ", "It's a <|endoftext|> test, they'll see.", "Ünïcode çafé ÀÉ ß", "日本語 テキスト 12³ ½", "Á combining", "x" * 3000, "tabs\tand\nlines \x1c \x85   end", "word " * 5000, "123 4.5-6_7 __ ''s 'S", "İstanbul ΑΣ ǅ", "a\x00b \x7f", "don't we've i'm 'd"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_word_ids_equal_the_library(library, monkeypatch):
    rng = random.Random(1)
    alphabet = "aBcé'stdlmrveÀß .,!?-_\n12<|>\t\"&@#"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(500)]
    encoder = WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(wordbpe, "KEPT", 700)
    monkeypatch.setattr(wordbpe, "ROOTS", 90)
    for _ in range(3):
        rng.shuffle(texts)
        for t, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_a_word_is_learnt_once(library, monkeypatch):
    """Whatever stands beside it, and however many texts have it: the library is given distinct words, never whole chunks."""
    encoder, given = WordBpe(public_tokenizers.path("word_bpe_49k.json")), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: (given.extend(words), learn(words)))
    texts = ["Loom, (loom) loom. loom!", "\tloom's \u00e9l\u00e0n-loom 77 ", None, "LOOM; \u00c9L\u00c0N's 7"]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted(given) == sorted({"loom", ",", "(", ")", ".", "!", "'s", "\u00e9l\u00e0n", "-", "7", ";"})


def test_words_of_every_character(library):
    """Every pair of Latin-1 characters, and marks around contractions, as a list and as a slice of an Arrow array."""
    plain = [chr(i) for i in range(256)]
    texts = [a + b + "x" for a in plain for b in "'sS \xc5\xe05!_\x0b\xa0"] + ["".join(plain), "".join(plain[33:127] + [chr(i) for i in range(192, 256) if i not in (215, 247)])]
    texts += [a + b + c + d for a in ("", "a", "5", "!", "'", "_") for b in ("'s", "''S", "'", "'re's", "'LL") for c in ("", "t", "'", "9", "\x0c") for d in ("'ve", "m", "")]
    encoder, want = WordBpe(public_tokenizers.path("word_bpe_49k.json")), [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [x.tolist() for x in encoder.encode(pa.array([None, *texts, "end"]).slice(1, len(texts)))] == want
    assert encoder.encode([]) == [] and encoder.encode(["\u65e5"])[0].tolist() == library.encode("\u65e5", add_special_tokens=False).ids
    assert encoder.encode([None, " \n", ""])[1].tolist() == []


def test_query(spark, tables, library):
    docs = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "no id")]
    rows = op10_best_fit_packing(spark, tables(documents=([(*d, "c") for d in docs], "doc_id long, text string, length string"))).collect()
    want = []
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    holds(rows)


def holds(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    return len(by)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_constraint(rule):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 400, 3000)
    bins, offsets = best_fit(lengths, 1000, 5, 400_000.0, (1, 0.5, 0.5), rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 1000 and len(own) <= 5 and (own.astype(float) ** 2).sum() <= 400_000
    assert bins.max() + 1 <= 1.35 * max(lengths.sum() / 1000, len(lengths) / 5, (lengths.astype(float) ** 2).sum() / 4e5)


def test_few_sequences(spark):
    rng = np.random.default_rng(3)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 6000).astype(int) + 1)
    frame = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = pack(frame, group=2000).collect()
    assert len(rows) == 6000 and holds(rows) <= 1.01 * lengths.sum() / 2048 + 3


def test_empty_table(spark, tables):
    assert op10_best_fit_packing(spark, tables(documents=([], "doc_id long, text string"))).count() == 0
    assert pack_stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string"), "").count() == 0


def test_packed_ids(spark, library):
    docs = [(i, f"word {i} " * (i * 40)) for i in range(30)]
    placed = pack(token_pieces(spark.createDataFrame(docs, "doc_id long, text string"), with_ids=True)).collect()
    by = {r.sequence_id: r.ids for r in sequence_ids(spark.createDataFrame(placed)).collect()}
    whole = {}
    for r in sorted(placed, key=lambda r: r.start):
        whole.setdefault(r.doc_id, []).extend(by[r.sequence_id][r.offset : r.offset + r.length])
    assert whole == {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in docs} and all(len(x) <= 2048 for x in by.values())


def plain_best_fit(lengths, tokens, most, cost, weights, rule):
    """The bin of each piece by the definition alone: a list of bins, all of them open, in the order of their opening."""
    bins, out = [], [0] * len(lengths)
    caps = (tokens, most, cost)
    for p in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = [x / c for x, c in zip((lengths[p], 1, float(lengths[p]) ** 2), caps)]
        best, least = None, None
        for b, room in enumerate(bins):
            if all(r >= d - 1e-12 for r, d in zip(room, need)):
                if rule == "norm":
                    score = sum(w * (r - d) ** 2 for w, r, d in zip(weights, room, need))
                else:
                    score = -sum(w * d * r for w, r, d in zip(weights, room, need))
                if least is None or score < least - 1e-12:
                    best, least = b, score
        if best is None:
            bins.append([1.0, 1.0, 1.0])
            best = len(bins) - 1
        bins[best] = [r - d for r, d in zip(bins[best], need)]
        out[p] = best
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(2048, 2048, 2048.0**2, (1.0, 1e-4, 1e-4)), (2048, 12, 1.5 * 1024**2, (1.0, 0.5, 1.0)), (1000, 5, 4e5, (1, 0.5, 0.5))])
def test_bin_choice_against_brute_force(rule, limits):
    rng = np.random.default_rng(7)
    lengths = np.minimum(limits[0], rng.lognormal(5, 1.2, 500).astype(int) + 1)
    got, _ = best_fit(lengths, *limits, rule)
    want = plain_best_fit(lengths.tolist(), *limits, rule)
    tied = sum(a != b for a, b in zip(got.tolist(), want))
    assert tied == 0


def test_all_three_capacities_choose_bins():
    """Under the limits of packing_under_limits the weights of pieces and cost choose: without either, bins differ. They
    need not be fewer: on these lengths all take about as many."""
    rng = np.random.default_rng(11)
    lengths = np.minimum(TOKENS // 2, rng.lognormal(5, 1.2, 1500).astype(int) + 1)
    pack_by = lambda w: best_fit(lengths, TOKENS, LIMITED["most"], LIMITED["cost"], w, LIMITED["rule"])[0]
    own = pack_by(LIMITED["weights"])
    assert own.tolist() == plain_best_fit(lengths.tolist(), TOKENS, LIMITED["most"], LIMITED["cost"], LIMITED["weights"], LIMITED["rule"])
    a, b, c = LIMITED["weights"]
    for other in ((a, 0.0, c), (a, b, 0.0), (a, 0.0, 0.0)):
        bins = pack_by(other)
        assert (bins != own).mean() > 0.05 and abs(int(bins.max()) - int(own.max())) <= 0.02 * own.max()


def test_query_under_limits(spark, tables):
    rng = random.Random(3)
    docs = [(i, "word " * min(3000, int(rng.lognormvariate(4.5, 1.3))), "c") for i in range(600)] + [(None, None, "c"), (1, "twice", None), (1, "twice", None)]
    rows = packing_under_limits(spark, tables(documents=(docs, "doc_id long, text string, length string"))).collect()
    assert holds(rows) > 0
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(x) <= TOKENS and len(x) <= LIMITED["most"] and sum(n * n for n in x) <= LIMITED["cost"] for x in by.values())
    assert any(len(x) == LIMITED["most"] for x in by.values()) and any(sum(n * n for n in x) > 0.9 * LIMITED["cost"] for x in by.values())
