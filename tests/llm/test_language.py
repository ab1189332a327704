import random
import zlib

import numpy as np
import pytest

from corpusloom.llm.language import codewords, drop_unidentified, identify, op6_language_id, train

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
PARTS = {"en": "the ing tion ed er", "fr": "eau que é ment la", "de": "sch ung ü der ein", "es": "ció ñ os las do", "xx": "zz qq xk wq jj", "nl": "ij aa oe een het"}


def text(rng, lang, n):
    p = PARTS[lang].split()
    return " ".join("".join(rng.choice(p) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=400, langs=("en", "fr", "de", "es")):
    rng = random.Random(1)
    return [(i, text(rng, lang := rng.choice(langs), rng.randrange(4, 120)), lang) for i in range(n)]


@pytest.mark.parametrize("langs", [("en", "fr", "de", "es"), tuple(PARTS)])
def test_held_out_accuracy(spark, tables, langs):
    rows = corpus(langs=langs)
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 !? ...", "fr"), (1003, "日本", None), (1004, text(random.Random(2), "de", 40_000), None), (None, rows[0][1], "en")]
    d = tables(documents=([(i, t, lang, "s", 1, "x") for i, t, lang in rows + odd + rows[:2]], SCHEMA))
    got = op6_language_id(spark, d).collect()
    assert len(got) == len(rows) + len(odd) + 2
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [(by[i].lang_pred, lang) for i, _, lang in rows if by[i].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.97
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred in langs and by[1004].lang_pred == "de"
    assert all(r.score == 0 for r in got if r.lang_pred == "und")


def test_nothing_or_one_language_to_learn(spark, tables):
    for langs, want in (((None,), "und"), (("en", None), "en")):
        rows = [(i, "some words" if i else "12", langs[i % len(langs)], "s", 1, "x") for i in range(20)]
        got = {r.doc_id: (r.lang_pred, r.score) for r in op6_language_id(spark, tables(documents=(rows, SCHEMA))).collect()}
        assert got[0] == ("und", 0) and all(got[i] == (want, float(want == "en")) for i in range(1, 20))


def test_predictions_read_text_alone(spark):
    rows = corpus(120)
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    a = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model, keep=("doc_id",))
    b = identify(spark.createDataFrame([(i, t, None) for i, t, _ in rows], "doc_id long, text string, lang string"), model, keep=("doc_id",))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_codes_keep_their_distance():
    for n in (2, 3, 4, 5, 6, 12, 40):
        code = codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        np.fill_diagonal(apart, 99)
        assert apart.min() >= (1 if n < 3 else 2) and (abs(code.sum(0)) < n).all()


def test_stage_and_empty_table(spark, tables):
    rows = [(i, t, lang, "s", 1, "x") for i, t, lang in corpus(60)] + [(99, "!!", "en", "s", 1, "x"), (98, None, "en", "s", 1, "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = drop_unidentified(spark, frame, "")
    assert out.columns == frame.columns and sorted(map(tuple, out.collect())) == sorted(rows[:60])
    assert op6_language_id(spark, tables(documents=([], SCHEMA))).count() == 0


def test_training_sample_is_bounded_and_no_language_is_left_out(spark, monkeypatch):
    from corpusloom.llm import language

    own = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(None, f"the word {i} of null ids", "en") for i in range(400)]
    rows += [(own[0], f"das Wort {i} zu einer Nummer", "de") for i in range(400)]
    rows += [(own[1], "le mot tout pareil", "fr")] * 400 + [(k, f"la palabra {k} de todos", "es") for k in own[2:5]]
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string, lang string"), []
    model = language.Model
    monkeypatch.setattr(language, "Model", lambda names, x, y: seen.append((names, len(x), np.bincount(y).tolist())) or model(names, x, y))
    train(docs, per_language=20)
    train(docs, training_rows=40)
    train(docs.where("lang <> 'es'").repartition(7), per_language=20)
    names = ["de", "en", "es", "fr"]
    assert seen == [(names, 63, [20, 20, 3, 20]), (names, 33, [10, 10, 3, 10]), (["de", "en", "fr"], 60, [20, 20, 20])]


def test_stage_keeps_letters_when_nothing_was_learned(spark):
    rows = [(1, "plain words", None), (2, None, None), (3, "12 !?", None), (4, "é", None), (5, "", None), (None, "слово", None)]
    out = drop_unidentified(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted((r.text, r.doc_id) for r in out.collect()) == [("plain words", 1), ("é", 4), ("слово", None)]


def plain_features(text):
    """Square roots of relative frequencies of hashed byte n-grams, one n-gram at a time."""
    from corpusloom.llm.language import BUCKETS, ORDERS
    from corpusloom.llm.words import randoms

    factor = [int(x) | 1 for x in randoms(max(ORDERS), 31)]
    raw, out = [b + 32 if 65 <= b <= 90 else b for b in text.encode()], np.zeros(BUCKETS)
    for k in ORDERS:
        for i in range(len(raw) - k + 1):
            value = sum((raw[i + j] + 1) * factor[j] for j in range(k)) % 2**64
            out[(value * 0x9E3779B97F4A7C15 % 2**64) >> (64 - BUCKETS.bit_length() + 1)] += 1
    return np.sqrt(out / max(out.sum(), 1))


def test_query_against_brute_force(spark, tables):
    """Codes for all splits, ridge regression in the primal, loss-weighted decoding, text by text."""
    import itertools

    from corpusloom.llm.language import AMBIGUOUS, RIDGE

    rows = corpus(90, ("en", "fr", "de"))
    got = {r.doc_id: r for r in op6_language_id(spark, tables(documents=([(*r, "s", 1, "x") for r in rows], SCHEMA))).collect()}
    learned = [(plain_features(t).astype(np.float16).astype(float), lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    names = sorted({lang for _, lang in learned})
    code = np.array([[1, *x] for x in itertools.product((1, -1), repeat=2) if -1 in x], float).T
    x, y = np.array([f for f, _ in learned]), np.array([names.index(lang) for _, lang in learned])
    share = 1 / np.bincount(y)[y]
    root = np.sqrt(share / share.mean())[:, None]
    mean = x.mean(0)
    a, b = (x - mean) * root, code[y] * root
    w = np.linalg.solve(a.T @ a + RIDGE * np.trace(a @ a.T) / len(a) * np.eye(a.shape[1]), a.T @ b)
    right = np.clip((share[:, None] * ((a @ w) * code[y] > 0)).sum(0) / share.sum(), 0.501, 0.999)
    trust = np.log(right / (1 - right))
    for i, t, _ in rows:
        out = (plain_features(t) - mean) @ w
        loss = [sum(q * max(0.0, 1 - o * c) for q, o, c in zip(trust, out, word)) for word in code]
        first, second = sorted(loss)[:2]
        score = (second - first) / (second + first)
        assert abs(got[i].score - score) < 1e-3 and (score < 1e-3 or got[i].lang_pred == names[int(np.argmin(loss))])
        assert abs(score - AMBIGUOUS) < 1e-3 or got[i].ambiguous == (score < AMBIGUOUS)


def test_ties_go_to_the_first_language(spark, tables):
    """Two languages learned from the same texts can't be told apart."""
    texts = [text(random.Random(k), "en", 20) for k in range(30)]
    own = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2][:60]
    rows = [(i, texts[n % 30], "bb" if n < 30 else "aa", "s", 1, "x") for n, i in enumerate(own)]
    got = op6_language_id(spark, tables(documents=(rows, SCHEMA))).collect()
    assert {r.lang_pred for r in got if r.score == 0} <= {"aa"} and all(r.score < 1e-3 and r.ambiguous for r in got)


def test_a_dirty_language_column_is_bounded(spark, monkeypatch):
    from corpusloom.llm import language

    own = [k for k in range(4000) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(k, f"the words of {k}", "en" if k % 3 else "de" if k % 2 else f"junk {k}") for k in own]
    monkeypatch.setattr(language, "LANGUAGES", 2)
    assert train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["de", "en"]
