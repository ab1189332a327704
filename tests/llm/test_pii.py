import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import crf, pii
from corpusloom.llm.common import as_bytes

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, x in enumerate(reversed(d)):
        x = int(x) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(t):
    n = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(n(m[0])) <= 19 and luhn(n(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(n(m[0])) <= 15]


TEXTS = [None, "", "plain words only", "mail é a.b@c.de, x@y and @z.q a@b@c.d e@f.g@h.i", "ip 1.2.3.4.5.6.7.8 256.1.1.1 010.001.000.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 9582442921002355", "+1 (504) 555-2652 +49 30 1234567 19 + 3", 'token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e" end', "call (504) 555-2652.", "9" * 30_000, "1." * 9000, "a" * 20_000 + "@", "12 " * 8000]


@pytest.fixture(scope="module")
def field():
    return crf.fit_labelled(crf.labelled_table())


def test_patterns_against_brute_force():
    rng = random.Random(1)
    for text in [t for t in TEXTS[1:9]] + ["".join(rng.choice("a1@.+ -(2)4é5.1") for _ in range(rng.randrange(60))) for _ in range(4000)]:
        assert pii.base_spans(text) == brute(text), text


def test_long_texts_take_linear_time():
    for text in TEXTS[9:]:
        pii.base_spans(text)


def test_field_on_unseen_rows(field):
    rows = crf.labelled_table(300, 99)
    data = np.frombuffer("\n".join(" ".join(w) for w, _ in rows).encode(), np.uint8)
    starts, ends, line = crf.tokens(data, np.array([0, len(data)]))
    gold = np.array([crf.LABELS.index(y) for _, ys in rows for y in ys])
    assert (field.label(data, starts, ends, line) == gold).mean() > 0.96


def test_viterbi_and_shortcut_against_all_paths(field):
    import itertools

    rng = np.random.default_rng(2)
    data, offs = as_bytes(pa.array(["Call +1 (504) 555-2652 now", "a b c", 'token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"', "x"]))
    starts, ends, line = crf.tokens(data, offs)
    for scale in (0, 3):
        f = crf.features(data, starts, ends, line)
        model = crf.Crf()
        model.moves = field.moves + scale * rng.normal(size=field.moves.shape).astype(np.float32)
        model.weights = field.weights + scale * rng.normal(size=field.weights.shape).astype(np.float32)
        e = model.emissions(f)
        got = model.decode(e, line)
        for k in set(line.tolist()):
            own = np.flatnonzero(line == k)
            value = lambda p: sum(e[i, y] for i, y in zip(own, p)) + sum(model.moves[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
            assert value(got[own]) >= max(map(value, itertools.product(range(6), repeat=len(own)))) - 1e-3


def test_query(spark, tables):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None)]
    d = tables(documents=(rows, "doc_id long, text string, spans string, n_ip string"))
    got = pii.op7_pii(spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id] or ""
        base = brute(text) if len(text) < 5000 else pii.base_spans(text)
        join = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(join.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.KINDS[:4]]
        assert set(filter(None, join.split(","))) <= set(r.spans.split(","))
    by = {r.doc_id: r.spans for r in got}
    assert by[7] == "secret:9:49" and by[8] == "phone:5:19"


def test_stage(spark):
    frame = spark.createDataFrame([(1, "mail é a.b@c.de!", "en", 17, "r"), (2, None, None, 5, "r"), (3, "clean", "en", 5, None)], "doc_id long, text string, lang string, n_chars long, redacted string")
    out = pii.redact_stage(spark, frame, "")
    assert out.columns == frame.columns
    assert sorted(map(tuple, out.collect())) == [(1, "mail é <EMAIL>!", "en", 15, "r"), (2, None, None, 5, "r"), (3, "clean", "en", 5, None)]


def test_empty_table(spark, tables):
    assert pii.op7_pii(spark, tables(documents=([], "doc_id long, text string"))).count() == 0


def lines_of(rows):
    """Lines with the spans of their labelled runs, in bytes."""
    for words, labels in rows:
        at, spans, text = 0, [], " ".join(words)
        for k, (w, y) in enumerate(zip(words, labels)):
            if y != "O":
                if k and labels[k - 1] == y and spans:
                    spans[-1][2] = at + len(w.encode())
                else:
                    spans.append([y, at, at + len(w.encode())])
            at += len(w.encode()) + 1
        yield text, spans


def test_precision_and_recall_of_added_spans(field):
    """Spans on lines that the field was not trained on: a labelled run counts as met by a span of its kind inside it."""
    rows = list(lines_of(crf.labelled_table(600, 1234)))
    data, offs = as_bytes(pa.array([t for t, _ in rows]))
    found = pii.field_spans(field, data, offs)
    right = sum(any(k == y and x <= a and b <= z for y, x, z in spans) for i, (_, spans) in enumerate(rows) for k, a, b in found.get(i, ()))
    # a run of more than one entity or with wrong check digits can't be a span, so recall is over runs that can
    wanted = [(i, y, a, b) for i, (t, spans) in enumerate(rows) for y, a, b in spans if pii.holds(y, t.encode()[a:b].decode().lstrip(pii.OPENING if y != "phone" else "\"'<[{").rstrip(pii.CLOSING))]
    met = sum(any(k == y and a <= x and z <= b for k, x, z in found.get(i, ())) for i, y, a, b in wanted)
    every = sum(map(len, found.values()))
    print(f"precision {right / every:.3f} of {every}, recall {met / len(wanted):.3f} of {len(wanted)}")
    assert right / every > 0.97 and met / len(wanted) > 0.95


def brute_labels(field, text):
    """Labels of a text's tokens: every line by itself, plain Viterbi over all its tokens."""
    out = []
    for row in text.split("\n"):
        data = np.frombuffer(row.encode(), np.uint8)
        starts, ends, line = crf.tokens(data, np.array([0, len(data)]))
        if len(starts):
            e = field.emissions(crf.features(data, starts, ends, line)).astype(float)
            best, back = e[0], []
            for x in e[1:]:
                score = best[:, None] + field.moves
                back.append(score.argmax(0))
                best = score.max(0) + x
            path = [int(best.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            out += path[::-1]
    return out


def test_added_spans_against_brute_force(field, monkeypatch):
    rng = random.Random(5)
    lines = [" ".join(w) for w, _ in crf.labelled_table(150, 77)]
    texts = ["\n".join(rng.sample(lines, 20)), " ".join(lines), "\n".join(lines) + " é " + " ".join(lines[:30]), "x", ""]
    data, offs = as_bytes(pa.array(texts))
    starts, ends, line = crf.tokens(data, offs)
    want = [y for t in texts for y in brute_labels(field, t)]
    assert field.label(data, starts, ends, line).tolist() == want
    monkeypatch.setattr(crf, "SLICE", 7)
    monkeypatch.setattr(crf, "STEP", 64)
    monkeypatch.setattr(crf, "CELLS", 50)
    assert field.label(data, starts, ends, line).tolist() == want


@pytest.mark.parametrize("text", ["mail a.b@c.de now " * 20 + "w ab, " * 1_300_000 + "\nphone +1 (504) 555-2652 or (504) 555-2652" * 1500, "x" * 8_000_000 + "\n" + "call (504) 555-2652 now\n" * 2000])
def test_memory_of_long_and_short_lines(field, text):
    """8 MB in a line of over a million tokens beside many short ones: arrays stay under 500 MB."""
    import tracemalloc

    data, offs = as_bytes(pa.array([text]))
    tracemalloc.start()
    spans = next(pii.all_spans([text], data, offs, field))[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20, peak
    assert sum(k == "phone" for k, _, _ in spans) >= 1500


def test_keys_are_secrets():
    assert all(pii.holds("secret", s) for s in ("ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e", "sk-aB3dE5gH7jK9mN1pQ3sT5vW7", "qRs7+Tuv/Wx0yZ1aBc2DeF3gHi4JkL5mNo6PqR7sT", "ghp_a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"))
    assert not any(pii.holds("secret", s) for s in ("internationalisation", "zzzzzzzzzzzzzzzzzzzzzzzzz1Z", "short1A", "2024-01-01-2024-01-02", "a sentence with 1 B blank"))
