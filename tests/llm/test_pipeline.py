import random

import corpus_pipeline
from corpusloom.llm.crf import fit_labelled, labelled_table
from corpusloom.llm.packing import VOCABULARY
from corpusloom.llm.pii import all_spans, redact
from tests.llm.test_decontaminate import dropped
from tests.llm.test_neighbours import brute as near, grams
from tests.llm.test_packing import holds

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus():
    rng = random.Random(1)
    parts = {"en": "the ing tion ed er", "fr": "eau que é ment la"}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randrange(2, 5))) for _ in range(n))
    items = [(i, text("en", 30)) for i in range(3)]
    docs = [(t := text(lang := rng.choice(["en", "fr"]), rng.randrange(20, 300)), lang) for _ in range(80)]
    docs += [(docs[0][0], "en"), (docs[1][0] + " one more", docs[1][1]), (docs[2][0].upper(), docs[2][1])]
    docs += [(text("en", 60) + " " + items[1][1], "en"), (text("en", 500) + " " + items[2][1] + " " + text("en", 500), "en"), (None, "en"), ("", None), ("12 34 ?!", "fr")]
    docs += [(text("en", 50) + " mail a.b@c.de or +1 (504) 555-2652 now", "en"), ('token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e" ' + text("fr", 40), None)]
    return [(i, t, lang, "s", len(t or ""), "c") for i, (t, lang) in enumerate(docs)], items


def test_run_against_brute_force(spark, tables):
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from corpusloom.llm.common import as_bytes

    docs, items = corpus()
    d = tables(documents=(docs, SCHEMA), benchmark=(items, "item_id long, text string"))
    rows = corpus_pipeline.run(spark, d).collect()
    kept = [(i, t) for i, t, *_ in docs if t and any(map(str.isalpha, t))]
    kept = [x for x, (i, c, _, _) in zip(kept, near(kept)) if i == c or not grams(x[1])]
    planted = {i for i, t, *_ in docs if t and any(item in t for _, item in items)}
    kept = [x for x in kept if not dropped(x[1], items)]
    assert len(planted) == 2 and not planted & {i for i, _ in kept}
    field, library = fit_labelled(labelled_table()), Tokenizer.from_file(VOCABULARY)
    data, offs = as_bytes(pa.array([t for _, t in kept]))
    clean = [redact(t, s) for (_, t), (_, s) in zip(kept, all_spans([t for _, t in kept], data, offs, field))]
    assert sum("<EMAIL>" in t and "<PHONE>" in t for t in clean) == 1 and sum("<SECRET>" in t for t in clean) == 1
    sizes = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for (i, _), t in zip(kept, clean)}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes and not planted & set(got) and holds(rows) <= np.ceil(sum(sizes.values()) / 2048) + 1
    assert 80 <= len(sizes) < len(docs) - 5


def test_empty_documents(spark, tables):
    d = tables(documents=([], SCHEMA), benchmark=([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, d).count() == 0


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
