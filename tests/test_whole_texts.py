"""Registered queries that must read whole texts, against plain Python and their SQL."""

from corpusloom.plans import queries


def same_as_sql(name, got, directory):
    import duckdb

    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"create view {t} as select * from '{directory}/{t}.parquet'")
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in got)


def test_loss_mask_reads_whole_texts(spark, tables):
    texts = ["abc", "x", "", "é»→" * 30 + "end", "in ab\n" * 20, "word " * 400 + "last"]
    d = tables(benchmark=(list(enumerate(texts)), "item_id long, text string"))
    got = {r.item_id: r for r in queries.QUERIES["loss_mask_tokens"](spark, d).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        half = len(t) // 2
        ids, weights = [ord(x) for x in "ab\n" + t], [0] * (3 + half) + [1] * (len(t) - half)
        say = lambda v: ",".join(map(str, v))
        assert (got[i].tokens, got[i].targets, got[i].weights) == (say(ids[:-1]), say(ids[1:]), say(weights[1:])), t


def test_loss_mask_whole_sql(spark):
    d = "/root/testdata/sf0.01"
    same_as_sql("loss_mask_tokens", queries.QUERIES["loss_mask_tokens"](spark, d).collect(), d)


def test_classifiers_read_whole_texts(spark, tables):
    from tests.test_text import py_classify

    code, prose = "const a = 1;\n@mark\nasync function go() {\n", "Some plain words go on. And the end?\n"
    texts = [prose * 10 + code * 9, code * 9, prose * 3 + code, code * 3 + prose * 40, "", " ", code * 20, prose, prose * 9 + "x: int"]
    d = tables(documents=(list(enumerate(texts)), "doc_id long, text string"))
    heads = {0: "import os\ndef run(x):\n    return x;\n", 1: "class A:\n  v: int = 1;\nif (a) => {\n"}
    plain = {r.doc_id: r for r in queries.QUERIES["domain_classify"](spark, d).collect()}
    full = {r.doc_id: r for r in queries.QUERIES["domain_classify_detailed"](spark, d).collect()}
    assert len(plain) == len(full) == len(texts)
    for i, t in enumerate(texts):
        domain, sure, score, shown = py_classify(heads.get(i % 4, "") + t)
        assert plain[i].domain == full[i].domain == domain and abs(plain[i].score - score) <= 1e-6, t
        assert full[i].indicators == ",".join(shown) and abs(full[i].confidence - sure) <= 6e-4 and abs(full[i].code_ratio - score) <= 6e-4, t


def test_classifiers_whole_sql(spark):
    d = "/root/testdata/sf0.01"
    for name in ("domain_classify", "domain_classify_detailed"):
        same_as_sql(name, queries.QUERIES[name](spark, d).collect(), d)


def test_likeness_of_whole_texts(spark, tables):
    import ast
    from difflib import SequenceMatcher

    texts = ["plain words", "plain words here", "it's \\ a line\nand more", "w " * 500]
    d = tables(documents=([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    source = {r.doc_id: r.source for r in queries.sources(spark, d).collect()}
    assert all("w " * 500 in source[3] and t.split()[0].strip("\'") in source[i].replace('"', "'") for i, t in enumerate(texts))
    dump = lambda i: ast.dump(ast.parse(source[i]))
    got = {r.doc_id: r.likeness for r in queries.QUERIES["ast_likeness_texts"](spark, d).collect()}
    assert got == {i: round(SequenceMatcher(None, dump(i), dump(i - 1)).ratio(), 6) for i in range(1, 4)}
