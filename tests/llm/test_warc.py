import random

from pyspark.sql import functions as F

from corpusloom.llm.warc import canonical_url, lower_names, op9_warc_revisits, resolve_revisits, with_payload

SCHEMA = "record_id long, url string, at long, kind string, status int, headers map<string,string>, digest string, length long, body string, canonical string"


def test_canonical_url(spark):
    cases = {"HTTP://WWW.Example.com:80/A/b/?b=2&a=1&utm_source=x#f": "example.com/A/b?a=1&b=2", "https://example.com": "example.com", "example.com/?ref=1": "example.com", None: None, "": "", "https://a.org:8080/x?refer=1": "a.org:8080/x?refer=1", "  http://a.org/x#a\nb ": "a.org/x"}
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == cases


def brute(rows):
    out = []
    for r in rows:
        i, url, at, kind, status, headers, digest = r[:7]
        if kind != "revisit":
            continue
        h = {k.lower(): v for k, v in (headers or {}).items()}
        key = lambda x: (x[2], x[0] is not None, x[0] or 0)
        own = [x for x in rows if x[3] == "response" and x[4] == 200 and x[2] is not None and x[1] == url and url and at is not None and (x[2] < at or x[2] == at and (x[0] if x[0] is not None else -1) < (i if i is not None else -1))]
        if not own:
            out.append((i, "missing", None, None))
            continue
        best = max(own, key=key)
        b = {k.lower(): v for k, v in (best[5] or {}).items()}
        plain = lambda e: e and e.removeprefix("W/")
        if "etag" in h:
            state = "resolved" if plain(h["etag"]) == plain(b.get("etag")) else "mismatch"
        elif "last-modified" in h:
            state = "resolved" if h["last-modified"] == b.get("last-modified") else "mismatch"
        elif digest is not None:
            state = "resolved" if digest == best[6] else "mismatch"
        else:
            state = "unverified"
        merged = b | {k: v for k, v in h.items() if k not in ("content-length", "connection")}
        out.append((i, state, best[0], tuple(sorted(merged.items()))) if state != "mismatch" else (i, state, None, None))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        url = rng.choice(["a.org/x", "a.org/y", "b.org", None]) if rng.random() < 0.5 else "hot.org/z"
        headers = {k: v for k, v in (("ETag", rng.choice(["1", "W/1", "2"])), ("LAST-modified", rng.choice("ab")), ("Content-Length", "0"), ("X", str(i))) if rng.random() < 0.5}
        kind = rng.choice(["response", "revisit", "request"])
        rows.append((i if i else None, url, rng.choice([None, rng.randrange(500_000)]) if i % 9 == 0 else rng.randrange(500_000) // 1000 * 1000, kind, rng.choice([200, 200, 404, None]) if kind == "response" else 304, headers if i % 11 else None, rng.choice(["d1", "d2", None]), i, f"body {i}", "clash"))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = resolve_revisits(frame, 20_000)
    key = lambda x: (x[0] is not None, x[0] or 0)
    result = sorted(((r.record_id, r.state, r.refers_to, tuple(sorted(r.headers.items())) if r.headers is not None else None) for r in got.collect()), key=key)
    assert result == sorted(brute(rows), key=key)
    again = sorted(((r.record_id, r.state, r.refers_to, tuple(sorted(r.headers.items())) if r.headers is not None else None) for r in resolve_revisits(frame).collect()), key=key)
    assert again == result
    whole = with_payload(got, frame).where("refers_to is not null").collect()
    assert whole and all(r.body == f"body {r.refers_to}" for r in whole)


def test_repeated_records(spark):
    """Each repeated revisit is resolved, and repeated responses change nothing."""
    response = (1, "a.org/x", 10, "response", 200, {"ETag": "1"}, "d1", 3, "b", "c")
    revisit = (2, "a.org/x", 20, "revisit", 304, {"ETag": "W/1", "X": "y"}, None, None, None, "c")
    lost = (None, None, None, "revisit", 304, None, None, None, None, None)
    got = resolve_revisits(spark.createDataFrame([response] * 3 + [revisit] * 4 + [lost] * 2, SCHEMA)).collect()
    assert sorted((r.state, r.refers_to or 0) for r in got) == [("missing", 0)] * 2 + [("resolved", 1)] * 4


def test_chunks_follow_the_busiest_url(spark):
    from corpusloom.llm.warc import CHUNK, chunk_seconds

    rows = [(i, f"WWW.a.org/x#{i}", i * 10, "revisit") for i in range(1000)] + [(5000, "b.org", 999_999, "revisit"), (5001, None, None, "revisit")]
    frame = spark.createDataFrame(rows, "record_id long, url string, at long, kind string")
    assert chunk_seconds(frame) == CHUNK and 900 <= chunk_seconds(frame, 100) <= 1000 and chunk_seconds(frame.where("url is null")) == CHUNK
    assert chunk_seconds(spark.createDataFrame([(i, "a", 5, "x") for i in range(50)], frame.schema), 7) == 1


def test_names_that_differ_in_case(spark):
    got = spark.createDataFrame([({"A": "1", "a": "2", "b": "3"},), (None,), ({},)], "h map<string,string>").select(lower_names(F.col("h")).alias("h")).collect()
    assert [r.h for r in got] == [{"a": "2", "b": "3"}, {}, {}]


def test_empty_table(spark, tables):
    assert op9_warc_revisits(spark, tables(pages=([], "page_id long, url string, html string"))).count() == 0
