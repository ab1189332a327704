import itertools
import random

from corpusloom.llm.licenses import TEMPLATES, align, increasing, op5_license_scan, scan_licenses

SCHEMA = "doc_id long, text string, license string"


def test_longest_increasing_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        v = [rng.randrange(12) for _ in range(rng.randrange(9))]
        got = [v[i] for i in increasing(v)]
        best = max(n for n in range(len(v) + 1) for c in itertools.combinations(v, n) if all(a < b for a, b in zip(c, c[1:])))
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:]))


def test_alignment_is_increasing_and_equal():
    rng = random.Random(2)
    for _ in range(200):
        b = [rng.randrange(30) for _ in range(rng.randrange(40))]
        a = [x for x in b if rng.random() > 0.1] + [99]
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(align("a x b y c".split(), "a b c".split())) == 3
    assert len(align(list(range(100)), list(range(100)))) == 100


def prose(rng, n):
    return " ".join(rng.choice("the of and then an on eresou thetion ande with under is to version a".split()) for _ in range(n))


def test_planted_templates(spark):
    rng, rows, want = random.Random(3), [], {}
    for name, text in TEMPLATES.items():
        words = text.split()
        if len(words) > 20:
            words[7] = "changed"
            del words[15]
        i = len(rows)
        rows.append((i, prose(rng, 300) + "\n" + "  ".join(words).upper() + "\n" + prose(rng, 3000), "x"))
        want[i] = name
    clean = [None, "", "!!", prose(rng, 5000), "the License", "Released under"]
    rows += [(1000 + i, t, "x") for i, t in enumerate(clean)] + [(0, rows[0][1], None)]
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA), keep=("doc_id",)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in want:
            assert want[r.doc_id] in r.licenses.split("|") and r.coverage >= 0.8, want[r.doc_id]
            assert len(TEMPLATES[r.license].split()) <= len(rows[r.doc_id][1][r.start : r.stop].split()) + 3
        else:
            assert (r.license, r.coverage, r.licenses, r.start) == (None, 0.0, "", None)


def test_offsets_and_ties(spark):
    text = "éé » " + TEMPLATES["MIT notice"] + " " + TEMPLATES["CC-BY-NC-4.0 notice"]
    r = scan_licenses(spark.createDataFrame([(1, text, "")], SCHEMA)).first()
    assert r.licenses == "CC-BY-NC-4.0 notice|MIT notice" and r.license == "CC-BY-NC-4.0 notice" and text[r.start : r.stop] == "Licensed under CC BY-NC 4.0"


def test_empty_table(spark, tables):
    assert op5_license_scan(spark, tables(documents=([], "doc_id long, text string"))).count() == 0


def naive(a, b):
    """Patience alignment by plain recursion and an exhaustive longest chain of unique words."""
    if not a or not b:
        return 0
    if a[0] == b[0]:
        return 1 + naive(a[1:], b[1:])
    if a[-1] == b[-1]:
        return 1 + naive(a[:-1], b[:-1])
    unique = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]
    chains = [[] for _ in unique]
    for k, (_, y) in enumerate(unique):
        best = max((chains[m] for m in range(k) if unique[m][1] < y), key=len, default=[])
        chains[k] = [*best, unique[k]]
    chain = max(chains, key=len, default=[])
    if not chain:
        return 0
    total, i, j = len(chain), 0, 0
    for x, y in [*chain, (len(a), len(b))]:
        total += naive(a[i:x], b[j:y])
        i, j = x + 1, y + 1
    return total


def test_query_against_brute_force(spark, tables):
    import math

    from corpusloom.llm.licenses import EXACT, SPREAD, THRESHOLD
    from tests.llm.test_decontaminate import words

    rng, texts = random.Random(9), [None, "", "..."]
    for name, text in TEMPLATES.items():
        w = text.split()
        for damage in (0, 1, len(w) // 8, len(w) // 4):
            v = list(w)
            for _ in range(damage):
                v[rng.randrange(len(v))] = rng.choice(["other", "the", "license"])
            texts.append(prose(rng, 30) + " " + " ".join(v) + " " + prose(rng, 30))
    got = {r.doc_id: r for r in op5_license_scan(spark, tables(documents=([(i, t, "c") for i, t in enumerate(texts)], SCHEMA))).collect()}
    for i, t in enumerate(texts):
        own, found = words(t), []
        for name, text in TEMPLATES.items():
            v = words(text)
            least, width = len(v) if name in EXACT else math.ceil(THRESHOLD * len(v) - 1e-9), math.ceil(SPREAD * len(v))
            best = max((naive(own[a : a + width], v) for a in range(len(own)) if own[a] in v), default=0)
            if best >= least:
                found.append((-best / len(v), -best, name))
        share, n, name = min(found, default=(0.0, 0, None))
        assert (got[i].license, round(got[i].coverage, 9), got[i].n_matched) == (name, round(-share, 9), -n), t
        assert got[i].licenses == "|".join(sorted(f[2] for f in found))


def test_edited_short_notices_are_reported(spark):
    from corpusloom.llm.licenses import EXACT
    from tests.llm.test_decontaminate import words

    rng, rows = random.Random(11), []
    for name, text in TEMPLATES.items():
        own = words(text)
        if name in EXACT:
            for k in range(len(own)):
                for new in (["zzz"], [], [own[k], "zzz"]):
                    rows.append((len(rows), " ".join(own[:k] + new + own[k + 1 :]), name, len(own) - (own[k] not in new)))
    said = [("Licensed under the MIT License", "MIT notice", 4), ("Licensed under the Apache License, Version 2", "Apache-2.0 notice", 7)]
    rows += [(i, *x) for i, x in enumerate(said, len(rows))]
    docs = [(i, prose(rng, 40) + " qqq " * 30 + t + " qqq " * 30 + prose(rng, 40)) for i, t, _, _ in rows]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), keep=("doc_id",)).collect()}
    for i, t, name, n in rows:
        size, r = len(words(TEMPLATES[name])), got[i]
        near = dict(x.rsplit(":", 1) for x in r.near.split("|") if x)
        if n == size:
            assert name in r.licenses.split("|") and name not in near, t
        elif n >= 0.8 * size - 1e-9:
            assert name not in r.licenses.split("|") and abs(float(near[name]) - n / size) < 1e-6, t
            assert r.near_coverage >= n / size - 1e-9 and docs[i][1][r.near_start : r.near_stop] in t, t
        else:
            assert name not in near, t
    assert [got[len(rows) - 2 + i].near_license for i in range(2)] == [x[1] for x in said]


def test_sibling_licenses_are_told_apart(spark):
    gpl3 = TEMPLATES["GPL-3.0 header"]
    siblings = {
        "GPL-3.0 header": gpl3,
        "GPL-2.0 header": gpl3.replace("version 3", "version 2"),
        "AGPL-3.0 header": gpl3.replace("GNU General", "GNU Affero General"),
        "LGPL-3.0 header": gpl3.replace("GNU General", "GNU Lesser General"),
        "BSD-2-Clause": TEMPLATES["BSD-2-Clause"],
        "BSD-3-Clause": TEMPLATES["BSD-2-Clause"] + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
        "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX GPL-2.0-only": "# SPDX-License-Identifier: GPL-2.0-only",
        "SPDX GPL-2.0-or-later": "# SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX MIT": "// SPDX-License-Identifier: MIT",
        "SPDX CC-BY-NC-4.0": "SPDX-License-Identifier: CC-BY-NC-4.0",
    }
    rows = [(i, "some words first\n" + t + "\nand the rest") for i, t in enumerate(siblings.values())]
    got = {r.doc_id: r.license for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), keep=("doc_id",)).collect()}
    assert [got[i] for i in range(len(rows))] == list(siblings)


def test_whole_texts_beside_their_openings(spark):
    names = [x for x in TEMPLATES if x.endswith(" text")]
    short = [x.removesuffix(" text") for x in names]
    rows = [(i, "Copyright someone.\n" + TEMPLATES[x] + "\nint main;") for i, x in enumerate(names + short)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), keep=("doc_id",)).collect()}
    assert [got[i].license for i in range(len(rows))] == names + short
    assert all(x in got[i].licenses.split("|") for i, x in enumerate(short))


def test_a_template_has_its_own_share(spark):
    """The same long notice, seven of eight words right, counts or is near by its own share alone."""
    rows = [(1, "alpha beta gamma delta epsilon zeta eta wrong")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    template = {"a": "alpha beta gamma delta epsilon zeta eta theta"}
    for own, want in (({}, ("a", None)), ({"a": 0.9}, (None, "a"))):
        r = scan_licenses(frame, templates=template, own=own).first()
        assert (r.license, r.near_license) == want


def test_a_text_of_many_thousand_words(spark):
    rng = random.Random(8)
    text = prose(rng, 40_000) + " " + TEMPLATES["MIT text"] + " " + prose(rng, 40_000)
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.license, r.coverage) == ("MIT text", 1.0)
