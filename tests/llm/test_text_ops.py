"""Toxicity, line templates, personal data, decontamination and licences on small fixtures."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import decontam, licenses, line_templates, pii, toxicity

from .util import clashing, docs, prose

LABELS = "doc_id long, quality int, toxic int"


def toxic_corpus(n=400):
    r = random.Random(9)
    out, labels = [], []
    for i in range(n):
        bad = r.random() < 0.3
        w = prose(r, r.randrange(5, 60), 300).split()
        for _ in range(3 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["vile", "Scum!", "awful-thing"]))
        out.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return out, labels


def test_toxicity_learns(spark):
    texts, labels = toxic_corpus()
    got = toxicity.toxicity(docs(spark, [*texts, (5000, None), (5001, ""), (5002, "scum " * 30000), (None, "fine")]), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], LABELS)).collect()
    by = {r["doc_id"]: r for r in got}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in by.items() if i is not None and i < 400 and r["held_out"]} == set(held) and not by[None]["held_out"]
    right = sum(by[i]["predicted"] == labels[i][2] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert by[5000]["score"] == by[5001]["score"] < 0.5 < by[5002]["score"]


def test_toxicity_ignores_held_out_labels(spark):
    texts, labels = toxic_corpus(200)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(docs(spark, texts), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, flip))
    assert a == b


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in toxicity.toxicity(clashing(docs(spark, [(1, "x"), (1, "x")])), none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs(spark, [(1, "x")]).limit(0), none).count() == 0


def test_ftrl_is_sparse():
    r = np.random.default_rng(0)
    data, label = [], {}
    for i in range(300):
        label[i] = int(i % 3 == 0)
        data.append((i, np.unique(np.concatenate([r.integers(100, 1 << 20, 30), [7] if label[i] else [9]])).astype(np.int32)))
    at, w, _ = toxicity._ftrl(data, label, 1.0)
    assert len(at) < 50 and w[list(at).index(7)] > 0


def lines_corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 7)))
    prose = lambda r, n, _: " ".join(word() for _ in range(n))
    out = []
    for i in range(30):
        body = [prose(r, 12, 5000) for _ in range(4)]
        body.insert(r.randrange(5), f"Page {i} of {100 + i} | all rights to the reader {i}")
        if i < 3:
            body.insert(2, "seen in three documents only, so it stays")
        body.append("short line")
        out.append((i, "\n".join(body)))
    copy = "\n".join(prose(r, 12, 5000) for _ in range(4))
    return out + [(100 + i, copy) for i in range(8)] + [(200, ""), (201, None), (202, "\n\n"), *[(300 + i, f"{i} {i} {i} {i} {i}\n{word()} {word()} {word()} {word()}") for i in range(9)], (203, "Page 7 of 107 | all rights to the reader 7")]


def test_lines(spark):
    pairs = lines_corpus()
    got = {r["doc_id"]: r for r in line_templates.drop_lines(docs(spark, pairs)).collect()}
    for i, t in pairs:
        keep = [x for x in (t or "").split("\n") if not x.startswith("Page ")]
        gone = len((t or "").split("\n")) - len(keep) if t else 0
        assert got[i]["n_dropped"] == gone and got[i]["n_lines"] == (len(t.split("\n")) if t else 0), i
        assert got[i]["text"] == (t if not gone else "\n".join(keep)), i


def word_lines(r, n):
    return [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(4, 8))) for _ in range(10)) for _ in range(n)]


def test_lines_in_blank_separated_runs_amid_copies(spark):
    """Templates of several lines, amid blank lines, and in a hot group of copies and near copies."""
    r = random.Random(12)
    footer = ["this footer is the same in all of the papers", "and so is its second line of plain words", "with a third one that closes it for good"]
    pairs = [(i, "\n\n".join([*word_lines(r, 3), *footer, *word_lines(r, 2)])) for i in range(12)]
    hot = word_lines(r, 8)
    pairs += [(100 + i, "\n\n".join([*hot, *footer])) for i in range(30)]
    pairs += [(200 + i, "\n\n".join([*hot[:4], word_lines(r, 1)[0], *hot[5:], *footer])) for i in range(30)]
    got = {x["doc_id"]: x for x in line_templates.drop_lines(docs(spark, pairs)).collect()}
    for i, t in pairs:
        assert got[i]["n_dropped"] == 3 and got[i]["text"] == "\n".join(x for x in t.split("\n") if x not in footer), i


def test_long_lines_count_from_two_documents_on(spark):
    """A passage of over 50 words in two or three documents stays in the first only; copies stay whole."""
    r = random.Random(13)
    long = [" ".join(word_lines(r, 6)) for _ in range(3)]
    pairs = [(i, "\n".join([*word_lines(r, 6), long[k], *word_lines(r, 6)])) for i, k in enumerate([0, 0, 1, 1, 1, 2])]
    copy = "\n".join([" ".join(word_lines(r, 6)), *word_lines(r, 6)])
    pairs += [(10, copy), (11, copy), (12, copy.rsplit("\n", 1)[0] + "\n" + word_lines(r, 1)[0])]
    got = {x["doc_id"]: x["n_dropped"] for x in line_templates.drop_lines(docs(spark, pairs)).collect()}
    assert {i for i, n in got.items() if n} == {1, 3, 4} and max(got.values()) == 1


def test_lines_with_names_among_the_leading_tokens(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    pairs = [(i, "\n".join([*word_lines(r, 3), f"written by {word()} {word()} for the daily news desk of our paper", *word_lines(r, 2)])) for i in range(40)]
    assert [x["n_dropped"] for x in line_templates.drop_lines(docs(spark, pairs)).collect()] == [1] * 40


def test_counts_of_line_tokens_travel_packed():
    """A row a piece and pass, not a row a token, goes to where the counts are added up."""
    r = random.Random(15)
    pairs = [(i, "\n".join(word_lines(r, 20))) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs])], names=["doc_id", "text"])
    made = list(line_templates._constants(np.full(1 << 23, 255, np.uint8))(iter([batch])))
    assert 0 < sum(b.num_rows for b in made) <= 1024


def test_lines_do_not_depend_on_chance_hits(spark, monkeypatch):
    """Bitmaps of a few bits hold most keys by chance."""
    pairs = lines_corpus()
    whole = {x["doc_id"]: x["text"] for x in line_templates.drop_lines(docs(spark, pairs)).collect()}
    for bits in (3, 5):
        monkeypatch.setattr(line_templates, "MAP_BITS", bits)
        assert {x["doc_id"]: x["text"] for x in line_templates.drop_lines(docs(spark, pairs)).collect()} == whole


def test_lines_edges(spark):
    assert line_templates.drop_lines(docs(spark, [(1, "x")]).limit(0)).count() == 0
    df = clashing(docs(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")])).withColumn("n_lines", F.lit(9))
    out = line_templates.drop_lines(df)
    assert sorted(r["n_lines"] for r in out.collect()) == [1, 1, 1] and set(df.columns) <= set(out.columns)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(s):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, s):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def pii_texts():
    r = random.Random(11)
    fixed = ["a@b.c_d@e.f", "x@@y@z.w 1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.255", "+1 (826) 555-4081 190.137.223.204 4111111111111111 4012888888881881", "4111 1111 1111 1111 4111-1111-1111-1111", "é😀é a.b@c.d 4111111111111111", "+49 123 4567 8 +", "5", "+1234567 +12345678", "", None, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "0" * 16, 'token = "2d36530ff989cdbaf29243955fc930be3d922f7b"', "a@b a@b. @ a@-.-"]
    noise = ["".join(r.choice("a1.@+- 45()é") for _ in range(60)) for _ in range(150)]
    return list(enumerate(fixed + noise))


def test_pii_base_spans(spark):
    pairs = pii_texts()
    got = {r["doc_id"]: r for r in pii.summary(pii.find(docs(spark, pairs))).collect()}
    for i, t in pairs:
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        spans = [x for x in got[i]["spans"].split(",") if x]
        assert set(want) <= set(spans)
        for k in PATTERNS:
            assert got[i][f"n_{k}"] == sum(x.startswith(k) for x in want)
        order = [(pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in spans]
        assert order == sorted(order)


def test_pii_adds_what_the_patterns_run_together(spark):
    t = "call +1 (826) 555-4081 190.137.223.204 or pay 4111111111111111 4012888888881881 now"
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.summary(pii.find(docs(spark, [(1, t), *[(10 + i, f"card 4111111111111111 x{i}") for i in range(20)]]))).collect()}
    cards = [x for x in got[1] if x.startswith("card")]
    assert [t[int(x.split(":")[1]): int(x.split(":")[2])] for x in cards] == ["4111111111111111", "4012888888881881"]


def test_pii_edges(spark):
    assert pii.summary(pii.find(docs(spark, [(1, "x")]).limit(0))).count() == 0
    assert pii.summary(pii.find(clashing(docs(spark, [(1, "a@b.c"), (1, "a@b.c"), (None, None)])))).count() == 3
    long = {1: "1" * 100_000, 2: "x" * 100_000 + "@", 3: "a@b.c " * 3000, 4: "1 " * 50_000, 5: "+1" + " 2" * 40_000}
    got = {r["doc_id"]: r for r in pii.summary(pii.find(docs(spark, list(long.items())))).collect()}
    assert got[3]["n_email"] == 3000 and sum(got[i][f"n_{k}"] for i in (1, 2, 4, 5) for k in PATTERNS) == 0


def test_reliabilities_tell_labelers_apart():
    patterns = {"card:++0++:2ds": 500, "card:-+0--:2ds": 400, "card:+-0++:2ds": 30, "card:-0---:2ds": 60}
    p = pii.reliabilities(patterns)
    assert p["card:++0++:2ds"] > 0.9 > 0.1 > p["card:-0---:2ds"]
    s = pii.classifier(patterns, p)
    assert s["card:++0++:2ds"] > 0.5 > s["card:-0---:2ds"]


def test_reliabilities_against_single_spans():
    """The same expectation-maximisation with a row for every span instead of a table of votes."""
    r = random.Random(3)
    rows = ["".join(r.choice("++0" if real and j != 2 else "--0+") for j in range(5)) for real in [True] * 80 + [False] * 50]
    post = [0.9 if v.count("+") > v.count("-") else 0.1 for v in rows]
    for _ in range(40):
        prior = (1 + sum(post)) / (2 + len(rows))
        rate = [[{c: ((4.0 if c == own else 1.0) + sum(p if side else 1 - p for v, p in zip(rows, post, strict=True) if v[j] == c)) for c in "+-0"} for side, own in ((0, "-"), (1, "+"))] for j in range(5)]
        rate = [[{c: x / sum(w.values()) for c, x in w.items()} for w in both] for both in rate]
        odds = [math.log(prior / (1 - prior)) + sum(math.log(rate[j][1][v[j]] / rate[j][0][v[j]]) for j in range(5)) for v in rows]
        post = [1 / (1 + math.exp(-max(-60, min(60, o)))) for o in odds]
    patterns = {}
    for i, v in enumerate(rows):
        key = f"card:{v}:{i % 3}ds"
        patterns[key] = patterns.get(key, 0) + 1
    got = pii.reliabilities(patterns)
    for i, (v, p) in enumerate(zip(rows, post, strict=True)):
        assert abs(got[f"card:{v}:{i % 3}ds"] - p) < 1e-9


def test_pii_added_spans_by_hand(spark):
    """Proposals of a fixture found with a plain scan; those of accepted patterns are the added spans."""
    t = ["write to jane(at)example.org now", 'password = "hunter2hunter2hunter2X9"', "ids 1.2.3.4.5.6.7.8 and 4111 1111 1111 1111", "nothing here"]
    t += [f"mail: p{i}[at]site.net" for i in range(30)]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, list(enumerate(t)))).collect()}
    for i, x in enumerate(t):
        want = {("email", m.start(), m.end()) for m in re.finditer(r"[a-z0-9]+(?:\(at\)|\[at\])[a-z]+\.[a-z]+", x)}
        want |= {("secret", m.start(), m.end()) for m in re.finditer(r"hunter2hunter2hunter2X9", x)}
        added = {(s["kind"], s["s"], s["e"]) for s in got[i]["added"]}
        assert added <= want and (added == want or i == 1), x
        for a in added:
            assert not any(b["kind"] == a[0] and b["s"] < a[2] and a[1] < b["e"] for b in got[i]["base"])


def test_pii_of_a_log_is_linear(spark):
    """Many blocks of matches keep exact offsets."""
    x = "".join(f"10.0.{i % 250}.{i % 199} é user{i}@host.org, " for i in range(6000))
    row = pii.summary(pii.find(docs(spark, [(1, x)]))).collect()[0]
    assert row["n_email"] == row["n_ip"] == 6000
    assert row["base_sha256"] == hashlib.sha256(",".join(base_spans(x)).encode()).hexdigest()


def lcs_tiles(a, b, least):
    """Greedy string tiling by plain search."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return sum(out)
        for x in range(k):
            ma[i + x] = mb[j + x] = True
        out.append(k)


def test_tiles_against_plain_search():
    r = np.random.default_rng(2)
    for _ in range(60):
        item = r.integers(0, 12, int(r.integers(3, 30))).astype(np.uint64)
        cut = int(r.integers(0, len(item)))
        doc = np.concatenate([r.integers(0, 12, int(r.integers(0, 20))).astype(np.uint64), item[cut:], r.integers(0, 12, 4).astype(np.uint64), item[:cut]])
        found = decontam.tiles(doc, item, 3)
        assert sum(t[2] for t in found) == lcs_tiles(doc.tolist(), item.tolist(), 3)
        for a, b, k in found:
            assert (doc[a: a + k] == item[b: b + k]).all() and k >= 3


def test_decontamination(spark, monkeypatch):
    r = random.Random(8)
    items = [(i, prose(r, 40, 3000)) for i in range(5)] + [(7, "so few words"), (8, ""), (9, None)]
    w = items[0][1].split()
    pairs = [
        (1, prose(r, 60, 3000) + " " + items[1][1].upper() + "!! " + prose(r, 9, 3000)), (2, " ".join(w[25:] + ["x"] + w[:25])), (3, " ".join(w[:15])), (4, prose(r, 500, 3000)),
        (5, "well, so few words it is"), (6, None), (7, ""), (8, items[2][1] + " " + items[3][1]), (9, "SO, FEW; WORDS"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontam.contaminated(clashing(docs(spark, pairs)), bench).collect()}
    assert set(got) == {(1, 1), (2, 0), (5, 7), (8, 2), (8, 3), (9, 7)}
    assert got[2, 0]["n_tiles"] == 2 and got[2, 0]["coverage"] == 1.0
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 20)
    assert {(x["doc_id"], x["item_id"]) for x in decontam.contaminated(docs(spark, pairs), bench).collect()} == set(got)
    assert decontam.contaminated(docs(spark, pairs).limit(0), bench).count() == 0 and decontam.contaminated(docs(spark, pairs), bench.limit(0)).count() == 0


def test_sharp_s_and_capitals(spark):
    bench = spark.createDataFrame([(1, "die große Straße führt über Österreich nach Süden")], "item_id long, text string")
    assert decontam.contaminated(docs(spark, [(1, "DIE GROSSE STRASSE FÜHRT ÜBER ÖSTERREICH NACH SÜDEN")]), bench).count() == 1


FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.txt", "code"), (3, "a/b/c/y.txt", "more code"), (4, "a/b/z.txt", "text\n# Licensed under the Apache License, Version 2.0!!\nmore text of the file, with as many words as it takes to be no licence file"),
    (5, "other/q.txt", "nothing"), (6, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, "a/b/c/d/w.txt", None), (8, None, "Licensed under CC BY-NC 4.0."), (9, "ab/v.txt", ""),
    (10, "other/r.txt", "a licence to fish is needed in the county of the river and the lake"), (2, "a/x.txt", "code"),
]


def cosine(line):
    """The best template of a line by plain TF-IDF over FILES."""
    import math

    terms = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    templates = licenses._template_terms()
    known = {w for t in templates.values() for w in t}
    df = {w: sum(w in terms(t) for _, _, t in FILES) for w in known}
    idf = lambda w: math.log((1 + len(FILES)) / (1 + df.get(w, 0))) + 1
    a = {w: terms(line).count(w) * idf(w) for w in terms(line)}
    best = []
    for (name, _), t in templates.items():
        b = {w: n * idf(w) for w, n in t.items()}
        best.append((-sum(a[w] * b[w] for w in a if w in b) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), name))
    return min(best)


def test_licences(spark):
    df = clashing(spark.createDataFrame(FILES, "doc_id long, path string, text string").repartition(3))
    rows = licenses.scan(df).collect()
    got = {r["doc_id"]: (r["license"], r["origin"], r["directory"]) for r in rows}
    assert len(rows) == len(FILES)
    assert got == {1: ("MIT", "file", None), 2: ("MIT", "inherited", "a"), 3: ("GPL-3.0", "inherited", "a/b"), 4: ("Apache-2.0", "header", None), 5: (None, None, None), 6: ("GPL-3.0", "file", None), 7: ("GPL-3.0", "inherited", "a/b"), 8: ("CC-BY-NC-4.0", "file", None), 9: (None, None, None), 10: (None, None, None)}
    score, name = cosine("# Licensed under the Apache License, Version 2.0!!")
    mine = next(r for r in rows if r["doc_id"] == 4)
    assert mine["license"] == name and mine["score"] == pytest.approx(-score, abs=1e-6)
    assert licenses.scan(df.limit(0)).count() == 0


def test_licences_of_repeated_rows(spark):
    """Equal rows are one file; rows of one key with unlike texts are files of their own."""
    body = "Released under the MIT License.\n\n" + "plain words of a text that is no licence file " * 3
    rows = [(1, "a/x.txt", body)] * 3 + [(2, "a/y.txt", "code"), (3, "b/z.txt", "code"), (3, "b/z.txt", "Licensed under CC BY 4.0.")]
    got = sorted((r["doc_id"], r["license"] or "", r["origin"] or "") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == [(1, "MIT", "header")] * 3 + [(2, "", ""), (3, "CC-BY-4.0", "file"), (3, "CC-BY-4.0", "inherited")]


def test_licences_by_name(spark):
    texts = {
        "ISC": "ISC License\n\nCopyright (c) 2020 Jane Doe\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies.",
        "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any means.",
        "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.",
    }
    files = [(i, f"{i}/COPYING", t) for i, t in enumerate(texts.values())] + [(100 + i, f"z/{i}.py", f"some of the code and the text of file {i} for the user") for i in range(40)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(3)] == list(texts)


def test_licences_of_blocks_tags_and_titles(spark):
    gpl = licenses.LONGER["GPL-3.0"][-1].split()
    wrapped = "\n".join("# " + " ".join(gpl[i: i + 9]) for i in range(0, len(gpl), 9))
    plain = [(100 + i, f"x/{i}.txt", "see the details for more, all in the file, by one of you") for i in range(60)]
    files = [(1, "a/x.py", "# SPDX-License-Identifier: Apache-2.0\n\ncode"), (2, "b/LICENSE", "Apache License\n\nterms"), (3, "c/x.py", wrapped + "\n\nimport os"), (4, "d/x.py", " ".join(gpl)),
             (5, "e/x.py", "Copyright (c) 2019 Jane Doe. Licensed under the MIT License, see LICENSE for details.")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(files + plain, "doc_id long, path string, text string")).collect()}
    assert [got[i] for i in range(1, 6)] == ["Apache-2.0", "Apache-2.0", "GPL-3.0", "GPL-3.0", "MIT"]
    assert not any(got[i] for i, _, _ in plain)
