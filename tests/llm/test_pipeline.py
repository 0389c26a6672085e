"""The pipeline's stages against plain versions of each, and the registered queries."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronoweave.llm import queries as Q

from .test_jaccard import brute
from .util import DOCS, docs

pytest.importorskip("public_tokenizers")


def corpus():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 8)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(9)) for _ in range(n))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(4)]
    out = []
    for i in range(120):
        t = text(5)
        if i % 3 == 0:
            t += "\n" + "vile scum " * 3
        if i % 4 == 1:
            t += "\nthis site uses cookies to keep you happy"
        if i % 20 == 7:
            t += "\n" + items[i % 4][1]
        out.append((i, t))
    out += [(200 + i, out[2][1].replace(out[2][1].split()[3], "changed", 1)) for i in range(3)] + [(300, None), (301, ""), (302, out[5][1])]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(120)]
    return out, items, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    pairs, items, labels = corpus()
    docs(spark, pairs).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    pairs, items, _ = corpus()
    text = dict(pairs)
    frame, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        frame = f(spark, frame, sf_dir)
        seen[name] = {r["doc_id"]: r for r in frame.collect()} if name != "packing" else frame.collect()
        if name != "packing":
            assert frame.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert set(seen["toxicity"]) == {i for i in text if i >= 120 or i % 3}
    cookie = "\nthis site uses cookies to keep you happy"
    want = {i: text[i] and text[i].replace(cookie, "") for i in seen["toxicity"]}
    assert {i: r["text"] for i, r in seen["line_dedup"].items()} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in seen["line_dedup"].values())
    keep = {i for i, _, c in brute(list(want.items())) if i == c}
    assert set(seen["ngram_jaccard"]) == keep and 302 not in keep and 201 not in keep
    leaks = {i for i in keep if want[i] and any(t in want[i] for _, t in items)}
    assert leaks and set(seen["decontamination"]) == keep - leaks
    assert {r["doc_id"] for r in seen["packing"]} == keep - leaks
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length").collect())) == sorted(str(r) for r in frame.select("doc_id", "start", "length").collect())


def test_stages_take_edges(spark, sf_dir):
    for rows in ([], [(1, None)], [(1, "a"), (1, "a"), (None, "b")]):
        frame = docs(spark, rows) if rows else docs(spark, [(1, "x")]).limit(0)
        for name, f in corpus_pipeline.STAGES:
            frame = f(spark, frame, sf_dir)
        assert frame.count() == len(rows)


def test_registered_queries(spark):
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


@pytest.mark.parametrize("name", [n for n in Q.queries() if n not in ("op2_suffix_dedup",)])
def test_queries_run(spark, name):
    df = Q.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.agg(F.count("*")).first()[0] > 0
