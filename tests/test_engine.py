"""Micro-fixtures of single operators, the rule catalog, sources, sinks and the pipelines."""

import itertools
import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoweave import sources
from chronoweave.__main__ import main
from chronoweave.config import Config, read_jsonc, strip_comments, write_json
from chronoweave.functions import RELATIONS, concept_is, concept_like, duration, trapezoid
from chronoweave.operators import abstraction as A
from chronoweave.operators import cohort as C
from chronoweave.operators import intervals as I
from chronoweave.operators import mining as M
from chronoweave.plans.catalog import Catalog, parse
from chronoweave.plans.executor import evaluate

D0 = datetime(2020, 1, 1)
SCHEMA = "patient_id string, concept string, start_ts timestamp_ntz, end_ts timestamp_ntz, value string, value_num double"


def day(n):
    return D0 + timedelta(days=n)


def rows(spark, data):
    """(patient, concept, first day, last day, value)"""
    out = []
    for p, c, s, e, v in data:
        try:
            n = float(v)
        except (TypeError, ValueError):
            n = None
        out.append((p, c, day(s), day(e), None if v is None else str(v), n))
    return spark.createDataFrame(out, SCHEMA)


def got(df):
    return sorted((r["patient_id"], r["concept"], (r["start_ts"] - D0).days, (r["end_ts"] - D0).days, r["value"]) for r in df.collect())


def test_windows():
    ws = C.windows(2, 1, 2010, 2024, 1)
    assert len(ws) == 12 and ws[0] == C.Years(2010, 2012, 2012, 2013) and ws[-1] == C.Years(2021, 2023, 2023, 2024)
    assert len(C.windows(4, 2, 2000, 2024, 3)) == 9
    assert C.windows(2, 1, 2022, 2024) == [C.Years(2022, 2024)]
    assert C.select_windows(ws, index=2) == [ws[1]] and C.select_windows(ws, k_start=2015) == [ws[5]]
    with pytest.raises(ValueError):
        C.select_windows(ws, index=13)


def test_cohorts(spark):
    raw = spark.createDataFrame([("p1", "outcome", "2012-01-01", None, None), ("p2", " Outcome ", "2013-01-01 00:00:00", None, None), ("p3", "other", "2011-05-01", None, "x"), ("p4", "outcome", "bad", None, None)], sources.RAW)
    events, w = sources.events(raw), C.Years(2010, 2012, 2012, 2013)
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(C.yes_cohort(events, "outcome", w)) == ["p1"]
    assert ids(C.never_pool(events, "outcome")) == ["p3", "p4"]
    assert ids(C.never_pool(events, "outcome", dated_only=False)) == ["p3"]
    assert ids(C.all_cohort(events, w)) == ["p3"]
    pool = spark.createDataFrame([(str(i),) for i in range(40)], "patient_id string")
    assert C.control_sample_seeded(pool, 5, 42) == random.Random(42).sample(sorted(map(str, range(40)), key=lambda x: (len(x), x)), 5)
    assert C.control_sample(pool, spark.createDataFrame([(100,)], "n long"), 1).count() == 40
    labels = C.window_labels(events, "outcome", [w, C.Years(2000, 2002, 2002, 2003)], 3)
    assert sorted(map(tuple, labels.collect())) == [(2010, "NO", "p3"), (2010, "NO", "p4"), (2010, "YES", "p1")]


def test_concepts(spark):
    t = spark.createDataFrame([("EventXAlpha",), ("EVENT_ALPHA",), (" event_alpha ",)], "c string")
    assert [r[0] for r in t.select(concept_is(F.col("c"), "Event_Alpha")).collect()] == [False, True, True]
    assert [r[0] for r in t.select(concept_like(F.col("c"), "Event_Alpha")).collect()] == [True, True, False]


def test_dedup(spark):
    raw = spark.createDataFrame([("1", "a", "t", "t", "v"), ("1", "a", "t", "t", "v"), ("1", "a", "t", "t", "v ")], sources.RAW)
    assert C.exact_dedup(raw).count() == 2 and raw.count() == 3


def test_rows_carried_by_look_back_keep_microseconds(spark):
    t = datetime(2020, 1, 5, 10, 0, 0, 123456)
    row = lambda c, at, v: ("p", c, at, at, v, None)
    anchors = spark.createDataFrame([row("visit", t, None)], SCHEMA).withColumn("_row", F.struct("start_ts", "end_ts"))
    samples = spark.createDataFrame([row("lab", t - timedelta(microseconds=1), "7")], SCHEMA)
    got = A.last_before(anchors, samples).collect()
    assert [(r["_row"]["start_ts"], r["sample_ts"], r["sample_value"]) for r in got] == [(t, t - timedelta(microseconds=1), "7")]


def test_steady_time_as_an_interval(spark):
    data = rows(spark, [("p", "a", 0, 0, 1), ("p", "a", 10, 10, 9), ("p", "a", 30, 30, 20)])
    found = A.trend(data, "t", 5.0, F.make_interval(days=F.lit(14)))
    assert [(r[2], r[3], r[4]) for r in got(found)] == [(0, 10, "Increasing")]


def test_trend(spark):
    data = [("p", "x", d, d, v) for d, v in ((0, 50), (30, 56), (60, 57), (200, 90))] + [("q", "x", 0, 0, "High"), ("q", "x", 1, 1, "Low")]
    assert [(r[2], r[3], r[4]) for r in got(A.trend(rows(spark, data), "t", 5.0, 98))] == [(0, 30, "Increasing"), (30, 60, "Stable")]


def test_concatenate(spark):
    data = [("p", "c", 0, 5, "A"), ("p", "c", 10, 12, "A"), ("p", "c", 60, 61, "A")]
    assert got(I.concatenate(rows(spark, data))) == [("p", "c", 0, 12, "A"), ("p", "c", 60, 61, "A")]
    split = I.concatenate(rows(spark, [*data, ("p", "c", 7, 7, "B")]))
    assert got(split) == [("p", "c", 0, 5, "A"), ("p", "c", 7, 7, "B"), ("p", "c", 10, 12, "A"), ("p", "c", 60, 61, "A")]
    assert got(I.concatenate(split)) == got(split)


def test_persistence(spark):
    one = spark.createDataFrame([("p", "c", datetime(2024, 8, 31), datetime(2024, 8, 31), "1", 1.0)], SCHEMA)
    assert I.persist(one, (0, "month"), (6, "month")).first()["end_ts"] == datetime(2025, 2, 28)
    two = rows(spark, [("p", "c", 0, 0, 1), ("p", "c", 3, 3, 2)])
    assert got(I.persist(two, (1, "day"), (10, "day"))) == [("p", "c", -1, 3, "1"), ("p", "c", 2, 13, "2")]


def test_context(spark):
    ctx = A.induce(rows(spark, [("p", "i", 0, 1, "True"), ("p", "i", 0, 1, "False")]), "ctx", A.boundary("start", (0, "second")), A.boundary("end", (1, "year")), F.col("value") == "True")
    assert ctx.count() == 1
    clips = lambda *d: spark.createDataFrame([("p", day(x)) for x in d], "patient_id string, clip_ts timestamp_ntz")
    assert got(A.clip(ctx, clips(10, 20)))[0][3] == 10
    assert got(A.clip(ctx, clips(-1, 0)))[0][3] == 367


def test_last_before(spark):
    visit, lab = rows(spark, [("p", "visit", 100, 100, 1)]), rows(spark, [("p", "lab", 95, 95, 8), ("p", "lab", 99, 99, 9), ("p", "lab", 100, 100, 7)])
    assert A.last_before(visit, lab, True, (6, "month")).first()["sample_num"] == 9
    assert A.last_before(visit, lab, False).first()["sample_num"] == 7
    assert A.last_before(visit, lab.where("value = '8'"), True, (1, "day")).count() == 0


def test_trapezoid(spark):
    x = spark.createDataFrame([(0.0,), (8544.0,), (8545.0,), (-1.0,), (None,)], "x double")
    assert [r[0] for r in x.select(trapezoid(F.col("x"), 0, 0, 8544, 8544)).collect()] == [1.0, 1.0, 0.0, 0.0, None]


def test_relations(spark):
    data = [(0, 5, 5, 8, "b"), (0, 5, 3, 8, "o"), (0, 5, 2, 4, "c"), (0, 5, 0, 7, "c"), (0, 5, 0, 5, "c"), (0, 5, 2, 5, "c"), (5, 5, 5, 5, "c")]
    t = spark.createDataFrame(data, "a int, b int, c int, d int, want string")
    for r in t.withColumn("r", RELATIONS["Three"](F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect():
        assert r["r"] == r["want"]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=2, max_size=12))
def test_relations_are_total(spark, spans):
    spans = sorted((min(s), max(s)) for s in spans)
    pairs = [(*x, *y) for x, y in itertools.combinations(spans, 2)]
    t = spark.createDataFrame(pairs, "a int, b int, c int, d int")
    for kind in RELATIONS:
        assert t.where(RELATIONS[kind](F.col("a"), F.col("b"), F.col("c"), F.col("d")).isNull()).count() == 0


def brute_patterns(data, n, support, depth):
    """Frequent patterns by enumeration of all interval subsets of every patient."""
    by, need = {}, M.least_patients(support, n)
    for p, c, s, e, v in data:
        by.setdefault(p, []).append((s, e, f"{c}={v}"))
    rel = lambda x, y: "c" if x[0] == y[0] else "b" if y[0] >= x[1] else "o" if y[1] > x[1] else "c"
    out, known = {}, None
    for k in range(1, depth + 1):
        found = {}
        for p, xs in by.items():
            for combo in itertools.combinations(sorted(xs), k):
                name = combo[0][2] + "".join("|" + combo[j][2] + ":" + "".join(rel(combo[i], combo[j]) for i in range(j)) for j in range(1, k))
                found.setdefault(name, {}).setdefault(p, 0)
                found[name][p] += 1
        known = {name: ps for name, ps in found.items() if len(ps) >= need}
        out |= {(p, k, name): c for name, ps in known.items() for p, c in ps.items()}
    return out


def test_mining_against_enumeration(spark):
    r = random.Random(3)
    data = [(f"p{p}", c, s, s + r.randint(0, 6), r.choice("xy")) for p in range(5) for c in "AB" for s in r.sample(range(20), 3)]
    want = brute_patterns(data, 5, 0.4, 4)
    found = M.mine(rows(spark, data), 5, 0.4, 4)
    assert {(x["patient_id"], x["level"], x["pattern"]): x["horizontal"] for x in found.collect()} == want
    again = M.mine(rows(spark, data[::-1]).repartition(7), 5, 0.6, 4)
    assert {tuple(x)[:3] for x in again.collect()} <= set(want)
    cells, names = M.matrix(found, rows(spark, [*data, ("none", "A", 0, 0, "x")]))
    assert len(names) == len({w[2] for w in want}) and sum(next(x["cells"] for x in cells.collect() if x["id"] == "none")) == 0
    assert M.wide(cells, names).columns == ["id", *names]


def test_support_and_adjacency(spark):
    assert M.least_patients(0.2, 5) == 1 and M.least_patients(0.3, 5) == 2
    s = M.symbols(rows(spark, [("p", "A", 0, 1, "x"), ("p", "A", 2, 3, "x"), ("p", "B", 5, 6, "y")]))
    assert M.pair_support(M.pairs(s).where("a_symbol = 'A=x' AND b_symbol = 'B=y'"), 1).first()["instances"] == 2
    t = M.symbols(rows(spark, [("p", "A", 0, 1, "x"), ("p", "A", 2, 3, "z"), ("p", "B", 5, 6, "y")]))
    assert M.pairs(t, adjacency=True).where("a_symbol = 'A=x' AND b_symbol = 'B=y'").count() == 0
    assert M.pairs(t).count() == 3 and M.pairs(t, max_gap=(1, "day")).count() == 1


def test_wide_matrix_beyond_the_pivot_limit(spark):
    found = spark.range(10001).select(F.lit("p").alias("patient_id"), F.concat(F.lit("s"), "id").alias("pattern"), F.lit(1).alias("horizontal"))
    cells, names = M.matrix(found, found)
    assert len(names) == 10001 and sum(cells.first()["cells"]) == 10001


STATE = """<state id="5" name="sugar_state" concept-type="state"><temporal-semantic concatenable="true"/><derived-from><derived-from-id>22</derived-from-id></derived-from>
<mapping-function rank-selection-criteria="min"><mapping-functions-to-values>%s</mapping-functions-to-values></mapping-function></state>"""
CASE = '<mapping-function-2-value order="%d" value="%s"><evaluation-tree><comparison-function comparison-operator="smaller"><left><concept-id-allowed-values id="22"/></left><right><double>%s</double></right></comparison-function></evaluation-tree></mapping-function-2-value>'
RAW = '<numeric-raw-concept id="22" name="sugar"><temporal-semantic concatenable="false"/><numeric-allowed-values min-value="0" max-value="1000"/></numeric-raw-concept>'


def test_catalog(spark):
    cases = "".join(CASE % c for c in ((1, "Normal", 100), (0, "Low", 70), (2, "Pre", 126), (3, "High", 1000)))
    gone = '<context id="9" name="gone"><inducer-entities><inducer-entity id="777"/></inducer-entities></context>'
    cat = Catalog([parse(RAW), parse(STATE % cases), parse(gone)])
    assert cat.missing == [("9", "777")] and [len(x) for x in cat.levels] == [2, 1]
    data = [("p", "Sugar", 10 * k, 10 * k, v) for k, v in enumerate((69.9, 70, 100, 126, 5000))]
    made = evaluate(cat, rows(spark, data))
    assert [r[4] for r in got(made.where("concept = '5'"))] == ["Low", "Normal", "Pre", "High"]
    with pytest.raises(ValueError):
        Catalog([parse(STATE.replace(">22<", ">5<") % "")])
    with pytest.raises(ValueError):
        parse('<thing id="1" name="x"/>')


def test_rules_over_several_sources(spark):
    two = """<state id="30" name="both"><temporal-semantic concatenable="false"/><derived-from><derived-from-id>1</derived-from-id><derived-from-id>2</derived-from-id></derived-from><mapping-function><mapping-functions-to-values>
    <mapping-function-2-value order="0" value="True"><evaluation-tree><logical-function logical-operator="and"><operands><operand><comparison-function comparison-operator="equal"><left><concept-id-allowed-values id="1"/></left><right><string>yes</string></right></comparison-function></operand>
    <operand><comparison-function comparison-operator="bigger"><left><concept-id-allowed-values id="2"/></left><right><double>5</double></right></comparison-function></operand></operands></logical-function></evaluation-tree></mapping-function-2-value></mapping-functions-to-values></mapping-function></state>"""
    raw = '<nominal-raw-concept id="1" name="flag"><temporal-semantic/><nominal-allowed-values><nominal-allowed-value value="Yes"/></nominal-allowed-values></nominal-raw-concept>'
    num = '<numeric-raw-concept id="2" name="num"><temporal-semantic/></numeric-raw-concept>'
    clip = '<context id="40" name="ctx"><temporal-semantic/><inducer-entities><inducer-entity id="30"><value-constraints><value-constraint value="True" operator="equal"/></value-constraints><until boundary-point="end"><time-gap value="10" granularity="day"/></until></inducer-entity></inducer-entities><clippers><clipper-entity id="1"><clipper-value-constraints><clipper-value-constraint value="Yes" operator="equal"/></clipper-value-constraints><from boundary-point="start"><time-gap value="0" granularity="second"/></from></clipper-entity></clippers></context>'
    made = evaluate(Catalog([parse(x) for x in (two, raw, num, clip)]), rows(spark, [("p", "flag", 0, 10, "Yes"), ("p", "flag", 20, 20, "No"), ("p", "num", 5, 15, 6), ("p", "flag", 12, 12, "yes")]))
    assert got(made.where("concept = '30'")) == [("p", "30", 5, 10, "True"), ("p", "30", 12, 12, "True")]
    assert ("p", "40", 5, 12, "True") in got(made.where("concept = '40'"))


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('﻿{ // note\n "window": {"K": 2, "Y": 1, "END_DATE": "2024-10-08", "_note": "x"}, "cohort": {"OUTCOME_CONCEPT": "a//b"}, "mining": {"MVS": 0.3, "maxGap": 0, "timeUnit": "Days", "concepts": "1, 2"}}', encoding="utf-8")
    c = Config.from_file(p)
    assert c.window.end_year == 2024 and c.outcome == "a//b" and c.mining.max_gap is None and c.mining.concepts == ("1", "2") and c.mining.unit == "day"
    assert strip_comments('"a\\"//b" //c') == '"a\\"//b" ' and read_jsonc(p)["window"]["K"] == 2
    write_json(tmp_path / "m.json", c.to_mining_json(["1"]))
    assert json.loads((tmp_path / "m.json").read_text())["mvs"] == 0.3


def test_sources(spark, tmp_path):
    f = tmp_path / "raw_events.csv"
    f.write_text("﻿PatientID,ConceptName,StartTime,EndTime,Value\n 7 ,A,2020-01-02,,5\n,B,2020-01-01,,1\n8,C\n9,D,2020-01-02 03:04,2020-01-03,x\n10,E,,\n11,F,\n12,\"G,H\"\n", encoding="utf-8")
    e = {r["patient_id"]: r for r in sources.events(sources.raw_csv(spark, str(f))).collect()}
    assert set(e) == {"7", "9", "10", "11"} and e["10"]["start_ts"] is None and e["10"]["value"] is None  # three columns are enough
    assert e["7"]["end_ts"] == e["7"]["start_ts"] == datetime(2020, 1, 2) and e["7"]["value_num"] == 5 and e["9"]["value_num"] is None
    ids = tmp_path / "ids.txt"
    ids.write_text("3\n\n 1 \n1,2\n")
    assert sorted(r[0] for r in sources.id_list(spark, str(ids)).collect()) == ["1", "2", "3"]
    with pytest.raises(FileNotFoundError):
        sources.id_list(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        sources.require(spark, str(tmp_path / "none"), str(tmp_path))
    (tmp_path / "projects.csv").write_text("ProjectID,ProjectName,Kb_ID\n1,x,2\n")
    found = sources.require(spark, str(tmp_path), str(tmp_path))
    assert found["knowledge_table.csv"] is None and sources.projects(spark, found["projects.csv"]) == {1: 2}
    assert sources.data_dir(spark, str(tmp_path / "none"), str(tmp_path)) == (str(tmp_path), str(tmp_path / "none"))
    sources.write_id_list(spark.createDataFrame([("10",), ("9",)], "patient_id string"), str(tmp_path / "list"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "list")).collect()) == ["10", "9"]


def test_command_line(spark, tmp_path):
    events = ["PatientID,ConceptName,StartTime,EndTime,Value"]
    for p in range(6):
        events += [f"{p},A,2010-0{1 + p % 3}-01,2010-05-01,x", f"{p},B,2011-01-0{1 + p},2011-02-01,y"]
    events.append("0,out,2012-03-01,,1")
    (tmp_path / "raw_events.csv").write_text("\n".join(events) + "\n")
    (tmp_path / "c.json").write_text(json.dumps({"window": {"K": 2, "Y": 1, "STEP": 1, "START_YEAR": 2010, "END_DATE": "2013-01-01"}, "cohort": {"OUTCOME_CONCEPT": "out"}, "mining": {"MVS": 0.5}}))
    (tmp_path / "ids.txt").write_text("1\n2\n")
    base = ["--config", str(tmp_path / "c.json"), "--events", str(tmp_path / "raw_events.csv")]
    assert main([*base, "--out", str(tmp_path / "o")]) == 0
    found = sources.results(spark, str(tmp_path / "o"))
    assert [f.split("/")[-4] for f in found] == ["2010-2012_NO_patterns", "2010-2012_YES_patterns"]
    yes = spark.read.option("header", True).csv(found[1])
    assert yes.count() == 1 and "A=x|B=y:b" in yes.columns
    assert spark.read.parquet(str(tmp_path / "o/long")).select("label").distinct().count() == 2
    assert main([*base, "--out", str(tmp_path / "p"), "--mode", "list", "--ids", str(tmp_path / "ids.txt"), "--window", "1"]) == 0
    assert main([*base, "--out", str(tmp_path / "q"), "--mode", "all", "--k-start", "2010"]) == 0
    assert "2010-2012_ALL_patterns" in sources.results(spark, str(tmp_path / "q"))[0]
    assert main(["--config", str(tmp_path / "c.json"), "--events", str(tmp_path / "none"), "--out", "x"]) == 2


def test_duration_rejects_unknown_units():
    with pytest.raises(ValueError):
        duration(1, "fortnight")


def test_external_rules_and_random_sample(spark):
    cat = Catalog([parse(RAW), parse('<pattern id="50" name="ext"><temporal-semantic/><derived-from><derived-from-id>22</derived-from-id></derived-from><pattern-definition><components/></pattern-definition></pattern>')])
    double = lambda known: known.where("concept = '22'").withColumn("concept", F.lit("50")).withColumn("value_num", F.col("value_num") * 2)
    made = evaluate(cat, rows(spark, [("p", "sugar", 0, 0, 4)]), external={"50": double})
    assert made.where("concept = '50'").first()["value_num"] == 8
    pool = spark.range(50).select(F.col("id").cast("string").alias("patient_id"))
    assert C.random_sample(pool, 7).count() == 7 and C.random_sample(pool, 7, 3).count() == 7
