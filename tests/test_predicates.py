"""Predicates over four runs with loosely typed fields."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import predicates as Q
from tideline.functions import values as V

RUNS = [
    ("a", "ppo_seed0", "sweep/ppo_seed0", "finished", ["baseline", "v2"], '{"lr": 0.001, "seed": 0, "algo": "PPO", "flag": true, "notes": "first"}', '{"loss": 0.25}'),
    ("b", "ppo_seed1", "sweep/ppo_seed1", "running", ["v2"], '{"lr": 0.0015, "seed": 1, "algo": "PPO", "flag": false}', '{"loss": "nan"}'),
    ("c", "sac_seed0", "other/sac_seed0", "crashed", [], '{"lr": 0.01, "seed": 0, "algo": "SAC", "steps": 100}', '{"loss": 1.5}'),
    ("d", "sac_debug", "other/sac_debug", "finished", None, '{"lr": "1e-3", "seed": 2, "algo": "sac", "steps": 1000, "opt/name": "adam\'s"}', '{"loss": "inf"}'),
]
f = V.field
CASES = [
    (lambda: Q.eq(f("lr"), 0.001), "ad"),
    (lambda: Q.ne(f("lr"), 0.001), "bc"),
    (lambda: Q.gt(f("lr"), 0.001), "bc"),
    (lambda: Q.ge(f("lr"), 0.0015), "bc"),
    (lambda: Q.lt(f("lr"), 0.01) & Q.gt(f("lr"), 0.001), "b"),
    (lambda: Q.eq(f("steps"), 100), "c"),
    (lambda: Q.matches(f("steps"), "^100$"), "c"),
    (lambda: Q.matches(f("steps"), "100"), "cd"),
    (lambda: Q.isin(f("seed"), 0, 2), "acd"),
    (lambda: ~Q.isin(f("seed"), 0, 2), "b"),
    (lambda: Q.eq(f("algo"), "PPO"), "ab"),
    (lambda: Q.like(f("algo"), "sac"), "cd"),
    (lambda: Q.like(f("algo"), "p_o"), "ab"),
    (lambda: ~Q.like(f("name"), "%seed%"), "d"),
    (lambda: Q.matches(f("name"), "SEED[01]"), "abc"),
    (lambda: Q.like(f("path"), "other/%") | Q.eq(f("algo"), "PPO") & Q.eq(f("seed"), 1), "bcd"),
    (lambda: ~Q.eq(f("algo"), "PPO") & ~Q.eq(f("seed"), 2), "c"),
    (lambda: Q.eq(f("tags"), "v2"), "ab"),
    (lambda: Q.ne(f("tags"), "v2"), "cd"),
    (lambda: Q.is_missing(f("tags")), "d"),
    (lambda: Q.is_present(f("notes")), "a"),
    (lambda: Q.eq(f("notes"), None), "bcd"),
    (lambda: Q.ne(f("missing"), 3), "abcd"),
    (lambda: Q.gt(f("missing"), 3), ""),
    (lambda: Q.lt(f("loss"), 1), "a"),
    (lambda: Q.gt(f("loss"), 1), "cd"),
    (lambda: Q.eq(f("loss"), "nan"), ""),
    (lambda: Q.eq(f("loss"), "inf"), "d"),
    (lambda: Q.gt(f("loss"), 1e308), "d"),
    (lambda: Q.lt(f("loss"), "inf"), "ac"),
    (lambda: Q.eq(f("flag"), True), "a"),
    (lambda: Q.ne(f("flag"), True), "bcd"),
    (lambda: Q.isin(f("state"), "running", "crashed"), "bc"),
    (lambda: Q.gt(f("name"), "ppo_seed1"), "cd"),
    (lambda: Q.eq(f("opt/name"), "adam's"), "d"),
    (lambda: Q.search("sac"), "cd"),
    (lambda: Q.search("SEED1"), "b"),
    (lambda: Q.search("seed["), ""),
    (lambda: Q.which("finished"), "acd"),
    (lambda: V.in_scope("path", "other"), "cd"),
    (lambda: Q.focus((f("algo"), "PPO"), (f("notes"), "∅")), "b"),
]


@pytest.fixture(scope="module")
def runs(spark):
    df = spark.createDataFrame(RUNS, "run string, name string, path string, state string, tags array<string>, config string, summary string")
    return df.withColumns({"config": F.from_json("config", "map<string,variant>"), "summary": F.from_json("summary", "map<string,variant>"), "info": F.parse_json(F.lit('{"git": {"sha": "abc"}, "a.b": 1}'))}).cache()


def test_cases(runs):
    flags = runs.select("run", *(case().alias(f"t{i}") for i, (case, _) in enumerate(CASES))).collect()
    for i, (_, expected) in enumerate(CASES):
        assert "".join(sorted(r["run"] for r in flags if r[f"t{i}"])) == expected, i
        assert all(r[f"t{i}"] is not None for r in flags), i


def test_fields(runs):
    r = runs.where("run = 'd'").select(V.text_of(f("info.git.sha")), V.as_number(f("info.a.b")), V.text_of(f("lr")), V.as_number(f("lr")), V.as_number(f("m.loss"))).first()
    assert tuple(r) == ("abc", 1.0, "1e-3", 0.001, float("inf"))
    assert runs.where("run = 'a'").select(V.text_of(f("tags"))).first()[0] == '["baseline","v2"]'


def test_numbers_and_texts(spark):
    texts = spark.createDataFrame([(" +1.5e3 ",), ("1.",), (".5",), ("Infinity",), ("1d",), ("nan",), ("",), (None,)], "t string")
    found = [r[0] for r in texts.select(V.number_of_text("t")).collect()]
    assert found[:5] == [1500.0, 1.0, 0.5, None, None] and found[5] != found[5] and found[6:] == [None, None]
    numbers = [1e21, 0.001, 1e-5, 3.0, 123456789.25, 0.0001, 1e16, -2.5, float("inf"), 12345678.5, 0.00025, 1.5e-7]
    shown = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").orderBy("i").select(V.text_of_number("x")).collect()]
    assert shown == ["1e+21", "0.001", "1e-05", "3", "123456789.25", "0.0001", "1e+16", "-2.5", "inf", "12345678.5", "0.00025", "1.5e-07"]


def test_level_for(spark):
    import math

    cases = [256 * 2.0**k for k in range(-19, 60, 3)]
    spans = [x for c in cases for x in (math.nextafter(c, 0), c, math.nextafter(c, math.inf))] + [0.0, -1.0]
    found = spark.createDataFrame([(i, s) for i, s in enumerate(spans)], "i int, s double").orderBy("i").select(V.level_for("s")).collect()
    for s, (level,) in zip(spans, found, strict=True):
        assert level == (min(k for k in range(-20, 63) if 256 * 2.0**k >= s) if s > 0 else 0), s


def test_paths(spark):
    r = spark.sql("SELECT 'a/b/c' AS p").select(V.parent("p"), V.ancestor("p", 9), V.relative("p", "a"), V.relative("p", "a/b/c"), V.ancestors("p"), V.section_of("p"), V.natural_key(F.lit("Seed10"))).first()
    assert tuple(r)[:4] == ("a/b", "", "b/c", ".") and r[4] == ["", "a", "a/b", "a/b/c"] and r[5] == "a/b" and r[6] == "seed" + "10".rjust(20, "0")
