import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.errors import PredicateError, PredicateTypeError
from lodestone.plans import predicate as P

PAGES = [("en", 0.9, "https://nyt.com/a"), ("en", 0.5, "https://example.com/b"), ("la", 0.3, "https://nyt.com/c"), ("en", 0.8, "https://example.com/d"), ("fr", 0.7, "https://lemonde.fr/e")]
NULLS = [(1, "x", 0.9), (2, "y", 0.4), (3, "z", None), (4, "y", 0.7)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(PAGES)], "k int, lang string, qs double, url string").cache()


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(NULLS)], "k int, a int, b string, q double").cache()


def hits(df, text):
    return sorted(r.k for r in P.where(df, text).collect())


@pytest.mark.parametrize("text, want", [("lang = 'en'", [0, 1, 3]), ("qs >= 0.7", [0, 3, 4]), ("lang IN ('la', 'fr')", [2, 4]), ("url LIKE '%nyt.com%'", [0, 2]), ("lang = 'en' AND qs >= 0.8", [0, 3]), ("lang = 'la' OR qs > 0.85", [0, 2]), ("missing_col = 'x'", []), ("missing_col != 'x'", [0, 1, 2, 3, 4]), ("LANG = 'en'", []), ("lang = 1", []), ("lang != 1", [0, 1, 2, 3, 4]), ("url LIKE 'https://___.com/_'", [0, 2]), ('lang = "en" and not qs < 0.6  ', [0, 3])])
def test_pages(pages, text, want):
    assert hits(pages, text) == want


@pytest.mark.parametrize("text, want", [("NOT (a = 1)", [1, 2, 3]), ("NOT (a > 1 AND b = 'y')", [0, 2]), ("a BETWEEN 2 AND 3", [1, 2]), ("q BETWEEN 0.5 AND 1.0", [0, 3]), ("q IS NULL", [2]), ("q IS NOT NULL", [0, 1, 3]), ("q != 0.9", [1, 2, 3]), ("NOT (q > 0.5)", [1, 2]), ("q = NULL", [2]), ("q IN (0.4, NULL)", [1, 2]), ("NOT q IN (0.4, NULL)", [0, 3]), ("(a > 1 AND a < 4) OR b = 'z'", [1, 2]), ("(a > 1 AND a <= 4) OR b = 'z'", [1, 2, 3]), ("NOT a = 1 AND b = 'y'", [1, 3]), ("NOT NOT q > 0.5", [0, 3]), ("q > NULL", []), ("NOT q > NULL", [0, 1, 2, 3]), ("b LIKE '%y%'", [1, 3]), ("(" * 50 + "a = 1" + ")" * 50, [0])])
def test_nulls(nulls, text, want):
    assert hits(nulls, text) == want
    assert [P.evaluate(P.parse(text), {"a": a, "b": b, "q": q}) for a, b, q in NULLS] == [k in want for k in range(4)]


@pytest.mark.parametrize("text", ["", "a", "a =", "= 1", "a = 1 AND", "AND = 1", "a IN ()", "a IN (1", "a NOT IN (1)", "a <> 1", "a = b", "a + 1 = 2", "f(a) = 1", "(a = 1", "a = 1)", "a LIKE 1", "a IS 1", "a BETWEEN 1", "a = 'x", "a = 1; DROP"])
def test_refused(text):
    with pytest.raises(PredicateError):
        P.parse(text)


@pytest.mark.parametrize("text", ["b > 1", "a < 'x'", "q BETWEEN 'a' AND 'b'", "NOT b <= 2"])
def test_orders_across_types(nulls, text):
    with pytest.raises(PredicateTypeError):
        P.where(nulls, text)


def test_literals():
    assert P.parse(r"a = 'it\'s\n\\'") == P.Compare("a", "=", "it's\n\\")
    assert [P.parse(f"a = {v}").value for v in ("1", "-2", "1.5", "1e3", "true", "FALSE", "null", "'é'")] == [1, -2, 1.5, 1000.0, True, False, None, "é"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "en"), (None, "de")], "n long, lang string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for text in ("NOT n > 5", "lang != 'en'", "n IN (1, 2) OR lang = 'x'", "n BETWEEN 1 AND 3", "NOT lang LIKE 'e%'"):
        plan = P.where(df, text)._jdf.queryExecution().toString()
        assert "PushedFilters: [" in plan and "PushedFilters: []" not in plan, text


VALUES = st.one_of(st.none(), st.integers(-2, 2))
ATOMS = st.one_of(st.builds(P.Compare, st.sampled_from(["a", "z"]), st.sampled_from(["=", "!=", "<", "<=", ">", ">="]), VALUES), st.builds(P.In, st.just("a"), st.lists(VALUES, min_size=1, max_size=3).map(tuple)), st.builds(P.Between, st.just("a"), VALUES, VALUES), st.builds(P.IsNull, st.just("a"), st.booleans()), st.builds(P.Like, st.just("s"), st.sampled_from(["%b%", "a_", "_\n%", "%\\%"])), st.builds(P.Compare, st.just("s"), st.sampled_from(["=", "!="]), st.sampled_from(["a", None, "ab"])))
TREES = st.recursive(ATOMS, lambda t: st.one_of(st.builds(P.Not, t), st.builds(P.Junction, st.sampled_from(["AND", "OR"]), st.lists(t, min_size=2, max_size=3).map(tuple))), max_leaves=6)


@given(st.lists(TREES, min_size=12, max_size=12))
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_any_tree_against_python(spark, trees):
    rows = [(k, a, s) for k, (a, s) in enumerate((a, s) for a in (None, -1, 0, 1, 2) for s in (None, "a", "ab", "b\n", "\n\\", "a%"))]
    df = spark.createDataFrame(rows, "k int, a int, s string")
    shown = df.select("k", *(P.compile_column(t, df.schema).alias(f"t{n}") for n, t in enumerate(trees))).collect()
    for r in shown:
        _, a, s = rows[r.k]
        assert [r[f"t{n}"] for n in range(len(trees))] == [P.evaluate(t, {"a": a, "s": s}) for t in trees]
