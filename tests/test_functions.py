import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrow.functions import dom, normal, tolerant, udfs
from harrow.functions import text as X


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", f(F.col("v"))).orderBy("i").collect()]


TEXTS = ["The cat's  hat is\tred.", "", None, "a an the", "É è—naïve_x 1.5", " x\x1cy\x85z", "An, the! THE"]


def test_normalisers_match_python(spark):
    assert column(spark, TEXTS, X.normalize_text) == [normal.normalize_text(t) for t in TEXTS]
    assert column(spark, TEXTS, X.normalize_html_text) == [normal.normalize_html_text(t) for t in TEXTS]


def test_squad(spark):
    assert column(spark, TEXTS, X.squad_normalize) == ["cats hat is red", "", "", "", "é è—naïve_x 15", "x y z", ""][:0] + ["cats hat is red", "", "", "", "é è—naïvex 15", "x y z", ""]


def f1(g, p):
    from collections import Counter

    n = sum((Counter(g) & Counter(p)).values())
    if not g and not p:
        return (1.0, 1.0, 1.0)
    if not n:
        return (0.0, 0.0, 0.0)
    return (2 * n / (len(g) + len(p)), n / len(p), n / len(g))


def test_token_scores(spark):
    random.seed(1)
    rows = [(i, [random.choice("abc") for _ in range(random.randint(0, 6))], [random.choice("abcd") for _ in range(random.randint(0, 6))]) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, g array<string>, p array<string>")
    for r in df.select("i", "g", "p", X.token_scores(F.col("g"), F.col("p")).alias("s"), X.token_scores(F.col("p"), F.col("g")).alias("b")).collect():
        assert tuple(r.s) == pytest.approx(f1(r.g, r.p))
        assert (r.s.precision, r.s.recall) == pytest.approx((r.b.recall, r.b.precision))


def test_predicates(spark):
    v = ["http://a", "HTTPS://b", "ftp://http://", None, "", "dict_keys(['a'])", " {x} ", "[", "a: b: c", "<NULL>", "  "]
    assert column(spark, v, X.is_url) == [True, True] + [False] * 9
    assert column(spark, v, X.is_schema) == [bool(udfs.is_schema(x)) for x in v]
    assert column(spark, v, X.is_not_null) == [tolerant.not_null(x) for x in v]
    df = spark.createDataFrame([(0, []), (1, [None]), (2, ["NaN"]), (3, ["x"]), (4, [" "]), (5, None)], "i int, v array<string>")
    assert [r[1] for r in df.select("i", X.is_not_null_list("v")).orderBy("i").collect()] == [False, False, False, True, True, False]


def test_yes_no_and_prompt(spark):
    r = spark.sql("select -1D a, -2D b, cast(null as double) n, -1e9D z").select(X.yes_no_probability("a", "b"), X.yes_no_probability("n", "n"), X.yes_no_probability("z", "z")).first()
    assert r[0] == pytest.approx(0.7310585786) and r[1] == 0.5 and r[2] == 0.0
    p = spark.sql("select 'a {content}' q, 'b' c").select(X.prompt("{{x}} {query}|{content}", query="q", content="c")).first()[0]
    assert p == "{x} a {content}|b"


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("{'a': 1, b: 'x',}", {"a": 1, "b": "x"}), ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": True, "b": None}', {"a": True, "b": None}), ('{"a": "it\'s"}', {"a": "it's"}),
        ('{"a": 1 // c\n}', {"a": 1}), ("{\"a\": \"x\\n\\u00e9\"}", {"a": "x\né"}), ('{"a": {"b": []}', {"a": {"b": []}}),
    ],
)
def test_repair(text, value):
    assert tolerant.repair(text) == value


def test_extract_and_parse():
    assert tolerant.extract('Sure:\n```json\n{"a": "x"}\n``` done') == {"a": "x"}
    assert tolerant.extract("no") == {} == tolerant.extract(None) == tolerant.extract("{")
    assert tolerant.extract({"a": 1}) == {"a": 1}
    assert tolerant.spread({"a": "x", "b": 1, "c": "y"}) == "xy"
    assert tolerant.parse("[1, 2]") == [1, 2] and tolerant.parse("nothing") == {} and tolerant.parse(None) == {}


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=5), x, max_size=3), max_leaves=8))
@settings(max_examples=100, deadline=None)
def test_valid_json_reads_the_same(value):
    assert tolerant.parse(json.dumps(value)) == value


@pytest.mark.parametrize(
    ("gold", "values"),
    [("1.50", [1.5]), ("1_000", [1000]), ("0x10", [16]), ("None", [None]), ("007", ["007"]), ("['a', None, ' b ']", ["a", "b"]), ("a &amp; b", ["a & b"]), ("<NULL>", []), ({}, [{}]), ([None], []), ("(1,2)", [(1, 2)])],
)
def test_gold_values(gold, values):
    assert tolerant.gold_values(gold) == [v for v in values if v is not None]


def test_compare():
    assert tolerant.same("2", 2.0) and not tolerant.same("1.50", "1.50") and tolerant.same("A-b", "a b") and tolerant.same("none", None)
    assert tolerant.same(None, " ") and not tolerant.same(None, "x") and tolerant.same("---", "!!") and tolerant.same(["x", "y"], "Y")
    assert tolerant.similar("hello world", "hello worl") and not tolerant.similar("hello", "bye") and tolerant.ratio("", "") == 100.0


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=150, deadline=None)
def test_ratio_is_that_of_the_longest_common_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert tolerant.ratio(a, b) == pytest.approx(200 * t[-1][-1] / (len(a) + len(b)) if a or b else 100)


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>H</header><p class="x">One <a href="/u">two</a><br> three<p> </p><!-- c --><div><p>Four &amp; five</p></div></body></html>'


def test_clean_html():
    assert dom.clean_html(PAGE) == "<!DOCTYPE html><html><head><title>T</title></head><body><p>One two three<div><p>Four &amp; five</p></div></p></body></html>"
    assert dom.clean_html(PAGE, keep_tags=False) == "T One two three Four & five"
    assert dom.clean_html(None) == "" and 'class="x"' in dom.clean_html(PAGE, strip_attrs=False) and "<a>" in dom.clean_html(PAGE, strip_links=False)


@pytest.mark.parametrize("size", [1, 3, 7, 500])
def test_chunks_lose_no_text(size):
    page = "<div>" + "".join(f"<p>word{i} and, more <b>bold {i}</b></p>" for i in range(20)) + "</div>"
    chunks = dom.chunk_html(page, size)
    tokens = [t for c in chunks for t in dom._TOKEN.findall(dom.parse(c).text(" "))]
    assert tokens == dom._TOKEN.findall(dom.parse(page).text(" "))
    assert all(len(dom._TOKEN.findall(dom.parse(c).text(" "))) <= size for c in chunks)
    assert dom.chunk_html("", size) == [] == dom.chunk_html(None, size)


def test_closest_node_and_xpath():
    page = "<html><body><p>apples and pears</p><p>plums</p><div><p>plum tart</p></div></body></html>"
    r = dom.closest_node(page, "Plum tart!")
    assert (r["text"], r["xpath"], r["found"]) == ("plum tart", "/html/body/div/p", True)
    assert dom.closest_node(page, "plums")["xpath"] == "/html/body/p[2]"
    assert dom.closest_node(page, "kiwi") == {"text": "kiwi", "xpath": None, "sub_index": None, "score": 0.0, "found": False}
    assert not dom.closest_node(page, "  ")["found"]


def test_postprocessed():
    assert udfs.postprocessed('{"a": "x", "b": 2, "c": "y"}', "what?", None, False) == "xy"
    assert json.loads(udfs.postprocessed("```json\n{'a': 'x'}\n```", "{a}", None, False)) == {"a": "x"}
    assert udfs.postprocessed("{}", "{a}", None, True).startswith("[PARSE_ERROR]")
    assert json.loads(udfs.postprocessed('{"a": "Plum!", "b": null}', "{a}", "<p>plum  tart</p>", True)) == {"a": "plum tart", "b": None}


def test_field_marks():
    def marks(g, p, **k):
        return {m["field"]: (m["hit"], m["extracted"], m["in_gold"]) for m in udfs.field_marks(json.dumps(g), None if p is None else p if isinstance(p, str) else json.dumps(p), **k)}

    assert marks({"a": "x"}, {}) == {"a": (False, True, True)}
    assert marks({"a": "x"}, {"a": None}) == {"a": (False, False, True)}
    assert marks({"a": None}, {"a": None}) == {"a": (True, False, False)} and marks({"a": None}, {"a": None}, strict=True)["a"][0] is False
    assert marks({"a": "x"}, None) == {"a": (False, False, True)} and marks({"a": "x"}, "[1]")["a"] == (False, True, True)
    assert marks({"a": "x"}, {"__error__": "e"})["a"] == (False, True, True) and marks([1], {}) == {}
