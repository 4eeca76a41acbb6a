"""Golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from loomworks.functions import text as T
from loomworks.functions.python_code import parses, signature_and_body
from loomworks.operators import filters


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


CODE = [
    ('def f(a: int) -> int:\n    """Doc."""\n    x = 1\n    if a:\n        x = 2\n    return x', "def f(a: int) -> int:", "x = 1\nif a:\n    x = 2\nreturn x"),
    ("def f(a):\n\n    return a", "def f(a):", "return a"),
    ('def f(\n    a,\n    b\n) -> int:\n    """D"""\n    return a', "def f(\n    a,\n    b\n) -> int:", "return a"),
    ("def f(\n    a,\n    b\n) -> int:\n    return a", "def f(\n    a,\n    b\n) -> int:", "a,\nb"),
    ("def f(a): return a", "def f(a): return a", None),
    ("def f(a):  # note\n    if a:\n        return 1\n    return 2", "def f(a):  # note\n    if a:", "if a:\n    return 1\nreturn 2"),
    ("class A:\n    def m(self):\n        return 1", "def m(self):", "return 1"),
    ("class A:\n    def go(self):\n        return 1\ndef g(x):\n    return x", "def go(self):", "return x"),
    ("async def f():\n    return 1", None, None),
    ("import math\n\ndef f(a):\n    return math.pi\n\ndef g():\n    return 2", "def f(a):", "return math.pi"),
    ('def f():\n    """D"""', "def f():", None),
    ("def f():\n        x = 1\n  # c\n        return x", "def f():", "x = 1\n  # c\nreturn x"),
    ("@dec\ndef f(a):\n    return a", "def f(a):", "return a"),
    ('def f():\n    """D"""; x = 1\n    return x', "def f():", "return x"),
    ("def f(:", None, None),
    ("", None, None),
    (None, None, None),
]


@pytest.mark.parametrize("code,signature,body", CODE)
def test_signature_and_body(code, signature, body):
    assert signature_and_body(code) == (signature, body)


def test_parses_edge_cases():
    assert parses(None) and parses("") and not parses("x = \0") and not parses("(" * 500)


COMBINE = [
    ('def f(x):\n    """d"""\n', "return x", 'def f(x):\n    """d"""\n    return x', True),
    ("def f(x):", "for i in x:\n  y = i\nreturn y", "def f(x):\n    for i in x:\n    y = i\n    return y", False),
    ("def f(x):", "for i in x:\n        y = i\n    return y", "def f(x):\n    for i in x:\n        y = i\n    return y", True),
    ("def f(x):", "if x:\n    return 1\nreturn 2", "def f(x):\n    if x:\n    return 1\n    return 2", False),
    ("def f(x):", "\treturn 1", "def f(x):\n    return 1", True),
]


@pytest.mark.parametrize("skeleton,body,whole,ok", COMBINE)
def test_combine(spark, skeleton, body, whole, ok):
    assert value(spark, T.combine(F.lit(skeleton), F.lit(body))) == whole
    assert parses(whole) is ok


RATINGS = [
    ("Problem Design Score: 5\nSummary: a\nb", 5, "a\nb"),
    ("PROBLEM design SCORE:\n4.5\nsummary: x --- y", 4, "x"),
    ("Problem Design Score: X\nSummary:", None, None),
    ("Problem Design Score: 10/5 Summary:  \n\nq", 10, "q"),
]


@pytest.mark.parametrize("text,score,summary", RATINGS)
def test_rating(spark, text, score, summary):
    assert value(spark, T.rating_score(F.lit(text), "Problem Design")) == score
    assert value(spark, T.rating_summary(F.lit(text))) == summary


NAMES = [("D\n\nFunction name:\n\ndef foo(x):", "foo", "D"), ("D", "", "D"), ("Function name: foo", "", ""), ("D Function name: def é1", "é1", "D")]


@pytest.mark.parametrize("text,name,description", NAMES)
def test_name_and_description(spark, text, name, description):
    assert value(spark, T.name_after_description(F.lit(text))) == name
    assert value(spark, T.description_before_name(F.lit(text))) == description


def small():
    return [
        (T.uid16(F.lit("abc")), "ba7816bf8f01cfea"),
        (T.function_name(F.lit("a\ndef foo_Bar(x):\ndef baz(x)")), "baz"),
        (T.function_name(F.lit("x")), None),
        (T.drop_hint(F.lit("T: a\nD: b\n\n  Hint: x\nmore")), "T: a\nD: b"),
        (T.drop_hint(F.lit("t\nhint: x")), "t\nhint: x"),
        (T.starts_with_def(F.lit("  def f(): pass")), True),
        (T.has_code(F.lit("# a\n\n#b")), False),
        (T.has_code(F.lit("pass")), True),
        (T.has_code(F.lit("")), False),
        (T.strip(F.lit("\u001cx")), "x"),
        (T.strip(F.lit("\u00a0x\n")), "x"),
        (T.strip(F.lit("\u200bx")), "\u200bx"),
        (T.length_perplexity(F.lit("")), 100.0),
        (T.logprob_perplexity(F.array().cast("array<double>")), -1.0),
        (T.logprob_perplexity(F.array(F.lit(0.0), F.lit(None))), 1.0),
        (T.first_filled(F.lit(None).cast("string"), F.lit(""), F.lit("c")), "c"),
        (T.code_prompt("{{problem}}|{{skeleton}}", F.lit("a {{skeleton}}"), F.lit(" s ")), "a s|s"),
        (T.name_of_completion(F.lit("  "), "FIM"), ""),
        (filters.scores_valid(F.struct(*[F.lit(5).alias(d) for d in T.DIMENSIONS]), F.lit("s")), True),
        (filters.scores_valid(F.struct(*[F.lit(6).alias(d) for d in T.DIMENSIONS]), F.lit("s")), False),
    ]


def test_small(spark):
    for column, wanted in small():
        assert value(spark, column) == wanted, column


def test_names_and_thresholds(spark):
    names = ["ab", "abc", "Abc", "  ", "a" * 66, None]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in rows.select(filters.name_matches(F.col("n"))).collect()] == [False, True, False, False, False, False]
    scores = F.struct(F.lit(5).alias("correctness"), F.lit(None).cast("int").alias("efficiency"))
    want = {"correctness": 4, "efficiency": 3}
    assert value(spark, filters.meets_thresholds(scores, want)) is False
    assert value(spark, filters.meets_thresholds(scores, want, False)) is True
    assert value(spark, filters.meets_thresholds(scores, {})) is True
