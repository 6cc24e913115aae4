"""Answers that are equal, and answers that are not."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from brindle.functions import expressions
from brindle.operators import sequences as Q

EQUAL = [
    ("1/2", "0.5"), ("\\frac{1}{2}", "1/2"), ("\\dfrac12", "\\frac{1}{2}"), ("\\tfrac{3}{4}", ".75"), ("1,000", "1000"), ("1{,}234{,}567", "1234567"), ("$5", "5"), ("\\$12.50", "12.5"), ("50%", "0.5"), ("50\\%", "50"), ("0.25", "25"),
    ("3.14159", "\\pi"), ("2\\pi", "6.283185"), ("\\sqrt{4}", "2"), ("\\sqrt2", "2^{1/2}"), ("\\sqrt[3]{27}", "3"), ("\\sqrt[3]{-8}", "-2"), ("2\\sqrt{3}", "\\sqrt{12}"), ("\\frac{\\sqrt{2}}{2}", "\\frac{1}{\\sqrt{2}}"), ("sqrt(2)/2", "\\frac{\\sqrt2}{2}"),
    ("x+y", "y+x"), ("(x+1)^2", "x^2+2x+1"), ("(x-1)(x+1)", "x^2-1"), ("2x", "x+x"), ("\\frac{x^2-1}{x-1}", "x+1"), ("x^{-1}", "\\frac{1}{x}"), ("a(b+c)", "ab+ac"), ("-(x-y)", "y-x"), ("x**2", "x^2"), ("3\\cdot 4", "12"), ("6\\div 4", "3/2"),
    ("\\sin^2 x+\\cos^2 x", "1"), ("\\sin(2x)", "2\\sin(x)\\cos(x)"), ("\\ln(e)", "1"), ("e^{\\ln x}", "x"), ("\\tan x", "\\frac{\\sin x}{\\cos x}"), ("|{-3}|", "3"), ("5!", "120"), ("10^{-3}", "0.001"), ("2^{10}", "1024"),
    ("(1,2)", "(1, 2)"), ("(\\frac12, 3)", "(0.5,3)"), ("[0, 1)", "[0,1)"), ("Interval(0, 1)", "[0,1]"), ("Interval.open(0, 1/2)", "(0, 0.5)"), ("Interval.Ropen(0, 1)", "[0, 1)"), ("Interval.Lopen(0,1)", "(0,1]"), ("Point(1, 2)", "(1,2)"),
    ("x = 5", "5"), ("x=\\frac{1}{2}", "0.5"), ("y = 2x+1", "2x + 1"), ("x+y=3", "y+x=3"), ("x-3=y", "y=x-3"), ("x \\in [1,2]", "[1,2]"), ("12_8", "12"), ("90^\\circ", "90"), ("5\\text{ cm}", "5"), ("\\left(1,2\\right)", "(1,2)"), ("\\left(\\frac{1}{2}\\right)^2", "1/4"),
    ("1, 2, 3", "1,2,3"), ("x, \\frac{2}{4}", "x,1/2"), ("\\begin{pmatrix}1 & 2\\\\3 & 4\\end{pmatrix}", "[[1,2],[3,4]]"), ("\\begin{pmatrix} \\frac12 \\\\ 2 \\end{pmatrix}", "\\begin{pmatrix} 0.5 \\\\ 2 \\end{pmatrix}"), ("Yes", "yes"), ("(A)", "( a )"), ("-\\frac{1}{3}", "\\frac{-1}{3}"), ("7.", "7"), ("i^2", "-1"),
]
DIFFERENT = [
    ("1/2", "1/3"), ("x+1", "x+2"), ("(1,2)", "[1,2]"), ("(1,2)", "(2,1)"), ("(1,2)", "(1,2,3)"), ("[0,1)", "[0,1]"), ("x^2", "x^3"), ("2", "3"), ("", "5"), ("5", ""), ("x", "y"), ("\\sqrt{2}", "1.5"), ("no", "yes"), ("1,2", "1,3"), ("x=1", "2"), ("x+y=3", "x+y=4"),
    ("(x+1)^2", "x^2+1"), ("\\frac{1}{0}", "1"), ("(((", "1"), ("\\frac{", "1"), ("2^{99999999}", "3"), ("99999!", "1"), ("a" * 5000, "b" * 5000), ("(" * 3000, "x"), ("\\sin x", "\\cos x"), ("|x|", "-x"), ("1000", "1,0"), ("None", "0"), ("9" * 4000 + "^9", "x"),
]


@pytest.mark.parametrize(("a", "b"), EQUAL)
def test_equal_answers(a, b):
    assert expressions.equal(a, b) and expressions.equal(b, a)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_answers(a, b):
    began = time.time()
    assert not expressions.equal(a, b) and not expressions.equal(b, a)
    assert time.time() - began < 2


def test_whole_numbers_are_exact():
    """Neighbours above ten thousand are within the tolerance of rounded values."""
    for a, b in (("14017", "14018"), ("1,000,000", "1000001"), ("2^{14}", "16385"), ("-20000", "-20001"), ("9" * 400, "8" * 400)):
        assert not expressions.equal(a, b) and not expressions.equal(b, a)
    assert expressions.equal("14017", "014017") and expressions.equal("1401700", "14017") and expressions.equal("-0", "0")
    assert expressions.equal("14017.3", "14017.4")


def test_percent_is_optional():
    assert not expressions.equal("50", "0.5", percent=False)


def test_scores_on_columns(spark):
    rows = [("so \\boxed{\\frac{2}{4}}", "0.5", 1.0), ("\\boxed{(x+1)^2}", "x^2+2x+1", 1.0), ("\\boxed{3}", "4", 0.0), ("no box", "4", 0.0), (None, "1", 0.0), ("\\boxed{1}", None, 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t string, want double")
    assert df.where(Q.math_score(F.col("s"), F.col("t")) != F.col("want")).count() == 0
