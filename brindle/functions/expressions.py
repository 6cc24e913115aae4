"""Equality of mathematical answers: a reader of LaTeX and plain notation, rational arithmetic, values at hashed points.

An answer is read into a tree of tuples. Two trees are equal if their values agree at points that a hash of the variables'
names gives: exactly while arithmetic stays rational, which decides equality of rational functions, and to nine digits
beyond it. Answers without variables agree within TOLERANCE, whole numbers only if they are equal. Work is bounded by the
number of tokens and by the size of exponents, and answers beyond that are compared as text only.
"""

from __future__ import annotations

import cmath
import math
import re
from fractions import Fraction
from hashlib import md5

TOLERANCE, POINTS, MOST_TOKENS, MOST_POWER = 1e-4, 5, 400, 64
FUNCTIONS = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "ln": cmath.log, "log": cmath.log, "exp": cmath.exp,
    "cot": lambda x: 1 / cmath.tan(x), "sec": lambda x: 1 / cmath.cos(x), "csc": lambda x: 1 / cmath.sin(x),
}
TOKEN = re.compile(r"\\[A-Za-z]+|" + "|".join([*sorted(FUNCTIONS, key=len, reverse=True), "sqrt", "pi"]) + r"|\d+(?:,\d{3})+(?![\d,])(?:\.\d+)?|\d+\.?\d*|\.\d+|[A-Za-z]|\S")
BLANK = re.compile(r"\\(?:left|right|displaystyle|quad|qquad)(?![A-Za-z])|\\[,;:! ]|\$|\\\$|\\text\{[^{}]*\}|\^\{?\\circ\}?|\\%|%$")
SPELLINGS = {"\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cdot": "*", "\\times": "*", "\\div": "/", "**": "^", "−": "-", "\\ast": "*", "\\lvert": "|", "\\rvert": "|", "π": "\\pi", "{,}": ","}
OPEN, CLOSE = {"(": ")", "{": "}", "[": "]"}, ")}]"

Tree = tuple


class _Reader:
    """Recursive descent over tokens: sums of products of powers; neighbours without an operator are multiplied."""

    def __init__(self, text: str) -> None:
        self.tokens, self.at = TOKEN.findall(text), 0
        if len(self.tokens) > MOST_TOKENS:
            raise ValueError("too long")

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        token = self.peek()
        if not token or wanted and token != wanted:
            raise ValueError(f"no {wanted or 'token'} at {self.at}")
        self.at += 1
        return token

    def whole(self) -> Tree:
        tree = self.sum()
        if self.peek():
            raise ValueError("rest")
        return tree

    def sum(self) -> Tree:
        tree = self.product()
        while self.peek() in ("+", "-"):
            tree = (self.take(), tree, self.product())
        return tree

    def product(self) -> Tree:
        tree = self.signed()
        while (token := self.peek()) and token not in "+-,=!" and token not in CLOSE and not (token == "|" and self.bars):
            operator = self.take() if token in "*/" else "*"
            tree = (operator, tree, self.signed())
        return tree

    bars = 0

    def signed(self) -> Tree:
        if self.peek() in ("+", "-"):
            return ("-", ("number", Fraction(0)), self.signed()) if self.take() == "-" else self.signed()
        return self.power()

    def power(self) -> Tree:
        tree = self.atom()
        if self.peek() == "^":
            self.take()
            tree = ("^", tree, self.signed() if self.peek() in ("-", "+") else self.argument())
        if self.peek() == "!":
            self.take()
            tree = ("!", tree)
        return tree

    def argument(self) -> Tree:
        """A group, or the one digit or letter that LaTeX takes where a group is missing."""
        token = self.peek()
        if token.isdigit() and len(token) > 1 and self.at and self.tokens[self.at - 1] in ("\\frac", "\\sqrt"):
            self.tokens[self.at : self.at + 1] = [token[0], token[1:]]
        return self.atom()

    def atom(self) -> Tree:
        token = self.take()
        if token in OPEN:
            tree = self.sum()
            self.take(OPEN[token])
            return tree
        if token == "|":
            self.bars += 1
            tree = self.sum()
            self.take("|")
            self.bars -= 1
            return ("abs", tree)
        name = token.lstrip("\\")
        if token[0].isdigit() or token[0] == ".":
            return ("number", Fraction(token.replace(",", "").rstrip(".")))
        if token == "\\frac":
            top = self.argument()
            if self.peek().isdigit() and len(self.peek()) > 1 and self.tokens[self.at - 1].isdigit():
                self.tokens[self.at : self.at + 1] = [self.peek()[0], self.peek()[1:]]
            return ("/", top, self.argument())
        if name == "sqrt":
            degree: Tree = ("number", Fraction(2))
            if self.peek() == "[":
                degree = self.atom()
            return ("^", self.argument(), ("/", ("number", Fraction(1)), degree))
        if name in FUNCTIONS:
            exponent = None
            if self.peek() == "^":
                self.take()
                exponent = self.argument()
            inner = self.atom() if self.peek() in OPEN else self.product()
            return (name, inner) if exponent is None else ("^", (name, inner), exponent)
        if name == "pi":
            return ("pi",)
        if name.isalpha():
            return ("name", name)
        raise ValueError(token)


def _value(tree: Tree, point: int):
    """A Fraction while arithmetic stays rational, else a complex number."""
    kind = tree[0]
    if kind == "number":
        return tree[1]
    if kind == "pi":
        return complex(math.pi)
    if kind == "name":
        if tree[1] in ("e", "i"):
            return complex(math.e) if tree[1] == "e" else 1j
        drawn = int(md5(f"{tree[1]}|{point}".encode()).hexdigest()[:12], 16)
        return Fraction(drawn % 997 + 2, drawn // 997 % 89 + 3)
    x = _value(tree[1], point)
    if kind in FUNCTIONS:
        return FUNCTIONS[kind](complex(x))
    if kind == "abs":
        return abs(x) if isinstance(x, Fraction) else complex(abs(x))
    if kind == "!":
        if not isinstance(x, Fraction) or x.denominator != 1 or not 0 <= x <= MOST_POWER:
            raise ValueError("no factorial")
        return Fraction(math.factorial(int(x)))
    y = _value(tree[2], point)
    if kind == "^":
        return _power(x, y)
    if not (isinstance(x, Fraction) and isinstance(y, Fraction)):
        x, y = complex(x), complex(y)
    return x + y if kind == "+" else x - y if kind == "-" else x * y if kind == "*" else x / y


def _power(x, y):
    if isinstance(x, Fraction) and isinstance(y, Fraction):
        if y.denominator == 1 and abs(y) <= MOST_POWER and abs(x.numerator).bit_length() + x.denominator.bit_length() <= 512:
            return x ** int(y)
        if y == Fraction(1, 2) and x >= 0:
            root = Fraction(math.isqrt(x.numerator), math.isqrt(x.denominator))
            if root * root == x:
                return root
        if y.numerator == 1 and y.denominator % 2 and x < 0:
            return -_power(-x, y)  # the real odd root
    return complex(x) ** complex(y)


def _names(tree: Tree) -> set[str]:
    return {tree[1]} - {"e", "i"} if tree[0] == "name" else set().union(*(_names(x) for x in tree[1:] if isinstance(x, tuple)))


def _agree(a: Tree, b: Tree) -> bool:
    names = _names(a) | _names(b)
    met = 0
    for point in range(POINTS if names else 1):
        try:
            x, y = _value(a, point), _value(b, point)
        except (ZeroDivisionError, OverflowError, ValueError):
            continue
        if isinstance(x, Fraction) and isinstance(y, Fraction) and (names or x.denominator == y.denominator == 1):
            same = x == y
        else:
            same = cmath.isclose(complex(x), complex(y), rel_tol=1e-9 if names else TOLERANCE, abs_tol=1e-12)
        if not same:
            return False
        met += 1
    return met >= (2 if names else 1)


def _parts(text: str) -> list[str]:
    """Split at commas outside brackets."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in OPEN) - (c in CLOSE)
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def _spelt(text: str) -> str:
    for old, new in SPELLINGS.items():
        text = text.replace(old, new)
    text = re.sub(r"^Interval(?:\.(Ropen|Lopen|open))?\((.*)\)$", lambda m: f"{'(' if m[1] in ('Lopen', 'open') else '['}{m[2]}{')' if m[1] in ('Ropen', 'open') else ']'}", text.strip())
    text = re.sub(r"\\begin\{[pb]?matrix\}(.*?)\\end\{[pb]?matrix\}", lambda m: "[" + ",".join("[" + r.replace("&", ",") + "]" for r in m[1].split("\\\\")) + "]", text, flags=re.DOTALL)
    text = re.sub(r"^(?:Point|Matrix)\((.*)\)$", r"(\1)", BLANK.sub("", text).strip())
    text = re.sub(r"^(-?[0-9]+)_\{?[0-9]+\}?$", r"\1", text)
    return re.sub(r"^[A-Za-z]\s*\\in\b", "", text).strip().rstrip(".")


def _whole(text: str) -> str | None:
    """The digits of a whole number without leading zeros, so that any length compares exactly."""
    plain = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)
    if found := re.fullmatch(r"(-?)0*([0-9]+)", plain):
        return found[2] if found[2] == "0" else found[1] + found[2]
    return None


def _number(text: str) -> float | None:
    plain = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)
    return float(plain) if re.fullmatch(r"-?(?:\d+\.?\d*|\.\d+)(?:[eE]-?\d+)?", plain) else None


def equal(answer: str, truth: str, percent: bool = True) -> bool:
    """Whether an answer says the same as the truth. A number may be given as a percentage of it or the other way round."""
    if answer.replace(" ", "").lower() == truth.replace(" ", "").lower():
        return True
    a, b = _spelt(answer), _spelt(truth)
    if ("=" in a) != ("=" in b):  # a named value stands for its value
        a, b = (re.sub(r"^(?:[A-Za-z]|\\[A-Za-z]+)\s*=\s*(?=[^=]+$)", "", t) for t in (a, b))
    if a.replace(" ", "") == b.replace(" ", ""):
        return a != ""
    if not a or not b:
        return False
    x, y = _whole(a), _whole(b)
    if x is not None and y is not None:  # the tolerance is for rounded values
        return x == y or (percent and (x + "00" == y or x == y + "00"))
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        return any(math.isclose(x, z, rel_tol=TOLERANCE) for z in ((y / 100, y, y * 100) if percent else (y,)))
    p, q = _parts(a), _parts(b)
    if len(p) > 1 or len(q) > 1:
        return len(p) == len(q) and all(equal(m, n, percent) for m, n in zip(p, q, strict=True))
    if a[0] in "([" and b[0] in "([" and a[-1] in ")]" and b[-1] in ")]":
        p, q = _parts(a[1:-1]), _parts(b[1:-1])
        if len(p) > 1 or len(q) > 1:
            return (a[0], a[-1]) == (b[0], b[-1]) and len(p) == len(q) and all(equal(m, n, percent) for m, n in zip(p, q, strict=True))
    try:
        if a.count("=") == b.count("=") == 1:
            sides = [("-", *(_Reader(s).whole() for s in t.split("="))) for t in (a, b)]
            return _agree(*sides) or _agree(sides[0], ("-", ("number", Fraction(0)), sides[1]))
        return _agree(_Reader(a).whole(), _Reader(b).whole())
    except (ValueError, RecursionError, IndexError):
        return False
