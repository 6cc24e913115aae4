"""Golden values of column functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from brindle.functions import arrays as A
from brindle.functions import policy as P
from brindle.functions import sid
from brindle.functions import text as T
from brindle.functions import vec as V
from brindle.operators import metrics as M
from brindle.operators import sequences as Q


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first()["v"]


B, E = sid.BEGIN, sid.END


def test_codes(value):
    assert value(sid.sid_format(F.array(F.lit(1), F.lit(2), F.lit(3)))) == f"{B}<s_a_1><s_b_2><s_c_3>{E}"
    packed = sid.sid_encode(F.lit(5), F.lit(6), F.lit(7))
    assert value(packed) == 5 * 8192**2 + 6 * 8192 + 7 and value(sid.sid_decode(packed)) == [5, 6, 7]
    assert value(sid.sid_parse_all(F.lit("x<s_a_0><s_b_0><s_c_9>y<s_a_1><s_b_0><s_c_0>"))) == [9, 8192**2]
    assert value(sid.sid_parse_first(F.lit("none"))) is None


def test_answers(value):
    assert set(value(sid.answer_set(F.lit(f"{B}123{E}{B}456{E}{B}123{E}")))) == {"123", "456"}
    assert value(sid.sid_from_generation(F.lit(f"<think>reasoning</think>\n{B}123"))) == "123"
    assert value(sid.sid_from_generation(F.lit(f"<think>a</think>b</think>{B}9{E}{B}8{E}"))) == "9"
    assert value(sid.sid_from_generation(F.lit("<think>a</think> plain "))) == "plain"


def test_levels(value):
    code = lambda a, b, c: sid.sid_encode(F.lit(a), F.lit(b), F.lit(c))
    truth = F.array(code(1, 2, 3))
    assert value(sid.best_level(F.array(code(1, 2, 3), code(1, 2, 9), code(1, 9, 3), code(9, 2, 3)), truth)) == [100.0, 10.0, 1.0, 0.0]
    assert value(sid.partial_hit(F.array().cast("array<bigint>"), truth)) == 0.0


def test_slices(value):
    three = F.array(*map(F.lit, (1, 2, 3)))
    assert value(A.newest(three, 5)) == [1, 2, 3] and value(A.newest(three, 2)) == [2, 3] and value(A.oldest(three, 2)) == [1, 2]
    assert value(A.without_repeats(F.array(*map(F.lit, (1, 1, 2, 2, 1))))) == [1, 2, 1]
    assert value(A.masked(three, F.array(*map(F.lit, (1, 0, 1))))) == [1, 3]
    assert value(A.masked(three, F.array(F.lit(1)))) is None
    assert value(A.truncated(three, 2, "middle")) == [1, 3]
    with pytest.raises(Exception, match="more than 2"):
        value(A.truncated(three, 2, "error"))
    assert value(A.padded(three, 5, 0, left=True)) == [0, 0, 1, 2, 3]


def test_loss_mask(value):
    ids = F.array(*map(F.lit, (9, 1, 2, 5, 6, 7, 3, 5, 1, 2, 8)))
    assert value(A.loss_mask(ids, (1, 2), (7, 3))) == [0, 0, 0, 1, 1, 1, 1, 0, 0, 0, 1]


def test_texts(value):
    assert value(T.normalised_answer(F.lit(" The  Quick, brown FOX! "))) == "quick brown fox"
    assert value(T.yes_no(F.lit("是<|im_end|>"))) == 1 and value(T.yes_no(F.lit("否"))) == 0 and value(T.yes_no(F.lit("不是"))) == 1
    assert value(T.json_from_response(F.lit('text ```json\n{"a": 1}\n```'), "a int")["a"]) == 1
    assert value(T.gsm8k_score(F.lit("so #### 1,000"), F.lit("1000"))) == 1.0
    assert value(T.qa_score(F.lit("<answer>x</answer><answer>The cat.</answer>"), F.array(F.lit("cat")))) == 1.0
    assert value(T.qa_score(F.lit("no tag"), F.array(F.lit("cat")))) == 0.0
    assert value(T.qa_score(F.lit("<answer>cat</answer>" * 11), F.array(F.lit("cat")))) == 0.25


def test_choice_is_stable(value):
    first = value(T.choice(["a", "b", "c"], 1, F.lit(7), "x"))
    assert first == value(T.choice(["a", "b", "c"], 1, F.lit(7), "x"))
    assert len(value(T.stable_uuid(F.lit(1)))) == 36


def test_vectors(value):
    p, q = F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(0.0))
    m = 0.5 * (0.5 * math.log(0.5 / 0.75) + 0.5 * math.log(0.5 / 0.25)) + 0.5 * math.log(1 / 0.75)
    assert value(V.js_divergence(p, q)) == pytest.approx(m)
    assert value(V.js_distance(p, q)) == pytest.approx(math.sqrt(m))
    assert value(V.cosine(p, q)) == pytest.approx(1 / math.sqrt(2)) and value(V.entropy(p)) == pytest.approx(math.log(2))
    assert sum(value(V.softmax(F.array(F.lit(1.0), F.lit(900.0))))) == pytest.approx(1)


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_policy(value):
    assert value(P.discounted_returns(arr(1, 1, 1), arr(1, 1, 1), 0.5)) == [1.75, 1.5, 1.0]
    assert value(P.suffix_sums(arr(1, 2, 3), arr(1, 0, 1))) == [4.0, 3.0, 3.0]
    # Masked positions do not change the advantages of the others.
    plain = value(P.gae(arr(0, 1), arr(0.5, 0.2), arr(1, 1), 0.9, 0.8))
    gap = value(P.gae(arr(0, 7, 1), arr(0.5, 9, 0.2), arr(1, 0, 1), 0.9, 0.8))
    assert [gap[0], gap[2]] == pytest.approx(plain)
    assert value(P.masked_mean(arr(1, float("nan"), 3), arr(1, 0, 1))) == pytest.approx(2)
    assert value(P.kl_estimate(F.lit(-1.0), F.lit(-2.0), "k3")) == pytest.approx(math.exp(-1))
    assert P.next_beta(0.1, 2.0, 1.0, 10, 100) == pytest.approx(0.1 * 1.02)
    assert value(P.ppo_loss(F.lit(5.0), F.lit(0.0), F.lit(-1.0))) == 3.0
    assert value(P.overlong_penalty(F.lit(110), 100, 20, 1.0)) == -1.5


def test_rank_metrics(value):
    pred, truth = F.array(*map(F.lit, ("123", "456", "999", "888"))), F.array(*map(F.lit, ("123", "456", "789")))
    assert value(M.recall_at(pred, truth, 2)) == pytest.approx(2 / 3) and value(M.recall_at(pred, truth, 4)) == pytest.approx(2 / 3)
    assert value(M.pass_at(pred, truth, 1)) and not value(M.first_truth_at(pred, F.array(F.lit("888")), 3))
    assert value(M.ndcg_at(pred, truth, 4)) == pytest.approx((1 + 1 / math.log2(3)) / (1 + 1 / math.log2(3) + 0.5))
    assert value(M.recall_at(pred, F.array().cast("array<string>"), 4)) == 0.0


def test_judge_and_bleu(value):
    assert [value(M.judge_score(F.lit(x))) for x in ("4", "9", "bad", None, "1.5")] == [4.0, 3.0, 3.0, 3.0, 1.5]
    words = F.array(*map(F.lit, "a b c d e".split()))
    assert value(M.bleu(words, words)) == pytest.approx(1.0)


def test_math_answers():
    assert Q.boxed("a \\boxed{\\frac{1}{2}} b") == "\\frac{1}{2}" and Q.boxed("none") is None
    assert Q.math_equal("x = \\dfrac12", "\\frac{1}{2}") and Q.math_equal("0.5", "1/2") and Q.math_equal("10 \\%", "10")
    assert not Q.math_equal("2", "3") and Q.math_equal(None, None) and Q.math_equal("1,000", "1000")


def test_chat_messages(value):
    messages = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("system", "s"), ("user", "u"), ("assistant", "<think>x</think>a"), ("user", "v"), ("assistant", "b"))])
    out = [m["content"] for m in value(T.think_switches(messages))]
    assert out == ["s", "u/think", "<think>x</think>a", "v/no_think", "<think>\n\n</think>\nb"]
    assert len(value(T.until_first_exchange(messages))) == 3
    assert value(T.with_prefix_on_last_user(messages, F.lit("p")))[-1]["content"] == "b"
    calls = value(T.tool_calls(F.lit('<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>')))
    assert calls[0]["name"] == "f"
