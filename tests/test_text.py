import random
import re

import pytest
from pyspark.sql import functions as F

from hopsmith.functions import text as T


def one(spark, make, *values):
    """Results of a column function for each value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("c"))).collect()]


def test_normalisers(spark):
    assert one(spark, T.normalize_answer, " The  Cat's, hat! ", "a-b", "", "Été an x", None) == ["cats hat", "ab", "", "été x", None]
    assert one(spark, T.normalize_articles_first, "a-b", "the cat") == ["b", "cat"]
    assert one(spark, T.normalize_plain, " The A. ") == ["the a."]


def test_labels(spark):
    assert one(spark, T.strip_answer_label, "Loud\nFinal answer: Loud", "Answer: 42", "x answer: a answer: b", "Paris", "FINAL ANSWER: ") == ["Loud", "42", "b", "Paris", ""]
    assert one(spark, T.strip_leading_label, "Final answer: Rome..", "so Final answer: Rome") == ["Rome", "so Final answer: Rome"]
    assert one(spark, T.final_answer, "x FINAL answer: Rome.", "Oslo.") == ["Rome", "Oslo"]
    assert one(spark, T.after_final_answer_marker, "Final answer: a Final answer: b", "none") == ["b", "none"]
    assert one(spark, T.after_thinking_final_answer, "<think>final answer: q</think> fINAL answer: r", "z") == ["r", "z"]


def test_thinking(spark):
    assert one(spark, T.strip_thinking, "<think>a\nb</think> c <think>d", "e") == ["c", "e"]
    assert one(spark, T.discard_reasoning, "<think>a", "<think>a</think>b", "c") == ["[incomplete reasoning]", "b", "c"]


def test_yes_no_and_lists(spark):
    assert one(spark, T.yes_no, "Yes.", "no, never", "I KNOW", "maybe", " ") == [1, 0, 0, None, None]
    assert one(spark, T.numbered_items, "1. Paris \n 2) Rome\nx\n3.Oslo") == [["Paris", "Rome", "Oslo"]]
    assert one(spark, lambda c: T.fitted(F.split(c, ","), 3), "a", "a,b,c,d") == [["a", "", ""], ["a", "b", "c"]]


def test_tags(spark):
    assert one(spark, T.last_search, "<search>a</search> <search> b\n</search>", "none", "<search></search>") == ["b", None, ""]
    assert one(spark, T.tagged_answer, "<answer> x </answer><answer>y</answer>", "p\n q \n\n", "<answer></answer>", " ") == ["x", "q", "", ""]
    assert one(spark, lambda c: T.section(c, "<s>", "</s>"), "<s>a</s><s>b</s>", "n", "<s> open") == ["b", None, "open"]
    assert one(spark, lambda c: T.section(c, None, "<e>"), "a<e>b<e>", "") == ["a", ""]


def test_numbers(spark):
    assert one(spark, T.gsm_answer, "x #### 1,234", "none", "#### -3.5 y") == ["1234", "", "-3.5"]
    assert one(spark, T.two_step_answer, "<think>t</think>Final Answer: 1,200.", "12.") == ["1200", "12"]
    assert one(spark, lambda c: T.two_step_answer(c, True), "12.") == ["12."]
    assert one(spark, T.word_count, " a  b c ", "") == [3, 0]


def packed(text, size):
    out, cur = [], None
    for s in filter(None, re.split(r"(?<=[.!?])\s+|(?<=\n\n)", text)):
        joined = s if not cur else cur + " " + s
        if len(joined) <= size:
            cur = joined
        else:
            out.append(cur or "")
            cur = s
    return out + [cur] if cur else out


def test_chunks(spark):
    rng = random.Random(1)
    texts = ["aaaaaaaaa. bb. cc.", "", "a. b.\n\nc! d? e"] + ["".join(rng.choice("ab. !\n") for _ in range(60)) for _ in range(40)]
    expected = [packed(t, 7) for t in texts]
    assert expected[0] == ["", "aaaaaaaaa.", "bb. cc."]
    assert one(spark, lambda c: T.pack_chunks(c, 7), *texts) == expected
    assert one(spark, lambda c: T.pack_chunks_udf(c, F.lit(7)), *texts) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Dr. Who left. He ran!", ["Dr. Who left.", "He ran!"]),
        ("See https://a.b/c.d now. Ok?", ["See https://a.b/c.d now.", "Ok?"]),
        ("Pi is 3.14. Wow", ["Pi is 3.14.", "Wow"]),
        ("Wait... what", ["Wait..", "what"]),
        ("Acme Inc. The end.", ["Acme Inc. The end."]),
        ("Acme Inc. He left.", ["Acme Inc", "He left."]),
        ("line one\nline two", ["line one", "line two"]),
        ('He said "go." Then', ['He said "go".', "Then"]),
        ("At U.S. borders", ["At U.S. borders"]),
        ("", []),
    ],
)
def test_sentences(text, expected):
    assert T.split_sentences(text) == expected


def test_latex(spark):
    assert T.boxed(r"work \\boxed{\\frac{1}{2}}") == r"\\frac{1}{2}"
    assert T.simplify_latex(r" \\dfrac{1}{2} ") == r"\\frac12"
    assert T.simplify_latex(T.boxed(r"\\boxed{\\sqrt{2}}")) == r"\\sqrt2"
    assert [T.boxed(t) for t in (r"\boxed", r"\boxed 7x", r"\boxed{a", r"\boxed{a}\boxed{b{c}}", "")] == ["", "7", "", "b{c}", ""]
    assert T.simplify_latex(r"\frac{12}{3}\tfrac ab\frac") == r"\frac{12}3\fracab\frac"
    assert T.simplify_latex(r"\frac{\frac{1}{2}}{x}") == r"\frac{\frac12}{x}"
    assert one(spark, T.boxed_for_comparison, r"\boxed{\left( \text{x} \right)}", None) == ["(x)", None]


def test_story_references(spark):
    facts = ["Mary went to the kitchen.", "Mary took the milk.", "Mary went to the garden.", "Mary dropped the milk.", "Mary went to the office."]
    df = spark.createDataFrame([(facts, "Where is the milk? ", ["kitchen", "garden", "office"]), (facts[:3], "Where is the milk?", ["kitchen", "garden"])], "f array<string>, q string, p array<string>")
    assert [r[0] for r in df.select(T.story_references(F.col("f"), F.col("q"), F.col("p"))).collect()] == [[3, 2], [1, 2]]


def test_letters_and_state(spark):
    df = spark.createDataFrame([(["x", "y"], [1, 0])], "e array<string>, s array<int>")
    row = df.select(T.letters(F.col("e")), T.state_text(F.lit("q"), F.col("e"), F.col("s")), T.state_text(F.lit("q"), F.col("e"), F.col("s"), by_index=False)).first()
    assert list(row) == ["\nA) x\nB) y", "q [SEP] x [SEP] y", "q [SEP] y [SEP] x"]
