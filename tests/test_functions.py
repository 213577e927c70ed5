"""Golden cases of extraction, verification, pass@k and pipelines."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import extract, intpipe
from tallyforge.functions.passk import pass_at_k
from tallyforge.operators import stats, tiering

#: Written integers and their values, and what they can be put into.
VALUES = {"52": 52, "-8": -8, "3,204": 3204, "-1,000,000": -1_000_000, "0045": 45}
LABELS = ("Answer", "answer", "ANSWER", "Final Answer", "final  answer")
DRESSES = ("{}", "  {}  ", "**{}**", "__{}__", "*{}*", "_{}_", "`{}`", '"{}"', "\u201c{}\u201d", "\\[ {} \\]", "\\({}\\)", "## {}", "> {}", "- {}", "* {}", "\u2022 {}", "> - **{}**")
BRACKETS = ("{}", "${}$", "${}", "\\boxed{{{}}}", "$\\boxed{{ {} }}$", "<{}>", "< {} >", "<integer>{}</integer>", "<integer> {}", "\\({}\\)", "**{}**", "_{}_")
HEADS = ("Answer:{}", "Answer : {}", "**Answer:** {}", "**Answer**: {}", "_Final answer:_ {}", "**Answer: {}", "Final answer: Answer: {}", "\\text{{Answer:}} {}", "Answer: {}.", "Answer: {},")
BELOW = ("Answer:\n{}", "Answer\n\n  {}\n", "**Final Answer:**\n**{}**", "### Answer\n> {}.", "**Answer:\n{}")
AROUND = ("{}", "First I count 17 of them.\n{}", "{}\nThat needed 2 steps, not 3.", "Answer: 991\nNo, once more.\n{}", "so \\boxed{{991}}\r\n{}", "{}\n\n")
SENTENCES = ("{}", "it comes to {}", "The answer is {}.", "Answers: {}", "of 3, 5 and 7 I take {}", "we get\n\n{}\nor so", "\\[ {} \\]", "boxed{{{}}}", "Answer: 77 and {}", "Answer = {}")
NOTHING = ("", "   \n", "Answer:", "Answer: twelve", "Answer: <integer>", "**Final Answer:**\nnone", "I don't know", "f(x) = y", None)


def explicit_cases():
    lines = [label + ": " + v for label in LABELS for v in VALUES]
    dressed = [d.format("Answer: " + v) for d in DRESSES for v in VALUES]
    bracketed = ["Answer: " + b.format(v) for b in BRACKETS for v in VALUES]
    others = [h.format(v) for h in (*HEADS, *BELOW, "so we have \\boxed{{{}}} in all", "\\[\n\\boxed{{{}}}\n\\]") for v in VALUES]
    texts = lines + dressed + bracketed + others
    values = list(VALUES.values())
    return [(t, values[k % len(values)]) for k, t in enumerate(texts)]


EXPLICIT = {a.replace("{{", "{").replace("}}", "}").replace("{}", t): v for a in AROUND for t, v in explicit_cases()}
FALLBACK = {s.format(v): n for s in SENTENCES for v, n in VALUES.items()}


def test_extraction(spark):
    cases = [(t, v, True) for t, v in EXPLICIT.items()] + [(t, v, False) for t, v in FALLBACK.items()] + [(t, None, False) for t in NOTHING]
    df = spark.createDataFrame(cases, "t string, v long, line boolean")
    out = df.select("t", "v", "line", extract.extract_answer(F.col("t")).alias("got"), extract.has_answer_line(F.col("t")).alias("got_line"), extract.extract_answer(F.col("t"), F.lit(True)).alias("cut")).collect()
    assert [r for r in out if r["got"] != r["v"] or r["got_line"] != r["line"] or r["cut"] is not None] == []


def test_verdicts(spark):
    long = "Answer: " + "9" * 40
    df = spark.createDataFrame([("Answer: 3.",), ("Answer: 99",), ("none",), (long,)], "t string").select(extract.verdict(F.col("t"), F.lit(3)).alias("v")).select("v.*")
    assert [tuple(r) for r in df.collect()] == [(1.0, 3, False), (0.0, 99, False), (0.0, None, True), (0.0, None, False)]


@pytest.mark.parametrize(("n", "c", "k", "p"), [(8, 8, 1, 1.0), (8, 0, 4, 0.0), (8, 1, 1, 0.125), (8, 1, 8, 1.0), (8, 1, 2, 0.25), (4, 1, 8, None)])
def test_pass_at_k(spark, n, c, k, p):
    assert spark.range(1).select(pass_at_k(F.lit(n), F.lit(c), k).alias("p")).first()["p"] == p


def pipeline(lo, hi, filters, transforms, op):
    step = lambda s: {**dict.fromkeys("dkmnst"), **s}
    return {"range": {"lo": lo, "hi": hi}, "filters": [step(s) for s in filters], "transforms": [step(s) for s in transforms], "op": step(op)}


def solve(spark, p):
    df = intpipe.solved(spark.createDataFrame([(p,)], f"pipeline {intpipe.PIPELINE}"))
    r = df.select(F.col("answer").cast("long"), intpipe.reject_reason().alias("reason"), "trace").first()
    return r["answer"], r["reason"]


def test_pipelines(spark):
    assert solve(spark, pipeline(7, 33, [{"name": "digit_sum_equals", "s": 6}], [], {"name": "max"}))[0] == 33
    assert solve(spark, pipeline(1, 50, [{"name": "divisible_by", "n": 5}], [{"name": "add", "k": 7}], {"name": "product_mod", "m": 82}))[0] == 66
    assert solve(spark, pipeline(1, 49, [{"name": "below_threshold", "t": 29}, {"name": "divisible_by", "n": 5}], [], {"name": "bitwise_and"}))[0] == 0
    assert solve(spark, pipeline(1, 9, [{"name": "even"}, {"name": "even"}], [], {"name": "sum"}))[1] == "duplicate_consecutive_filters"
    assert solve(spark, pipeline(1, 9, [{"name": "divisible_by", "n": 0}], [], {"name": "sum"}))[1] == "invalid_params"
    assert solve(spark, pipeline(5, 1, [], [], {"name": "sum"}))[1] == "invalid_params"
    assert solve(spark, pipeline(-120, -118, [], [{"name": "reverse_digits"}], {"name": "min"}))[0] == -911


def test_criterion_and_tiers(spark):
    c = spark.range(1).select(stats.criterion(F.lit(0.5), F.lit(0.1), F.lit(0.2)).alias("a"), stats.criterion(F.lit(0.5), F.lit(0.1), F.lit(-0.2)).alias("b"), stats.criterion(F.lit(0.5), F.lit(None), F.lit(0.2)).alias("c")).first()
    assert tuple(c) == (True, False, None)
    assert [r["t"] for r in spark.range(9).select(tiering.tier_of(F.col("id")).alias("t")).collect()] == ["hard"] * 2 + ["medium"] * 4 + ["easy"] * 3
    with pytest.raises(Exception, match="out of range"):
        spark.range(9, 10).select(tiering.tier_of(F.col("id")).alias("t")).collect()
    assert stats.ratio_interval([1, 2, 3], [1, -1, 0.1], 500)["bounded"] is False and stats.ratio_interval([1, 2, 3], [1, 1, 1], 500)["bounded"]


def test_looser_rules(spark):
    """By rule what is read, from texts of each reading's own making."""
    cases = [
        ("Answer: 5", 5, 5, 5), ("so\nAnswer:   5  \nbye", 5, 5, 5), ("  Answer: 5", None, 5, 5), ("answer: 5", None, 5, 5), ("Answer: 1,000", None, 1000, 1000), ("Answer: 5 of 6", None, None, None),
        ("**Final Answer:** 7.", None, 7, 7), ("Answer 7", None, 7, 7), ("**Answer**: $\\boxed{8}$.", None, 8, 8), ("my Answer: 5", None, None, None), ("Answer: 5 apples", None, None, None), ("Answer:\n\n9", 9, 9, 9),
        ("so \\boxed{ 12 } it is", None, 12, 12), ("\\boxed{12", None, None, None), ("the answer is 4, I think", None, None, 4), ("The final answer is: $\\boxed{44}$ here", None, 44, 44), ("the answer is (6)", None, None, 6),
        ("Answer: 1\nthe answer is 2", 1, 1, 2), ("the answer is 2\nAnswer: 1", 1, 1, 1), ("\\boxed{3}\nAnswer: 1\n\\boxed{4}", 1, 4, 4), ("Answer: 1\nAnswer: two", 1, 1, 1), ("nothing", None, None, None), ("", None, None, None), (None, None, None, None),
        ("Answer: -3", -3, -3, -3), ("12 Answer: 5", None, None, None), ("the answer is clearly 5", None, None, None), ("Answer: 99999999999999999999", None, None, None), ("ANSWER: 5}", None, 5, 5),
    ]
    df = spark.createDataFrame([c[:1] for c in cases], "t string").select("t", *[extract.extract_by_rule(F.col("t"), r).alias(r) for r in ("strict", "boxed", "prose")])
    got = [(r["t"], r["strict"], r["boxed"], r["prose"]) for r in df.collect()]
    assert got == cases


def test_rule_previews_read_a_text_once_by_patterns(spark):
    """One scan for all rules, no lambdas over the pieces of a text, one group a problem before rules are told apart."""
    from tallyforge.plans import catalogue

    c = spark.createDataFrame([("Answer: 5",)], "t string")
    plans = {r: c.select(extract.extract_by_rule(F.col("t"), r))._jdf.queryExecution().optimizedPlan().toString() for r in extract.RULES}
    assert not any("lambda" in p for p in plans.values())
    d = "/root/testdata/sf0.001"
    for name, exchanges in (("rule_preview", 1), ("preview_rules", 2)):
        plan = catalogue.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and plan.count("Exchange ") == exchanges, plan
    texts = ["**Final Answer:**\n\n  12", "Answer: 3\nAnswer:\n-4.\nso", "Answer:\n\n**7**", "**Answer:\n8", "answer:\n1,234\n9", "Answer:\nx\n5", "Answer:\n5 answer"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(extract.extract_by_rule(F.col("t"), "current")).collect()]
    assert got == [12, -4, 7, 8, 1234, 5, 5]
