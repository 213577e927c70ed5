"""Answer extraction over texts with known answers, integer pipelines, identities and prompts."""

from pyspark.sql import functions as F

from tallyforge.functions import extract as x
from tallyforge.functions import intpipe
from tallyforge.functions.hashrng import sha_int
from tallyforge.operators import caps, generate, rollups
from tallyforge.operators.tiering import spread_counts
from tallyforge.sources.adapters import table

from .catalogue import query

# -- completions with a known integer, in a form that l_linenumber chooses

KNOWN = "l_partkey * 37 - 2000"


def completions(spark, d):
    a = F.expr(KNOWN)
    s = a.cast("string")
    grouped = F.when(a < 0, F.concat(F.lit("-"), F.format_number(-a, 0))).otherwise(F.format_number(a, 0))
    n = F.col("l_linenumber")
    text = (
        F.when(n == 1, F.concat(F.lit("I add 3 and 4.\nAnswer: "), s))
        .when(n == 2, F.concat(F.lit("**Final Answer: "), s, F.lit("**")))
        .when(n == 3, F.concat(F.lit("So 12 of them.\n\\["), F.lit("\\boxed{"), s, F.lit("}\\]")))
        .when(n == 4, F.concat(F.lit("> Answer: "), grouped, F.lit(".\nthat took 3 steps")))
        .when(n == 5, F.concat(F.lit("Answer: 5\nno.\n**Final Answer:**\n\n  "), s))
        .when(n == 6, F.concat(F.lit("it could be 5, or 7, or "), s))
        .otherwise(F.concat(F.lit("Answer: "), s))
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", a.alias("known"), text.alias("completion"), (n == 7).alias("truncated"))


@query("extract_answers", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 7 THEN {KNOWN} END AS extracted FROM lineitem")
def extract_answers(spark, d):
    c = completions(spark, d)
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.extract_answer(F.col("completion"), F.col("truncated")).alias("extracted"))


@query("verify_answers", f"""WITH v AS (SELECT l_linenumber, {KNOWN} AS known, CASE WHEN l_suppkey % 4 = 0 THEN {KNOWN} + 1 ELSE {KNOWN} END AS answer FROM lineitem)
    SELECT l_linenumber, count(*) AS n, sum((l_linenumber <> 7 AND known = answer)::INT)::DOUBLE AS reward, sum((l_linenumber = 7)::INT)::BIGINT AS failed FROM v GROUP BY 1""")
def verify_answers(spark, d):
    c = completions(spark, d).withColumn("answer", F.col("known") + F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0))
    v = c.withColumn("v", x.verdict(F.col("completion"), F.col("answer"), F.col("truncated")))
    return v.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("v.reward").alias("reward"), F.count_if("v.extraction_failed").alias("failed"))


@query("answer_line_rate", "SELECT l_linenumber, CASE WHEN l_linenumber IN (6, 7) THEN 0.0 ELSE 1.0 END::DOUBLE AS rate FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def answer_line_rate(spark, d):
    c = completions(spark, d)
    return c.groupBy("l_linenumber").agg(F.avg(x.has_answer_line(F.col("completion"), F.col("truncated")).cast("double")).alias("rate"))


@query("rescore_texts", f"SELECT l_linenumber, sum(CASE WHEN l_linenumber <> 7 THEN 1.0 ELSE 0 END)::DOUBLE AS reward, count(DISTINCT {KNOWN}) FILTER (l_linenumber <> 7) AS answers FROM lineitem GROUP BY 1")
def rescore_texts(spark, d):
    c = completions(spark, d).select("l_linenumber", F.col("l_partkey").alias("problem_id"), "completion", "truncated", F.lit(None).cast("bigint").alias("answer"), "known")
    pool = c.select("problem_id", F.col("known").alias("answer")).distinct()
    out = caps.rescored(c.drop("known"), pool.withColumn("answer", F.col("answer") + 1), [pool])
    return out.groupBy("l_linenumber").agg(F.sum("reward").alias("reward"), F.count_distinct("extracted_answer").alias("answers"))


BUCKETED = (
    ("Answer: 16 numbers", False, "parsed_by_current_rule"),
    ("thinking", True, "truncated"),
    ("Answer: sixteen", False, "answer_non_integer"),
    ("**Answer** unclear", False, "answer_case_or_markdown"),
    ("well, the answer is unknown", False, "answer_in_prose"),
    ("no mention", False, "no_answer_mention"),
)


@query("extract_buckets", "WITH b(k, bucket) AS (VALUES " + ", ".join(f"({k}, '{b}')" for k, (_, _, b) in enumerate(BUCKETED)) + ") SELECT bucket, count(*) AS n FROM lineitem JOIN b ON l_partkey % 6 = k GROUP BY bucket")
def extract_buckets(spark, d):
    pick = lambda i, kind: F.get(F.array(*[F.lit(b[i]) for b in BUCKETED]), (F.col("l_partkey") % 6).cast("int")).alias(kind)
    rows = table(spark, d, "lineitem").select(pick(0, "t"), pick(1, "c"))
    return rows.groupBy(x.failure_bucket(F.col("t"), F.col("c")).alias("bucket")).agg(F.count("*").alias("n"))


@query("rule_preview", """WITH l AS (SELECT l_linenumber AS f, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT rule, sum(CASE WHEN list_contains(forms, f) THEN n ELSE 0 END)::BIGINT AS extracted FROM l, (VALUES ('strict', [1, 5, 7]), ('boxed', [1, 3, 5, 7]), ('prose', [1, 3, 5, 7]), ('current', [1, 2, 3, 4, 5, 6, 7])) v(rule, forms) GROUP BY rule""")
def rule_preview(spark, d):
    c = completions(spark, d)
    rules = ("strict", "boxed", "prose", "current")
    found = c.agg(*[F.count(x.extract_by_rule(F.col("completion"), rule)).alias(rule) for rule in rules])
    return found.select(F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("extracted")) for rule in rules])).alias("x")).select("x.*")


@query("strict_integers", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_partkey * 1000 END AS parsed, p_partkey AS after_mark FROM part")
def strict_integers(spark, d):
    k = F.col("p_partkey")
    s = F.when(k % 3 == 0, F.concat(F.lit(" "), (k * 1000).cast("string"))).when(k % 3 == 1, F.format_number(k * 1000, 0)).otherwise(F.concat((k * 1000).cast("string"), F.lit(" apples")))
    return table(spark, d, "part").select("p_partkey", x.strict_integer(s).alias("parsed"), x.hashed_answer(F.concat(F.lit("so 3+4=7\n#### "), F.format_number(k, 0), F.lit(" "))).alias("after_mark"))


@query("right_somewhere", f"SELECT l_linenumber, sum((l_linenumber <> 4 OR abs({KNOWN}) < 1000)::INT)::BIGINT AS n FROM lineitem GROUP BY 1")
def right_somewhere(spark, d):
    return completions(spark, d).groupBy("l_linenumber").agg(F.count_if(x.right_integer_somewhere(F.col("completion"), F.col("known"))).alias("n"))


# -- integer pipelines made of part rows

FILTER_OF = ("even", "odd", "divisible_by", "not_divisible_by", "below_threshold", "above_threshold", "digit_sum_equals", "contains_digit", "prime", "perfect_square", "positive", "negative")
TRANSFORM_OF = ("add", "multiply", "square", "absolute_value", "modulo", "digit_sum", "reverse_digits")
OP_OF = ("count", "unique_count", "zero_count", "sum", "product_mod", "mean", "median", "mode", "min", "max", "range", "bitwise_and", "bitwise_or", "bitwise_xor")


def pipelines(spark, d):
    """One filter, one transform, one operation, chosen by the part's key."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), F.pmod(i, F.lit(len(names))).cast("int"))
    null = F.lit(None).cast("bigint")
    f, t, o = pick(FILTER_OF, k), pick(TRANSFORM_OF, F.floor(k / 12)), pick(OP_OF, F.floor(k / 5))
    lo = k % 50 + 1 - F.when(k % 4 == 0, 30).otherwise(0)
    step = lambda name, **v: F.struct(*[v.get(c, null).cast("bigint").alias(c) for c in "dkmn"], name.alias("name"), *[v.get(c, null).cast("bigint").alias(c) for c in "st"])
    of = lambda names, name, value: F.when(name.isin(*names), value)
    a_filter = step(f, d=of(["contains_digit"], f, k % 10), n=of(["divisible_by", "not_divisible_by"], f, k % 5 + 2), s=of(["digit_sum_equals"], f, k % 9 + 1), t=of(["below_threshold", "above_threshold"], f, lo + size))
    a_transform = step(t, k=of(["add", "multiply"], t, k % 4 + 2), m=of(["modulo"], t, k % 7 + 3))
    op = step(o, m=of(["product_mod"], o, k % 40 + 7))
    p = F.struct(F.array(a_filter).alias("filters"), op.alias("op"), F.struct((lo + size + 10).alias("hi"), lo.alias("lo")).alias("range"), F.array(a_transform).alias("transforms"))
    return table(spark, d, "part").select("p_partkey", p.alias("pipeline"))


def _named(names, i):
    return f"(['{"', '".join(names)}'])[1 + ({i}) % {len(names)}]"


DIGITS = "list_sum(list_transform(string_split(abs(v)::VARCHAR, ''), lambda c: c::BIGINT))"
V_PIPES = f"""
    p AS (SELECT p_partkey AS k, p_size::BIGINT AS size, {_named(FILTER_OF, 'p_partkey')} AS f, {_named(TRANSFORM_OF, 'p_partkey // 12')} AS t, {_named(OP_OF, 'p_partkey // 5')} AS o,
        p_partkey % 50 + 1 - CASE WHEN p_partkey % 4 = 0 THEN 30 ELSE 0 END AS lo FROM part),
    v0 AS (SELECT *, unnest(range(lo, lo + size + 11)) AS v FROM p),
    v1 AS (SELECT *, v AS src FROM v0 WHERE CASE f WHEN 'even' THEN v % 2 = 0 WHEN 'odd' THEN v % 2 <> 0 WHEN 'positive' THEN v > 0 WHEN 'negative' THEN v < 0 WHEN 'divisible_by' THEN v % (k % 5 + 2) = 0
        WHEN 'not_divisible_by' THEN v % (k % 5 + 2) <> 0 WHEN 'below_threshold' THEN v < lo + size WHEN 'above_threshold' THEN v > lo + size WHEN 'digit_sum_equals' THEN {DIGITS} = k % 9 + 1
        WHEN 'contains_digit' THEN contains(abs(v)::VARCHAR, (k % 10)::VARCHAR) WHEN 'prime' THEN v > 1 AND len(list_filter(range(2, v), lambda q: v % q = 0)) = 0
        ELSE v >= 0 AND floor(sqrt(greatest(v, 0)) + 0.5)::BIGINT * floor(sqrt(greatest(v, 0)) + 0.5)::BIGINT = v END),
    v2 AS (SELECT * REPLACE (CASE t WHEN 'add' THEN v + k % 4 + 2 WHEN 'multiply' THEN v * (k % 4 + 2) WHEN 'square' THEN v * v WHEN 'absolute_value' THEN abs(v)
        WHEN 'modulo' THEN ((v % (k % 7 + 3)) + (k % 7 + 3)) % (k % 7 + 3) WHEN 'digit_sum' THEN {DIGITS} ELSE sign(v)::BIGINT * reverse(abs(v)::VARCHAR)::BIGINT END AS v) FROM v1),
    g AS (SELECT k, any_value(o) AS o, list(v::BIGINT ORDER BY src) AS a FROM v2 GROUP BY k),
    counted AS (SELECT k, v, count(*) AS n FROM v2 GROUP BY k, v), modes AS (SELECT k, arg_min(v, (-n) * 100000000 + v) AS mode FROM counted GROUP BY k),
    solved AS (SELECT k, CASE o WHEN 'count' THEN len(a) WHEN 'unique_count' THEN len(list_distinct(a)) WHEN 'zero_count' THEN len(list_filter(a, lambda v: v = 0)) WHEN 'sum' THEN list_sum(a)
        WHEN 'product_mod' THEN list_reduce(a, lambda s, v: ((s * v) % (k % 40 + 7) + (k % 40 + 7)) % (k % 40 + 7), 1::BIGINT) WHEN 'mean' THEN round_even(list_sum(a) / len(a), 0)
        WHEN 'median' THEN (list_sort(a))[(len(a) + 1) // 2] WHEN 'mode' THEN mode WHEN 'min' THEN list_min(a) WHEN 'max' THEN list_max(a) WHEN 'range' THEN list_max(a) - list_min(a)
        WHEN 'bitwise_and' THEN list_bit_and(a) WHEN 'bitwise_or' THEN list_bit_or(a) ELSE list_bit_xor(a) END::BIGINT AS answer FROM g JOIN modes USING (k))
"""


@query("intpipe_answers", f"WITH {V_PIPES} SELECT p.k AS p_partkey, answer FROM p LEFT JOIN solved USING (k)")
def intpipe_answers(spark, d):
    return intpipe.solved(pipelines(spark, d)).select("p_partkey", F.col("answer").cast("bigint").alias("answer"))


@query("intpipe_trace_sizes", f"WITH {V_PIPES} SELECT p.k AS p_partkey, concat_ws(',', size + 11, coalesce(len(a), 0), coalesce(len(a), 0)) AS sizes FROM p LEFT JOIN g USING (k)")
def intpipe_trace_sizes(spark, d):
    return intpipe.solved(pipelines(spark, d)).select("p_partkey", F.array_join(intpipe.step_sizes().cast("array<string>"), ",").alias("sizes"))


@query("reject_reasons", f"""WITH {V_PIPES}, before AS (SELECT k, list(v::BIGINT ORDER BY v) AS b0, list(v::BIGINT ORDER BY v) AS dummy FROM v0 GROUP BY k), mid AS (SELECT k, list(v::BIGINT ORDER BY v) AS b1 FROM v1 GROUP BY k),
    j AS (SELECT p.*, b0, b1, a, answer FROM p JOIN before USING (k) LEFT JOIN mid USING (k) LEFT JOIN g USING (k) LEFT JOIN solved USING (k)),
    why AS (SELECT k, CASE WHEN b1 IS NULL THEN 'empty_set' WHEN b0 = b1 THEN 'noop_filter' WHEN list_sort(a) = b1 THEN 'noop_transform' WHEN len(a) < 3 THEN 'too_few_at_final_op'
        WHEN o = 'mode' AND len(list_distinct(a)) = len(a) THEN 'mode_without_repeat' WHEN o = 'unique_count' AND len(list_distinct(a)) = len(a) THEN 'unique_count_without_repeat'
        WHEN o LIKE 'bitwise%' AND list_min(a) < 0 THEN 'bitwise_negative' WHEN abs(answer) > 1000000000 THEN 'answer_too_large' END AS reason FROM j)
    SELECT reason, count(*) AS n FROM why GROUP BY reason""")
def reject_reasons(spark, d):
    solved = intpipe.solved(pipelines(spark, d))
    return solved.groupBy(intpipe.reject_reason().alias("reason")).agg(F.count("*").alias("n"))


@query("canonical_ids", """WITH p AS (SELECT p_partkey AS k, p_partkey % 50 + 1 AS lo, p_partkey % 50 + 11 + p_size AS hi FROM part),
    j AS (SELECT k, '{"filters":[{"n":3,"name":"divisible_by"},{"name":"even"}],"op":{"name":"sum"},' AS head, '"range":{"hi":' || hi || ',"lo":' || lo || '},' AS span, '"transforms":[]}' AS tail FROM p)
    SELECT k AS p_partkey, sha256(head || span || tail) AS problem_id, sha256(head || tail) AS structure_id FROM j""")
def canonical_ids(spark, d):
    p = F.expr("""struct(array(struct(null as d, null as k, null as m, 3L as n, 'divisible_by' as name, null as s, null as t), struct(null as d, null as k, null as m, null as n, 'even' as name, null as s, null as t)) as filters,
        struct(null as d, null as k, null as m, null as n, 'sum' as name, null as s, null as t) as op, struct(p_partkey % 50 + 11 + p_size as hi, p_partkey % 50 + 1 as lo) as range, array() as transforms)""").cast(intpipe.PIPELINE)
    return table(spark, d, "part").select("p_partkey", p.alias("pipeline")).select("p_partkey", intpipe.canonical_id().alias("problem_id"), intpipe.structure_id().alias("structure_id"))


@query("render_prompts", "SELECT p_partkey, p_name || chr(10) || chr(10) || 'End with a line of the form' || chr(10) || 'Answer: <integer>' AS prompt FROM part")
def render_prompts(spark, d):
    return table(spark, d, "part").select("p_partkey", generate.prompt(F.col("p_name")).alias("prompt"))


# -- the generator's parts, on part and order rows, by numbers that SQL can repeat

SEED = generate.PoolConfig().seed


def _drawn(slot, index=None, key="scale || ':' || steps || ':' || attempt"):
    """DuckDB SQL of ``sha_int`` for a slot of an attempt; ``index``: SQL of a place in a list."""
    tail = f" || ':' || {index}" if index else ""
    return f"('0x' || substr(sha256('{SEED}:' || {key} || ':{slot}'{tail}), 1, 12))::BIGINT"


ALLOWED = [n for n in intpipe.FILTERS if n not in generate.PoolConfig().excluded]
_DRAWN_FILTER = f"""CASE WHEN name IN ('divisible_by', 'not_divisible_by') THEN name || ' ' || (2 + number % 11) WHEN name IN ('below_threshold', 'above_threshold') THEN name || ' ' || (lo + number % (hi + 2 - lo))
    WHEN name = 'digit_sum_equals' THEN name || ' ' || (1 + number % 18) WHEN name = 'contains_digit' THEN name || ' ' || number % 10 ELSE name END"""
_DRAWN_TRANSFORM = "CASE WHEN name = 'add' THEN name || ' ' || (CASE WHEN number % 19 = 9 THEN 1 ELSE number % 19 - 9 END) WHEN name = 'multiply' THEN name || ' ' || (2 + number % 4) WHEN name = 'modulo' THEN name || ' ' || (2 + number % 19) ELSE name END"


def _listed(kind, names, shown, n):
    return f"""SELECT attempt, string_agg({shown}, ', ' ORDER BY i) AS {kind}s FROM (SELECT attempt, lo, hi, i, {_named(names, _drawn(kind, 'i'))} AS name, {_drawn(kind + ' value', 'i')} AS number FROM (SELECT *, unnest(range({n})) AS i FROM ranged)) GROUP BY attempt"""


@query("drawn_candidates", f"""WITH a AS (SELECT p_partkey AS attempt, CASE WHEN p_size % 2 = 0 THEN 'S' ELSE 'M' END AS scale, 2 + p_partkey % 4 AS steps FROM part),
    spans AS (SELECT *, CASE scale WHEN 'S' THEN 50 ELSE 200 END AS high, CASE scale WHEN 'S' THEN 10 + {_drawn('span')} % 41 ELSE 51 + {_drawn('span')} % 150 END AS span, 1 + {_drawn('pair')} % (steps - 1) AS f, {_named(list(intpipe.FINAL), _drawn('op'))} AS op, {_drawn('op value')} AS opn FROM a),
    ranged AS (SELECT *, 1 + {_drawn('lo')} % (high - span + 1) AS lo, 1 + {_drawn('lo')} % (high - span + 1) + span AS hi FROM spans),
    fs AS ({_listed('filter', ALLOWED, _DRAWN_FILTER, 'f')}), ts AS ({_listed('transform', list(intpipe.TRANSFORMS), _DRAWN_TRANSFORM, 'steps - 1 - f')})
    SELECT attempt, scale, steps AS total_steps, lo, hi, filters, coalesce(transforms, '') AS transforms, CASE op WHEN 'product_mod' THEN op || ' ' || (2 + opn % 95) ELSE op END AS op FROM ranged JOIN fs USING (attempt) LEFT JOIN ts USING (attempt)""")
def drawn_candidates(spark, d):
    """Each part is an attempt at a problem."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("attempt"), F.when(F.col("p_size") % 2 == 0, "S").otherwise("M").alias("scale"), (2 + k % 4).alias("total_steps"))
    shown = lambda s: F.concat_ws(" ", s["name"], F.coalesce(s["n"], s["t"], s["s"], s["d"], s["k"], s["m"]).cast("string"))
    p = F.col("pipeline")
    return generate.drawn(rows, numbers=sha_int).select("attempt", "scale", "total_steps", p["range"]["lo"].alias("lo"), p["range"]["hi"].alias("hi"), F.array_join(F.transform(p["filters"], shown), ", ").alias("filters"), F.array_join(F.transform(p["transforms"], shown), ", ").alias("transforms"), shown(p["op"]).alias("op"))


ATTEMPTS = """o AS (SELECT o_orderkey AS attempt, o_orderpriority AS priority, o_orderstatus AS status, o_custkey AS customer, CASE WHEN o_totalprice < 50000 THEN 'too_cheap' END AS cheap FROM orders),
    r AS (SELECT *, CASE WHEN cheap IS NULL AND row_number() OVER (PARTITION BY customer, cheap IS NULL ORDER BY attempt) > 1 THEN 'duplicate_id' ELSE cheap END AS reason FROM o),
    t AS (SELECT priority, 120 // 5 + (row_number() OVER (ORDER BY priority) <= 120 % 5)::INT AS target FROM (SELECT DISTINCT priority FROM o)),
    n AS (SELECT *, sum((reason IS NULL)::INT) OVER (PARTITION BY priority ORDER BY attempt) AS nth FROM r JOIN t USING (priority)),
    used AS (SELECT * FROM n WHERE nth < target OR (nth = target AND reason IS NULL))"""


def _attempts(spark, d):
    """Orders as attempts: cells by priority, no cheap ones, one for each customer, 120 in all."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("attempt"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"), F.when(F.col("o_totalprice") < 50000, "too_cheap").alias("reason"))
    rows = generate.first_attempts(rows, "customer", ["attempt"])
    cells = sorted(r["priority"] for r in rows.select("priority").distinct().collect())  # five
    targets = spark.createDataFrame(list(zip(cells, spread_counts(120, len(cells)), strict=True)), "priority string, target long")
    return rows, generate.filled(rows, targets, ["priority"])


@query("cells_filled", f"WITH {ATTEMPTS} SELECT attempt, priority, customer FROM used WHERE reason IS NULL")
def cells_filled(spark, d):
    return _attempts(spark, d)[1][0].select("attempt", "priority", "customer")


@query("cells_account", f"WITH {ATTEMPTS} SELECT priority, any_value(target)::BIGINT AS target, count(*) AS attempts, sum((reason IS NULL)::INT)::BIGINT AS accepted, round(1 - sum((reason IS NULL)::INT) / count(*), 4) AS rejection_rate FROM used GROUP BY priority")
def cells_account(spark, d):
    return _attempts(spark, d)[1][1]


@query("attempts_rejected", f"WITH {ATTEMPTS} SELECT priority, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY ALL")
def attempts_rejected(spark, d):
    return _attempts(spark, d)[0].groupBy("priority", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def _quoted(names):
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


PHRASE_TABLE = "phrases(name, options) AS (VALUES " + ", ".join(f"('{n}', {_quoted(p)})" for n, p in generate.PHRASES.items()) + ")"


def _phrase(options, place):
    number = f"('0x' || substr(sha256('0:' || k || ':{place}'), 1, 12))::BIGINT"
    return f"({options})[1 + {number} % len({options})]"


def _put(text, **values):
    for name, value in values.items():
        text = f"replace({text}, '{{{name}}}', coalesce(({value})::VARCHAR, ''))"
    return text


_F_VALUES = {"d": "k % 10", "n": "k % 5 + 2", "s": "k % 9 + 1", "t": "lo + size"}


@query("rendered_problems", f"""WITH {V_PIPES}, {PHRASE_TABLE}, j AS (SELECT p.*, a.options AS fo, b.options AS to_, c.options AS oo FROM p JOIN phrases a ON a.name = f JOIN phrases b ON b.name = t JOIN phrases c ON c.name = o)
    SELECT k AS p_partkey, {_put(_phrase(_quoted(generate.RANGES), -1), lo='lo', hi='lo + size + 10')} || ' First, ' || {_put(_phrase('fo', 0), **_F_VALUES)} || '. '
        || {_phrase("['Then, ', 'Next, ']", 1)} || {_put(_phrase('to_', 1), k='k % 4 + 2', m='k % 7 + 3')} || '. ' || {_phrase("['Finally, ', 'Of these, ']", -2)} || {_put(_phrase('oo', -3), m='k % 40 + 7')} || '.' AS text FROM j""")
def rendered_problems(spark, d):
    return pipelines(spark, d).select("p_partkey", generate.render(0, key="p_partkey", numbers=sha_int).alias("text"))


@query("pipeline_invariants", f"""WITH {V_PIPES}, before AS (SELECT k, list(v::BIGINT ORDER BY v) AS b0 FROM v0 GROUP BY k), mid AS (SELECT k, list(v::BIGINT ORDER BY v) AS b1 FROM v1 GROUP BY k),
    j AS (SELECT p.k, b0, coalesce(b1, []) AS b1, coalesce(a, []) AS a FROM p JOIN before USING (k) LEFT JOIN mid USING (k) LEFT JOIN g USING (k))
    SELECT k AS p_partkey, 'empty step' AS broken FROM j WHERE len(b1) = 0 UNION ALL SELECT k, 'step without effect' FROM j WHERE b0 = b1 OR list_sort(a) = b1 UNION ALL SELECT k, 'too few values at the last step' FROM j WHERE len(a) < 3""")
def pipeline_invariants(spark, d):
    """Of pipelines that no rule has checked, so that many break a promise."""
    traced = intpipe.solved(pipelines(spark, d)).withColumnRenamed("p_partkey", "problem_id")
    return rollups.invariants(traced).withColumnRenamed("problem_id", "p_partkey")


@query("problem_pool")
def problem_pool(spark, d):
    problems, _ = generate.pool(spark, 64)
    return problems.select("problem_id", "answer", "range_scale", "total_steps", generate.render().alias("text"))


@query("pool_account")
def pool_account(spark, d):
    return generate.pool(spark, 64)[1]


#: Problems of the reference's pool; the two queries above make a small one.
POOL = 6000


@query("problem_pool_whole")
def problem_pool_whole(spark, d):
    problems, _ = generate.pool(spark, POOL)
    return problems.select("problem_id", "answer", "range_scale", "total_steps", generate.render().alias("text"))


@query("pool_account_whole")
def pool_account_whole(spark, d):
    return generate.pool(spark, POOL)[1]


@query("dedup_exact_docs", "SELECT source, count(*) AS n, count(DISTINCT text) AS n_texts, sum(first::INT)::BIGINT AS kept FROM (SELECT source, text, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1 AS first FROM documents) GROUP BY source")
def dedup_exact_docs(spark, d):
    from tallyforge.operators.tiering import rejection_select

    rows = table(spark, d, "documents").select(F.col("source").alias("problem_id"), F.col("doc_id").alias("sample_idx"), F.col("text").alias("completion"), F.lit(True).alias("correct"))
    kept = rejection_select(rows).groupBy("problem_id").agg(F.count("*").alias("kept"))
    totals = rows.groupBy("problem_id").agg(F.count("*").alias("n"), F.count_distinct("completion").alias("n_texts"))
    return totals.join(kept, "problem_id").withColumnRenamed("problem_id", "source")
