"""Integer pipelines (range, filters, transforms, final operation) as array expressions.

A step is a struct with its name and parameters. Values are DECIMAL(38,0), so that squares of squares don't overflow; a value
that still does makes its step null (reason ``invalid_params``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = "struct<d:bigint,k:bigint,m:bigint,n:bigint,name:string,s:bigint,t:bigint>"
PIPELINE = f"struct<filters:array<{STEP}>,op:{STEP},range:struct<hi:bigint,lo:bigint>,transforms:array<{STEP}>>"
NUMBER = "decimal(38,0)"
MAX_ANSWER = 1_000_000_000

_text = "cast(abs(v) as string)"
_digit_sum = f"aggregate(split({_text}, ''), 0L, (a, c) -> a + coalesce(try_cast(c as bigint), 0L))"

#: Predicate of each filter over v, with the step's parameters.
FILTERS = {
    "even": "v % 2 = 0",
    "odd": "v % 2 <> 0",
    "positive": "v > 0",
    "negative": "v < 0",
    "divisible_by": "v % s.n = 0",
    "not_divisible_by": "v % s.n <> 0",
    "below_threshold": "v < s.t",
    "above_threshold": "v > s.t",
    "digit_sum_equals": f"{_digit_sum} = s.s",
    "contains_digit": f"contains({_text}, cast(s.d as string))",
    "prime": "v > 1 and not exists(sequence(2L, greatest(2L, cast(ceil(sqrt(v)) as bigint))), p -> p < v and v % p = 0)",
    "perfect_square": "v >= 0 and cast(round(sqrt(v)) as decimal(19,0)) * cast(round(sqrt(v)) as decimal(19,0)) = v",
}
#: New value of each transform over v; null where it doesn't fit.
TRANSFORMS = {
    "add": "try_add(v, cast(s.k as decimal(38,0)))",
    "multiply": "try_multiply(v, cast(s.k as decimal(38,0)))",
    "square": "try_multiply(v, v)",
    "absolute_value": "abs(v)",
    "modulo": "pmod(v, cast(s.m as decimal(38,0)))",
    "digit_sum": _digit_sum,
    "reverse_digits": f"cast(sign(v) as int) * try_cast(reverse({_text}) as decimal(38,0))",
}
_sum = "aggregate(a, cast(0 as decimal(38,0)), (x, v) -> cast(try_add(x, v) as decimal(38,0)))"
_sorted = "array_sort(a)"
_fold = lambda op: f"cast(aggregate(slice(a, 2, size(a)), try_cast(a[0] as bigint), (x, v) -> x {op} try_cast(v as bigint)) as decimal(38,0))"
#: Result of each final operation over the array a.
FINAL = {
    "count": "size(a)",
    "unique_count": "size(array_distinct(a))",
    "zero_count": "size(filter(a, v -> v = 0))",
    "sum": _sum,
    "product_mod": "aggregate(a, cast(1 as decimal(38,0)), (x, v) -> cast(pmod(x * pmod(v, cast(op.m as decimal(18,0))), cast(op.m as decimal(18,0))) as decimal(38,0)))",
    "mean": f"bround(cast({_sum} as decimal(38,6)) / size(a), 0)",
    "median": f"element_at({_sorted}, cast(floor((size(a) + 1) / 2) as int))",
    "mode": "array_sort(transform(array_distinct(a), v -> struct(-size(filter(a, w -> w = v)) as n, v as v)))[0].v",
    "min": "array_min(a)",
    "max": "array_max(a)",
    "range": "array_max(a) - array_min(a)",
    "bitwise_and": _fold("&"),
    "bitwise_or": _fold("|"),
    "bitwise_xor": _fold("^"),
}


def _guarded(name: str, value: str) -> str:
    """Parameters that make a step impossible give null."""
    need = {"divisible_by": "n", "not_divisible_by": "n", "modulo": "m"}.get(name)
    return f"CASE WHEN s.{need} <> 0 THEN {value} END" if need else value


def trace(pipeline: str = "pipeline") -> Column:
    """array<array<decimal>>: the values at first and after each step; null if the range is empty or a step is impossible.

    An empty step result stays empty to the end."""
    filters = " ".join(f"WHEN '{n}' THEN {_guarded(n, f'filter(a, v -> {p})')}" for n, p in FILTERS.items())
    transforms = " ".join(f"WHEN '{n}' THEN {_guarded(n, f'transform(a, v -> cast({p} as decimal(38,0)))')}" for n, p in TRANSFORMS.items())
    step = f"CASE s.name {filters} {transforms} END"
    first = f"transform(sequence({pipeline}.range.lo, {pipeline}.range.hi), v -> cast(v as decimal(38,0)))"
    grown = f"aggregate(concat({pipeline}.filters, {pipeline}.transforms), array({first}), (acc, s) -> array_append(acc, transform(array(element_at(acc, -1)), a -> {step})[0]))"
    whole = f"CASE WHEN {pipeline}.range.lo <= {pipeline}.range.hi THEN {grown} END"
    return F.expr(f"transform(array({whole}), t -> CASE WHEN NOT exists(t, a -> a IS NULL OR exists(a, v -> v IS NULL)) THEN t END)[0]")


def answer(traced: str = "trace", pipeline: str = "pipeline") -> Column:
    """The final operation over the last values of a trace; null if there are none or it is impossible."""
    cases = " ".join(f"WHEN '{n}' THEN cast({e} as {NUMBER})" for n, e in FINAL.items() if n != "product_mod")
    cases += f" WHEN 'product_mod' THEN CASE WHEN op.m <> 0 THEN cast({FINAL['product_mod']} as {NUMBER}) END"
    return F.expr(f"transform(array(struct(element_at({traced}, -1) as a, {pipeline}.op as op)), x -> transform(array(x.a), a -> transform(array(x.op), op -> CASE WHEN size(a) > 0 THEN CASE op.name {cases} END END)[0])[0])[0]")


def solved(df, pipeline: str = "pipeline"):
    """``df`` with trace and answer."""
    return df.withColumn("trace", trace(pipeline)).withColumn("answer", answer("trace", pipeline))


def step_sizes(traced: str = "trace") -> Column:
    return F.expr(f"transform({traced}, a -> size(a))")


def reject_reason(traced: str = "trace", answered: str = "answer", pipeline: str = "pipeline", least: int = 3) -> Column:
    """The first rule that a pipeline breaks, or null."""
    p, t = pipeline, traced
    doubled = f"exists(sequence(1, size({p}.filters) - 1), i -> {p}.filters[i] = {p}.filters[i - 1])"
    steps = f"""get(filter(transform(sequence(1, size({t}) - 1), i -> CASE WHEN size({t}[i]) = 0 THEN 'empty_set'
        WHEN array_sort({t}[i]) = array_sort({t}[i - 1]) THEN IF(i <= size({p}.filters), 'noop_filter', 'noop_transform') END), r -> r IS NOT NULL), 0)"""
    last = f"element_at({t}, -1)"
    return F.expr(f"""
        CASE WHEN size({p}.filters) > 1 AND {doubled} THEN 'duplicate_consecutive_filters'
             WHEN {t} IS NULL THEN 'invalid_params'
             WHEN size({t}) > 1 AND {steps} IS NOT NULL THEN {steps}
             WHEN size({last}) < {least} THEN 'too_few_at_final_op'
             WHEN {p}.op.name = 'mode' AND size(array_distinct({last})) = size({last}) THEN 'mode_without_repeat'
             WHEN {p}.op.name = 'unique_count' AND size(array_distinct({last})) = size({last}) THEN 'unique_count_without_repeat'
             WHEN {p}.op.name LIKE 'bitwise%' AND array_min({last}) < 0 THEN 'bitwise_negative'
             WHEN {answered} IS NULL THEN 'invalid_params'
             WHEN abs({answered}) > {MAX_ANSWER} THEN 'answer_too_large' END""")


def canonical_json(pipeline: str = "pipeline") -> Column:
    """Compact JSON with keys in alphabetical order and without null parameters; the struct's fields are in that order."""
    return F.to_json(F.col(pipeline))


def canonical_id(pipeline: str = "pipeline") -> Column:
    return F.sha2(canonical_json(pipeline), 256)


def structure_id(pipeline: str = "pipeline") -> Column:
    """The same without the range."""
    return F.sha2(F.to_json(F.col(pipeline).dropFields("range")), 256)
