"""A stratified pool of integer-pipeline problems, from hashed numbers: attempt by attempt, but with no order needed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.hashrng import between, hash_int
from tallyforge.functions.intpipe import FILTERS, FINAL, STEP, TRANSFORMS, canonical_id, reject_reason, solved

from .tiering import spread_counts, wanted_attempts


@dataclass(frozen=True)
class PoolConfig:
    """Fixed values of the default pool: span bands by scale, filters and transforms of a problem, total steps."""

    seed: int = 20260901
    lo_min: int = 1
    bands: tuple[tuple[str, int, int], ...] = (("S", 10, 50), ("M", 51, 200))
    filters: tuple[int, int] = (1, 4)
    transforms: tuple[int, int] = (0, 3)
    steps: tuple[int, int] = (2, 5)
    excluded: tuple[str, ...] = ("positive", "negative")
    least_final: int = 3

    def __post_init__(self):
        ordered = sorted(self.bands, key=lambda b: b[1])
        if any(a[2] >= b[1] for a, b in zip(ordered, ordered[1:], strict=False)):
            raise ValueError("span bands overlap")
        if unknown := set(self.excluded) - set(FILTERS):
            raise ValueError(f"unknown filters: {sorted(unknown)}")
        for n in range(self.steps[0], self.steps[1] + 1):
            if not self.step_pairs(n):
                raise ValueError(f"no numbers of filters and transforms make {n} steps")

    def step_pairs(self, total: int) -> list[tuple[int, int]]:
        return [(f, total - 1 - f) for f in range(self.filters[0], self.filters[1] + 1) if self.transforms[0] <= total - 1 - f <= self.transforms[1]]


def _step(name: Column, **values: Column) -> Column:
    fields = [values.get(k, F.lit(None)).cast("bigint").alias(k) for k in ("d", "k", "m", "n")]
    tail = [values.get(k, F.lit(None)).cast("bigint").alias(k) for k in ("s", "t")]
    return F.struct(*fields, name.alias("name"), *tail).cast(STEP)


def _pick(names: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.pmod(number, F.lit(len(names))).cast("int"))


def candidates(cells: DataFrame, attempts: int, config: PoolConfig = PoolConfig()) -> DataFrame:
    """``cells`` (scale, total_steps) times 0..attempts-1, each with an unchecked pipeline."""
    return drawn(cells.crossJoin(cells.sparkSession.range(attempts).withColumnRenamed("id", "attempt")), config)


def drawn(rows: DataFrame, config: PoolConfig = PoolConfig(), numbers=hash_int) -> DataFrame:
    """``rows`` (scale, total_steps, attempt), each with an unchecked pipeline. ``numbers``: ``hash_int``, or ``sha_int``, which other engines can
    repeat."""
    draw = lambda *slot: numbers(config.seed, F.col("scale"), F.col("total_steps"), F.col("attempt"), *slot)
    low, high = (F.element_at(F.create_map(*[x for b in config.bands for x in (F.lit(b[0]), F.lit(b[k]))]), F.col("scale")).cast("bigint") for k in (1, 2))
    span = between(draw("span"), low, high)
    rows = rows.withColumn("span", span).withColumn("lo", between(draw("lo"), config.lo_min, F.lit(config.lo_min) + high - F.col("span"))).withColumn("hi", F.col("lo") + F.col("span"))
    pairs = None
    for n in range(config.steps[0], config.steps[1] + 1):
        options = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t")) for f, t in config.step_pairs(n)])
        choice = F.get(options, F.pmod(draw("pair"), F.lit(len(config.step_pairs(n)))).cast("int"))
        pairs = F.when(F.col("total_steps") == n, choice) if pairs is None else pairs.when(F.col("total_steps") == n, choice)
    rows = rows.withColumn("pair", pairs)
    allowed = [n for n in FILTERS if n not in config.excluded]

    def a_filter(i: Column) -> Column:
        name = _pick(allowed, draw("filter", i))
        number = draw("filter value", i)
        when = lambda names, value: F.when(name.isin(*names), value)
        return _step(name, n=when(("divisible_by", "not_divisible_by"), between(number, 2, 12)), t=when(("below_threshold", "above_threshold"), between(number, F.col("lo"), F.col("hi") + 1)), s=when(("digit_sum_equals",), between(number, 1, 18)), d=when(("contains_digit",), between(number, 0, 9)))

    def a_transform(i: Column) -> Column:
        name = _pick(list(TRANSFORMS), draw("transform", i))
        number = draw("transform value", i)
        added = between(number, -9, 9)
        k = F.when(name == "add", F.when(added == 0, 1).otherwise(added)).when(name == "multiply", between(number, 2, 5))
        return _step(name, k=k, m=F.when(name == "modulo", between(number, 2, 20)))

    op = _pick(list(FINAL), draw("op"))
    listed = lambda n, make: F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.when(i < n, make(i))), lambda s: s.isNotNull())
    pipeline = F.struct(
        listed(F.col("pair.f"), a_filter).alias("filters"), _step(op, m=F.when(op == "product_mod", between(draw("op value"), 2, 96))).alias("op"),
        F.struct(F.col("hi").cast("bigint").alias("hi"), F.col("lo").cast("bigint").alias("lo")).alias("range"), listed(F.col("pair.t"), a_transform).alias("transforms"),
    )
    return rows.select("scale", "total_steps", "attempt", pipeline.alias("pipeline"))


def checked(rows: DataFrame, least: int = 3) -> DataFrame:
    """Candidates with trace, answer, reason (null: acceptable) and problem_id; of equal ones the first attempt counts."""
    found = solved(rows).withColumn("reason", reject_reason(least=least)).withColumn("problem_id", canonical_id())
    return first_attempts(found, "problem_id", ["attempt", "scale", "total_steps"])


def first_attempts(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with reason ``duplicate_id`` where an earlier acceptable row (reason null) has the same key."""
    first = Window.partitionBy(key, F.col("reason").isNull()).orderBy(*order)
    again = F.col("reason").isNull() & (F.row_number().over(first) > 1)
    return rows.withColumn("reason", F.when(again, "duplicate_id").otherwise(F.col("reason")))


def filled(rows: DataFrame, targets: DataFrame, cell: list[str], attempt: str = "attempt") -> tuple[DataFrame, DataFrame]:
    """(rows taken, cell accounting): each cell of ``targets`` (``cell``, target) filled with its first acceptable attempts. The account has for each
    cell the attempts up to the one that filled it (all, if it stays short), accepted, target and rejection_rate. Cells are few."""
    nth = F.sum(F.col("reason").isNull().cast("int")).over(Window.partitionBy(*cell).orderBy(attempt))
    known = rows.join(F.broadcast(targets), cell).withColumn("nth", nth)
    used = known.where((F.col("nth") < F.col("target")) | ((F.col("nth") == F.col("target")) & F.col("reason").isNull()))
    account = used.groupBy(*cell, "target").agg(F.count("*").alias("attempts"), F.count_if(F.col("reason").isNull()).alias("accepted"))
    return used.where("reason is null").drop("nth"), account.withColumn("rejection_rate", F.round(1 - F.col("accepted") / F.col("attempts"), 4))


def cell_targets(spark: SparkSession, n: int, config: PoolConfig = PoolConfig()) -> DataFrame:
    cells = [(b[0], s) for b in config.bands for s in range(config.steps[0], config.steps[1] + 1)]
    return spark.createDataFrame([(*c, t) for c, t in zip(cells, spread_counts(n, len(cells)), strict=True)], "scale string, total_steps int, target long")


def pool(spark: SparkSession, n: int, config: PoolConfig = PoolConfig(), attempts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(problems, cell accounting): each cell filled with its first acceptable attempts; more attempts are made while one is
    short, up to a bound that is an error."""
    targets = cell_targets(spark, n, config)
    most = targets.agg(F.max("target")).first()[0]
    attempts = attempts or max(64, 8 * most)
    while True:
        rows = checked(candidates(targets.select("scale", "total_steps"), attempts, config), config.least_final)
        made, account = filled(rows, targets, ["scale", "total_steps"])
        if account.where("accepted = target").count() == targets.where("target > 0").count():
            break
        if attempts >= wanted_attempts(most):
            raise RuntimeError(f"a cell is short after {attempts} attempts")
        attempts *= 2
    account = account.drop("target")
    problems = made.select("problem_id", "pipeline", F.col("answer").cast("bigint").alias("answer"), F.col("scale").alias("range_scale"), F.size("pipeline.filters").alias("n_filters"), F.size("pipeline.transforms").alias("n_transforms"), "total_steps")
    return problems, account


def config_of(document: dict) -> PoolConfig:
    """A pool's configuration from a document (``store.parse`` of its file): seed, range (lo_min and bands: scale to [low, high] spans), filters,
    transforms and steps ([least, most]), excluded filters, least_final. What it doesn't name is as by default; another name is an error."""
    names = {"seed", "lo_min", "bands", "filters", "transforms", "steps", "excluded", "least_final"}
    if unknown := set(document) - names:
        raise ValueError(f"unknown settings of a pool: {sorted(unknown)}")
    given = dict(document)
    if "bands" in given:
        given["bands"] = tuple((str(scale), int(low), int(high)) for scale, (low, high) in given["bands"].items())
    return PoolConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def regenerated_diff(stored: DataFrame, n: int, config: PoolConfig = PoolConfig()) -> DataFrame:
    """Problems that a stored pool (problem_id, answer, range_scale, total_steps) and one generated anew don't have in common, by side: none if the
    pool can be reproduced."""
    from .reports import row_diff

    columns = ["problem_id", "answer", "range_scale", "total_steps"]
    return row_diff(stored.select(*columns), pool(stored.sparkSession, n, config)[0].select(*columns))


def pool_uniform(spark: SparkSession, n: int, config: PoolConfig = PoolConfig(), attempts: int | None = None) -> DataFrame:
    """A pool without strata: each attempt is in a cell by its own hash, and the first ``n`` acceptable ones stay."""
    names = [(b[0], s) for b in config.bands for s in range(config.steps[0], config.steps[1] + 1)]
    cells = F.array(*[F.struct(F.lit(a).alias("scale"), F.lit(b).alias("total_steps")) for a, b in names])
    attempts = attempts or max(64, 8 * n)
    while True:
        rows = spark.range(attempts).select(F.col("id").alias("attempt"), F.get(cells, F.pmod(hash_int(config.seed, F.lit("cell"), F.col("id")), F.lit(len(names))).cast("int")).alias("c"))
        good = checked(drawn(rows.select("c.*", "attempt"), config), config.least_final).where("reason is null").orderBy("attempt").limit(n)
        if good.count() == n:
            return good.select("problem_id", "pipeline", F.col("answer").cast("bigint").alias("answer"), F.col("scale").alias("range_scale"), "total_steps", "attempt")
        if attempts >= wanted_attempts(n):
            raise RuntimeError(f"{attempts} attempts aren't enough for {n} problems")
        attempts *= 2


def summaries(problems: DataFrame) -> DataFrame:
    """Counts by scale, by steps and by final operation, in one pass."""
    named = problems.withColumn("op", F.col("pipeline.op.name"))
    return named.groupingSets([["range_scale"], ["total_steps"], ["op"]], "range_scale", "total_steps", "op").agg(F.count("*").alias("n"))


RANGES = ("Look at every integer from {lo} up to {hi}, both included.", "Begin with all whole numbers between {lo} and {hi}, ends included.", "Write down the integers {lo} to {hi}, counting {lo} and {hi}.")
PHRASES = {
    "even": ("keep the even ones", "drop every odd number", "leave only numbers divisible by two"),
    "odd": ("keep the odd ones", "drop every even number", "leave only numbers not divisible by two"),
    "positive": ("keep the numbers above zero", "drop zero and all negatives", "leave only positive numbers"),
    "negative": ("keep the numbers under zero", "drop zero and all positives", "leave only negative numbers"),
    "divisible_by": ("keep the multiples of {n}", "drop what {n} doesn't divide", "leave only numbers that {n} divides"),
    "not_divisible_by": ("drop the multiples of {n}", "keep what {n} doesn't divide", "leave only numbers that aren't multiples of {n}"),
    "below_threshold": ("keep the numbers under {t}", "drop {t} and all above it", "leave only numbers smaller than {t}"),
    "above_threshold": ("keep the numbers over {t}", "drop {t} and all below it", "leave only numbers larger than {t}"),
    "digit_sum_equals": ("keep those whose digits add up to {s}", "drop those whose digit sum isn't {s}", "leave only numbers with digit sum {s}"),
    "contains_digit": ("keep those written with the digit {d}", "drop those without a digit {d}", "leave only numbers that show a {d}"),
    "prime": ("keep the primes", "drop what isn't prime", "leave only prime numbers"),
    "perfect_square": ("keep the perfect squares", "drop what isn't a square", "leave only squares of integers"),
    "add": ("add {k} to each", "raise each by {k}", "replace each v by v + {k}"),
    "subtract": ("subtract {k} from each", "lower each by {k}", "replace each v by v - {k}"),
    "multiply": ("multiply each by {k}", "take {k} times each", "replace each v by {k}v"),
    "square": ("square each", "multiply each by itself", "replace each v by its square"),
    "absolute_value": ("drop the signs", "take absolute values", "replace each v by |v|"),
    "modulo": ("take each modulo {m}", "replace each by its remainder on division by {m}", "reduce each to its residue modulo {m}"),
    "digit_sum": ("replace each by the sum of its digits", "add up the digits of each", "take digit sums"),
    "reverse_digits": ("reverse the digits of each", "write each backwards", "replace each by its digits in reverse order"),
    "count": ("count what is left", "say how many values remain", "give the number of values"),
    "unique_count": ("count the different values", "say how many distinct values remain", "give the number of distinct values"),
    "zero_count": ("count the zeros", "say how many values are 0", "give the number of zeros"),
    "sum": ("add all values up", "give the total", "find the sum of what is left"),
    "product_mod": ("give the product of all values modulo {m}", "multiply all values and reduce modulo {m}", "find the remainder of the product on division by {m}"),
    "mean": ("give the mean, rounded half to even", "find the average, rounded to the nearest even on ties", "average the values and round, ties to even"),
    "median": ("give the lower median", "find the middle value, the lower of two", "sort and take the middle, the lower one for an even count"),
    "mode": ("give the most frequent value, the smallest on ties", "find the mode, ties to the smallest", "say which value is most common, the least of equals"),
    "min": ("give the smallest value", "find the minimum", "say what the least value is"),
    "max": ("give the largest value", "find the maximum", "say what the greatest value is"),
    "range": ("give the largest minus the smallest", "find the spread from least to greatest", "subtract the minimum from the maximum"),
    "bitwise_and": ("combine all values by bitwise AND", "give the AND of all bits", "AND all values together"),
    "bitwise_or": ("combine all values by bitwise OR", "give the OR of all bits", "OR all values together"),
    "bitwise_xor": ("combine all values by bitwise XOR", "give the XOR of all bits", "XOR all values together"),
}


def check_phrases(least: int = 3) -> None:
    if short := [n for n, p in PHRASES.items() if len(p) < least] + [n for n in (*FILTERS, *TRANSFORMS, *FINAL) if n not in PHRASES]:
        raise ValueError(f"too few phrases: {short}")


def render(seed: int = 0, pipeline: str = "pipeline", key: str = "problem_id", numbers=hash_int) -> Column:
    """The problem in words, phrases chosen by a hash (``numbers``) of (seed, key, place)."""
    table = F.create_map(*[x for n, p in PHRASES.items() for x in (F.lit(n), F.array(*map(F.lit, p)))])
    chosen = lambda options, place: F.get(options, F.pmod(numbers(seed, F.col(key), place), F.size(options).cast("bigint")).cast("int"))

    def phrase(s: Column, place: Column) -> Column:
        negative = (s["name"] == "add") & (s["k"] < 0)
        text = chosen(F.element_at(table, F.when(negative, "subtract").otherwise(s["name"])), place)
        for p in ("d", "k", "m", "n", "s", "t"):
            text = F.replace(text, F.lit("{" + p + "}"), F.coalesce((F.abs(s[p]) if p == "k" else s[p]).cast("string"), F.lit("")))
        return text

    p = F.col(pipeline)
    first = chosen(F.array(*map(F.lit, RANGES)), F.lit(-1))
    for name in ("lo", "hi"):
        first = F.replace(first, F.lit("{" + name + "}"), p["range"][name].cast("string"))
    steps = F.transform(F.concat(p["filters"], p["transforms"]), lambda s, i: F.concat(F.when(i == 0, F.lit("First, ")).otherwise(chosen(F.array(F.lit("Then, "), F.lit("Next, ")), i)), phrase(s, i), F.lit(".")))
    last = F.concat(chosen(F.array(F.lit("Finally, "), F.lit("Of these, ")), F.lit(-2)), phrase(p["op"], F.lit(-3)), F.lit("."))
    return F.concat_ws(" ", first, F.array_join(steps, " "), last)


TEMPLATE = "{problem_text}\n\nEnd with a line of the form\nAnswer: <integer>"


def prompt(text: Column, template: str = TEMPLATE) -> Column:
    return F.replace(F.lit(template), F.lit("{problem_text}"), text)


def chat(text: Column, turns: str = "{user}", system: str = "") -> Column:
    """A prompt in the turns of a chat model, given as text with {system} and {user}. The model's own template is its tokenizer's matter."""
    return F.replace(F.replace(F.lit(turns), F.lit("{system}"), F.lit(system)), F.lit("{user}"), text)


def val_candidates(pool_rows: DataFrame, n: int = 500, seed: int = 0, key: str = "problem_id", order: str = "pool_idx") -> DataFrame:
    """``n`` problems without replacement by hash, in the pool's order."""
    return pool_rows.orderBy(hash_int(seed, F.col(key)), key).limit(n).orderBy(order)
