"""Rewards of answers as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import extract
from .hashrng import coin


def binary(text: Column, answer: Column, truncated: Column | None = None) -> Column:
    """1 for the right answer, else 0."""
    return extract.verdict(text, answer, truncated)["reward"]


def random(seed: int, *key: Column) -> Column:
    """1 or 0 by a hash of the seed and the answer's own key, whatever its text."""
    return F.when(coin(seed, *key), 1.0).otherwise(0.0)


def formatted(text: Column, truncated: Column | None = None) -> Column:
    """1 for a text with an explicit answer, right or wrong."""
    return F.when(extract.has_answer_line(text, truncated), 1.0).otherwise(0.0)


#: Rewards by name: (text, answer, truncated, key) to a column.
REWARDS = {
    "verify": lambda text, answer, truncated, key: binary(text, answer, truncated),
    "random_bernoulli": lambda text, answer, truncated, key: random(0, key),
    "format": lambda text, answer, truncated, key: formatted(text, truncated),
}


def was_cut(n_tokens: Column, most: int) -> Column:
    """An answer of the most tokens that were allowed was cut."""
    return n_tokens >= most
