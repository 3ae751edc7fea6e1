"""Ranges of whole numbers as nodes of a binary tree, to be met by equality joins.

Node (level, node) stands for the numbers from ``node * 2 ** level`` to before ``(node + 1) * 2 ** level``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nodes_above(number: Column, levels: int) -> Column:
    """The nodes (level, node) of a binary tree over whole numbers from 0 that a number lies under."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda l: F.struct(l.alias("level"), F.floor(number / F.pow(F.lit(2.0), l)).cast("long").alias("node")))  # noqa: E741


def nodes_before(number: Column, levels: int) -> Column:
    """The nodes that cover all whole numbers from 0 to below ``number`` (at most 2 ** levels), each once."""
    at = lambda l: F.floor(number / F.pow(F.lit(2.0), l)).cast("long")  # noqa: E731, E741
    odd = F.filter(F.sequence(F.lit(0), F.lit(levels)), lambda l: at(l) % 2 == 1)  # noqa: E741
    return F.transform(odd, lambda l: F.struct(l.alias("level"), (at(l) - 1).alias("node")))  # noqa: E741
