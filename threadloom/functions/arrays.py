"""Fixed-length integer rows: speaker ids, padding, export form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom import fixed_values as V
from threadloom.functions.text import _col


def speaker_class(code: Column | str) -> Column:
    """2 for a known account, 1 for anybody else."""
    return F.when(_col(code) > 0, F.lit(2)).otherwise(F.lit(1))


def repeat_over_turns(classes: Column | str, turns: Column | str) -> Column:
    """Each turn's speaker class, once per id of that turn, flattened."""
    per_turn = F.zip_with(_col(classes), _col(turns), lambda c, t: F.array_repeat(c, F.size(t)))
    return F.flatten(per_turn)


def left_pad(ids: Column | str, length: int = V.SEQUENCE_LENGTH) -> Column:
    """Zeros on the left, and only the last ``length`` ids of a longer array."""
    a = _col(ids)
    kept = F.slice(a, F.greatest(F.size(a) - length, F.lit(0)) + 1, F.lit(length))
    zeros = F.array_repeat(F.lit(V.UNKNOWN_ID), F.greatest(length - F.size(a), F.lit(0)))
    return F.concat(zeros, kept)


def padding_mask(ids: Column | str) -> Column:
    return F.transform(_col(ids), lambda x: (x != V.UNKNOWN_ID).cast("int"))


def packed_line(*rows: Column | str) -> Column:
    """The rows one after another as one comma-separated line."""
    return F.array_join(F.flatten(F.array(*[_col(r) for r in rows])), ",")
