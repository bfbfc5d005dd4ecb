"""Array expressions over token ids and masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_length(ids: Column, length: int, pad: Column | int) -> Column:
    """Cut to ``length``, or fill up to it with ``pad``."""
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    return F.concat(
        F.slice(ids, 1, length),
        F.array_repeat(pad, F.greatest(F.lit(length) - F.size(ids), F.lit(0))),
    )


def fit_mask(ids: Column, length: int) -> Column:
    """1 for every kept id and 0 for every pad of :func:`fit_length`."""
    kept = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(length) - kept))


def fit_reversed(ids: Column, length: int, pad: Column | int) -> Column:
    """:func:`masked_reverse` of what :func:`fit_length` and :func:`fit_mask` make: the mask's ones stand before its zeros."""
    return fit_length(F.reverse(F.slice(ids, 1, length)), length, pad)


def special_mask(ids: Column, special: Sequence[int]) -> Column:
    """1 where the id is a special one."""
    members = F.array(*[F.lit(s) for s in special])
    return F.transform(ids, lambda i: F.array_contains(members, i).cast("int"))


def _marked(ids: Column, mask: Column, value: int) -> Column:
    zipped = F.arrays_zip(ids.alias("v"), mask.alias("m"))
    return F.transform(F.filter(zipped, lambda z: z["m"] == value), lambda z: z["v"])


def masked_reverse(ids: Column, mask: Column) -> Column:
    """Valid ids reversed and moved to the front, then the pad ids, also in reversed order.

    The mask is not part of the result: callers keep it as it was.
    """
    return F.concat(F.reverse(_marked(ids, mask, 1)), F.reverse(_marked(ids, mask, 0)))


def unreverse(states: Column, mask: Column) -> Column:
    """Valid entries flipped and put first, the other entries after them in their own order."""
    return F.concat(F.reverse(_marked(states, mask, 1)), _marked(states, mask, 0))


def shifted_right(items: Column, first: Column) -> Column:
    """Each entry's predecessor; ``first`` stands before the first entry."""
    return F.concat(F.array(first), F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))))


def shifted_left(items: Column, last: Column) -> Column:
    """Each entry's successor; ``last`` stands after the last entry."""
    return F.concat(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), F.array(last))


def effective_length(asked: int | None, tokenizer_max: int, cap: int = 1024) -> int:
    """Block length: the tokenizer maximum up to ``cap`` when none is asked for."""
    return min(tokenizer_max, cap if asked is None else asked)
