"""Per-row array expressions over token columns: Arrow UDFs over the flat buffers of a batch, and higher-order functions.

A higher-order function is interpreted for every element, which costs more than
the arithmetic; the sums of a row and the token terms of the losses therefore
run over the flat value buffer (:func:`tokens`), with SQL's rules for nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from rollspark.functions.cols import col


def narrowed(df: DataFrame) -> DataFrame:
    """``df`` with its arrays of 64-bit numbers as arrays of 16 or 32 bits where all of a row's numbers fit, for a
    shuffle; :func:`widened` takes it back."""
    def narrow(name):
        c = F.col(f"`{name}`")
        fits = [F.coalesce((F.array_min(c) >= -(1 << n)) & (F.array_max(c) < (1 << n)), F.lit(True)) for n in (15, 31)]
        return F.struct(F.when(fits[0], c.cast("array<smallint>")).alias("s"), F.when(~fits[0] & fits[1], c.cast("array<int>")).alias("i"), F.when(~fits[1], c).alias("l"))
    return df.withColumns({n: narrow(n) for n in _long_arrays(df)})


def widened(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the arrays that :func:`narrowed` made of those of ``like`` as they were."""
    return df.withColumns({n: F.coalesce(F.col(f"`{n}`")["s"].cast("array<bigint>"), F.col(f"`{n}`")["i"].cast("array<bigint>"), F.col(f"`{n}`")["l"]) for n in _long_arrays(like)})


def _long_arrays(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, LongType)]


def dsum(arr) -> Column:
    """Sum of an array as DOUBLE (0 for an empty array; null if one of its elements is null)."""
    return _row_sums(lambda x: x, arr)


def place_weighted_sum(arr) -> Column:
    """sum_i (i+1) * x_i."""
    return _row_sums(lambda x, place: x * place, arr, with_place=True)


def masked_sum(arr, mask) -> Column:
    return _row_sums(lambda x, m: x * m, arr, mask)


def mask_count(mask) -> Column:
    return dsum(mask)


def masked_mean(arr, mask) -> Column:
    """sum(x*m) / max(sum(m), 1) per row."""
    return masked_sum(arr, mask) / F.greatest(mask_count(mask), F.lit(1.0))


class Cells:
    """The elements of all arrays of a batch and which of them are not null; arithmetic with null gives null."""

    def __init__(self, value, ok):
        self.value, self.ok = value, ok

    def _with(self, other, f, swap=False):
        v, ok = (other.value, self.ok & other.ok) if isinstance(other, Cells) else (other, self.ok)
        return Cells(f(v, self.value) if swap else f(self.value, v), ok)

    def __add__(self, other):
        return self._with(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._with(other, lambda a, b: a - b)

    def __rsub__(self, other):
        return self._with(other, lambda a, b: a - b, swap=True)

    def __mul__(self, other):
        return self._with(other, lambda a, b: a * b)

    def __truediv__(self, other):
        return self._with(other, lambda a, b: a / b)

    def __rtruediv__(self, other):
        return self._with(other, lambda a, b: a / b, swap=True)

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self):
        return Cells(-self.value, self.ok)

    def exp(self):
        import numpy as np
        return Cells(np.exp(self.value), self.ok)

    def _skipping(self, other, f):
        """As SQL's ``least`` and ``greatest``: nulls are passed over, NaN is the largest value."""
        import numpy as np
        if not isinstance(other, Cells):
            return Cells(np.where(self.ok, f(self.value, other), other), np.ones_like(self.ok))
        both = f(self.value, other.value)
        return Cells(np.where(self.ok & other.ok, both, np.where(self.ok, self.value, other.value)), self.ok | other.ok)

    def least(self, other):
        import numpy as np
        return self._skipping(other, np.fmin)

    def greatest(self, other):
        import numpy as np
        return self._skipping(other, np.maximum)

    def where_above(self, other, yes: float, no: float):
        """``yes`` where this is above ``other``, ``no`` where it is not or either is null."""
        import numpy as np
        v, ok = (other.value, self.ok & other.ok) if isinstance(other, Cells) else (other, self.ok)
        above = (self.value > v) | (np.isnan(self.value) & ~np.isnan(v))
        return Cells(np.where(ok & above, yes, no), np.ones_like(self.ok))


def _flat(xs):
    """Lengths (0 for a null row), values as doubles and which are not null, of a list array."""
    import numpy as np
    import pyarrow.compute as pc
    lengths = pc.fill_null(pc.list_value_length(xs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = xs.flatten()
    ok = flat.is_valid().to_numpy(zero_copy_only=False) if flat.null_count else np.ones(len(flat), bool)
    return lengths, pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False).astype(np.float64), ok


def _arrow(run, args, result: str) -> Column:
    """``run`` (a function of one list of Arrow arrays) as an Arrow UDF of one to four columns."""
    import pyarrow as pa
    f = {1: lambda a: run([a]), 2: lambda a, b: run([a, b]), 3: lambda a, b, c: run([a, b, c]), 4: lambda a, b, c, d: run([a, b, c, d])}[len(args)]
    f.__annotations__ = dict.fromkeys("abcd"[:len(args)], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(f, result)(*args)


def _row_sums(f, *arrays, with_place: bool = False) -> Column:
    """Sum over each row of ``f`` of the elements, in their order; null if an array or an element is null or the lengths differ."""
    import numpy as np
    import pyarrow as pa

    def run(xs):
        parts = [_flat(x) for x in xs]
        lengths = parts[0][0]
        bad = np.zeros(len(lengths), bool)
        for x, (n, _, ok) in zip(xs, parts, strict=True):
            bad |= (n != lengths) | (x.is_null().to_numpy(zero_copy_only=False))
            if not ok.all():
                bad |= np.bincount(np.repeat(np.arange(len(n)), n), ~ok, len(n)) > 0
        values = []
        for n, v, _ in parts:
            values.append(v if (n == lengths).all() and not bad.any() else v[np.repeat(~bad, n)])
        lengths = np.where(bad, 0, lengths)
        row = np.repeat(np.arange(len(lengths)), lengths)
        if with_place:
            values.append(np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1.0)
        return pa.array(np.bincount(row, f(*values), len(lengths)).astype(np.float64), mask=bad)

    return _arrow(run, [col(a).cast("array<double>") for a in arrays], "double")


def tokens(f, *arrays, of_row=None) -> Column:
    """The array of ``f`` of the elements (:class:`Cells`) of one to four arrays, as ``zip_with``: a shorter array is
    filled up with nulls, and with a null array the result is null. ``of_row`` is a number of the row that ``f`` gets
    last, on every element."""
    import numpy as np
    import pyarrow as pa
    with_row = of_row is not None

    def run(xs):
        lists, row = (xs[:-1], xs[-1]) if with_row else (xs, None)
        parts = [_flat(x) for x in lists]
        none = np.zeros(len(lists[0]), bool)
        for x in lists:
            none |= x.is_null().to_numpy(zero_copy_only=False)
        lengths = np.where(none, 0, np.max([n for n, _, _ in parts], axis=0))
        cells = []
        for n, v, ok in parts:
            if not (n == lengths).all():
                kept = np.repeat(~none, n)
                m = np.where(none, 0, n)
                at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(np.cumsum(lengths) - lengths, m)
                wide, known = np.zeros(lengths.sum()), np.zeros(lengths.sum(), bool)
                wide[at], known[at] = v[kept], ok[kept]
                v, ok = wide, known
            cells.append(Cells(v, ok))
        if row is not None:
            known = row.is_valid().to_numpy(zero_copy_only=False)
            value = row.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64)
            cells.append(Cells(np.repeat(value, lengths), np.repeat(known, lengths)))
        with np.errstate(all="ignore"):
            out = f(*cells)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out.value, pa.float64(), mask=~out.ok), mask=pa.array(none))

    given = [col(a).cast("array<double>") for a in arrays]
    return _arrow(run, given if of_row is None else [*given, col(of_row).cast("double")], "array<double>")


def scale_by_mask(value, mask) -> Column:
    """Broadcast a scalar over a mask: [value * m for m in mask]."""
    v = col(value)
    return F.transform(col(mask), lambda m: v * m.cast("double"))


def zeros_like(arr) -> Column:
    return F.transform(col(arr), lambda x: F.lit(0.0))


def reverse_discounted(arr, gamma: float, reset=None) -> Column:
    """ret_t = x_t + gamma * ret_{t+1} (* reset_{t+1} if given), from the end.

    With ``reset`` = loss mask this is the REINFORCE++ return; without it is a
    discounted future sum. The fold keeps the running value and the output in
    one struct and reverses once at the end.
    """
    a = col(arr)
    if reset is None:
        z = F.transform(a, lambda x: F.struct(x.cast("double").alias("x"), F.lit(1.0).alias("m")))
    else:
        z = F.arrays_zip(a.alias("x"), col(reset).alias("m"))
    init = F.struct(F.lit(0.0).alias("run"),
                    F.array().cast("array<double>").alias("out"))
    folded = F.aggregate(
        F.reverse(z), init,
        lambda acc, e: F.struct(
            ((e["x"].cast("double") + F.lit(gamma) * acc["run"]) * e["m"].cast("double")).alias("run"),
            F.concat(acc["out"], F.array(e["x"].cast("double") + F.lit(gamma) * acc["run"])).alias("out")))
    return F.reverse(folded["out"])


def gae_advantages(rewards, values, gamma: float, lam: float, vectorized: bool = True) -> Column:
    """Unwhitened GAE: delta_t = r_t + gamma*v_{t+1} - v_t; A_t = delta_t + gamma*lam*A_{t+1}."""
    r, v = col(rewards), col(values)
    nxt = F.slice(F.concat(F.slice(v, 2, F.size(v)), F.array(F.lit(0.0))), 1, F.size(v))  # none for an empty row
    delta = tokens(lambda r, v, nv: r + gamma * nv - v, r, v, nxt)
    return (reverse_discounted_vec if vectorized else reverse_discounted)(delta, gamma * lam)


def _reverse_scan(x, m, lengths, gamma):
    """Vectorised reverse recurrence over ragged rows given as one flat array:
    out_t = x_t + gamma * run; run = out_t * m_t, from each row's end.

    Step j handles the j-th cell from the end of every row still that long, so
    the Python loop runs max(length) times and the work is O(cells)."""
    import numpy as np
    ends = np.cumsum(lengths)
    order = np.argsort(-lengths, kind="stable")
    sorted_len = lengths[order]
    out = np.empty_like(x)
    run = np.zeros(len(lengths))
    maxlen = int(sorted_len[0]) if len(sorted_len) else 0
    for j in range(maxlen):
        k = int(np.searchsorted(-sorted_len, -j, side="left"))  # rows with length > j
        rows = order[:k]
        idx = ends[rows] - 1 - j
        v = x[idx] + gamma * run[rows]
        out[idx] = v
        run[rows] = v * m[idx]
    return out


def reverse_discounted_vec(arr, gamma: float, reset=None) -> Column:
    """Same result as :func:`reverse_discounted`, computed by an Arrow UDF: the
    list column arrives as one flat value buffer plus list lengths, the
    reverse scan is vectorised over all rows of the batch, and the result is
    rebuilt as a list array (no Python object per row; linear in tokens,
    where the SQL fold copies its growing output array at every step)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(arrays) -> pa.Array:
        xs = arrays[0]
        lengths = pc.fill_null(pc.list_value_length(xs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = pc.fill_null(xs.flatten(), 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
        m = np.ones_like(x) if len(arrays) == 1 else pc.fill_null(arrays[1].flatten(), 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
        out = _reverse_scan(x, m, lengths, gamma) if len(x) else x
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out, type=pa.float64()), mask=xs.is_null())

    return _arrow(run, [col(a).cast("array<double>") for a in (arr, reset) if a is not None], "array<double>")


def masked_moments(arr, mask) -> Column:
    """Per row struct ``n`` (sum of the mask), ``mean`` and ``m2`` (sum of squared deviations from it) of the masked
    cells and ``total`` of all cells, by an Arrow UDF over the flat buffers. A row without masked cells has n = 0 and mean 0."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(xs: pa.Array, ms: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(xs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = pc.fill_null(xs.flatten(), 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
        m = pc.fill_null(ms.flatten(), 0.0).to_numpy(zero_copy_only=False).astype(np.float64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        add = lambda v: np.bincount(row, weights=v, minlength=len(lengths)).astype(np.float64)
        n = add(m)
        mean = np.divide(add(x * m), n, out=np.zeros_like(n), where=n > 0)
        return pa.StructArray.from_arrays([pa.array(v) for v in (n, mean, add(m * (x - mean[row]) ** 2), add(x))], ["n", "mean", "m2", "total"])

    run.__annotations__ = {"xs": pa.Array, "ms": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(run, "struct<n: double, mean: double, m2: double, total: double>")
    present = col(arr).isNotNull() & col(mask).isNotNull()
    return udf(F.when(present, col(arr).cast("array<double>")), F.when(present, col(mask).cast("array<double>")))
