"""Reverse-Polish factor formulas folded into DataFrame steps.

The builder walks the tokens once on the driver and adds one column per operator.  Operators of
the same row stay inside one projection; Spark does not nest window functions, so every window
operator is materialised as a column of its own.  Time windows share one partitioning, each
switch to a cross-section operator and back costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.features import NAMES
from factorloom.functions.ops import OPS
from factorloom.functions.recursion import with_ema
from factorloom.functions.series import Series, clamp, clean

OP_NAMES = list(OPS)


def token_names(tokens: Sequence[int | str]) -> list[str] | None:
    """Integer tokens (features first, then operators) or names, as names; None if unknown."""
    vocabulary = [*NAMES, *OP_NAMES]
    out = []
    for token in tokens:
        if isinstance(token, str):
            out.append(token)
        elif 0 <= token < len(vocabulary):
            out.append(vocabulary[token])
        else:
            return None
    return out


def stack_shape(names: Sequence[str]) -> bool:
    """True if the tokens leave exactly one value and never run short of operands."""
    depth = 0
    for name in names:
        need = OPS[name].arity if name in OPS else 0
        if depth < need:
            return False
        depth += 1 - need
    return depth == 1


def _finite(x: Column) -> Column:
    return ~(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def evaluate(
    df: DataFrame, tokens: Sequence[int | str], s: Series = Series(), leaves: Sequence[str] = NAMES,
    factor: str = "factor", normalise: bool = True,
) -> DataFrame:
    """Add ``factor`` and ``invalid`` to ``df``, whose columns include the leaf features.

    A malformed formula gives a NULL factor.  Non-finite values are replaced at every step and
    remembered in ``invalid``.
    """
    names = token_names(tokens)
    legal = names is not None and all(n in OPS or n in leaves for n in names) and stack_shape(names)
    if not legal:
        return df.withColumns({factor: F.lit(None).cast("double"), "invalid": F.lit(True)})
    inputs = df.columns
    stack: list[tuple[str, str]] = []
    for i, name in enumerate(names):
        value, invalid = f"_f{i}", f"_i{i}"
        if name not in OPS:
            raw, bad = F.col(name), F.lit(False)
        else:
            op = OPS[name]
            args = [stack.pop() for _ in range(op.arity)][::-1]
            columns = [a for a, _ in args]
            if op.kind == "ema":
                df = with_ema(df, s, {"_raw": (columns[0], (op.span,))})
            else:
                df = df.withColumn("_raw", op.build(s, *columns))
            raw, bad = F.col("_raw"), F.col(args[0][1])
            for _, other in args[1:]:
                bad = bad | F.col(other)
        df = df.withColumns({value: clean(raw, 0.0, 1.0, -1.0), invalid: bad | ~_finite(raw)}).drop("_raw")
        stack.append((value, invalid))
    value, invalid = stack[0]
    if normalise:
        df = df.withColumn("_out", normalised(s, value))
    else:
        df = df.withColumn("_out", F.col(value))
    return df.select(
        *inputs, clean(F.col("_out"), 0.0, 3.0, -3.0).alias(factor), (F.col(invalid) | ~_finite(F.col("_out"))).alias("invalid")
    )


def normalised(s: Series, x: str) -> Column:
    """Z-score across the codes of one time, or over the past where only one code exists."""
    several = F.count(F.lit(1)).over(s.cross()) > 1
    across = (F.col(x) - F.avg(x).over(s.cross())) / F.greatest(F.stddev_samp(x).over(s.cross()), F.lit(1e-8))
    past = F.sqrt(F.greatest(F.var_pop(x).over(s.so_far()), F.lit(1e-8)))
    alone = (F.col(x) - F.avg(x).over(s.so_far())) / past
    return clamp(F.when(several, across).otherwise(alone), -3.0, 3.0)


# -- restricted dialect ----------------------------------------------------------------
# Fixed values of the restricted dialect.
RESTRICTED_ARITY = {"ADD": 2, "SUB": 2, "MUL": 2, "DIV": 2, "NEG": 1, "ABS": 1, "CS_RANK": 1}
MAX_TOKENS, MAX_DEPTH, MAX_OPERATORS = 32, 7, 12


def restricted_shape(tokens: Sequence[str], leaves: Sequence[str]) -> bool:
    depths: list[int] = []
    for token in tokens:
        if token in leaves:
            depths.append(1)
        elif token in RESTRICTED_ARITY and len(depths) >= RESTRICTED_ARITY[token]:
            args = [depths.pop() for _ in range(RESTRICTED_ARITY[token])]
            depths.append(max(args) + 1)
        else:
            return False
    operators = sum(t in RESTRICTED_ARITY for t in tokens)
    return len(depths) == 1 and depths[0] <= MAX_DEPTH and len(tokens) <= MAX_TOKENS and operators <= MAX_OPERATORS


def evaluate_restricted(
    df: DataFrame, tokens: Sequence[str], available: dict[str, str], member: str, cutoff: str,
    s: Series = Series(), factor: str = "factor",
) -> DataFrame:
    """Missing values infect, x/0 is missing, ranks use average ties over valid members.

    ``available`` maps each leaf to the column with its availability time; a leaf that is not
    available at ``cutoff`` or whose row is not a ``member`` is missing.  The availability of a
    result is the latest of its inputs, and of all participants for a cross rank.
    """
    if not restricted_shape(tokens, list(available)):
        raise ValueError("formula is outside the restricted dialect")
    inputs = df.columns
    stack: list[tuple[str, str]] = []
    for i, token in enumerate(tokens):
        value, at = f"_f{i}", f"_a{i}"
        if token in available:
            known = F.col(member) & (F.col(available[token]) <= F.col(cutoff)) & _finite(F.col(token))
            df = df.withColumns({value: F.when(known, F.col(token)), at: F.when(known, F.col(available[token]))})
        elif token == "CS_RANK":
            arg, arg_at = stack.pop()
            df = df.withColumns(
                {
                    value: average_rank(F.col(arg), s.cross()) / F.count(arg).over(s.cross()),
                    at: F.when(F.col(arg).isNotNull(), F.max(arg_at).over(s.cross())),
                }
            )
        else:
            args = [stack.pop() for _ in range(RESTRICTED_ARITY[token])][::-1]
            df = df.withColumn(value, _restricted_op(token, [F.col(a) for a, _ in args]))
            df = df.withColumn(at, F.when(F.col(value).isNotNull(), _latest([b for _, b in args])))
        stack.append((value, at))
    value, at = stack[0]
    return df.select(*inputs, F.col(value).alias(factor), F.when(F.col(value).isNotNull(), F.col(at)).alias("available"))


def _latest(names: list[str]) -> Column:
    return F.greatest(*names) if len(names) > 1 else F.col(names[0])


def _restricted_op(token: str, args: list[Column]) -> Column:
    out = {
        "ADD": lambda: args[0] + args[1],
        "SUB": lambda: args[0] - args[1],
        "MUL": lambda: args[0] * args[1],
        "DIV": lambda: F.try_divide(args[0], args[1]),
        "NEG": lambda: -args[0],
        "ABS": lambda: F.abs(args[0]),
    }[token]()
    return F.when(_finite(out), out)


def average_rank(x: Column, window) -> Column:
    """1-based rank with ties averaged over a bounded cross-section; NULL stays NULL."""
    ordered = window.orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(ordered.rangeBetween(0, 0))
    return F.when(x.isNotNull(), F.rank().over(ordered) + (ties - 1) / 2.0)
