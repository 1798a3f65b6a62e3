"""Standard-normal quantile and distribution functions as Spark expressions.

Spark has neither a probit nor an ``erf``.  Both are rational approximations
(Wichura 1988, AS 241; Cody 1969).  One column is evaluated by generated code.  For
more columns that code would outgrow what the JVM compiles, so they are packed into an
array that one function runs over, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Published coefficients, highest power first.
AS241_CENTRAL = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
     45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
     133.14166789178437745, 3.387132872796366608),
    (5226.495278852854561, 28729.085735721942674, 39307.89580009271061,
     21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
     42.313330701600911252, 1.0),
)
AS241_TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
     1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
     4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
     0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
     2.05319162663775882187, 1.0),
)
AS241_FAR_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
     0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
     5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
     7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
     0.59983220655588793769, 1.0),
)
CODY_CENTRAL = (
    (0.065682337918207449113, 2.2352520354606839287, 161.02823106855587881,
     1067.6894854603709582, 18154.981253343561249),
    (1.0, 47.20258190468824187, 976.09855173777669322,
     10260.932208618978205, 45507.789335026729956),
)
CODY_MIDDLE = (
    (1.0765576773720192317e-8, 0.39894151208813466764, 8.8831497943883759412,
     93.506656132177855979, 597.27027639480026226, 2494.5375852903726711,
     6848.1904505362823326, 11602.651437647350124, 9842.7148383839780218),
    (1.0, 22.266688044328115691, 235.38790178262499861, 1519.377599407554805,
     6485.558298266760755, 18615.571640885098091, 34900.952721145977266,
     38912.003286093271411, 19685.429676859990727),
)
CODY_FAR = (
    (0.02307344176494017303, 0.21589853405795699, 0.1274011611602473639,
     0.022235277870649807, 0.001421619193227893466, 2.9112874951168792e-5),
    (1.0, 1.28426009614491121, 0.468238212480865118,
     0.0659881378689285515, 0.00378239633202758244, 7.29751555083966205e-5),
)
INV_SQRT_2PI = 0.3989422804014327


def _number(value: float) -> str:
    text = repr(float(value))
    return text if "e" in text else text + "e0"


def _polynomial(x: str, coefficients) -> str:
    text = _number(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {_number(c)})"
    return text


def _ratio(x: str, pair) -> str:
    return f"({_polynomial(x, pair[0])} / {_polynomial(x, pair[1])})"


def probit_tail_sql(p: str) -> str:
    """``sqrt(-ln(min(p, 1-p)))``, null outside (0, 1); feeds :func:`probit_sql`."""
    return f"(CASE WHEN {p} > 0 AND {p} < 1 THEN sqrt(-ln(least({p}, 1 - {p}))) END)"


def probit_sql(p: str, tail: str) -> str:
    """Normal quantile of column ``p``; ``tail`` holds :func:`probit_tail_sql`."""
    q = f"({p} - 0.5e0)"
    return (
        f"(CASE WHEN abs({q}) <= 0.425e0 THEN "
        f"{q} * {_ratio(f'(0.180625e0 - {q} * {q})', AS241_CENTRAL)} "
        f"WHEN {tail} <= 5 THEN sign({q}) * {_ratio(f'({tail} - 1.6e0)', AS241_TAIL)} "
        f"ELSE sign({q}) * {_ratio(f'({tail} - 5)', AS241_FAR_TAIL)} END)"
    )


def normal_cdf_sql(z: str) -> str:
    """Standard normal distribution function of column ``z``."""
    square = f"({z} * {z})"
    size = f"abs({z})"
    inverse = f"(1 / {square})"
    central = f"0.5e0 + {z} * {_ratio(square, CODY_CENTRAL)}"
    middle = f"exp(-{square} / 2) * {_ratio(size, CODY_MIDDLE)}"
    far = (
        f"exp(-{square} / 2) * ({_number(INV_SQRT_2PI)} - {inverse} * "
        f"{_ratio(inverse, CODY_FAR)}) / {size}"
    )
    return (
        f"(CASE WHEN {size} <= 0.67448975e0 THEN {central} "
        f"WHEN {size} <= 5.656854249492381e0 THEN "
        f"CASE WHEN {z} > 0 THEN 1 - {middle} ELSE {middle} END "
        f"WHEN {z} > 0 THEN 1 - {far} ELSE {far} END)"
    )


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """AS 241 over an array; NaN outside (0, 1)."""
    q = p - 0.5
    with np.errstate(invalid="ignore", divide="ignore"):
        tail = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
        central = 0.180625 - q * q
        inner = q * np.polyval(AS241_CENTRAL[0], central) / np.polyval(AS241_CENTRAL[1], central)
        near = np.polyval(AS241_TAIL[0], tail - 1.6) / np.polyval(AS241_TAIL[1], tail - 1.6)
        far = np.polyval(AS241_FAR_TAIL[0], tail - 5.0) / np.polyval(AS241_FAR_TAIL[1], tail - 5.0)
        outer = np.sign(q) * np.where(tail <= 5.0, near, far)
    inside = (p > 0) & (p < 1)
    return np.where(inside, np.where(np.abs(q) <= 0.425, inner, outer), np.nan)


def normal_quantiles(name: str) -> Column:
    """Normal quantiles of the array column ``name``, entry by entry; null outside (0, 1)."""
    # what the rational functions run over is found first: they name it often
    middle = "abs(_p - 0.5e0) <= 0.425e0"
    over = f"CASE WHEN {middle} THEN 0.180625e0 - (_p - 0.5e0) * (_p - 0.5e0) ELSE {probit_tail_sql('_p')} END"
    value = (
        f"CASE WHEN {middle} THEN (_p - 0.5e0) * {_ratio('_r', AS241_CENTRAL)} "
        f"WHEN _r <= 5 THEN sign(_p - 0.5e0) * {_ratio('(_r - 1.6e0)', AS241_TAIL)} "
        f"ELSE sign(_p - 0.5e0) * {_ratio('(_r - 5)', AS241_FAR_TAIL)} END"
    )
    return F.expr(f"zip_with(`{name}`, transform(`{name}`, _p -> {over}), (_p, _r) -> {value})")


def normal_probabilities(name: str) -> Column:
    """Normal probabilities of the array column ``name``, entry by entry."""
    return F.expr(f"transform(`{name}`, _z -> {normal_cdf_sql('_z')})")


def _by_entry(df: DataFrame, columns: Mapping[str, str], function: Callable[[str], Column]) -> DataFrame:
    packed = df.withColumn("_packed", F.array(*[F.col(f"`{c}`").cast("double") for c in columns.values()]))
    return (
        packed.withColumn("_packed", function("_packed"))
        .withColumns({out: F.get("_packed", F.lit(i)) for i, out in enumerate(columns)})
        .drop("_packed")
    )


def with_probit(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add ``{output: probability}`` normal quantiles; null outside (0, 1)."""
    if len(columns) > 1:
        return _by_entry(df, columns, normal_quantiles)
    # non-null inputs keep the generated code short enough to be compiled; the
    # logarithm is evaluated ahead of the rational function, which names it often
    for out, p in columns.items():
        inside = F.coalesce((F.col(f"`{p}`") > 0) & (F.col(f"`{p}`") < 1), F.lit(False))
        safe = F.when(inside, F.coalesce(F.col(f"`{p}`"), F.lit(0.5))).otherwise(F.lit(0.5))
        tail = F.coalesce(F.expr(probit_tail_sql("_p")), F.lit(1.0))
        df = (
            df.withColumns({"_inside": inside, "_p": safe})
            .withColumn("_tail", tail)
            .withColumn(out, F.when(F.col("_inside"), F.expr(probit_sql("_p", "_tail"))))
            .drop("_inside", "_p", "_tail")
        )
    return df


def with_normal_cdf(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add ``{output: z}`` standard normal probabilities."""
    if len(columns) > 1:
        return _by_entry(df, columns, normal_probabilities)
    for out, z in columns.items():
        value = F.expr(normal_cdf_sql("_z"))
        df = (
            df.withColumn("_z", F.coalesce(F.col(f"`{z}`"), F.lit(1.0)))
            .withColumn(out, F.when(F.col(f"`{z}`").isNotNull(), value))
            .drop("_z")
        )
    return df
