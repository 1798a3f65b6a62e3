"""Column contracts and numeric/categorical classification (driver-side, no job)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

# The 27 survey columns in delivery order, and the numeric ones.
SURVEY_COLUMNS = [
    "수도권여부",
    "가구주_성별코드",
    "가구원수",
    "노인가구여부",
    "한부모가구여부",
    "가구주_교육정도_학력코드",
    "가구주_동거여부",
    "가구주_만연령",
    "가구주_종사상지위(보도용)",
    "가구주_혼인상태코드",
    "입주형태통합코드",
    "주택종류통합코드",
    "소득계층구간코드(보도용)(보완)",
    "자산총액5분위코드",
    "순자산5분위코드",
    "자산",
    "자산_금융자산",
    "자산_실물자산",
    "부채",
    "원리금상환금액",
    "순자산",
    "경상소득(보완)",
    "지출_소비지출비",
    "여유자금운용계획코드",
    "거주지주택가격전망코드",
    "가구주_은퇴여부",
    "가구주_미은퇴_적정생활비",
]
SURVEY_NUMERIC = [
    "가구원수",
    "가구주_만연령",
    "자산",
    "자산_금융자산",
    "자산_실물자산",
    "부채",
    "원리금상환금액",
    "순자산",
    "경상소득(보완)",
    "지출_소비지출비",
    "가구주_미은퇴_적정생활비",
]
SURVEY_CLASS_TARGET = "소득계층구간코드(보도용)(보완)"
SURVEY_VALUE_TARGET = "경상소득(보완)"


def survey_categorical() -> list[str]:
    return [c for c in SURVEY_COLUMNS if c not in SURVEY_NUMERIC]


def survey_schema() -> T.StructType:
    """Numerics as long, categorical codes as text, in delivery order."""
    return T.StructType(
        [
            T.StructField(c, T.LongType() if c in SURVEY_NUMERIC else T.StringType())
            for c in SURVEY_COLUMNS
        ]
    )


def expect_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail unless ``df`` has exactly ``names`` in that order."""
    if list(df.columns) != list(names):
        missing = [c for c in names if c not in df.columns]
        extra = [c for c in df.columns if c not in names]
        raise ValueError(f"column mismatch: missing {missing}, unexpected {extra}, or wrong order")
    return df


def project_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep ``names`` in that order; fail if one is absent."""
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}")
    return df.select(*[F.col(f"`{c}`") for c in names])


def classify_columns(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) by data type, in schema order."""
    fields = [f for f in df.schema.fields if f.name not in exclude]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in fields if f.name not in numeric]
