"""Column-level recodes, clamps, patches and unit conversions.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value in every double column. Done where tables are read, and
    again (at no cost to speak of) where rules would misread a NaN as a large number."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles}) if doubles else df


def parse_date(df: DataFrame, col: str = "date") -> DataFrame:
    """Text to date; text with a time part keeps its day, unparseable text is NULL."""
    return df.withColumn(col, F.expr(f"try_cast(`{col}` AS DATE)"))


def recode(df: DataFrame, col: str, mapping: Mapping[int, int]) -> DataFrame:
    """Replace codes by one simultaneous map (``{5: 2, 6: 5}`` never chains 6 -> 2)."""
    c = F.col(col)
    e = None
    for src, dst in mapping.items():
        e = (F.when(c == src, F.lit(dst)) if e is None else e.when(c == src, F.lit(dst)))
    return df if e is None else df.withColumn(col, e.otherwise(c).cast(df.schema[col].dataType))


def clamp(df: DataFrame, col: str, zero_to: float, upper: float) -> DataFrame:
    """0 becomes ``zero_to``, values above ``upper`` become ``upper``; negatives
    and NULL are left alone, NaN becomes NULL."""
    t = df.schema[col].dataType
    c = F.nanvl(F.col(col), F.lit(None)) if t.typeName() in ("double", "float") else F.col(col)
    return df.withColumn(col, F.when(c == 0, F.lit(zero_to)).when(c > upper, F.lit(upper))
                         .otherwise(c).cast(t))


def patch(df: DataFrame, col: str, cond: Column, value) -> DataFrame:
    """Set ``col`` to ``value`` where ``cond`` is true (NULL condition: unchanged)."""
    return df.withColumn(col, F.when(cond, F.lit(value)).otherwise(F.col(col)))


def exact_sum(col) -> Column:
    """Sum of a double column in 38-digit decimals, nine of them after the point: it does
    not depend on the order in which rows and partitions are added. Ratios of such sums
    often end on a half in the last printed digit, where a double sum's last bit would
    show. Values of 1e18 or more and infinities, which no decimal holds, are added as
    doubles; NaN is missing; parts below 5e-10 of a value are rounded off."""
    c = _c(col).cast("double")
    fits = F.abs(c) < F.lit(1e18)
    exact = F.sum(F.when(fits, c.cast("decimal(28,9)"))).cast("double")
    rest = F.sum(F.when(~fits & ~F.isnan(c), c))
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def kg_sum(grams) -> Column:
    """Sum of gram weights in KG."""
    return exact_sum(grams) / F.lit(1000.0)


def to_tonnes(kg) -> Column:
    return _c(kg) / F.lit(1000.0)


def fill_zero(df: DataFrame, cols) -> DataFrame:
    """Missing (NULL or NaN) to 0 after a spine join."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(0)).cast(
        df.schema[c].dataType) for c in cols})


def clip_low(df: DataFrame, col: str, low: float = 0.0) -> DataFrame:
    """Values below ``low`` become ``low``; NULL stays NULL."""
    c = F.col(col)
    return df.withColumn(col, F.when(c < low, F.lit(low)).otherwise(c))


def log_axis(col) -> Column:
    """Chart position of a value on the log-scaled daily charts: log10(v + 1)."""
    return F.log10(_c(col) + F.lit(1.0))


def species_label(category="category", tetun="category_tetun") -> Column:
    """``category (category_tetun)``; a missing part prints as ``NA`` like R's paste0."""
    na = F.lit("NA")
    return F.concat(F.coalesce(_c(category), na), F.lit(" ("), F.coalesce(_c(tetun), na),
                    F.lit(")"))


def split_latlng(col="latlng") -> tuple[Column, Column]:
    """``"lat,lng"`` text to two doubles (unparseable parts are NULL)."""
    c = _c(col)
    lat = F.split_part(c, F.lit(","), F.lit(1))
    lng = F.split_part(c, F.lit(","), F.lit(2))
    return lat.try_cast("double"), lng.try_cast("double")
