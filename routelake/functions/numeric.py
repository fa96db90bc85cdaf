"""Numeric Column builders: lenient casts, costs, vectors, judge replies.

All builders return ``Column`` expressions evaluated inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# A plain decimal/scientific number as Python's float() accepts it (no '1d'
# suffixes, which Java's parser would take).
_NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL_RE = r"^(?i)[+-]?(nan|inf|infinity)$"


def nan_to_null(x) -> Column:
    """NaN -> NULL (pandas skips NaN in min/max/mean; Spark sorts it largest)."""
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def lenient_double(x) -> Column:
    """P5: float, numeric text, ``{'pass@1': v}`` or ``np.float64(v)`` -> double; else NULL.

    NaN results are mapped to NULL (ingest rule).
    """
    c = _c(x).cast("string")
    s = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    plain = F.when(s.rlike(_NUM_RE) | s.rlike(_SPECIAL_RE), s.try_cast("double"))
    # np.float64(x) wrappers are removed, then a dict literal with 'pass@1'.
    unwrapped = F.regexp_replace(s, r"np\.float64\((.*?)\)", "$1")
    pass1 = F.regexp_extract(unwrapped, r"""^\{.*['"]pass@1['"]\s*:\s*([^,}\s]+)""", 1)
    from_dict = F.when(pass1.rlike(_NUM_RE), pass1.try_cast("double"))
    return nan_to_null(F.coalesce(plain, from_dict))


def as_double(df, name: str) -> Column:
    """P5 for a DataFrame column: numeric types cast directly, text parsed leniently."""
    from pyspark.sql.types import NumericType
    if isinstance(df.schema[name].dataType, NumericType):
        return nan_to_null(F.col(name).cast("double"))
    return lenient_double(name)


def nan_null_to_zero(x) -> Column:
    """NULL / NaN -> 0.0."""
    c = _c(x).cast("double")
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def token_cost(in_tokens, out_tokens, in_price, out_price) -> Column:
    """In x in_price + out x out_price (prices per million, not rescaled)."""
    return _c(in_tokens) * _c(in_price) + _c(out_tokens) * _c(out_price)


def judge_score(reply) -> Column:
    """``<answer>x</answer>`` on one line -> double clamped to [0, 1]; else NULL."""
    raw = F.regexp_extract(_c(reply), r"(?d)<answer>(.*?)</answer>", 1)
    raw = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    v = F.when(raw.rlike(_NUM_RE) | raw.rlike(_SPECIAL_RE), raw.try_cast("double"))
    # greatest/least skip NULLs, so an unparsable reply must stay NULL explicitly.
    return (F.when(v.isNull() | F.isnan(v), F.lit(None).cast("double"))
             .otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))))


def parse_vector(text) -> Column:
    """``tensor([..], device=..)`` / ``[..]`` text -> array<double>; failure -> NULL."""
    body = F.regexp_extract(_c(text), r"(?s)\[([^\[\]]*)\]", 1)
    js = F.concat(F.lit("["), body, F.lit("]"))
    arr = F.from_json(js, "array<double>")
    return F.when(F.length(body) > 0, arr)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))


def cosine(a, b) -> Column:
    """Cosine similarity; zero vector -> 0.0; unequal dimension -> NULL."""
    a, b = _c(a), _c(b)
    den = norm(a) * norm(b)
    sim = F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)
    return F.when(F.size(a) == F.size(b), sim)


def unit(a) -> Column:
    """Scale to unit length (zero vector stays zero)."""
    a = _c(a)
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x / n))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))
