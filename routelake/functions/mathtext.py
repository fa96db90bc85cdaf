"""Competition-math answers: T19 (last boxed content), T20 (LaTeX
canonicaliser) and E7 (MATH score), as Column expressions.

Where the reference's string routine raises (empty ``\\sqrt`` / ``\\frac``
tails, several ``\\text{ `` units, non-integer ``a/b``) the canonical form is
NULL, and E7 then compares the raw strings (D11).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routelake.operators.common import let, memo_column

BOXED = "\\boxed"
BOXED_SP = "\\boxed "
FBOX = "\\fbox"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def _rindex(s: Column, sub: str) -> Column:
    """0-based index of the last occurrence of ``sub`` (-1 if absent)."""
    r = F.locate(sub[::-1], F.reverse(s))  # 1-based in the reversed string, 0 if absent
    return F.when(r == 0, F.lit(-1)).otherwise(F.length(s) - r - F.lit(len(sub) - 1))


def _lit_split(s: Column, sep: str) -> Column:
    """Python ``s.split(sep)`` for a literal separator (keeps empty pieces)."""
    import re
    return F.split(s, re.escape(sep), -1)


@memo_column
def last_boxed(text) -> Column:
    """The last ``\\boxed{...}`` / ``\\fbox{...}`` with balanced braces,
    or ``\\boxed `` + text up to the next ``$``; NULL if none or unbalanced."""
    return let(_c(text), _last_boxed)


def _last_boxed(s: Column) -> Column:
    sp = F.concat(F.lit(BOXED_SP), F.try_element_at(_lit_split(F.try_element_at(_lit_split(s, BOXED_SP), F.lit(-1)), "$"), F.lit(1)))
    return let(F.when(_rindex(s, BOXED) >= 0, _rindex(s, BOXED)).otherwise(_rindex(s, FBOX)),
               lambda idx: _braced(s, sp, idx))


def _braced(s: Column, sp: Column, idx: Column) -> Column:
    return let(F.substring(s, idx + 1, 1 << 30), lambda tail: _braced_tail(s, sp, idx, tail))


def _braced_tail(s: Column, sp: Column, idx: Column, tail: Column) -> Column:
    chars = F.split(tail, "")
    init = F.struct(F.lit(0).alias("open"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("end"))

    def step(acc, ch):
        opened = acc["open"] + F.when(ch == "{", 1).otherwise(0)
        closed = opened - F.when(ch == "}", 1).otherwise(0)
        hit = acc["end"].isNull() & (ch == "}") & (closed == 0)
        return F.struct(closed.alias("open"), (acc["i"] + 1).alias("i"),
                        F.when(hit, acc["i"]).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(chars, init, step)["end"]
    braced = F.when(end.isNotNull(), F.substring(tail, 1, end + 1))
    return (F.when(s.isNull(), F.lit(None).cast("string"))
             .when(F.contains(s, F.lit(BOXED_SP)), sp)
             .when(idx < 0, F.lit(None).cast("string"))
             .otherwise(braced))


@memo_column
def remove_boxed(boxed) -> Column:
    """Content of ``\\boxed ...`` / ``\\boxed{...}``; NULL where the reference asserts."""
    return let(_c(boxed), _remove_boxed)


def _remove_boxed(s: Column) -> Column:
    return (F.when(F.contains(s, F.lit(BOXED_SP)),
                   F.when(s.startswith(BOXED_SP), F.substring(s, len(BOXED_SP) + 1, 1 << 30)))
             .when(s.startswith(BOXED + "{") & s.endswith("}"),
                   s.substr(F.lit(len(BOXED) + 2), F.length(s) - F.lit(len(BOXED) + 2))))


def _fix_sqrt(s: Column) -> Column:
    return let(s, _fix_sqrt_v)


def _fix_sqrt_v(s: Column) -> Column:
    parts = _lit_split(s, "\\sqrt")
    rest = F.slice(parts, 2, 1 << 30)
    fixed = F.transform(rest, lambda x: F.when(F.substring(x, 1, 1) != "{",
                                               F.concat(F.lit("\\sqrt{"), F.substring(x, 1, 1), F.lit("}"),
                                                        F.substring(x, 2, 1 << 30)))
                        .otherwise(F.concat(F.lit("\\sqrt"), x)))
    bad = F.exists(rest, lambda x: x == "")
    out = F.concat(F.try_element_at(parts, F.lit(1)), F.array_join(fixed, ""))
    return F.when(~F.contains(s, F.lit("\\sqrt")), s).when(bad, F.lit(None).cast("string")).otherwise(out)


def _fix_fracs(s: Column) -> Column:
    return let(s, _fix_fracs_v)


def _fix_fracs_v(s: Column) -> Column:
    parts = _lit_split(s, "\\frac")
    rest = F.slice(parts, 2, 1 << 30)
    kind = F.transform(rest, lambda x: F.when(x == "", "err")
                       .when(F.substring(x, 1, 1) == "{", "ok")
                       .when(F.length(x) < 2, "short").otherwise("ok"))
    first_bad = F.try_element_at(F.filter(kind, lambda k: k != "ok"), F.lit(1))

    def piece(x):
        a, b = F.substring(x, 1, 1), F.substring(x, 2, 1)
        post = F.substring(x, 3, 1 << 30)
        return F.concat(F.lit("\\frac"),
                        F.when(a == "{", x)
                         .when(b != "{", F.concat(F.lit("{"), a, F.lit("}{"), b, F.lit("}"), post))
                         .otherwise(F.concat(F.lit("{"), a, F.lit("}"), b, post)))

    out = F.concat(F.try_element_at(parts, F.lit(1)), F.array_join(F.transform(rest, piece), ""))
    return (F.when(F.size(parts) <= 1, s)
             .when(first_bad == "err", F.lit(None).cast("string"))
             .when(first_bad == "short", s)
             .otherwise(out))


_CANON_INT = r"^-?(0|[1-9][0-9]*)$"
_PY_INT = r"^[+-]?[0-9]+(_[0-9]+)*$"


def _fix_a_slash_b(s: Column) -> Column:
    return let(s, _fix_a_slash_b_v)


def _fix_a_slash_b_v(s: Column) -> Column:
    parts = _lit_split(s, "/")
    a, b = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    canon = a.rlike(_CANON_INT) & b.rlike(_CANON_INT) & (a != "-0") & (b != "-0")
    ints = a.rlike(_PY_INT) & b.rlike(_PY_INT)
    return (F.when(F.size(parts) != 2, s)
             .when(canon, F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("}")))
             .when(ints, s)
             .otherwise(F.lit(None).cast("string")))


@memo_column
def canonical_answer(x) -> Column:
    """The reference's 14 ordered rewrites; NULL where it would raise."""
    s = _c(x)
    for old, new in [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"),
                     ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")]:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = let(s, lambda v: F.when(~F.contains(v, F.lit("\\text{ ")), v)
                           .when(F.size(_lit_split(v, "\\text{ ")) == 2, F.try_element_at(_lit_split(v, "\\text{ "), F.lit(1)))
                           .otherwise(F.lit(None).cast("string")))
    for old, new in [("\\%", ""), (" .", " 0."), ("{.", "{0.")]:
        s = F.replace(s, F.lit(old), F.lit(new))
    return let(s, _canonical_rest)


def _canonical_rest(s: Column) -> Column:
    empty = F.length(s) == 0
    t = let(s, lambda v: F.when(v.startswith("."), F.concat(F.lit("0"), v)).otherwise(v))
    t = let(t, lambda v: F.when((F.size(_lit_split(v, "=")) == 2)
                                & (F.length(F.try_element_at(_lit_split(v, "="), F.lit(1))) <= 2),
                                F.try_element_at(_lit_split(v, "="), F.lit(2))).otherwise(v))
    t = _fix_sqrt(t)
    t = F.replace(t, F.lit(" "), F.lit(""))
    t = _fix_fracs(t)
    t = let(t, lambda v: F.when(v == "0.5", F.lit("\\frac{1}{2}")).otherwise(v))
    t = _fix_a_slash_b(t)
    return F.when(empty, F.lit("")).otherwise(t)


@memo_column
def math_equiv(a, b) -> Column:
    """``is_equiv``: canonical forms equal; raw equality where either raises."""
    return let(F.struct(_c(a).alias("a"), _c(b).alias("b")), lambda ab: _equiv(ab["a"], ab["b"]))


def _equiv(a: Column, b: Column) -> Column:
    ca, cb = canonical_answer(a), canonical_answer(b)
    return (F.when(a.isNull() & b.isNull(), F.lit(True))
             .when(a.isNull() | b.isNull(), F.lit(False))
             .when(ca.isNull() | cb.isNull(), a == b)
             .otherwise(ca == cb))


@memo_column
def math_score(pred, gt) -> Column:
    """1.0 when the last boxed answers are equivalent, else 0.0; NULL when
    the truth has no usable boxed answer (the reference drops such rows)."""
    row = F.struct(_c(pred).alias("pred"), remove_boxed(last_boxed(gt)).alias("g"))
    return let(row, lambda r: let(last_boxed(r["pred"]), lambda pb: _score(r["pred"], r["g"], pb)))


def _score(pred: Column, g: Column, pb: Column) -> Column:
    return let(remove_boxed(pb), lambda p: F.when(g.isNull() | pred.isNull(), F.lit(None).cast("double"))
               .when(pb.isNull() | p.isNull(), F.lit(0.0))
               .otherwise(math_equiv(p, g).cast("double")))
