"""Text Column builders (answer normalisation, extraction, prompt pieces).

Regex notes: Java regex is ASCII by default, so ``(?U)`` is used wherever
the reference relies on Python's Unicode ``\\s``; ``(?d)`` makes ``.`` and
``$`` treat only ``\\n`` as a line end, like Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# ASCII punctuation (Python's string.punctuation) as a class and
# as a character list, the articles dropped by the answer normaliser, the
# think phrase.
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
PUNCT_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
THINK_PHRASE = "Let's think step by step."


def py_strip(x) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def answer_tokens(x) -> Column:
    """T1 as tokens: lower -> drop ASCII punctuation -> drop articles at Unicode
    word boundaries -> split on whitespace, without empty tokens."""
    s = F.translate(F.lower(_c(x)), PUNCT_CHARS, "")  # deletes every listed character
    s = F.regexp_replace(s, r"(?U)\b(" + "|".join(ARTICLES) + r")\b", " ")
    return F.filter(F.split(s, r"(?U)\s+"), lambda t: t != "")


def normalize_answer(x) -> Column:
    """Normalised answer text (tokens joined by one space)."""
    return F.array_join(answer_tokens(x), " ")


def last_paren_letter(x, allow_blanks: bool = True) -> Column:
    """Last ``(X)`` (letter, optional blanks inside), ``""`` if none."""
    pat = r"(?U)\(\s*[a-zA-Z]\s*\)" if allow_blanks else r"\([a-zA-Z]\)"
    return F.coalesce(F.try_element_at(F.regexp_extract_all(_c(x), F.lit(pat), 0), F.lit(-1)), F.lit(""))


def clean_brackets(x) -> Column:
    """Strip, `` [title]`` -> ``. ``, drop ``[...]``, one pass of double space -> single."""
    s = py_strip(x)
    s = F.replace(s, F.lit(" [title]"), F.lit(". "))
    s = F.regexp_replace(s, r"(?d)\[.*?\]", "")
    return F.replace(s, F.lit("  "), F.lit(" "))


def strip_think_suffix(query, task=None) -> Column:
    """T4: query key without a trailing "let's think step by step[.]" (any case).

    BoolQ queries also collapse whitespace first and accept "lets".
    """
    q = _c(query)
    plain = py_strip(F.regexp_replace(q, r"(?iU)\s*let's think step by step\.?\s*$", ""))
    if task is None:
        return plain
    collapsed = F.regexp_replace(q, r"(?U)\s+", " ")
    boolq = py_strip(F.regexp_replace(collapsed, r"(?iU)\s*let'?s think step by step\.?\s*$", ""))
    return F.when(_c(task) == "boolq", boolq).otherwise(plain)


def remove_think_phrase(x) -> Column:
    """T5: remove "let's think step by step" in both spellings, anywhere."""
    s = F.replace(_c(x), F.lit("let's think step by step"), F.lit(""))
    return F.replace(s, F.lit("Let's think step by step"), F.lit(""))


# Task groups used to reformat ground truth in SFT data.
CODE_TASKS = ("mbpp", "human_eval")
CHOICE_TASKS = ("mmlu", "gpqa", "commonsense_qa", "openbook_qa", "arc_challenge", "hellaswag")


def reformat_ground_truth(gt, task) -> Column:
    """Code -> ``[BEGIN]\\n x \\n[DONE]``; choice -> ``(x)``; else text."""
    g = _c(gt).cast("string")
    t = _c(task)
    return (F.when(t.isin(*CODE_TASKS), F.concat(F.lit("[BEGIN]\n "), g, F.lit(" \n[DONE]")))
             .when(t.isin(*CHOICE_TASKS), F.concat(F.lit("("), g, F.lit(")")))
             .otherwise(g))


def index_to_letter(i) -> Column:
    """0 -> A, 1 -> B, ..."""
    return F.char(F.lit(65) + _c(i))


def letter_to_index(x) -> Column:
    return F.ascii(_c(x)) - F.lit(65)


def option_lines(options, labels=None, style: str = "dot") -> Column:
    """Render options as ``A. x\\n`` lines (``style='dot'``) or
    ``\\n(A) x`` (``style='paren'``); labels default to A, B, C, ..."""
    opts = _c(options)

    def label(i, lab):
        return lab if lab is not None else F.char(F.lit(65) + i)

    if labels is None:
        parts = F.transform(opts, lambda x, i: _render(label(i, None), x, style))
    else:
        parts = F.zip_with(_c(labels), opts, lambda lab, x: _render(lab, x, style))
    return F.array_join(parts, "")


def _render(lab, x, style):
    if style == "dot":
        return F.concat(lab, F.lit(". "), x, F.lit("\n"))
    return F.concat(F.lit("\n("), lab, F.lit(") "), x)


# Characters whose title case differs from their upper case
# (Python's capitalize title-cases the first character).
TITLECASE_SPECIAL = {
    "ß": "Ss", "ǅ": "ǅ", "ǆ": "ǅ", "Ǆ": "ǅ", "ǈ": "ǈ", "ǉ": "ǈ", "Ǉ": "ǈ", "ǋ": "ǋ", "ǌ": "ǋ", "Ǌ": "ǋ",
    "ǲ": "ǲ", "ǳ": "ǲ", "Ǳ": "ǲ", "ﬀ": "Ff", "ﬁ": "Fi", "ﬂ": "Fl", "ﬃ": "Ffi", "ﬄ": "Ffl", "ﬅ": "St", "ﬆ": "St",
}


def capitalize(x) -> Column:
    """Python ``str.capitalize``: first character title-cased, the rest lower-cased."""
    s = _c(x)
    first = F.substring(s, 1, 1)
    special = F.create_map(*[F.lit(v) for kv in TITLECASE_SPECIAL.items() for v in kv])
    return F.concat(F.coalesce(special[first], F.upper(first)), F.lower(F.substring(s, 2, 1 << 30)))


def truncate_chars(x, n: int = 1000, marker: str = "... [truncated]") -> Column:
    """Text longer than ``n`` characters -> first ``n`` + marker."""
    s = _c(x)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(marker))).otherwise(s)


def truncate_tokens(x, n: int = 3000) -> Column:
    """P12 (token form): first ``n`` whitespace tokens, re-joined by one space."""
    toks = F.filter(F.split(_c(x), r"(?U)\s+"), lambda t: t != "")
    return F.when(F.size(toks) > n, F.array_join(F.slice(toks, 1, n), " ")).otherwise(_c(x))


# Letters/digits/underscore runs, or single other non-space characters.
TOKEN_PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def token_count_estimate(x) -> Column:
    """T22 (re-aimed): word and punctuation pieces, an estimate of tokenizer length."""
    return F.regexp_count(_c(x), F.lit(TOKEN_PIECE)).cast("bigint")


def concat_fields(*cols) -> Column:
    """``''.join(fields)``."""
    return F.concat(*[_c(c) for c in cols])


# Chat markers of the local-inference prompt format.
CHAT_SYSTEM = "You are a helpful AI assistant. Please provide clear and accurate responses."


def chat_template(system, user) -> Column:
    """system/user/assistant header markers around a prompt."""
    return F.concat(F.lit("<|start_header_id|>system<|end_header_id|>\n"), _c(system),
                    F.lit("\n<|eot_id|>\n<|start_header_id|>user<|end_header_id|>\n"), _c(user),
                    F.lit("\n<|eot_id|>\n<|start_header_id|>assistant<|end_header_id|>\n"))


def extract_code(pred, humaneval=None) -> Column:
    """Text between ``[BEGIN]`` and ``[DONE]`` (or end), case-insensitive,
    dot-all, stripped; no marker -> whole text stripped.  For HumanEval the
    body is indented by four spaces unless it starts with ``def ``."""
    p = _c(pred)
    pat = r"(?is)\[BEGIN\](.*?)(?:\[DONE\]|$)"
    has = p.rlike(r"(?i)\[BEGIN\]")
    body = py_strip(F.regexp_extract(p, pat, 1))
    code = F.when(has, body).otherwise(py_strip(p))
    if humaneval is None:
        return code
    indented = F.when(has & ~F.regexp_replace(body, r"(?U)^\s+", "").startswith("def "),
                      F.concat(F.lit("    "), F.replace(body, F.lit("\n"), F.lit("\n    ")))).otherwise(code)
    return F.when(_c(humaneval), indented).otherwise(code)


def gsm8k_truth(gt) -> Column:
    """T17 (truth): text after the last ``####``, with ``, $ .`` removed, stripped."""
    tail = F.element_at(F.split(_c(gt), "####", -1), -1)
    return py_strip(F.translate(tail, ",$.", ""))


def gsm8k_prediction(pred) -> Column:
    """T17 (prediction): last number-like run that is not ``''``/``'.'``
    (else the first run), with ``, $ .`` removed; NULL when there is none."""
    runs = F.regexp_extract_all(_c(pred), F.lit(r"(-?[0-9.,]+)"), 1)
    valid = F.filter(runs, lambda r: ~r.isin("", "."))
    pick = F.coalesce(F.try_element_at(valid, F.lit(-1)), F.try_element_at(runs, F.lit(1)))
    return py_strip(F.translate(pick, ",$.", ""))


def angle_number(pred) -> Column:
    """First ``<digits>`` group, NULL if none."""
    v = F.regexp_extract(_c(pred), r"(?U)<(\d+)>", 1)
    return F.when(v != "", v)
