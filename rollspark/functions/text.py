"""Answer extraction and normalisation as native column expressions.

Each helper maps string columns to a column; nothing runs in Python per row.
Order-dependent replacement chains keep the reference's order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollspark.functions.cols import col, pystrip

THINK_END = "</think>"


def after_think(text) -> Column:
    """Text after the first '</think>' up to a second one (C1); unchanged when absent."""
    t = col(text)
    return F.when(t.contains(THINK_END), F.split_part(t, F.lit(THINK_END), F.lit(2))).otherwise(t)


def _let(value, fn) -> Column:
    """``fn`` of a value computed once, however often ``fn`` names it."""
    return F.transform(F.array(value), fn).getItem(0)


def _balanced_prefix(tail) -> Column:
    """A text up to the first '}' that closes every '{' before it, or NULL.

    Folds over the pieces between closing braces, not over characters."""
    def step(acc, piece):
        depth = acc["depth"] + F.length(piece) - F.length(_rep(piece, "{", "")) - 1
        n = acc["n"] + 1
        return F.struct(depth.alias("depth"), n.alias("n"),
                        F.when((acc["end"] == 0) & (depth == 0), n).otherwise(acc["end"]).alias("end"))

    def cut(t):
        pieces = F.split(t, r"\}")
        closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # the last piece is not closed
        init = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))
        return _let(F.aggregate(closed, init, step)["end"],
                    lambda k: F.when(k > 0, F.concat(F.call_function("substring_index", t, F.lit("}"), k), F.lit("}"))))

    return _let(tail, lambda t: F.when(t.isNotNull(), cut(t)))


def last_boxed(text) -> Column:
    """Last balanced '\\boxed{...}' (or '\\fbox...' when no '\\boxed'), C2."""
    t = col(text)
    return _balanced_prefix(
        F.when(t.contains("\\boxed"), F.concat(F.lit("\\boxed"), F.substring_index(t, "\\boxed", -1)))
        .when(t.contains("\\fbox"), F.concat(F.lit("\\fbox"), F.substring_index(t, "\\fbox", -1))))


def remove_boxed(s) -> Column:
    """Inside of '\\boxed{...}'; NULL when the string is not exactly that."""
    x = col(s)
    ok = x.startswith("\\boxed{") & x.endswith("}")
    return F.when(ok, F.substring(x, F.lit(8), F.length(x) - F.lit(8)))


def boxed_answer(text) -> Column:
    """Answer inside the last \\boxed{} of the text, or NULL."""
    t = col(text)
    return F.when(t.contains("\\boxed"), _let(last_boxed(t), remove_boxed))


def _rep(s: Column, a: str, b: str) -> Column:
    return F.replace(s, F.lit(a), F.lit(b))


def mathd_normalize(answer) -> Column:
    """Light LaTeX normalisation (C3), in the reference's order:
    strip an enclosing \\text{}, drop line breaks / \\! / \\left / \\right /
    degrees / \\$ / right-hand units / \\%, add leading zeros, drop a short
    'x =' prefix, fix \\sqrt and \\frac shorthands, remove spaces, 0.5 ->
    \\frac{1}{2}, and a/b -> \\frac{a}{b} for plain integers.

    Every step reads the previous one exactly once (regex rewrites instead of
    if/else on the same value), so the expression stays linear in size."""
    a = pystrip(F.regexp_replace(pystrip(col(answer)), r"^\\text\{(.+?)\}(?s:.*)$", "$1"))
    s = _rep(a, "\n", "")
    s = _rep(s, "\\!", "")
    s = _rep(s, "\\\\", "\\")
    s = _rep(_rep(s, "tfrac", "frac"), "dfrac", "frac")
    s = _rep(_rep(s, "\\left", ""), "\\right", "")
    s = _rep(_rep(s, "^{\\circ}", ""), "^\\circ", "")
    s = _rep(s, "\\$", "")
    # the reference asserts a single unit split and otherwise keeps the input
    units_error = F.regexp_count(s, F.lit(r"\\text\{ ")) > 1
    s = F.regexp_replace(s, r"(?s)^((?:(?!\\text\{ ).)*)\\text\{ (?:(?!\\text\{ ).)*$", "$1")
    s = _rep(s, "\\%", "")
    s = _rep(_rep(s, " .", " 0."), "{.", "{0.")
    s = F.regexp_replace(s, r"^\.", "0.")
    s = F.regexp_replace(s, r"(?s)^[^=]{0,2}=([^=]*)$", "$1")
    sqrt_error = s.endswith("\\sqrt")  # nothing after \\sqrt: the reference keeps the input
    s = F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}")
    s = _rep(s, " ", "")
    s = F.regexp_replace(s, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    s = F.regexp_replace(s, r"\\frac([^{])\{", r"\\frac{$1}{")
    s = F.regexp_replace(s, r"^0\.5$", r"\\frac{1}{2}")
    s = F.regexp_replace(s, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")
    return F.when(units_error | sqrt_error, a).otherwise(s)


def answers_equal(given, truths) -> Column:
    """C5 without a symbolic solver: the given answer equals one of the array
    ``truths`` after the light normalisation (C3), or by :func:`heavy_equal`
    after the heavy one (C4). The heavy side is evaluated only where the light
    one finds no match; each answer is normalised once. Null or empty truths
    match nothing."""
    g, ts = col(given), F.filter(col(truths), lambda t: t.isNotNull() & (t != ""))
    light = _let(F.struct(mathd_normalize(g).alias("g"), F.transform(ts, mathd_normalize).alias("ts")),
                 lambda p: F.exists(p["ts"], lambda t: t == p["g"]))
    heavy = _let(F.struct(heavy_normalize_all(F.array(g)).alias("g"), heavy_normalize_all(ts).alias("ts")),
                 lambda p: F.exists(p["ts"], lambda t: heavy_equal(p["g"].getItem(0), t)))
    return F.when(g.isNull(), F.lit(False)).otherwise(
        F.coalesce(light, F.lit(False)) | F.coalesce(heavy, F.lit(False)))


# ---------------------------------------------------------------- GSM8K

def gsm8k_strict(text) -> Column:
    """Number after the first '#### ', commas and '$' removed; NULL if absent."""
    m = F.regexp_extract(col(text), r"#### (-?[0-9.,]+)", 1)
    return F.when(col(text).rlike(r"#### (-?[0-9.,]+)"), F.replace(F.replace(m, F.lit(","), F.lit("")),
                                                                     F.lit("$"), F.lit("")))


def gsm8k_flexible(text) -> Column:
    """Last number that is not '' or '.'; if none qualifies the first one."""
    nums = F.regexp_extract_all(col(text), F.lit(r"(-?[0-9.,]+)"), 1)
    ok = F.filter(nums, lambda x: (x != "") & (x != "."))
    return F.when(F.size(nums) == 0, F.lit(None).cast("string")) \
        .when(F.size(ok) > 0, F.try_element_at(ok, F.lit(-1))).otherwise(F.try_element_at(nums, F.lit(1)))


def md5_mod(s, modulo: int) -> Column:
    """int(md5(s), 16) % modulo, by folding the hex digits (exact, no overflow)."""
    hexd = F.split(F.md5(col(s)), "")
    return F.aggregate(hexd, F.lit(0).cast("bigint"),
                       lambda acc, h: (acc * 16 + F.conv(h, 16, 10).cast("bigint")) % modulo)


def gsm8k_score(text, truth, method: str = "strict", format_score: float = 0.0, score: float = 1.0,
                random_perturb: bool = False) -> Column:
    """Score when the extracted answer equals the ground truth, the
    format score otherwise, 0 when nothing is extracted. With
    ``random_perturb`` the two scores swap when md5(truth) % 100 < 50."""
    ans = gsm8k_strict(text) if method == "strict" else gsm8k_flexible(text)
    t = col(truth).cast("string")
    hit, miss = F.lit(float(score)), F.lit(float(format_score))
    if random_perturb:
        flip = md5_mod(t, 100) < 50
        hit, miss = F.when(flip, miss).otherwise(hit), F.when(flip, hit).otherwise(miss)
    return F.when(ans.isNull(), F.lit(0.0)).when(ans == t, hit).otherwise(miss)


def final_line_answer(solution) -> Column:
    """GSM8K solution answer (C9): on the last line that starts with '####'
    (after stripping), the rest without a leading ':' and without commas;
    else the last '####' match anywhere; else NULL."""
    lines = F.split(col(solution), "\r\n|\n|\r")
    hits = F.filter(lines, lambda l: pystrip(l).startswith("####"))
    last = pystrip(F.try_element_at(hits, F.lit(-1)))
    content = pystrip(F.substring(last, 5, 1 << 30))
    content = F.when(content.startswith(":"), pystrip(F.substring(content, 2, 1 << 30))).otherwise(content)
    content = pystrip(F.replace(content, F.lit(","), F.lit("")))
    anywhere = F.regexp_extract_all(col(solution), F.lit(r"####[ \t]*([^\r\n]+)"), 1)
    return F.when(F.size(hits) > 0, content) \
        .when(F.size(anywhere) > 0, pystrip(F.try_element_at(anywhere, F.lit(-1))))


# ---------------------------------------------------------------- QA

# Fixed value: Python's string.punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PUNCT_CLASS = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"


def qa_normalize(s) -> Column:
    """lower, drop ASCII punctuation, drop articles a/an/the, squeeze spaces."""
    x = F.lower(col(s))
    x = F.regexp_replace(x, _PUNCT_CLASS, "")
    x = F.regexp_replace(x, r"(?U)\b(a|an|the)\b", " ")
    return pystrip(F.regexp_replace(x, r"\s+", " "))


def qa_exact_match(pred, golds) -> Column:
    """1 when the normalised prediction equals any normalised gold answer."""
    p = qa_normalize(pred)
    return F.when(F.exists(col(golds), lambda g: qa_normalize(g) == p), 1).otherwise(0)


def qa_substring_match(pred, golds) -> Column:
    """1 when any normalised gold answer is inside the normalised prediction."""
    p = qa_normalize(pred)
    return F.when(F.exists(col(golds), lambda g: F.instr(p, qa_normalize(g)) > 0), 1).otherwise(0)


def last_answer_tag(text) -> Column:
    """Stripped content of the last <answer>...</answer> (dot matches newline)."""
    m = F.regexp_extract_all(col(text), F.lit(r"(?s)<answer>(.*?)</answer>"), 1)
    return F.when(F.size(m) > 0, pystrip(F.try_element_at(m, F.lit(-1))))


# ---------------------------------------------------------------- extractors (C11)

def first_tag(text, tag: str) -> Column:
    """Content of the first <tag>...</tag>, or NULL."""
    pat = rf"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(col(text).rlike(pat), F.regexp_extract(col(text), pat, 1))


def last_code_block(text) -> Column:
    """Stripped body of the last fenced ``` code block, or NULL."""
    m = F.regexp_extract_all(col(text), F.lit(r"(?s)```(?:\w+)?\n(.*?)```"), 1)
    return F.when(F.size(m) > 0, pystrip(F.try_element_at(m, F.lit(-1))))


def judge_score(text) -> Column:
    """First '### Final Score: 0|1|0.0|1.0' as DOUBLE, or NULL."""
    pat = r"### Final Score:\s*([01](?:\.0)?)"
    return F.when(col(text).rlike(pat), F.regexp_extract(col(text), pat, 1).cast("double"))


# ----------------------------------------------------------------- C6 Minerva

# Minerva answer normalisation lists, in the reference's order.
MINERVA_SUBSTITUTIONS = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
MINERVA_REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points",
    "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3",
    "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
# Regex rewrites after the lists: (pattern, Java replacement).
MINERVA_REWRITES = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", "frac{$2}{$3}"),
    (r"(sqrt)([^{])", "sqrt{$2}"),
)
MINERVA_ANSWER = r"(?i)Answer\s*:\s*([^\n<]+)"


def minerva_normalize(answer) -> Column:
    """Minerva final-answer normalisation (C6): text after the last '=',
    substitutions, removals, TeX rewrites, '$' dropped, commas dropped from
    plain digit strings, stripped."""
    x = F.substring_index(col(answer), "=", -1)
    for a, b in MINERVA_SUBSTITUTIONS:
        x = _rep(x, a, b)
    for r in MINERVA_REMOVED:
        x = _rep(x, r, "")
    for pat, repl in MINERVA_REWRITES:
        x = F.regexp_replace(x, pat, repl)
    x = _rep(x, "$", "")
    nc = _rep(x, ",", "")
    x = F.when(nc.rlike("^[0-9]+$"), nc).otherwise(x)
    return pystrip(x)


def minerva_score(solution, truth) -> tuple[Column, Column]:
    """C6 default mode: (score +1/-1, normalised prediction) from the last
    'Answer: ...' in the last 300 characters."""
    s = F.substring(col(solution), -300, 300)
    hits = F.regexp_extract_all(s, F.lit(MINERVA_ANSWER), 1)
    ext = F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit("[INVALID]"))
    pred = minerva_normalize(ext)
    return F.when(pred == minerva_normalize(truth), 1.0).otherwise(-1.0), pred


def last_boxed_strict(text) -> Column:
    """Last balanced '\\boxed{...}' (only the braced form), or NULL."""
    t = col(text)
    return _balanced_prefix(
        F.when(t.contains("\\boxed{"), F.concat(F.lit("\\boxed{"), F.substring_index(t, "\\boxed{", -1))))


def strict_box_score(solution, truth) -> tuple[Column, Column]:
    """C6 strict mode: (+1/-1, prediction) where the prediction is the inside
    of the last boxed answer within the last 100 of the last 300 characters,
    compared to the truth as is."""
    s = F.substring(F.substring(col(solution), -300, 300), -100, 100)
    pred = _let(last_boxed_strict(s), lambda b: F.substring(b, F.lit(8), F.length(b) - F.lit(8)))
    return F.when(pred.isNotNull() & (pred == col(truth)), 1.0).otherwise(-1.0), pred


# ----------------------------------------------------------------- C4 heavy normalisation

# Unit words removed by the heavy normalisation, in order.
HEAVY_UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month",
               "year", "foot", "feet", "inch", "yard")


# Plain replacements of the heavy normalisation, in order.
HEAVY_REPLACED = (("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "),
                  ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12"))
# Powers that keep an answer from being compared by value.
UNSAFE_POWERS = r"\^\{|\^\(|\^[0-9]+\^|\^[0-9][0-9]+"

# TeX written as plain text, in order (pattern, replacement). Arguments come without braces inside;
# the patterns that take arguments run once per level of nesting, ``TEX_LEVELS`` levels deep.
TEX_FIRST = ((r"\\[td]frac", r"\\frac"), (r"\\(left|right|displaystyle|limits)([^a-zA-Z]|$)", "$2"), (r"\\(,|;|:|!|quad|qquad|space)", " "),
             (r"\\frac", r" \\frac"))
TEX_ARGUMENTS = ((r"([\^_])\{([^{}]*)\}", "$1$2"),
                 (r"\\(text|textbf|textit|textrm|mathrm|mathbf|mathit|mathbb|mathcal|mbox|operatorname)\s*\{([^{}]*)\}", "$2"),
                 (r"\\sqrt\s*\{([^{}]*)\}", "sqrt($1)"), (r"\\sqrt\s*([0-9a-zA-Z])", "sqrt($1)"),
                 (r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", "$1/$2"), (r"\\frac\s*([0-9a-zA-Z])\s*\{([^{}]*)\}", "$1/$2"),
                 (r"\\frac\s*\{([^{}]*)\}\s*([0-9a-zA-Z])", "$1/$2"), (r"\\frac\s*([0-9a-zA-Z])\s*([0-9a-zA-Z])", "$1/$2"))
TEX_LEVELS = 4
TEX_LAST = ((r"\\pi([^a-zA-Z]|$)", "pi$1"), (r"\\infty([^a-zA-Z]|$)", "inf$1"), (r"\\cup([^a-zA-Z]|$)", "U$1"),
            (r"\\(cdot|times)([^a-zA-Z]|$)", "*$2"), (r"\\leq?([^a-zA-Z]|$)", "≤$1"), (r"\\geq?([^a-zA-Z]|$)", "≥$1"),
            (r"\\pm([^a-zA-Z]|$)", "±$1"), (r"\\([{}])", "$1"), (r"^\s+|\s+$", ""))
TEX_RULES = (*TEX_FIRST, *(TEX_ARGUMENTS * TEX_LEVELS), *TEX_LAST)

_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def _as_float(x) -> Column:
    """The number a text spells (Spark's own cast would also take '5d'), or NULL."""
    return F.when(x.rlike(rf"^\s*{_NUMBER}\s*$"), F.trim(x).try_cast("double"))


def _is_whole(f) -> Column:
    return F.coalesce((F.abs(f) < float("inf")) & (F.abs(f - F.rint(f)) <= 1e-7), F.lit(False))


def _whole_text(f) -> Column:
    """All digits of a whole double: up to 2^62 as BIGINT, up to 2^122 from two
    exact halves as DECIMAL, from there on 17 significant digits and zeros."""
    half = float(2 ** 60)
    a = F.abs(f)
    hi = F.floor(a / half)
    wide = hi.cast("decimal(19,0)") * F.lit(2 ** 60).cast("decimal(19,0)") \
        + (a - hi.cast("double") * half).cast("bigint").cast("decimal(19,0)")
    return F.when(a < float(2 ** 62), f.cast("bigint").cast("string")) \
        .when(a < float(2 ** 122), F.concat(F.when(f < 0, "-").otherwise(""), wide.cast("decimal(38,0)").cast("string"))) \
        .otherwise(F.format_string("%.0f", f))


def strip_grouping_commas(x) -> Column:
    """Drop commas between a digit and exactly three digits until nothing
    changes. Two passes always suffice: a comma skipped by the first pass
    directly follows a dropped one, and dropping commas only lengthens runs."""
    for _ in range(2):
        x = F.regexp_replace(x, r"(\d),(\d\d\d)($|\D)", "$1$2$3")
    return x


def _plain_words(x) -> Column:
    for a, b in HEAVY_REPLACED:
        x = _rep(x, a, b)
    return x


def _without_units(x) -> Column:
    e = x
    for u in HEAVY_UNITS:
        e = F.regexp_replace(e, u + r"(es)?(s)? *(\^[0-9]+)?", "")
    return F.when(x.rlike("|".join(HEAVY_UNITS)), e).otherwise(x)


def plain_tex(x) -> Column:
    """TeX as plain text by ``TEX_RULES``: fractions 'a/b', roots 'sqrt(a)', the arguments of text and font commands,
    powers and indices, products, pi, infinity, union and comparison signs. Other commands keep their TeX."""
    e = x
    for pattern, plain in TEX_RULES:
        e = F.regexp_replace(e, pattern, plain)
    return F.when(x.contains("\\"), e).otherwise(x)


def heavy_normalize_all(answers) -> Column:
    """C4 for every answer of an array: unwrap a leading \\text{...}, drop %/$
    signs, 'or'/'and' -> ',', million/billion/trillion -> *10^k, unit words,
    degree signs, one pair of enclosing braces and ',\\!'; integral floats
    become integers; TeX becomes plain text (:func:`plain_tex`); mixed numbers
    '7 3/4' -> '7+3/4'; spaces and braces dropped; lower case; integers with
    thousands separators are rewritten without them.

    Each step is a pass of its own over the array (steps read the previous
    value several times; one nested expression would grow exponentially)."""
    def unwrapped(x):
        return F.when(x.rlike(r"^\\text\{.+?\}"), F.regexp_extract(x, r"^\\text\{(.+?)\}", 1)).otherwise(x)

    def unbraced(x):
        inner = F.when((F.length(x) > 0) & x.startswith("{") & x.endswith("}"),
                       F.substring(x, F.lit(2), F.length(x) - F.lit(2))).otherwise(x)
        return F.regexp_replace(inner, r",\\! *", "")

    def integral(x):
        return _let(_as_float(x), lambda f: F.when(_is_whole(f), _whole_text(F.rint(f))).otherwise(x))

    def squeezed(x):
        e = F.regexp_replace(F.regexp_replace(x, "- *", "-"), "([0-9]) +([0-9])", "$1+$2")
        return F.lower(_rep(_rep(_rep(e, " ", ""), "{", ""), "}", ""))

    def ungrouped(x):
        f = _as_float(_rep(x, ",", ""))
        trunc = F.when(f < 0, F.ceil(f)).otherwise(F.floor(f))
        return F.when(_is_whole(_as_float(strip_grouping_commas(x))),
                      F.when(F.abs(f) < float(2 ** 62), trunc.cast("string")).otherwise(_whole_text(f))).otherwise(x)

    a = col(answers)
    for step in (unwrapped, _plain_words, _without_units, lambda x: F.regexp_replace(x, r"\^ *\\circ", ""),
                 unbraced, integral, plain_tex, squeezed, ungrouped):
        a = F.transform(a, step)
    return a


def heavy_normalize(df, answer: str, out: str = "answer_norm"):
    """:func:`heavy_normalize_all` for a column of single answers."""
    return df.withColumn(out, heavy_normalize_all(F.array(col(answer))).getItem(0))


def answer_elements(x) -> Column:
    """The members of a tuple or interval '(a, b]', else the whole text alone;
    grouping commas are no separators."""
    return _let(strip_grouping_commas(x), lambda s: F.when(
        s.rlike(r"^[()\[\]][^()\[\]]+[()\[\]]$"),
        F.transform(F.split(F.substring(s, F.lit(2), F.length(s) - F.lit(2)), ","), pystrip)).otherwise(F.array(s)))


def literal_value(x) -> Column:
    """The value of a literal as DOUBLE: a number, a fraction 'a/b' of numbers, a
    mixed number 'a+b/c' or 'n*10^k'; NULL for anything else."""
    def part(pat, i):
        return F.regexp_extract(x, pat, i).try_cast("double")
    frac, mixed, power = rf"^\(?({_NUMBER})/({_NUMBER})\)?$", r"^([0-9]+)\+([0-9]+)/([0-9]+)$", rf"^({_NUMBER})\*10\^([0-9])$"
    return F.when(x.rlike(rf"^{_NUMBER}$"), x.try_cast("double")) \
        .when(x.rlike(frac), F.try_divide(part(frac, 1), part(frac, 2))) \
        .when(x.rlike(mixed), part(mixed, 1) + F.try_divide(part(mixed, 2), part(mixed, 3))) \
        .when(x.rlike(power), part(power, 1) * F.pow(F.lit(10.0), part(power, 2)))


UNEQUAL, UNDECIDED, EQUAL = 0, 1, 2


def heavy_state(given, truth) -> Column:
    """C5 on answers normalised by C4: EQUAL for equal text, or tuples of one
    bracket kind and length whose members are all equal. Members that are both
    literal fractions must be the same text; a whole number equals only a whole
    number; otherwise equal text or equal literals count, unless the pair has
    more than two different letters or an unsafe power. UNDECIDED: no member is
    unequal, but some pair that could be compared holds something else than a
    literal, which takes a symbolic solver; it counts as not equal."""
    g, t = col(given), col(truth)

    def member(p):
        a, b = p["t"], p["g"]
        frac = r"^-?[0-9]+.?/0*[1-9][0-9]*.?$"
        both = F.concat(a, F.lit(")-("), b)
        letters = F.array_distinct(F.regexp_extract_all(F.regexp_replace(both, "sqrt|frac", ""), F.lit(r"(\p{L})"), 1))
        comparable = (F.size(letters) <= 2) & ~both.rlike(UNSAFE_POWERS)
        values = literal_value(a) == literal_value(b)
        return F.when(a.rlike(frac) & b.rlike(frac), F.when(a == b, EQUAL).otherwise(UNEQUAL)) \
            .when((_is_whole(_as_float(a)) != _is_whole(_as_float(b))) | ~comparable, UNEQUAL) \
            .when((a == b) | F.coalesce(values, F.lit(False)), EQUAL).when(values.isNull(), UNDECIDED).otherwise(UNEQUAL)

    def members(p):
        same_brackets = (F.substring(g, 1, 1) == F.substring(t, 1, 1)) & (F.substring(g, -1, 1) == F.substring(t, -1, 1))
        alike = (F.size(p["t"]) == F.size(p["g"])) & ((F.size(p["t"]) == 1) | same_brackets)
        return F.when(alike, F.array_min(F.transform(F.arrays_zip(p["t"].alias("t"), p["g"].alias("g")), member))).otherwise(UNEQUAL)

    return F.when(g == t, EQUAL).when((g == "") | (t == ""), UNEQUAL).otherwise(
        _let(F.struct(answer_elements(t).alias("t"), answer_elements(g).alias("g")), members))


def heavy_equal(given, truth) -> Column:
    """Whether :func:`heavy_state` is EQUAL."""
    return heavy_state(given, truth) == EQUAL


def answers_undecided(given, truths) -> Column:
    """Whether an answer equals none of ``truths`` as :func:`answers_equal` sees it, but a symbolic solver might."""
    g, ts = col(given), F.filter(col(truths), lambda t: t.isNotNull() & (t != ""))
    open_ = _let(F.struct(heavy_normalize_all(F.array(g)).alias("g"), heavy_normalize_all(ts).alias("ts")),
                 lambda p: F.exists(p["ts"], lambda t: heavy_state(p["g"].getItem(0), t) == UNDECIDED))
    return F.when(g.isNull(), F.lit(False)).otherwise(~answers_equal(given, truths) & F.coalesce(open_, F.lit(False)))
