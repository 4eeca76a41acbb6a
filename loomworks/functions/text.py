"""Scalar text functions as Column builders (FN1-FN17, FN20-FN26, AGG12).

Whitespace is Unicode whitespace plus the separators U+001C to U+001F, as in Python's str.strip; Spark's trim is not used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"


def strip(x: Column) -> Column:
    """FN2: without whitespace at both ends."""
    return F.regexp_replace(x, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def lstrip(x: Column) -> Column:
    """FN2, left half."""
    return F.regexp_replace(x, rf"(?U)^{SPACE}+", "")


def rstrip(x: Column) -> Column:
    """FN2, right half."""
    return F.regexp_replace(x, rf"(?U){SPACE}+\z", "")


def uid16(x: Column) -> Column:
    """FN1: the first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 16)


def lines(x: Column) -> Column:
    """FN26: split at line feeds; a trailing empty line stays."""
    return F.split(x, "\n", -1)


def fill(template: Column | str, **values: Column) -> Column:
    """FN3-FN5, FN8: replaces {{name}} by each value in turn; later values also reach placeholders inside earlier ones."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def skeleton_prompt(template: str, problem: Column) -> Column:
    """FN3."""
    return fill(template, problem=strip(problem))


def code_prompt(template: str, problem: Column, skeleton: Column) -> Column:
    """FN4: both stripped, the problem first."""
    return fill(template, problem=strip(problem), skeleton=strip(skeleton))


def rating_prompt(template: str, problem_text: Column, code: Column) -> Column:
    """FN5: as they are."""
    return fill(template, problem_text=problem_text, code=code)


# Default prompt parts.
FUNCTION_HEAD = "This is an algorithm function.\n\ndef "
FUNCTION_TAIL = "():\n"
FIM_TOKENS = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")


def fim_prompt(prefix: str = FUNCTION_HEAD, suffix: str = FUNCTION_TAIL, tokens: tuple[str, str, str] = FIM_TOKENS) -> Column:
    """FN6, FN12: prefix and suffix between the model's fill-in-the-middle tokens."""
    return F.lit(tokens[0] + prefix + tokens[1] + suffix + tokens[2])


def l2r_prompt(prompt: str = FUNCTION_HEAD) -> Column:
    """FN7, FN12."""
    return F.lit(prompt)


def definition_prompt(name: Column, description: Column, template: str | None = None) -> Column:
    """FN8, FN12: a function head with its docstring opened; placeholders are {func_name} and {description}."""
    template = template if template is not None else FUNCTION_HEAD + '{func_name}():\n    """\n    {description}\n    """'
    out = F.lit(template)
    for key, value in (("{func_name}", name), ("{description}", description)):
        out = F.replace(out, F.lit(key), value)
    return F.replace(F.replace(out, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")) if "{{" in template else out


def description_before_name(text: Column) -> Column:
    """FN9, second part: what stands before `Function name:`, or all of the text."""
    return strip(F.regexp_replace(strip(text), r"(?s)Function name:.*\z", ""))


def name_after_description(text: Column) -> Column:
    """FN9, first part, and FN10: the name defined after `Function name:`, or ''."""
    text = strip(text)
    after = strip(F.regexp_replace(text, r"(?s)^.*?Function name:", ""))
    name = F.regexp_extract(strip(F.substr(after, F.lit(5))), r"^([\p{L}\p{N}_]*)", 1)
    return F.when(F.contains(text, F.lit("Function name:")) & F.startswith(after, F.lit("def ")), name).otherwise("")


def name_of_completion(text: Column, mode: str) -> Column:
    """FN11: the first word before a parenthesis; L2R completions may begin with `def `.  Blank text gives ''."""
    text = strip(text)
    if mode != "FIM":
        text = F.when(F.startswith(text, F.lit("def ")), strip(F.substr(text, F.lit(5)))).otherwise(text)
    return F.regexp_extract(F.regexp_extract(text, r"(?s)^([^(]*)", 1), rf"(?U)^{SPACE}*([^\s\x1c-\x1f]*)", 1)


def function_name(code: Column) -> Column:
    """FN13: the first name defined at the start of a line with a lower-case head, or null."""
    found = F.regexp_extract(code, rf"(?mdU)^def{SPACE}+([a-z_][a-z0-9_]*){SPACE}*\(", 1)
    return F.nullif(found, F.lit(""))


def imports(code: Column) -> Column:
    """FN14: stripped lines that begin an import."""
    return F.filter(F.transform(lines(code), strip), lambda x: F.startswith(x, F.lit("import ")) | F.startswith(x, F.lit("from ")))


def combine(skeleton: Column, body: Column) -> Column:
    """FN15: the skeleton, then the body's lines; those not indented by four spaces get exactly that."""
    four = F.lit("    ")
    put = F.transform(lines(body), lambda x: F.when((strip(x) == "") | F.startswith(x, four), x).otherwise(F.concat(four, lstrip(x))))
    return F.concat(rstrip(skeleton), F.lit("\n"), F.array_join(put, "\n"))


def starts_with_def(body: Column) -> Column:
    """FLT11 negated: the body repeats a function head."""
    return F.startswith(lstrip(body), F.lit("def "))


def has_code(body: Column) -> Column:
    """FLT12: some line is neither blank nor a comment."""
    return F.exists(lines(body), lambda x: (strip(x) != "") & ~F.startswith(strip(x), F.lit("#")))


def drop_hint(text: Column) -> Column:
    """FN17: from the first line that begins with `Hint:` on, nothing; stripped."""
    return strip(F.regexp_replace(text, rf"(?sU)(?:^|(?<=\n)){SPACE}*Hint:.*\z", ""))


#: Rating dimensions and the words that announce their scores.
DIMENSIONS = {
    "problem_design": "Problem Design",
    "function_definition": "Function Definition",
    "correctness": "Correctness",
    "efficiency": "Efficiency",
    "readability": "Readability",
}


def rating_score(text: Column, title: str) -> Column:
    """FN16: the integer after `<title> Score:` in any case; null without one."""
    words = f"{SPACE}+".join([*title.split(), "Score:"])
    return F.nullif(F.regexp_extract(text, rf"(?isuU){words}{SPACE}*(\d+)", 1), F.lit("")).try_cast("int")


def rating_summary(text: Column) -> Column:
    """FN16: what follows `Summary:` up to a blank line, a rule or the end; null without one."""
    pattern = rf"(?isuU)Summary:{SPACE}*(.+?)(?:\n\n|---|\z)"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def rating(text: Column) -> Column:
    """FN16: struct of the five scores."""
    return F.struct(*[rating_score(text, title).alias(k) for k, title in DIMENSIONS.items()])


def length_perplexity(code: Column) -> Column:
    """FN20: the stand-in for a model's perplexity."""
    return F.lit(100.0) / (F.lit(1.0) + F.log(F.greatest(F.lit(1), F.length(code)).cast("double")))


def logprob_perplexity(logprobs: Column) -> Column:
    """AGG12: exp of the negative mean; nulls are skipped; none gives -1."""
    known = F.filter(logprobs, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(F.coalesce(F.size(known), F.lit(0)) <= 0, F.lit(-1.0)).otherwise(F.exp(-total / F.size(known)))


def stub_candidate(i: Column) -> Column:
    """FN21."""
    return F.concat(F.lit("def auto_gen_"), i.cast("string"), F.lit("():\n    pass\n"))


def first_filled(*columns: Column) -> Column:
    """PRJ2: the first that is neither null nor empty, or ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))
