"""Reading scores out of the text that a judge returned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit.functions.text import first_match, strip

_NUMBER = r"\b(\d+)\b"


def _double(c: Column) -> Column:
    return c.try_cast("double")


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def parsed(c: Column) -> Column:
    """VARIANT of JSON text, null if it is none. Unlike try_parse_json, text after the value is not ignored."""
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(values) == 1, F.get(values, 0))


def rating_or_last(response: Column, default: float = 3.0) -> Column:
    """`Rating: n`, else the last whole number, else the default. Not clamped."""
    return F.coalesce(_double(first_match(response, r"Rating:\s*(\d+)")), _double(F.try_element_at(_all(response, _NUMBER), F.lit(-1))), F.lit(default))


def rating_or_first(response: Column, default: float = 3.0, named: bool = True) -> Column:
    """`Rating: n` (if named), else the first number from 1 to 5, else the default."""
    rating = [_double(first_match(response, r"Rating:\s*(\d+)"))] if named else []
    return F.coalesce(*rating, _double(F.try_element_at(_all(response, r"\b([1-5])\b"), F.lit(1))), F.lit(default))


def rating_of_ten(response: Column) -> Column:
    """`Rating: n`, else the first whole number, else the rating or score of a JSON object, else 5; from 0 to 10."""
    v = parsed(response)
    got = F.coalesce(
        _double(first_match(response, r"(?i)Rating:\s*(\d+)")),
        _double(F.try_element_at(_all(response, _NUMBER), F.lit(1))),
        F.try_variant_get(v, "$.rating", "double"), F.try_variant_get(v, "$.score", "double"), F.lit(5.0),
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), got))


def embedded_json(response: Column) -> Column:
    """VARIANT of what stands from the first brace to the last, else of the whole text; null if neither is JSON."""
    return F.coalesce(parsed(F.regexp_extract(response, r"(?s)\{.*\}", 0)), parsed(strip(response)))


def json_number(response: Column, field: str, default: float = 3.0) -> Column:
    """A number of the embedded object; without JSON the last whole number of the text; else the default."""
    v = embedded_json(response)
    last = _double(F.try_element_at(_all(response, _NUMBER), F.lit(-1)))
    return F.when(v.isNotNull(), F.coalesce(F.try_variant_get(v, f"$.{field}", "double"), F.lit(default))).otherwise(F.coalesce(last, F.lit(default)))


def relevance_flag(response: Column) -> Column:
    """`relevant` of the embedded object; without JSON whether the text holds yes, true or 1."""
    v = embedded_json(response)
    return F.when(v.isNotNull(), F.coalesce(F.try_variant_get(v, "$.relevant", "boolean"), F.lit(False))).otherwise(F.lower(response).rlike("yes|true|1"))


def agent_score(response: Column) -> Column:
    """STRUCT<score, reasoning> of an agent judge: JSON between the outer braces, else named fields, else any number, else 1."""
    s = strip(response)
    v = parsed(F.when(s.contains("{") & s.contains("}"), F.regexp_extract(s, r"(?s)\{.*\}", 0)).otherwise(s))
    field = _double(first_match(s, r"[\"']?score[\"']?\s*:\s*([0-9.]+)"))
    number = _double(first_match(s, r"\b([0-9.]+)\b"))
    score = F.when(v.isNotNull(), F.coalesce(F.try_variant_get(v, "$.score", "double"), F.try_variant_get(v, "$", "double"), F.lit(1.0))).otherwise(F.coalesce(field, number, F.lit(1.0)))
    reason = F.when(v.isNotNull(), F.try_variant_get(v, "$.reasoning", "string")).otherwise(F.when(field.isNotNull(), first_match(s, r"[\"']?reasoning[\"']?\s*:\s*[\"']([^\"']*)[\"']")))
    return F.struct(score.alias("score"), F.coalesce(reason, F.lit("")).alias("reasoning"))


def result_score(result: Column) -> Column:
    """STRUCT<score, reasoning> of a scorer's result as JSON text, whatever its form: an object's score, the first
    object of a list, a number (or text or truth value that is one), 0 for an object with an error or without score,
    an empty list, and anything else. The reasoning of an error is its text."""
    v = parsed(strip(result))
    first = F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v)
    listed = F.try_variant_get(v, "$", "array<variant>").isNotNull()
    error = F.when(~listed, F.try_variant_get(v, "$.error", "string"))
    alone = F.when(~listed, F.coalesce(F.try_variant_get(v, "$", "double"), _double(result)))
    score = F.when(error.isNotNull(), 0.0).otherwise(F.coalesce(F.try_variant_get(first, "$.score", "double"), alone, F.lit(0.0)))
    reason = F.when(error.isNotNull(), F.concat(F.lit("Error: "), error)).otherwise(F.try_variant_get(first, "$.reasoning", "string"))
    return F.struct(score.alias("score"), F.coalesce(reason, F.lit("")).alias("reasoning"))


def panel_score(response: Column) -> Column:
    """Score of a panel judge from 0 to 1: JSON (whole, fenced, or the first object) with score from 1 to 5 and reasoning, else 0."""
    s = strip(response)
    fenced = F.regexp_extract(s, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1)
    v = F.coalesce(parsed(s), parsed(F.when(fenced != "", fenced).otherwise(F.regexp_extract(s, r"(?s)\{.*?\}", 0))))
    score = F.try_variant_get(v, "$.score", "double")
    ok = score.between(1, 5) & F.try_variant_get(v, "$.reasoning", "string").isNotNull()
    return F.when(ok, (score - 1) / 4).otherwise(0.0)


def criteria_score(response: Column, low: float = 1.0, high: float = 5.0) -> Column:
    """Score named in a `**Score:**` or `**Final Score:**` line (x/y gives x), else the last number; scaled to 0..1; none gives 0."""
    line = F.try_element_at(F.filter(F.transform(F.split(response, "\n"), strip), lambda x: x.rlike(r"^\*\*(?:Final )?Score:\*\*")), F.lit(-1))
    named = _double(first_match(F.element_at(F.split(line, ":"), -1), r"(\d+\.?\d*)"))
    last = _double(F.try_element_at(_all(response, r"\b(\d+\.?\d*)\b"), F.lit(-1)))
    scaled = (F.coalesce(named, last) - low) / (high - low)
    return F.when(scaled.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def verdict_weight(response: Column, full: str, partial: str, negative: str, reference_compat: bool = False) -> Column:
    """1 for `full`, 0.5 for `partial`, 0 otherwise. reference_compat: `full` counts wherever it occurs unless
    `negative` occurs, also inside the partial word."""
    up = F.upper(response)
    if reference_compat:
        return F.when(up.contains(full) & ~up.contains(negative), 1.0).when(up.contains(partial), 0.5).otherwise(0.0)
    return F.when(up.contains(partial), 0.5).when(up.contains(negative), 0.0).when(up.contains(full), 1.0).otherwise(0.0)
