"""Strict JSON reading that also survives very deep nesting."""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))')


class Invalid(ValueError):
    """The text is not standard JSON."""


def _no_constant(name: str) -> None:
    raise Invalid(name)


def _iterative(text: str, number):
    """The same grammar with an explicit stack, for texts nested too deeply for the recursive reader."""
    text = text.strip(" \t\n\r")
    at, stack, keys, want, root = 0, [], [], "value", None
    done = False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or done:
            raise Invalid("unexpected text")
        at = m.end()
        sign, string, num, word = m.groups()
        if sign in (",", ":"):
            if want != sign and not (sign == "," and want == ",]"):
                raise Invalid(sign)
            want = "value" if sign == ":" else ("key" if isinstance(stack[-1], dict) else "value")
            continue
        if sign in ("]", "}"):
            kind = list if sign == "]" else dict
            if not stack or not isinstance(stack[-1], kind) or want not in (",]", "first"):
                raise Invalid(sign)
            value = stack.pop()
            keys.pop()
            done, want = not stack, ",]"
            continue
        if string and (want == "key" or want == "first" and isinstance(stack[-1], dict)):
            keys[-1] = json.loads(string)
            want = ":"
            continue
        if want == "first" and isinstance(stack[-1], dict) or want not in ("value", "first"):
            raise Invalid(m.group())
        value = [] if sign == "[" else {} if sign == "{" else json.loads(string) if string else number(num) if num else json.loads(word)
        if stack:
            if isinstance(stack[-1], dict):
                stack[-1][keys[-1]] = value
            else:
                stack[-1].append(value)
        else:
            root = value
        if sign:
            stack.append(value)
            keys.append(None)
            want = "first"
        else:
            want = ",]"
            done = not stack
    if not done:
        raise Invalid("unfinished")
    return root


def loads(text: str, raw_numbers: bool = False):
    """Parse standard JSON (no NaN, no trailing text); raise Invalid otherwise.

    raw_numbers keeps numbers as the text they were written in.
    """
    options = {"parse_int": str, "parse_float": str} if raw_numbers else {}
    try:
        return json.loads(text, parse_constant=_no_constant, **options)
    except RecursionError:
        return _iterative(text, str if raw_numbers else (lambda s: float(s) if re.search("[.eE]", s) else int(s)))
    except Invalid:
        raise
    except ValueError as e:
        raise Invalid(str(e)) from None
