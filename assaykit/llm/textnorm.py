"""Text forms in which case, markup, spacing, hyphenation and character encoding do not matter."""

from __future__ import annotations

import html
import re
import unicodedata
from urllib.parse import unquote

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
_MOJIBAKE = re.compile(r"[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_QUOTED_PRINTABLE = re.compile(r"(?:=[0-9A-F]{2})+")


def _redecode(m: re.Match) -> str:
    for codec in ("cp1252", "latin-1"):
        try:
            return m.group().encode(codec).decode("utf-8")
        except UnicodeError:
            pass
    return m.group()


def decoded(text: str) -> str:
    """Undo entities, escapes, percent encoding and UTF-8 that was read as an 8-bit code; drop tags."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)
    if "%" in text:
        text = _PERCENT.sub(lambda m: unquote(m.group(), errors="replace"), text)
    if "=" in text:
        text = re.sub(r"=\r?\n", "", text)
        text = _QUOTED_PRINTABLE.sub(lambda m: unquote(m.group().replace("=", "%"), errors="replace"), text)
    if _MOJIBAKE.search(text):
        text = _MOJIBAKE.sub(_redecode, text)
    return text


def folded(text: str) -> str:
    """Compatibility form, case folded, without accents."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in text if not unicodedata.combining(c))


_WORD_CHARS = re.compile(r"[^\W_]+")


def squeezed(text: str) -> tuple[str, list[int]]:
    """(letters and digits only, offsets in it at which a new run of letters and digits begins)."""
    parts, starts, n = [], [], 0
    for m in _WORD_CHARS.finditer(folded(decoded(text))):
        starts.append(n)
        parts.append(m.group())
        n += m.end() - m.start()
    return "".join(parts), starts
