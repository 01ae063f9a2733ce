"""JSON as models write it.

The grammar is our own: prose and code fences around the value, either kind of quotes, bare words
as keys and texts, missing and trailing commas, literals in any case. Of a truncated value only
whole entries stay. One pass, whatever the faults.
"""

from __future__ import annotations

import json
import re

_SPACE = re.compile(r"[\s,]*")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?=[\s,\]}:]|$)")
_BARE = re.compile(r"[^\s,:\[\]{}\"']+(?:[ \t]+[^\s,:\[\]{}\"']+)*")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_LITERALS = {"true": True, "false": False, "null": None, "none": None}
_MOST_DEEP = 200


class _Cut(Exception):
    """The text ends within a value."""


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> str:
        """The next character after white space and commas."""
        self.at = _SPACE.match(self.text, self.at).end()
        if self.at >= len(self.text):
            raise _Cut
        return self.text[self.at]

    def value(self, depth: int = 0):
        c = self.skip()
        if depth > _MOST_DEEP:
            raise _Cut
        if c in "[{":
            self.at += 1
            return self.entries(c, depth)
        if c in "\"'":
            return self.quoted(c)
        if m := _NUMBER.match(self.text, self.at):
            self.at = m.end()
            return json.loads(m[0]) if not re.match(r"-?0\d", m[0]) else m[0]
        if m := _BARE.match(self.text, self.at):
            self.at = m.end()
            return _LITERALS.get(m[0].lower(), m[0])
        self.at += 1  # a mark that stands for nothing
        return self.value(depth + 1)

    def entries(self, opening: str, depth: int):
        """A list or an object up to its end; at the top a truncated one as far as it is whole."""
        out = [] if opening == "[" else {}
        try:
            while self.skip() not in "]}":
                if opening == "[":
                    out.append(self.value(depth + 1))
                else:
                    key = self.value(depth + 1)
                    if self.skip() == ":":
                        self.at += 1
                        found = self.value(depth + 1)
                        out[key if isinstance(key, str) else json.dumps(key)] = found
            self.at += 1  # whichever bracket it is
        except _Cut:
            if depth:
                raise
        return out

    def quoted(self, quote: str) -> str:
        """A text in quotes. A quote that no comma, colon or bracket follows is part of the text."""
        out, i, text = [], self.at + 1, self.text
        while True:
            if i >= len(text):
                raise _Cut
            c = text[i]
            if c == "\\":
                if i + 1 >= len(text):
                    raise _Cut
                code = text[i + 2 : i + 6]
                if text[i + 1] == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", code):
                    out.append(chr(int(code, 16)))
                    i += 6
                else:
                    out.append(_ESCAPES.get(text[i + 1], text[i + 1]))
                    i += 2
            elif c == quote and re.match(r"\s*(?:[,:\]}]|$|[\"'{\[])", text[i + 1 : i + 40]):
                self.at = i + 1
                found = "".join(out)
                halves = any("\ud800" <= x <= "\udfff" for x in found)
                return found.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if halves else found
            else:
                out.append(c)
                i += 1


def loads(raw: str | None):
    """The first list or object of an answer, or None. Valid JSON is read as such."""
    if raw is None:
        return None
    text = raw.strip()
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    begin = re.search(r"[\[{]", text)
    if begin is None:
        return None
    reader = _Reader(text[begin.start() :])
    try:
        return reader.value()
    except _Cut:
        return None
