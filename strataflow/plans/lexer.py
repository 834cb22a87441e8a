"""Tokens of the query language.

Strings are double-quoted with the escapes \\" \\\\ \\n \\t \\r; identifiers may be quoted by backticks (a
doubled one stands for itself); ``//`` starts a comment. Keywords are recognised in any case, and
only where the grammar wants them, so they remain usable as names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A statement that cannot be read or planned."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted, string, int, float, symbol, end
    text: str
    at: int


_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*)
      | (?P<float>\d+\.\d+(?:[eE][+-]?\d+)?)
      | (?P<int>\d+)
      | (?P<word>[^\W\d]\w*)
      | (?P<quoted>`(?:[^`]|``)*`)
      | (?P<string>"(?:[^"\\]|\\.)*")
      | (?P<symbol><-|->|<=|>=|!=|<>|\.\.|[-()\[\]{},.:;*=<>])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        kind, s = m.lastgroup, m[0]
        if kind == "string":
            s = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), s[1:-1], flags=re.S)
        elif kind == "quoted":
            s = s[1:-1].replace("``", "`")
        if kind != "space":
            out.append(Token(kind, s, at))
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out
