"""Where statements, clauses and list items begin and end in SQL text."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Quoted strings and names, comments, and any other single character.
_LEXEME = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|.", re.DOTALL)


def lexemes(text: str) -> Iterator[tuple[str, int]]:
    """Lexemes with the depth of parentheses around them; a comment is one blank."""
    depth = 0
    for m in _LEXEME.finditer(text):
        x = m[0]
        if x.startswith(("--", "/*")) and len(x) > 1:
            x = " "
        depth -= x == ")"
        yield x, depth
        depth += x == "("


def split_at(text: str, separator: str) -> list[str]:
    """Parts between separators that stand outside quotes, comments and parentheses."""
    parts = [""]
    for x, depth in lexemes(text):
        if x == separator and depth <= 0:
            parts.append("")
        else:
            parts[-1] += x
    return [p.strip() for p in parts]


def split_statements(text: str) -> list[str]:
    """The statements of a script, without comments and without empty ones."""
    return [s for s in split_at(text, ";") if s]
