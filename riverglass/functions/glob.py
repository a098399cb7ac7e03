"""GLOB patterns as regular expressions: * any run, ? one character, [..] a class, [^..] its complement."""

from __future__ import annotations

import re


def glob_regex(pattern: str, flavour: str = "java") -> str | None:
    """A regular expression for whole values, or None if nothing can match (an unclosed class).

    Matching is case-sensitive; a ] first in a class is literal, as is a ! there. The pattern ends at its
    first NUL; cut values likewise before matching.
    """
    rest, out = pattern.partition("\0")[0], []
    while rest:
        c, rest = rest[0], rest[1:]
        if c == "[":
            m = re.match(r"(\^?)(\]?[^\]]*)\]", rest, re.S)
            if not m:
                return None
            out.append(_class(m[1], m[2]))
            rest = rest[m.end() :]
        else:
            out.append({"*": ".*", "?": "."}.get(c) or _literal(c))
    return "(?s)\\A" + "".join(out) + ("\\z" if flavour == "java" else "\\Z")


def _literal(c: str) -> str:
    return c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02x}"


def _class(negated: str, body: str) -> str:
    parts, k = [], 0
    while k < len(body):
        if k + 2 < len(body) and body[k + 1] == "-":
            if body[k] <= body[k + 2]:
                parts.append(f"{_literal(body[k])}-{_literal(body[k + 2])}")
            k += 3
        else:
            parts.append(_literal(body[k]))
            k += 1
    if not parts:
        return "." if negated else "(?!)"
    return f"[{negated}{''.join(parts)}]"
