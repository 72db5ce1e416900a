"""Regular expressions: configuration escapes, and the Python dialect written for Spark's Java engine."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

# Single-letter escapes that a configured pattern may carry.
LETTER_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "\\": "\\", "'": "'", '"': '"'}

_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|(.))", re.S)
_QUANTIFIER = re.compile(r"\{(?:\d+(?:,\d*)?|,\d*)\}")


def decode_escapes(pattern: str) -> str:
    """Undo one level of escaping, so that a doubled backslash from a YAML file means a single one.

    Word boundaries and class escapes stay as written. Back-references and non-ASCII text are left alone.
    """
    def one(match):
        code = match.group(1) or match.group(2)
        if code:
            return chr(int(code, 16))
        return LETTER_ESCAPES.get(match.group(3), match.group(0))

    if re.search(r"(?<!\\)(?:\\\\)*\\\Z", pattern):
        return pattern
    return _ESCAPE.sub(one, pattern)


def java(pattern: str, ignore_case: bool = False) -> str:
    """The same pattern for Java: Unicode classes, `\\n` as the only line end, Python's group syntax and literals."""
    re.compile(pattern)
    body = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{_group(m)}>", _without_conditions(pattern))
    body = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{_group(m)}>", body)
    flags = ("iu" if ignore_case else "") + ("U" if re.search(r"\\[wWdDsSbB]", pattern) else "") + "d"
    return f"(?{flags}){_literals(body)}"


def _group(match) -> str:
    """A name of letters and digits for each name; different names stay different."""
    return "".join(c if re.match("[A-Ya-z0-9]", c) else "Zz" if c == "Z" else "Zu" if c == "_" else f"Zx{ord(c):x}Z" for c in match.group(1))


def _parts(pattern: str):
    """(place, text) of escapes, opened and closed groups and alternatives outside character classes."""
    i, class_start = 0, None
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            number = re.match(r"[1-9][0-9]?(?![0-9])", pattern[i + 1:])
            size = 1 + (len(number[0]) if number else 1)
            if class_start is None:
                yield i, pattern[i:i + size]
            i += size
            continue
        if class_start is not None:
            if ch == "]" and i > class_start:
                class_start = None
        elif ch == "[":
            class_start = i + (2 if pattern[i + 1:i + 2] == "^" else 1)
        elif ch == "(":
            head = re.match(r"\((?:\?(?:\([^)]*\)|P<\w+>|P=|<?[=!]|#[^)]*|[^(P<=!#]))?", pattern[i:])[0]
            yield i, head
            i += len(head)
            continue
        elif ch in "|)":
            yield i, ch
        i += 1


def _without_conditions(pattern: str) -> str:
    """`(?(g)yes|no)` as alternatives. An empty group at the end of group g has taken part exactly when g has, and a
    reference to an empty group matches nothing but is possible only then; other numbers move by the groups put in."""
    if "(?(" not in pattern:
        return pattern
    if re.search(r"\(\?[a-zA-Z]*x", pattern):
        raise ValueError(f"conditional groups in a pattern with comments: {pattern}")
    opened, closed, names, stack, edits, asked = {}, {}, {}, [], [], {}
    for at, part in _parts(pattern):
        if part.startswith("(?("):
            ref = part[3:-1]
            group = int(ref) if ref.isdigit() else names[ref]
            if group not in closed:
                raise ValueError(f"a condition on a group that is not complete: {pattern}")
            asked[group] = closed[group]
            edits.append((at, len(part), rf"(?:\k<Zi{group}>"))
            stack.append(["condition", group, False])
        elif part == "(" or part.startswith("(?P<"):
            number = len(opened) + 1
            opened[number] = at + len(part)
            if part != "(":
                names[part[4:-1]] = number
            stack.append(["group", number, False])
        elif part.startswith("("):
            stack.append(["other", 0, False])
        elif part == "|" and stack and stack[-1][0] == "condition":
            edits.append((at, 1, rf"|(?!\k<Zi{stack[-1][1]}>)"))
            stack[-1][2] = True
        elif part == ")":
            kind, number, both = stack.pop()
            if kind == "group":
                closed[number] = at
            elif kind == "condition" and not both:
                edits.append((at, 0, rf"|(?!\k<Zi{number}>)"))
    for at, part in _parts(pattern):
        if part[0] == "\\" and part[1:].isdigit() and part[1] != "0":
            moved = int(part[1:]) + sum(end < opened[int(part[1:])] for end in asked.values())
            edits.append((at, len(part), rf"(?:\{moved})"))
    for group, at in asked.items():
        edits += [(opened[group], 0, "(?:"), (at, 0, f")(?<Zi{group}>)")]
    for at, size, text in sorted(edits, reverse=True):
        pattern = pattern[:at] + text + pattern[at + size:]
    return pattern


def _literals(body: str) -> str:
    """Quote the brackets and braces that are literal in Python but syntax in Java."""
    out, i, class_start = [], 0, None
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            pair = body[i:i + 2]
            out.append("\\z" if pair == "\\Z" and class_start is None else pair)
            i += 2
            continue
        if class_start is not None:
            if ch == "]" and i > class_start:
                class_start = None
            elif ch in "[]&":
                ch = "\\" + ch
        elif ch == "[":
            if body[i + 1:i + 2] == "^":
                ch = "[^"
            class_start = i + len(ch)
        elif ch == "{":
            quantifier = _QUANTIFIER.match(body, i)
            ch = "\\{" if not quantifier else "{0" if body[i + 1] == "," else "{"
            if quantifier:
                out.append(ch + quantifier.group(0)[1:])
                i = quantifier.end()
                continue
        out.append(ch)
        i += len(ch.replace("\\", ""))
    return "".join(out)


def any_match(text: Column, patterns, ignore_case: bool = False) -> Column:
    """True where at least one pattern is found; false for an empty list.

    Patterns without groups that another pattern could disturb are searched as one alternation, in a single pass.
    """
    alone = [p for p in patterns if re.search(r"\(\?P|\(\?\(|\\[1-9]|\(\?[a-zA-Z]*x", p)]
    joint = [java(p, ignore_case) for p in patterns if p not in alone]
    tests = [text.rlike("|".join(f"(?:{p})" for p in joint) if len(joint) > 1 else joint[0])] if joint else []
    tests += [text.rlike(java(p, ignore_case)) for p in alone]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def find_all(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """All non-overlapping matches, as an array of strings."""
    return F.regexp_extract_all(text, F.lit(java(pattern, ignore_case)), F.lit(0))
