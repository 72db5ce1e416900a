"""Column expressions on text: lines, words, clipping, templates."""

from pyspark.sql import Column, functions as F

# White space as Python's str methods see it, for Java.
SPACE = r"[\s\x1C-\x1F]"
WORD = r"(?U)[^\s\x1C-\x1F]+"


def split_lines(text: Column) -> Column:
    """Lines of a text: CR, LF and CRLF end a line, and a final line end opens no further line.

    Only texts that hold a CR go through a regular expression.
    """
    plain = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    parts = F.split(plain, "\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.when(F.endswith(plain, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("int")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def strip_left(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+", "")


def strip_right(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)[^\s\x1C-\x1F]")


def clip(text: Column, limit: int, tail: str = "") -> Column:
    """First `limit` characters, then `tail` where something was cut off."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(tail))).otherwise(text)


def match_snippet(text: Column) -> Column:
    """A match on one line of at most 120 characters."""
    flat = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(flat) > 120, F.concat(F.substring(flat, 1, 117), F.lit("..."))).otherwise(flat)


def regex_template(line: Column) -> Column:
    """A pattern for lines like this one: specials quoted, digit runs and long hex runs generalised."""
    quoted = F.regexp_replace(strip(line), r"([\t\n\x0B\f\r #$&()*+\-.?\[\\\]^{|}~])", r"\\$1")
    digits = F.regexp_replace(quoted, r"(?U)\d+", r"\\d+")
    return F.regexp_replace(digits, r"[A-Fa-f0-9]{6,}", "[A-Fa-f0-9]+")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Extension with its dot; a name that starts with its only dot has none."""
    return F.regexp_extract(base_name(path), r"[^.]\.?(\.[^.]+)$", 1)


def text_lines(excerpt: Column) -> Column:
    """Stored text form of an excerpt."""
    return F.array_join(excerpt, "\n")
