import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from logquarry.functions.patterns import any_match, decode_escapes, find_all, java
from logquarry.functions.text import regex_template, split_lines, strip, suffix, words

SAMPLES = [
    'x "level":3, y', '"level" : 4', "É È é", "naïve café", "a{2} b{,3} {}", "[x] & [y]", "tab\there", "ERROR: bad", "error",
    "terrors", "12345 deadBEEF00", "PHP Fatal error", "  padded\u00a0 ", "", "a]b", "x^y", "foo.py bar.js modules/abc",
]
PATTERNS = [
    (r'"level"\s*:\s*(3|4)', False), (r"\berror\b", True), ("é", True), (r"\w+", False), (r"\{2}", False), (r"[[\]&]", False),
    (r"[]a]b", False), (r"b\{,3}", False), (r"(?P<first_word>\w+) (?P=first_word)", False), (r"\S+$", False), ("[^]]b", False),
    (r"x\^y\Z", False), (r"a{0,1}b", False), ("{}", False), (r"[a&&b]", False), (r"\d{3,}", False),
]


def test_escapes():
    assert decode_escapes(r'"\\s5\d{2}\\s') == r'"\s5\d{2}\s'
    assert decode_escapes(r"\berror\b") == r"\berror\b"
    assert decode_escapes(r"\\[error\\]") == r"\[error\]"
    assert decode_escapes(r"\x41\u00e9") == "Aé"
    assert decode_escapes("bad\\") == "bad\\"


CONDITIONS = [
    r"(a)?b(?(1)c|d)", r"(<)?\w+(?(1)>|$)", r"(?P<q>[\"'])?\w+(?(q)(?P=q))", r"(x)?(y)?(?(2)z|w)(o)\3?", r"(a)(?:(b)|c)+(?(2)d|e)\1",
    r"((a)|b)(?(2)[)|(]|x(y))(?(1)!)", r"(\()?a|b(?(1)\)|c)", r"(?P<a_b>x)(?P<ab>y)", r"(?P<Z_>x)?(?P<Zu>y)(?P=Zu)(?(Z_)q)", r"(?:(a)|b)(?(1)(c)|(d))\2?",
]
CONDITION_SAMPLES = [
    "abc bd abd bc", "<ab> ab> <ab", "'ab' 'ab ab\"", "xyzoo yzo xwoo woo wo", "abdа abda aceacea abcda", "a) a( bxy! a)!", "(a bc b) a(", "xy", "yyq xyyq xyy", "", "ac bd acc bdd",
]


def test_conditions_on_later_groups_are_refused():
    for pattern in (r"b(?(1)c|d)(a)", r"(?x)(a)?b(?(1)c|d) # (note"):
        with pytest.raises(ValueError):
            java(pattern)


@pytest.mark.parametrize("pattern", CONDITIONS)
def test_conditions_as_in_python(spark, pattern):
    df = spark.createDataFrame([(s,) for s in CONDITION_SAMPLES], "s string")
    rows = df.select("s", any_match(F.col("s"), [pattern, "no such text"]).alias("hit"), find_all(F.col("s"), pattern).alias("found")).collect()
    for row in rows:
        assert row.hit == bool(re.search(pattern, row.s)), (pattern, row.s)
        assert row.found == [m.group(0) for m in re.finditer(pattern, row.s)], (pattern, row.s)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abc", max_size=9), st.sampled_from(["(a)?b(?(1)c|a)", "(?:(a)|(b))(?(2)c|(b))\\1?", "(?P<o_o>a)?(?P<oo>b)?(?(o_o)c|(?(oo)a|b))"]))
def test_conditions_on_any_text(spark, text, pattern):
    found = spark._jvm.java.util.regex.Pattern.compile(java(pattern)).matcher(text)
    ours = []
    while found.find():
        ours.append((found.start(), found.end()))
    assert ours == [m.span() for m in re.finditer(pattern, text)]


@pytest.mark.parametrize("pattern,ignore_case", PATTERNS)
def test_same_matches_as_python(spark, pattern, ignore_case):
    compiled = re.compile(pattern, re.I if ignore_case else 0)
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    rows = df.select("s", any_match(F.col("s"), [pattern], ignore_case).alias("hit"),
                     find_all(F.col("s"), pattern, ignore_case).alias("found")).collect()
    for row in rows:
        assert row.hit == bool(compiled.search(row.s)), (pattern, row.s)
        assert row.found == [m.group(0) for m in compiled.finditer(row.s)], (pattern, row.s)


# Lines and the patterns that are suggested for them.
TEMPLATES = {
    "disk 12 full": r"disk\ \d+\ full", "  padded  ": "padded", "id deadbeefcafe seen": r"id\ [A-Fa-f0-9]+\ seen",
    "a.b(c)*": r"a\.b\(c\)\*", "": "", "v1.2.3": r"v\d+\.\d+\.\d+", "[x] #1": r"\[x\]\ \#\d+",
}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=40), min_size=20,
                max_size=60))
def test_text_functions_match_python(spark, texts):
    texts = texts + SAMPLES + ["a\r\nb\rc\n", "\n", "x\n\ny", " \t\x1f z\x85"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = F.col("s")
    for row in df.select("s", strip(s).alias("strip"), words(s).alias("words"), split_lines(s).alias("lines")).collect():
        plain = row.s.replace("\r\n", "\n").replace("\r", "\n")
        lines = plain.split("\n")
        assert row.strip == row.s.strip()
        assert row.words == row.s.split()
        assert row.lines == (lines[:-1] if lines[-1] == "" else lines)


def test_templates(spark):
    df = spark.createDataFrame([(t,) for t in TEMPLATES], "s string")
    assert {r.s: r.t for r in df.select("s", regex_template(F.col("s")).alias("t")).collect()} == TEMPLATES


def test_suffix(spark):
    from pathlib import PurePosixPath

    names = ["a/b.md", "x.tar.gz", ".hidden", "dir.d/plain", "..md", "a.", "README"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    for row in df.select("p", suffix(F.col("p")).alias("s")).collect():
        if not row.p.endswith(".") and not row.p.startswith(".."):
            assert row.s == PurePosixPath(row.p).suffix, row.p
