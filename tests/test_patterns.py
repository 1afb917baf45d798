import pytest

from filewright.functions.patterns import PatternError, date_format_of, date_pattern, group_count, java_regex, java_replacement


def test_translation():
    assert java_regex("/^a(b)$/i") == "(?iu)^a(b)$"
    assert java_regex(r"#a/b\#c#") == "a/b#c"
    assert java_regex("{a{2}}") == "a{2}"
    assert java_regex("/a$/D") == r"a\z"
    assert java_regex("/(?P<n>x)/") == "(?<n>x)"


@pytest.mark.parametrize("bad", ["abc", "/abc", "/a/U", "/a(b/", r"/a\Kb/", "/a(?R)?/", "/[a/", ""])
def test_refused(bad):
    with pytest.raises(PatternError):
        java_regex(bad)


#: pattern, text, what it matches first (None: nothing).
TABLE = [
    ("/[[:upper:]]+/", "pureABC", "ABC"), ("/[[:lower:]]+/", "ABCpure", "pure"), ("/[[:upper:]]+/", "pure", None), ("/[[:upper:]]+/i", "12pure", "pure"),
    ("/[[:digit:][:space:]]+/", "a1 2b", "1 2"), ("/[^[:alpha:]]+/", "ab12cd", "12"), ("/[[:^alpha:]]+/", "ab12cd", "12"), ("/[[:alnum:]_-]+/", "..a-1_b..", "a-1_b"),
    ("/[[:punct:]]+/", "ab,;c", ",;"), ("/[[:xdigit:]]+/", "xyzBEEFq", "BEEF"), ("/[[:word:]]+/", "-a_1-", "a_1"), ("/[[:^space:]]+/", "  ab ", "ab"), ("/[[:blank:]x]+/", "a x\tb", " x\t"),
    ("/[[]x/", "a[x", "[x"), ("/[]]x/", "a]x", "]x"), ("/[^]]x/", "]x ax", "ax"), ("/[a[]+/", "b[a[", "[a["), ("/a[&&b]/", "a&", "a&"), ("/a[&&b]/", "ab", "ab"),
    ("/[a-c[0-9]+/", "x[b2", "[b2"), ("/[\\b]/", "a\x08", "\x08"), ("/[\\101]/", "xA", "A"), (r"/[\d\-x]+/", "a1-x", "1-x"), (r"/[\Qa]\E]+/", "x]a", "]a"),
    (r"/\Qa.b\E+/", "a.bb axb", "a.bb"), (r"/\Q(\E/", "a(b", "("), (r"/\Qab/", "xab", "ab"), ("/a{/", "a{", "a{"), ("/{Y}/", "{Y}", "{Y}"), ("/a{,2}/", "a{,2}", "a{,2}"), ("/a{2}/", "aaa", "aa"), ("/a{1,}b/", "aab", "aab"), ("/}/", "}", "}"),
    ("/(?P<my_name>a)b(?P=my_name)/", "aba", "aba"), ("/(?<n>a)(?<n2>b)\\k<n2>/", "abb", "abb"), ("/(?'q'a)\\k{q}/", "aa", "aa"), ("/(a)(b)\\g{-1}/", "abb", "abb"), ("/(a)\\g1/", "aa", "aa"), ("/(a)\\g{1}1/", "aa1", "aa1"),
    ("/(a)(?#note b)c/", "ac", "ac"), ("/a # b\n c/x", "ac", "ac"), ("/[ #]+/x", "a #", " #"), (r"/a\ b/x", "a b", "a b"), ("/A(?-i)b/i", "ab aB", "ab"), ("/(?i:a)b/", "Ab AB", "Ab"), ("/(?>a+)b/", "aab", "aab"), ("/a++b/", "aab", "aab"),
    ("/(?<=a)b/", "ab", "b"), ("/(?<!a)b/", "abb", "b"), ("/a(?!b)/", "abac", "a"), (r"/\Aab\z/", "ab", "ab"), ("/ab$/D", "ab\n", None), (r"/\N+/", "a\nb", "a"), (r"/\x41\x{42}/", "AB", "AB"), (r"/\p{Lu}\pL/", "aÉb", "Éb"), (r"/\p{^Lu}+/", "AbcD", "bc"), (r"/[\p{^Lu}]+/", "AbcD", "bc"),
    (r"/\h+/", "a \tb", " \t"), (r"/\R/", "a\r\nb", "\r\n"), (r"/\0/", "a\0", "\0"), (r"/\e/", "\x1b", "\x1b"), ("~a/b~", "a/b", "a/b"), (r"#a\#b#", "a#b", "a#b"), ("(a(b))", "ab", "ab"), ("[a[bc]]", "ab", "ab"), (r"/a\/b/", "a/b", "a/b"), ("/a.c/s", "a\nc", "a\nc"), ("/^b/m", "a\nb", "b"),
    ("/a|b|/", "b", "b"), ("/(a|)(b)?c/", "ac", "ac"), ("/a*?b/", "aab", "aab"), (r"/\d{4}-\d{2}/", "x2024-01", "2024-01"), (r"/[^\/]+$/", "a/b", "b"), ("/É/iu", "é", "é"), ("/ab/A", "ab", "ab"), ("/b/A", "ab", None), (r"/[\w.]+@/", "a.b@", "a.b@"), (r"/\bfoo\b/", "a foo", "foo"), (r"/[a\]b]+/", "]ab", "]ab"), ("/[a-]+/", "-a", "-a"), ("/[--a]+/", "-a", "-a"), (r"/\.(jpe?g)$/i", "X.JPEG", ".JPEG"),
]


def test_every_pattern_matches_as_it_should(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[F.when(F.lit(text).rlike(java_regex(p)), F.regexp_extract(F.lit(text), java_regex(p), 0)).alias(f"c{i}") for i, (p, text, _) in enumerate(TABLE)]).first()
    wrong = [(p, text, got, expected) for (p, text, expected), got in zip(TABLE, row, strict=True) if got != expected]
    assert not wrong and len(TABLE) >= 80


@pytest.mark.parametrize("bad, place", [
    ("/a(?|b|c)/", "at 1"), (r"/ab\Kc/", "at 2"), ("/a(?R)/", "at 1"), ("/a(?1)/", "at 1"), ("/(a)(?(1)b)/", "at 3"), ("/(?&n)/", "at 0"), ("/(?P>n)/", "at 0"), ("/(*SKIP)a/", "at 0"), ("/a(?C1)/", "at 1"),
    ("/[[:nope:]]/", "at 1"), ("/[[.a.]]/", "at 1"), ("/[[=a=]]/", "at 1"), ("/a[bc/", "at 1"), ("/ab)/", "at 2"), ("/(ab/", "missing"), (r"/\u0041/", "at 0"), (r"/\Lx/", "at 0"), (r"/\C/", "at 0"), (r"/a\k<x>/", "no group"), ("/a**/", "Dangling"), ("/a/e", "flag"), ("/a/U", "flag"), ("/[z-a]/", "range"),
])
def test_refused_with_the_place(spark, bad, place):
    with pytest.raises(PatternError, match=place):
        java_regex(bad)


def test_replacements():
    assert java_replacement("$1jpg", 2) == "$1jpg"
    assert java_replacement(r"\1-${2}-$3", 2) == "$1-$2-"
    assert java_replacement("a$b", 1) == r"a\$b"


def test_date_patterns():
    p = date_pattern("/^{y}-{m}x{3}{foo}(.+)$/")
    assert p.placeholders == ("y", "m") and p.java == r"^(\d{2})-(\d{2})x{3}\{foo\}(.+)$" and group_count(p.java) == 3
    assert date_format_of("{Y}-{m}_IMG") == "Y-m_IMG"
    assert group_count(r"a\((?:b)(?<n>c)[(](d)") == 2
