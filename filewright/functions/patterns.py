"""Patterns as the commands take them: delimited Perl-style regular expressions, replacements and date placeholders.

Everything here runs once a query on the driver and returns text for Spark's (Java) regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: What each date placeholder matches.
DATE_PLACEHOLDERS = {"Y": r"(\d{4})", "y": r"(\d{2})", "m": r"(\d{2})", "d": r"(\d{2})", "H": r"(\d{2})", "i": r"(\d{2})", "s": r"(\d{2})"}
#: The named classes of bracket expressions, as Java writes them.
POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "upper": "Upper", "xdigit": "XDigit"}
#: Escapes that mean the same in both dialects; other letters are refused.
SAME_ESCAPES, CLASS_ESCAPES = "dDwWsSbBAZzGhHvVRXnrtfea", "dDwWsShHvVnrtfea"
_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}
_FLAGS = {"i": "(?iu)", "m": "(?m)", "s": "(?s)", "x": "(?x)", "u": "(?U)"}


class PatternError(ValueError):
    """A pattern that can't be used."""


def java_regex(pattern: str) -> str:
    """A delimited pattern, ``/body/flags``, as a Java expression. Raises PatternError, with the place, for what is malformed or Java lacks."""
    text = pattern.lstrip()
    if not text or text[0].isalnum() or text[0] in "\\ ":
        raise PatternError(f"no delimiter in {pattern!r}")
    end = text.rfind(_CLOSING.get(text[0], text[0]))
    if end <= 0:
        raise PatternError(f"no ending delimiter in {pattern!r}")
    body, flags = text[1:end], text[end + 1 :].strip()
    if text[0] not in _CLOSING:
        body = body.replace("\\" + text[0], re.escape(text[0]) if text[0] in ".^$*+?|()[]{}" else text[0])
    prefix = ""
    for flag in flags:
        if flag == "A":
            prefix += r"\G"
        elif flag in _FLAGS:
            prefix = _FLAGS[flag] + prefix
        elif flag != "D":
            raise PatternError(f"flag {flag!r} of {pattern!r} is not supported")
    java = prefix + _Reader(body, pattern, flags).expression()
    _checked(java, pattern)
    return java


class _Reader:
    """Reads an expression of the Perl dialect token by token and writes it for Java.

    Groups whose names Java hasn't become plain ones, and references to names numbers.
    """

    def __init__(self, body: str, pattern: str, flags: str):
        self.body, self.pattern, self.at, self.out = body, pattern, 0, []
        self.extended, self.caseless, self.end_only = "x" in flags, "i" in flags, "D" in flags
        self.depth, self.groups, self.names, self.named = 0, 0, {}, []

    def refuse(self, what: str, at: int | None = None):
        raise PatternError(f"{what} at {self.at if at is None else at} of {self.pattern!r} is not supported")

    def take(self, expression: str) -> re.Match | None:
        m = re.compile(expression, re.DOTALL).match(self.body, self.at)
        if m:
            self.at = m.end()
        return m

    def expression(self) -> str:
        while self.at < len(self.body):
            c = self.body[self.at]
            if c == "\\":
                self.escape()
            elif c == "[":
                self.bracket()
            elif c == "(":
                self.group()
            elif m := self.take(r"\{\d+(?:,\d*)?\}"):
                self.out.append(m[0])
            elif self.extended and c == "#":
                self.take(r"#[^\n]*\n?")
            else:
                self.depth -= c == ")"
                if self.depth < 0:
                    raise PatternError(f"unmatched ) at {self.at} of {self.pattern!r}")
                self.out.append("\\" + c if c in "{}" else r"\z" if c == "$" and self.end_only else c)
                self.at += 1
        if self.depth:
            raise PatternError(f"missing ) in {self.pattern!r}")
        for place, name in self.named:
            if name not in self.names:
                raise PatternError(f"no group {name!r} in {self.pattern!r}")
            self.out[place] = f"(?:\\{self.names[name]})"
        return "".join(self.out)

    def escape(self) -> None:
        at = self.at
        if m := self.take(r"\\Q(.*?)(?:\\E|$)"):
            self.out.append(re.escape(m[1]) if m[1] else "")
        elif self.take(r"\\E"):
            return
        elif m := self.take(r"\\(?:k\{(\w+)\}|k<(\w+)>|k'(\w+)'|g\{([A-Za-z_]\w*)\})"):
            self.named.append((len(self.out), m[1] or m[2] or m[3] or m[4]))
            self.out.append("")
        elif m := self.take(r"\\g(?:\{(-?\d+)\}|(-?\d+))"):
            n = int(m[1] or m[2])
            n = self.groups + 1 + n if n < 0 else n
            if n < 1:
                self.refuse(m[0], at)
            self.out.append(f"(?:\\{n})")
        elif self.take(r"\\N(?!\{)"):
            self.out.append(r"[^\n]")
        elif m := self.take(r"\\0(?![0-7])"):
            self.out.append(r"\x00")
        elif m := self.take(r"\\([pP])\{\^(\w+)\}"):
            self.out.append(f"\\{'P' if m[1] == 'p' else 'p'}{{{m[2]}}}")
        elif m := self.take(r"\\(?:[pP](?:\{[^}]*\}|\w)|x(?:\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2})|c[ -~]|\d+|[^A-Za-z0-9])"):
            self.out.append(m[0])
        elif m := self.take(rf"\\[{SAME_ESCAPES}]"):
            self.out.append(m[0])
        else:
            self.refuse(self.body[at : at + 2], at)

    def group(self) -> None:
        at = self.at
        if self.take(r"\(\?#[^)]*\)"):
            return
        if m := self.take(r"\(\?(?:P?<(?![=!])(\w+)>|'(\w+)')"):
            self.groups += 1
            name = m[1] or m[2]
            self.out.append(f"(?<{name}>" if re.fullmatch("[A-Za-z][A-Za-z0-9]*", name) and name not in self.names else "(")
            self.names.setdefault(name, self.groups)
        elif m := self.take(r"\(\?P=(\w+)\)"):
            self.named.append((len(self.out), m[1]))
            self.out.append("")
            return
        elif m := self.take(r"\(\?(?:[:=!>]|<[=!])"):
            self.out.append(m[0])
        elif m := self.take(r"\(\?[imsx]*(?:-[imsx]+)?[:)]"):
            self.out.append(m[0])
            if m[0].endswith(")"):
                return
        elif self.body.startswith(("(?", "(*"), at):
            self.refuse(self.body[at : at + 3])
        else:
            self.take(r"\(")
            self.groups += 1
            self.out.append("(")
        self.depth += 1

    def bracket(self) -> None:
        """A bracket expression: in it, ``[`` and ``&&`` are plain, named classes aren't, and white space always counts."""
        at = self.at
        out = [self.take(r"\[\^?")[0]]
        if self.take(r"\]"):
            out.append(r"\]")
        while self.at < len(self.body) and self.body[self.at] != "]":
            if m := self.take(r"\[:(\^?)(\w+):\]"):
                name = "alpha" if self.caseless and m[2] in ("upper", "lower") else m[2]
                if name in POSIX:
                    out.append(f"\\{'P' if m[1] else 'p'}{{{POSIX[name]}}}")
                elif name in ("space", "word"):
                    out.append("\\" + (name[0].upper() if m[1] else name[0]))
                else:
                    raise PatternError(f"no class {m[0]} at {m.start()} of {self.pattern!r}")
            elif m := self.take(r"\[[.=]"):
                self.refuse(m[0], m.start())
            elif m := self.take(r"\\Q(.*?)(?:\\E|$)"):
                out += [re.escape(x) for x in m[1]]
            elif self.take(r"\\E"):
                continue
            elif self.take(r"\\b"):
                out.append(r"\x08")
            elif m := self.take(r"\\([pP])\{\^(\w+)\}"):
                out.append(f"\\{'P' if m[1] == 'p' else 'p'}{{{m[2]}}}")
            elif m := self.take(r"\\([0-7]{1,3})"):
                out.append(f"\\x{int(m[1], 8) & 0xFF:02x}")
            elif m := self.take(rf"\\(?:[pP](?:\{{[^}}]*\}}|\w)|x(?:\{{[0-9A-Fa-f]+\}}|[0-9A-Fa-f]{{2}})|c[ -~]|[{CLASS_ESCAPES}]|[^A-Za-z0-9])"):
                out.append(m[0])
            elif self.body[self.at] == "\\":
                self.refuse(self.body[self.at : self.at + 2])
            else:
                c = self.take(".")[0]
                out.append("\\" + c if c in "[&^#" or (c.isspace() and self.extended) else c)
        if not self.take(r"\]"):
            raise PatternError(f"missing ] for [ at {at} of {self.pattern!r}")
        self.out.append("".join(out) + "]")


def _checked(java: str, pattern: str) -> None:
    """Fails early for an expression that Java refuses; without a session, for one that is malformed in any dialect."""
    from pyspark import SparkContext
    from pyspark.errors import PySparkException

    if (context := SparkContext._active_spark_context) is not None and context._jvm is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(java)
        except PySparkException as e:
            raise PatternError(f"{pattern!r}: {str(e).splitlines()[0]}") from None
        return
    try:
        re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", java.replace(r"\z", r"\Z").replace(r"\h", r"\s")).replace(r"\G", ""))
    except re.error as e:
        if "possessive" not in str(e) and "bad escape" not in str(e):
            raise PatternError(f"{pattern!r}: {e}") from None


def group_count(java: str) -> int:
    """Capture groups of an expression."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", java)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", plain))


def optional_groups(java: str) -> int:
    """How many of an expression's last groups may take no part in a match: those with ``?`` or ``*`` after them, all with an alternation."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "xx", java)
    open_, ends = [], []
    for m in re.finditer(r"\((?!\?)|\(\?<(?![=!])|\(\?|\)", plain):
        if m[0] != ")":
            open_.append(len(ends) if m[0] != "(?" else None)
            if m[0] != "(?":
                ends.append(0)
        elif open_ and (k := open_.pop()) is not None:
            ends[k] = m.end()
    may_miss = [bool(re.match(r"[?*]|\{0", plain[e:])) or "|" in plain for e in ends]
    return next((k for k, x in enumerate(reversed(may_miss)) if not x), len(may_miss))


def java_replacement(replacement: str, groups: int) -> str:
    r"""``\1``, ``$1``, ``${1}`` and ``$0`` of a replacement for Java; a group that isn't there is empty text."""

    def group(m: re.Match) -> str:
        n = int(m[1] or m[2] or m[3])
        return f"${{{n}}}" if n <= groups else ""

    parts, at = [], 0
    for m in re.finditer(r"\\(\d{1,2})|\$(\d{1,2})|\$\{(\d{1,2})\}", replacement):
        parts += [_literal(replacement[at : m.start()]), group(m).replace("{", "").replace("}", "")]
        if parts[-1] and replacement[m.end() : m.end() + 1].isdigit():
            parts.append("\\")  # keeps Java from reading the next digit as part of the group's number
        at = m.end()
    return "".join(parts) + _literal(replacement[at:])


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


@dataclass(frozen=True)
class DatePattern:
    """A compiled date pattern: its expression and the placeholders in the order of their groups."""

    java: str
    placeholders: tuple[str, ...]


def date_pattern(pattern: str) -> DatePattern:
    """``{Y}`` and the other placeholders become groups; other braces stay, and don't count as placeholders."""
    names = tuple(m for m in re.findall(r"\{(\w+)\}", pattern) if m in DATE_PLACEHOLDERS)
    return DatePattern(java_regex(re.sub(r"\{(\w+)\}", lambda m: DATE_PLACEHOLDERS.get(m[1], m[0]), pattern)), names)


def date_format_of(replacement: str) -> str:
    """``{x}`` becomes ``x``: what is left is a date format, in which plain letters are format characters too."""
    return re.sub(r"\{(\w+)\}", r"\1", replacement)
