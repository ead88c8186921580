"""Regular expressions: checks a pattern for the linear-time dialect and writes it for Java, and for Arrow's own linear-time engine.

The dialect has no look-around, back references, atomic groups or possessive repeats; ``$`` without
``m`` is the end of text; only line feed ends a line; ``\\s``, ``\\w``, ``\\d`` and ``\\b`` are ASCII.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..plans.errors import DelimitedError
from ..plans.limits import MAX_REGEX_BYTES

# POSIX class names and their ASCII ranges.
POSIX = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
_CLASS = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r "}
_PLAIN = {"n": r"\n", "r": r"\r", "t": r"\t", "f": r"\f", "v": r"\x0B", "a": r"\x07"}
_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?-iu:(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD})))"
_NO_EDGE = f"(?-iu:(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD})))"
_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_HEX = re.compile(r"[0-9A-Fa-f]+")


@dataclass(frozen=True)
class Regex:
    """A checked pattern; ``java`` is its form for ``rlike``, ``linear`` that for Arrow."""

    source: str
    flags: str = ""
    java: str = ""
    linear: str = ""

    def found_in(self, text: str) -> bool:
        """Whether a local text has a match, by the engine whose dialect this is."""
        import pyarrow as pa
        import pyarrow.compute as pc

        return pc.match_substring_regex(pa.scalar(text, pa.string()), self.linear).as_py()


def regex(source: str, flags: str = "") -> Regex:
    """Check a pattern and its flags (i, m, s, u) and translate it."""
    if not isinstance(source, str) or not isinstance(flags, str):
        raise DelimitedError("regular expression source and flags must be strings")
    if bad := "".join(f for f in flags if f not in "imsu"):
        raise DelimitedError(f"unsupported regular expression flags: {bad}")
    if len(set(flags)) != len(flags):
        raise DelimitedError(f"duplicate regular expression flags: {flags}")
    if len(source.encode()) > MAX_REGEX_BYTES:
        raise DelimitedError(f"regular expression exceeds {MAX_REGEX_BYTES} UTF-8 bytes")
    java, linear = (_Writer(source, flags, form).write() for form in ("java", "linear"))
    on = "".join(f for f in "ms" if f in flags)
    short = "".join(f for f in "ims" if f in flags)
    return Regex(source, flags, "(?d" + ("iu" if "i" in flags else "") + on + ")" + java, (f"(?{short})" if short else "") + linear)


def _syntax(source: str, what: str) -> DelimitedError:
    return DelimitedError(f"Invalid regular expression: /{source}/: {what}")


def _dialect(what: str) -> DelimitedError:
    return DelimitedError(f"invalid regular expression: {what}")


class _Writer:
    def __init__(self, source: str, flags: str, form: str):
        self.s, self.flags, self.at, self.java = source, flags, 0, form == "java"
        self.out: list[str] = []

    def write(self) -> str:
        s, depth, atom = self.s, 0, False
        while self.at < len(s):
            c = s[self.at]
            if c == "\\":
                self.out.append(self.escape(False))
                atom = True
            elif c == "[":
                self.out.append(self.char_class())
                atom = True
            elif c == "(":
                self.out.append(self.group())
                depth, atom = depth + 1, False
            elif c == ")":
                depth -= 1
                if depth < 0:
                    raise _syntax(s, "Unmatched ')'")
                self.put(")")
                atom = True
            elif c in "*+?" or c == "{" and _REPEAT.match(s, self.at):
                if not atom:
                    raise _syntax(s, "Nothing to repeat")
                self.repeat()
                atom = False
            elif c == "{" or c == "}" or c == "]":
                self.put("\\" + c)
                atom = True
            elif c == "$":
                self.put("$" if not self.java else r"(?![^\n])" if "m" in self.flags else r"\z")
                atom = False
            elif c == "^":
                self.put(r"(?<![^\n])" if self.java and "m" in self.flags else "^")  # Java's own never matches at the very end
                atom = False
            elif c == "|":
                self.put(c)
                atom = False
            else:
                self.put(c)
                atom = True
        if depth:
            raise _syntax(s, "Unterminated group")
        return "".join(self.out)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.at += 1

    def repeat(self) -> None:
        s = self.s
        m = _REPEAT.match(s, self.at)
        op = m[0] if m and s[self.at] == "{" else s[self.at]
        if op[0] == "{":
            low, high = int(m[1]), int(m[3]) if m[3] else None
            if high is not None and high < low:
                raise _syntax(s, "numbers out of order in {} quantifier")
            if max(low, high or 0) > 1000:
                raise _dialect(f"invalid repetition size: {op}")
        self.at += len(op)
        if s[self.at : self.at + 1] == "?":
            op += "?"
            self.at += 1
        if s[self.at : self.at + 1] in ("*", "+", "?") or _REPEAT.match(s, self.at):
            raise _syntax(s, "Nothing to repeat")
        self.out.append(op)

    def group(self) -> str:
        s, at = self.s, self.at
        if s[at + 1 : at + 2] != "?":
            self.at += 1
            return "("
        for bad in ("(?<=", "(?<!", "(?=", "(?!", "(?>"):
            if s.startswith(bad, at):
                raise _dialect(f"invalid perl operator: {bad if len(bad) < 4 else bad[:3]}")
        if m := re.compile(r"\(\?P?<([A-Za-z_]\w*)>").match(s, at):
            self.at = m.end()
            return f"(?<{m[1]}>" if self.java else f"(?P<{m[1]}>"
        if m := re.compile(r"\(\?([ims]*)(?:-([ims]*))?:").match(s, at):
            self.at = m.end()
            on, off = (x.replace("i", "iu") if self.java else x for x in (m[1], m[2] or ""))
            return f"(?{on}{'-' + off if off else ''}:"
        raise _syntax(s, "Invalid group")

    def code_point(self) -> int | None:
        r"""The value of \xHH, \x{H..}, \uHHHH or \u{H..} at the cursor (on the letter); None if it is none."""
        s, at = self.s, self.at
        letter = s[at]
        if s[at + 1 : at + 2] == "{":
            end = s.find("}", at)
            digits = s[at + 2 : end] if end > 0 else ""
            if (letter == "x" or "u" in self.flags) and _HEX.fullmatch(digits) and int(digits, 16) <= 0x10FFFF:
                self.at = end + 1
                return int(digits, 16)
            if letter == "u" and "u" not in self.flags:
                return None
            raise _syntax(s, "Invalid Unicode escape")
        n = 2 if letter == "x" else 4
        digits = s[at + 1 : at + 1 + n]
        if len(digits) != n or not _HEX.fullmatch(digits):
            raise _dialect(f"invalid escape sequence: \\{letter}")
        self.at += 1 + n
        v = int(digits, 16)
        if 0xD800 <= v < 0xDC00:
            m = re.compile(r"\\u([dD][c-fC-F][0-9A-Fa-f]{2})").match(s, self.at)
            if m:
                self.at = m.end()
                return 0x10000 + ((v - 0xD800) << 10) + int(m[1], 16) - 0xDC00
        if 0xD800 <= v < 0xE000:
            raise _dialect("lone surrogate escape")
        return v

    def escape(self, inside: bool) -> str:
        s = self.s
        self.at += 1
        if self.at >= len(s):
            raise _syntax(s, "\\ at end of pattern")
        c = s[self.at]
        if c in "xu":
            v = self.code_point()
            if v is None:
                raise _dialect("invalid escape sequence: \\u")
            return f"\\x{{{v:X}}}"
        if c in "pP":
            m = re.compile(r"[pP](?:\{(\^?)([A-Za-z_]+)\}|([A-Z]))").match(s, self.at)
            if not m:
                raise _dialect(f"invalid character class range: \\{c}")
            self.at = m.end()
            name = m[2] or m[3]
            negated = (c == "P") != bool(m[1])
            return f"\\{'P' if negated else 'p'}{{{name if len(name) <= 2 or not self.java else 'Is' + name}}}"
        self.at += 1
        if c in _PLAIN:
            return _PLAIN[c]
        if not self.java and (c.lower() in _CLASS or c in "bB" and not inside):
            return "\\" + c
        if c.lower() in _CLASS:
            ranges = _CLASS[c.lower()]
            if inside:
                return ranges if c.islower() else f"[^{ranges}]"
            return f"[{'' if c.islower() else '^'}{ranges}]"
        if c == "b":
            return r"\x08" if inside else _EDGE
        if c == "0" and not s[self.at : self.at + 1].isdigit():
            return r"\x00"
        if not inside and c == "B":
            return _NO_EDGE
        if not inside and c in "Az":
            return "\\" + c
        if not c.isalnum() and c.isascii():
            return "\\" + c if c not in "_" else c
        if not c.isascii():
            return c
        raise _dialect(f"invalid escape sequence: \\{c}")

    def char_class(self) -> str:
        s = self.s
        self.at += 1
        out = "["
        if s.startswith("^", self.at):
            out, self.at = "[^", self.at + 1
        if s.startswith("]", self.at):
            raise _dialect("missing ]: " + s[self.at - len(out) :])
        while True:
            if self.at >= len(s):
                raise _syntax(s, "Unterminated character class")
            c = s[self.at]
            if c == "]":
                self.at += 1
                return out + "]"
            if c == "[":
                m = re.compile(r"\[:(\^?)(\w+):\]").match(s, self.at)
                if m:
                    if m[2] not in POSIX:
                        raise _dialect(f"invalid character class range: {m[0]}")
                    out += m[0] if not self.java else f"[^{POSIX[m[2]]}]" if m[1] else POSIX[m[2]]
                    self.at = m.end()
                    continue
                out += r"\["
            elif c == "&":
                out += r"\&"
            elif c == "\\":
                out += self.escape(True)
                continue
            elif c in "^~":
                out += "\\" + c
            else:
                out += c
            self.at += 1
