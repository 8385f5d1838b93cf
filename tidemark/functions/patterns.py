"""User patterns of two regex dialects, rewritten for the JVM.

The archive tool reads its patterns in a Unicode dialect without look-around and
back-references but with set operations in classes; the preview reads them as a
browser does, ASCII classes and all, ignoring case.  The same text can mean
something else to Java (``a*+``, ``[[:alpha:]]``, ``[a-z--b]``, ``$``, ``\\w``).
``translate`` reads a pattern by its dialect's own syntax and writes Java that
matches the same strings.  It runs on the driver, over a pattern of a few
characters; the rows are matched by the JVM.

``InvalidPattern``: not a pattern in its dialect.  ``UnsupportedPattern``: it is one, but
Java cannot express it.
"""

from __future__ import annotations

import functools


class PatternError(ValueError):
    """A pattern that cannot be used."""


class InvalidPattern(PatternError):
    pass


class UnsupportedPattern(PatternError):
    pass


# The ASCII classes that may be named in a class, as Java fragments.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": r"\x20-~", "punct": r"!-/:-@\[-`\{-~", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z",
    "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
# General categories by their short names; any other property is asked for as a script or binary property.
CATEGORIES = "L Lu Ll Lt Lm Lo M Mn Mc Me N Nd Nl No P Pc Pd Ps Pe Pi Pf Po S Sm Sc Sk So Z Zs Zl Zp C Cc Cf Co Cn".split()
LONG_CATEGORIES = {"letter": "L", "mark": "M", "number": "N", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C",
                   "uppercase_letter": "Lu", "lowercase_letter": "Ll", "decimal_number": "Nd"}
# The shorthand classes of each dialect, as Java fragments for the inside of a class.
SHORT = {
    "tool": {"d": r"\p{Nd}", "s": r"\p{IsWhite_Space}", "w": r"\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}\p{IsJoin_Control}"},
    "preview": {"d": "0-9", "s": r"\t\n\x0B\f\r\x20\x{A0}\x{FEFF}\p{Zs}\x{2028}\x{2029}", "w": "0-9A-Za-z_"},
}
CONTROLS = {"t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
_HEX = set("0123456789abcdefABCDEF")
ANY = r"[\x{0}-\x{10FFFF}]"


def _upper(x: str) -> str:
    """The single upper-case character of ``x`` as the browser folds it: ASCII and others stay apart."""
    u = x.upper()
    return u if len(u) == 1 and not (ord(x) > 127 and ord(u) < 128) else x


@functools.cache
def _by_upper() -> dict[str, str]:
    """All characters of the first plane by that upper-case character, where there are several."""
    out: dict[str, str] = {}
    for c in range(1 << 16):
        u = _upper(chr(c))
        out[u] = out.get(u, "") + chr(c)
    return {u: chars for u, chars in out.items() if len(chars) > 1}


def _char(c: int) -> str:
    """A code point that stands for itself, in a class or outside."""
    x = chr(c)
    return x if x.isascii() and x.isalnum() else f"\\x{{{c:X}}}"


def translate(pattern: str, dialect: str = "tool", ignore_case: bool = False) -> str:
    """A Java pattern, to be searched for, that matches as ``pattern`` does in its dialect.

    It has no flags or capturing groups of its own (but those that back-references
    need), so several may be joined by ``|`` if ``has_references`` is false of all."""
    out = _Parser(pattern, dialect, ignore_case).whole()
    return out


def has_references(java: str) -> bool:
    """A translated pattern refers to its groups by number."""
    return any(java[i] == "\\" and java[i + 1].isdigit() for i in range(len(java) - 1) if (len(java[:i]) - len(java[:i].rstrip("\\"))) % 2 == 0)


class _Parser:
    def __init__(self, text: str, dialect: str, ignore_case: bool):
        if dialect not in SHORT:
            raise ValueError(f"unknown dialect {dialect!r}")
        self.text, self.at, self.tool = text, 0, dialect == "tool"
        self.short = SHORT[dialect]
        self.flags = {"i"} if ignore_case else set()
        self.names: set[str] = set()
        self.groups = 0  # capturing groups so far
        self.total = 0 if self.tool else self._count_groups()
        self.settled: dict[int, list] = {}  # groups that took part for sure: where they stand
        self.inside: list = []  # open groups and the branch of each
        self.keep = not self.tool and self._refers()

    # -- reading ------------------------------------------------------------------------------------
    def invalid(self, why: str):
        return InvalidPattern(f"invalid pattern {self.text!r}: {why} at {self.at}")

    def unsupported(self, why: str):
        return UnsupportedPattern(f"unsupported pattern {self.text!r}: {why}")

    def peek(self, n: int = 1) -> str:
        return self.text[self.at:self.at + n]

    def take(self, n: int = 1) -> str:
        got = self.peek(n)
        if len(got) < n:
            raise self.invalid("it ends too early")
        self.at += n
        return got

    def eat(self, what: str) -> bool:
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def _plain(self):
        """(index, character) of the characters outside classes that are not escaped."""
        i, inside = 0, False
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 2
                continue
            if inside:
                inside = c != "]"
            elif c == "[":
                inside = True
            else:
                yield i, c
            i += 1

    def _count_groups(self) -> int:
        return sum(c == "(" and (self.text[i + 1:i + 2] != "?" or (self.text[i + 1:i + 3] == "?<" and self.text[i + 3:i + 4] not in ("=", "!"))) for i, c in self._plain())

    def _refers(self) -> bool:
        i = 0
        while (i := self.text.find("\\", i)) >= 0:
            if self.text[i + 1:i + 2] in set("123456789k"):
                return True
            i += 2
        return False

    # -- structure ----------------------------------------------------------------------------------
    def whole(self) -> str:
        out = self.branches()
        if self.at < len(self.text):
            raise self.invalid("unopened group")
        return out

    def branches(self) -> str:
        """Alternatives up to the end or a closing parenthesis; flags set inside end with them."""
        flags, out = set(self.flags), [[]]
        frame = [object(), 0]
        self.inside.append(frame)
        while self.at < len(self.text) and self.peek() != ")":
            if self.eat("|"):
                out.append([])
                frame[1] += 1
            else:
                self.repeated(out[-1])
        self.inside.pop()
        self.flags = flags
        text = "|".join("".join(b) for b in out)
        return f"(?:{text})" if len(out) > 1 else text

    def repeated(self, out: list[str]) -> None:
        if self.tool and "x" in self.flags:
            while self.peek() and (self.peek().isspace() or self.peek() == "#"):
                if self.take() == "#":
                    while self.peek() and self.take() != "\n":
                        pass
            if not self.peek() or self.peek() in ")|":
                return
        before = self.groups
        atom, bare = self.atom()
        times = 0
        while (q := self.quantifier()) is not None:
            if bare and not self.tool:
                raise self.invalid("nothing to repeat")
            if times and not self.tool:
                raise self.invalid("nothing to repeat")
            lazy = self.eat("?")
            if "U" in self.flags:
                lazy = not lazy
            atom = f"(?:{atom}){q}{'?' if lazy else ''}"
            times += 1
            if q in ("*", "?") or q.startswith("{0"):
                for g in range(before + 1, self.groups + 1):
                    self.settled.pop(g, None)
        out.append(atom)

    def quantifier(self) -> str | None:
        c = self.peek()
        if c and c in "*+?":
            return self.take()
        if c != "{":
            return None
        end = self.text.find("}", self.at)
        low, comma, high = self.text[self.at + 1:end].partition(",") if end > 0 else ("", "", "")
        digits = low.isascii() and low.isdigit() and (high == "" or (high.isascii() and high.isdigit()))
        if not digits:
            if self.tool:
                raise self.invalid("a brace that is no count")
            return None  # the browser takes it as it stands
        if high and int(high) < int(low):
            raise self.invalid("a count from high to low")
        if max(int(low), int(high or 0)) > 2**31 - 1:
            raise self.unsupported("a count this large")
        self.at = end + 1
        return f"{{{int(low)}{comma}{int(high) if high else ''}}}"

    def atom(self) -> tuple[str, bool]:
        """(Java, whether the browser would refuse to repeat it)."""
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.klass(), False
        if c == "\\":
            return self.escape()
        if c == ".":
            if "s" in self.flags:
                return ANY, False
            return (r"[^\n]" if self.tool else r"[^\n\r\x{2028}\x{2029}]"), False
        if c == "^":
            return (r"(?:\A|(?<=\n))" if "m" in self.flags else r"\A"), True
        if c == "$":
            return (r"(?=\n|\z)" if "m" in self.flags else r"\z"), True
        if c in "*+?" or (c == "{" and self.tool):
            raise self.invalid("nothing to repeat")
        if c == "{":
            self.at -= 1
            if self.quantifier() is not None:
                raise self.invalid("nothing to repeat")
            self.at += 1
        return self.literal(ord(c)), False

    def literal(self, c: int) -> str:
        if "i" not in self.flags or not (x := chr(c)).isalpha():
            return _char(c)
        if self.tool:
            return f"(?iu:{_char(c)})"
        return f"[{self.cased(c)}]"

    def cased(self, c: int) -> str:
        """The characters that the browser takes for ``c`` when it ignores case: those of
        the same single upper-case character, ASCII and others apart."""
        return "".join(_char(ord(y)) for y in _by_upper().get(_upper(chr(c)), chr(c)))

    def group(self) -> tuple[str, bool]:
        refuse, head = False, "(?:"
        flags = set(self.flags)
        number = None
        if self.eat("?"):
            if self.eat(":"):
                pass
            elif not self.tool and (self.peek() in ("=", "!") or self.peek(2) in ("<=", "<!")):
                behind = self.eat("<")
                head, refuse = f"(?{'<' if behind else ''}{self.take()}", behind
            elif self.peek(2) == "P<" and self.tool or self.peek() == "<":
                self.eat("P")
                self.eat("<")
                end = self.text.find(">", self.at)
                name = self.text[self.at:end] if end > 0 else ""
                ok = name[:1].isalpha() or name[:1] == "_" or (not self.tool and name[:1] == "$")
                if not ok or not all(x.isalnum() or x in ("_.[]" if self.tool else "_$") for x in name):
                    raise self.invalid("a group name")
                if name in self.names:
                    raise self.invalid("a group name that is there already")
                self.names.add(name)
                self.at = end + 1
                number = self.groups = self.groups + 1
            elif self.tool and self.peek() not in ("=", "!", "<", ">", ""):
                on, sign = set(self.flags), True
                seen = 0
                while self.peek() not in (":", ")"):
                    f = self.take()
                    if f == "-" and sign:
                        sign, seen = False, 0
                        continue
                    if f not in "imsUux":
                        raise self.invalid(f"flag {f!r}") if f != "R" else self.unsupported("flag 'R'")
                    if f == "u" and not sign:
                        raise self.unsupported("matching bytes")
                    seen += 1
                    (on.add if sign else on.discard)(f)
                if not seen:
                    raise self.invalid("flags")
                if self.take() == ")":  # holds for the rest of the group around
                    self.flags = on
                    return "", True
                self.flags = on
            else:
                raise self.invalid("a group of this kind")
        else:
            number = self.groups = self.groups + 1
        body = self.branches()
        self.flags = flags
        if not self.eat(")"):
            raise self.invalid("unclosed group")
        if number is not None:
            self.settled[number] = [(f[0], f[1]) for f in self.inside]
            if self.keep:
                head = "("
        return f"{head}{body})", refuse

    # -- escapes ------------------------------------------------------------------------------------
    def hexes(self, *sizes: int) -> int | None:
        """A hexadecimal code after \\x or \\u: of one of the sizes, or (the tool) in braces."""
        if self.tool and self.eat("{"):
            end = self.text.find("}", self.at)
            digits = self.text[self.at:end] if end > 0 else ""
            if not digits or not set(digits) <= _HEX or int(digits, 16) > 0x10FFFF:
                raise self.invalid("a code point")
            self.at = end + 1
            return int(digits, 16)
        for n in sizes:
            if len(digits := self.peek(n)) == n and set(digits) <= _HEX:
                self.at += n
                return int(digits, 16)
        if self.tool:
            raise self.invalid("a code point")
        return None

    def escaped(self, c: str, in_class: bool) -> int:
        """The code point that a backslash and ``c`` stand for."""
        if c in CONTROLS:
            return CONTROLS[c]
        if c == "x":
            got = self.hexes(2)
            return ord("x") if got is None else got
        if c == "u":
            got = self.hexes(4)
            return ord("u") if got is None else got
        if self.tool:
            if c == "U":
                return self.hexes(8)
            if c == "a":
                return 7
            if c.isascii() and not c.isalnum() and c not in "<>" or c in "<>" and in_class:
                return ord(c)
            raise self.invalid(f"escape \\{c}")
        if c == "c":
            if (x := self.peek()).isascii() and (x.isalpha() or in_class and (x.isdigit() or x == "_")) and x:
                return ord(self.take()) % 32
            self.at -= 1  # the backslash stands for itself
            return ord("\\")
        if c in "01234567":
            digits = c
            while self.peek() and self.peek() in "01234567" and int(digits + self.peek(), 8) < 256:
                digits += self.take()
            return int(digits, 8)
        if c == "b" and in_class:
            return 8
        if c == "k" and not in_class and self.names:
            raise self.invalid("a named reference")
        return ord(c)

    def escape(self) -> tuple[str, bool]:
        c = self.take()
        word = f"[{self.short['w']}]"
        if c.lower() in self.short and c in "dswDSW":
            return f"[{'^' if c.isupper() else ''}{self.short[c.lower()]}]", False
        if c in "bB":
            if self.tool and self.peek() == "{":
                raise self.unsupported("\\b{...}")
            edge = rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
            return (edge if c == "b" else rf"(?:(?<={word})(?={word})|(?<!{word})(?!{word}))"), True
        if self.tool:
            if c == "A":
                return r"\A", True
            if c == "z":
                return r"\z", True
            if c in "pP":
                return f"[{self.prop(c)}]", False
            if c in "<>":
                return (rf"(?:(?<!{word})(?={word}))" if c == "<" else rf"(?:(?<={word})(?!{word}))"), True
            return self.literal(self.escaped(c, False)), False
        if c in "123456789":
            digits, at = c, self.at
            while self.peek().isascii() and self.peek().isdigit():
                digits += self.take()
            if int(digits) <= self.total:
                return self.reference(int(digits)), False
            self.at = at
            return (self.literal(ord(c)) if c in "89" else self.literal(self.escaped(c, False))), False
        if c == "k" and "(?<" in self.text.replace("(?<=", "").replace("(?<!", ""):
            raise self.unsupported("a named reference")
        return self.literal(self.escaped(c, False)), False

    def reference(self, n: int) -> str:
        """Java fails where a group took no part, the browser goes on: only groups that must have matched will do."""
        at = self.settled.get(n)
        here = [(f[0], f[1]) for f in self.inside]
        if at is None or at != here[:len(at)]:
            raise self.unsupported(f"a reference to group {n}, which may have taken no part")
        return rf"(?iu:\{n})" if "i" in self.flags else rf"(?:\{n})"

    def prop(self, c: str) -> str:
        name = self.take()
        if name == "{":
            end = self.text.find("}", self.at)
            if end < 0:
                raise self.invalid("unclosed property")
            name, self.at = self.text[self.at:end], end + 1
        no = c == "P"
        if name.startswith("^"):
            no, name = not no, name[1:]
        key, _, value = name.replace(":", "=").partition("=")
        plain = (value or key).strip()
        if value and key.strip().lower().replace("_", "") not in ("script", "sc", "generalcategory", "gc"):
            raise self.unsupported(f"property {name!r}")
        short = {x.lower(): x for x in CATEGORIES}.get(plain.lower()) or LONG_CATEGORIES.get(plain.lower().replace(" ", "_"))
        if not all(x.isalnum() or x in "_- " for x in plain) or not plain:
            raise self.invalid(f"property {name!r}")
        body = short or "Is" + plain.replace(" ", "_").replace("-", "_")
        return rf"\{'P' if no else 'p'}{{{body}}}"

    # -- classes ------------------------------------------------------------------------------------
    def klass(self) -> str:
        body = self.tool_set() if self.tool else self.browser_set()
        if "i" in self.flags and self.tool:
            return f"(?iu:{body})"
        return body

    def tool_set(self) -> str:
        """A class after its opening bracket, as a Java class.  Items stand side by side
        (union); ``&&``, ``--`` and ``~~`` work on all before them, from left to right."""
        no, left, op, items, first = self.eat("^"), None, None, [], True

        def joined() -> str:
            return "[" + "".join(items) + "]" if items else r"[^\x{0}-\x{10FFFF}]"

        def put(a: str | None, b: str) -> str:
            if a is None:
                return b
            if op == "&&":
                return f"[{a}&&{b}]"
            minus = lambda x, y: f"[{x}&&[^{y}]]"
            return minus(a, b) if op == "--" else f"[{minus(a, b)}{minus(b, a)}]"

        while True:
            if "x" in self.flags:
                while self.peek().isspace():
                    self.take()
            if not self.peek():
                raise self.invalid("unclosed class")
            if self.peek() == "]" and not first:
                self.take()
                break
            if not first and self.peek(2) in ("&&", "--", "~~"):
                left = put(left, joined())
                op, items = self.take(2), []
                continue
            first, item = False, self.tool_item()
            if isinstance(item, int):
                if self.peek() == "-" and self.peek(2) not in ("--", "-]"):
                    self.take()
                    end = self.tool_item()
                    if not isinstance(end, int) or end < item:
                        raise self.invalid("a class range")
                    items.append(f"{_char(item)}-{_char(end)}")
                else:
                    items.append(_char(item))
            else:
                items.append(item)
        body = put(left, joined())
        return f"[^{body}]" if no else body

    def tool_item(self) -> int | str:
        c = self.take()
        if c == "[":
            if self.peek() == ":":
                end = self.text.find(":]", self.at)
                name = self.text[self.at + 1:end] if end > 0 else ""
                if name.lstrip("^") in POSIX and not name.startswith("^^"):
                    self.at = end + 2
                    return f"[{'^' if name.startswith('^') else ''}{POSIX[name.lstrip('^')]}]"
            return self.tool_set()
        if c == "\\":
            c = self.take()
            if c in "dswDSW":
                return f"[{'^' if c.isupper() else ''}{self.short[c.lower()]}]"
            if c in "pP":
                return self.prop(c)
            return self.escaped(c, True)
        return ord(c)

    def browser_set(self) -> str:
        no, items = self.eat("^"), []
        while not self.eat("]"):
            item = self.browser_item()
            if self.peek() == "-" and self.peek(2) != "-]" and len(self.peek(2)) == 2:
                self.take()
                end = self.browser_item()
                if isinstance(item, int) and isinstance(end, int):
                    if end < item:
                        raise self.invalid("a class range")
                    items.append(f"{_char(item)}-{_char(end)}" + self.cased_range(item, end))
                    continue
                items += [self.member(item), _char(ord("-")), self.member(end)]
            else:
                items.append(self.member(item))
        if not items:
            return ANY if no else r"[^\x{0}-\x{10FFFF}]"
        return f"[{'^' if no else ''}{''.join(items)}]"

    def member(self, item: int | str) -> str:
        if isinstance(item, str):
            return item
        return self.cased(item) if "i" in self.flags and chr(item).isalpha() else _char(item)

    def cased_range(self, low: int, high: int) -> str:
        """What a range matches besides itself when case is ignored."""
        if "i" not in self.flags:
            return ""
        if high - low > 2000:
            raise self.unsupported("a class range this long, ignoring case")
        return "".join(self.cased(c) for c in range(low, high + 1) if chr(c).isalpha())

    def browser_item(self) -> int | str:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c in "dswDSW":
            body = self.short[c.lower()]
            return f"[^{body}]" if c.isupper() else body
        return self.escaped(c, True)
