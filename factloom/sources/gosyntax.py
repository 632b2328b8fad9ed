"""Declarations, calls, concurrency markers and decisions of one Go source file.

A lexer with automatic semicolons feeds a recursive-descent reader that keeps no tree: it notes
facts as it passes them. An expression is only (start, end, dotted name). Positions are byte
offsets; ``Source.span`` turns two of them into "line:column-line:column".
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field
from typing import NamedTuple

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BUILTINS = frozenset("append cap close complex copy delete imag len make new panic print println real recover".split())
_TOKEN = re.compile(
    r"(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<name>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)"
    r"|(?P<number>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?[0-9_]+)?|0[bBoO][0-9_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)i?)"
    r"|(?P<string>`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+')"
    r"|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])",
    re.S,
)
_ENDS = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))
BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Expr(NamedTuple):
    start: int
    end: int
    name: str = ""
    typelike: bool = False


@dataclass
class Source:
    """What one file holds; spans are (start, end) byte offsets."""

    package: str = ""
    start: int = 0
    end: int = 0
    imports: list[tuple[str, int, int]] = field(default_factory=list)
    types: list[tuple[str, str, int, int, list[tuple[str, int, int]]]] = field(default_factory=list)
    functions: list[tuple[str, str, int, int, list[str]]] = field(default_factory=list)
    markers: list[tuple[str, int, int]] = field(default_factory=list)
    calls: list[tuple[str, int, int]] = field(default_factory=list)
    lines: list[int] = field(default_factory=list)

    def place(self, at: int) -> tuple[int, int]:
        row = bisect.bisect_right(self.lines, at) - 1
        return row + 1, at - self.lines[row] + 1

    def span(self, start: int, end: int) -> str:
        (a, b), (c, d) = self.place(start), self.place(end)
        return f"{a}:{b}-{c}:{d}"


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, size = 0, len(text)

    def close(where: int) -> None:
        if out and (out[-1].kind in ("name", "number", "string") and out[-1].text not in KEYWORDS or out[-1].text in _ENDS):
            out.append(Token("op", ";", where, where))

    while at < size:
        m = _TOKEN.match(text, at)
        if m is None:
            raise SyntaxError(f"illegal character {text[at]!r} at byte {at}")
        kind = m.lastgroup
        if kind == "newline" or kind == "block" and "\n" in m[0]:
            close(at)
        elif kind in ("name", "number", "string", "op"):
            out.append(Token("keyword" if m[0] in KEYWORDS else kind, m[0], at, m.end()))
        at = m.end()
    close(size)
    out.append(Token("end", "", size, size))
    return out


def parse(content: bytes) -> Source:
    """Read a file; SyntaxError if it is not Go."""
    text = content.decode("latin-1")
    source = Source(lines=[0, *(m.end() for m in re.finditer("\n", text))])
    _Reader(tokens(text), source).file()
    proper = lambda s: s.encode("latin-1").decode("utf-8", "replace")
    source.imports = [(proper(p), a, b) for p, a, b in source.imports]
    source.types = [(proper(n), k, a, b, [(proper(f), c, d) for f, c, d in fs]) for n, k, a, b, fs in source.types]
    source.functions = [(proper(n), proper(r), a, b, d) for n, r, a, b, d in source.functions]
    source.calls = [(proper(n), a, b) for n, a, b in source.calls]
    return source


class _Reader:
    def __init__(self, toks: list[Token], source: Source) -> None:
        self.toks, self.s, self.i = toks, source, 0
        self.control = False  # in a header, where "{" opens a block and no literal
        self.decisions: list[str] | None = None

    # -- basics --

    @property
    def t(self) -> Token:
        return self.toks[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def next(self) -> Token:
        t = self.toks[self.i]
        self.i = min(self.i + 1, len(self.toks) - 1)
        return t

    def take(self, text: str) -> bool:
        if self.t.text == text and self.t.kind != "string":
            self.next()
            return True
        return False

    def want(self, text: str) -> Token:
        if self.t.text != text or self.t.kind == "string":
            raise SyntaxError(f"{self.s.place(self.t.start)}: expected {text!r}, found {self.t.text!r}")
        return self.next()

    def name(self) -> Token:
        if self.t.kind != "name":
            raise SyntaxError(f"{self.s.place(self.t.start)}: expected a name, found {self.t.text!r}")
        return self.next()

    def semi(self) -> None:
        if self.t.text not in (")", "}") and self.t.kind != "end":
            self.want(";")

    def decide(self, kind: str) -> None:
        if self.decisions is not None:
            self.decisions.append(kind)

    def mark(self, name: str, kind: str, start: int, end: int) -> None:
        self.s.markers.append((name, start, end))
        if kind:
            self.decide(kind)

    def matching(self) -> int:
        """Index of the token that closes the bracket at hand."""
        depth = 0
        for j in range(self.i, len(self.toks)):
            x = self.toks[j]
            if x.kind == "op":
                depth += (x.text in "([{") - (x.text in ")]}")
                if not depth:
                    return j
        raise SyntaxError(f"{self.s.place(self.t.start)}: bracket is not closed")

    def skip(self) -> int:
        """Pass over a bracketed part; its end."""
        self.i = self.matching()
        return self.next().end

    # -- declarations --

    def file(self) -> None:
        self.s.start = self.want("package").start
        n = self.name()
        self.s.package, self.s.end = n.text, n.end
        self.semi()
        while self.t.kind != "end":
            self.s.end = self.declaration()
            self.semi()

    def declaration(self) -> int:
        kind = self.next().text
        if kind == "func":
            return self.function(self.toks[self.i - 1].start)
        if kind not in ("import", "const", "var", "type"):
            raise SyntaxError(f"{self.s.place(self.toks[self.i - 1].start)}: expected a declaration, found {kind!r}")
        spec = {"import": self.import_spec, "type": self.type_spec}.get(kind, self.value_spec)
        if not self.take("("):
            return spec()
        while self.t.text != ")":
            spec()
            self.semi()
        return self.want(")").end

    def import_spec(self) -> int:
        start = self.t.start
        if self.t.kind == "name" or self.t.text == ".":
            self.next()
        t = self.next()
        if t.kind != "string":
            raise SyntaxError(f"{self.s.place(t.start)}: expected an import path")
        self.s.imports.append((t.text[1:-1], start, t.end))
        return t.end

    def value_spec(self) -> int:
        end = self.name().end
        while self.take(","):
            end = self.name().end
        if self.t.text not in ("=", ";", ")"):
            end = self.type().end
        if self.take("="):
            end = self.expressions()[-1].end
        return end

    def type_spec(self) -> int:
        n = self.name()
        if self.t.text == "[" and self.ahead().kind == "name" and (self.ahead(2).kind == "name" or self.ahead(2).text in (",", "interface", "~", "[", "map", "chan", "func")):
            self.skip()
        self.take("=")
        kind = {"struct": "struct", "interface": "interface"}.get(self.t.text, "type")
        at = len(self.s.types)
        fields: list[tuple[str, int, int]] = []
        self.s.types.append((n.text, kind, n.start, n.end, fields))
        end = (self.struct(fields) if kind == "struct" else self.type()).end
        self.s.types[at] = (n.text, kind, n.start, end, fields)
        return end

    def function(self, start: int) -> int:
        receiver = ""
        if self.t.text == "(":
            stop = self.matching()
            receiver = self.receiver(self.toks[self.i + 1 : stop])
            self.i = stop + 1
        n = self.name()
        if self.t.text == "[":
            self.skip()
        outer, self.decisions = self.decisions, []
        own = self.decisions
        at = len(self.s.functions)
        self.s.functions.append((n.text, receiver, start, start, own))
        end = self.signature()
        if self.t.text == "{":
            end = self.block()
        self.s.functions[at] = (n.text, receiver, start, end, own)
        self.decisions = outer
        return end

    @staticmethod
    def receiver(toks: list[Token]) -> str:
        toks = [t for t in toks if t.text != ";"]
        if len(toks) > 1 and toks[0].kind == "name" and (toks[1].kind == "name" or toks[1].text in ("*", "(")):
            toks = toks[1:]
        if toks and toks[-1].text == ",":
            toks = toks[:-1]
        stars = 0
        while toks and toks[0].text == "*":
            stars, toks = stars + 1, toks[1:]
        return "*" * stars + (toks[0].text if len(toks) == 1 and toks[0].kind == "name" else "receiver")

    def signature(self) -> int:
        end = self.skip()
        if self.t.text == "(":
            return self.skip()
        if self.t.kind == "name" or self.t.text in ("*", "[", "map", "chan", "func", "interface", "struct", "<-"):
            return self.type().end
        return end

    # -- types --

    def type(self) -> Expr:
        t = self.t
        if t.text == "*" or t.text == "~":
            self.next()
            return Expr(t.start, self.type().end)
        if t.text == "(":
            return Expr(t.start, self.skip())
        if t.text == "[":
            self.next()
            if not self.take("..."):
                if self.t.text != "]":
                    self.nested(self.expression)
            self.want("]")
            return Expr(t.start, self.type().end, "", True)
        if t.text == "map":
            self.next()
            self.want("[")
            self.type()
            self.want("]")
            return Expr(t.start, self.type().end, "", True)
        if t.text in ("chan", "<-"):
            self.next()
            if t.text == "<-":
                self.want("chan")
            else:
                self.take("<-")
            return Expr(t.start, self.type().end)
        if t.text == "func":
            self.next()
            return Expr(t.start, self.signature())
        if t.text == "struct":
            return self.struct([])
        if t.text == "interface":
            self.next()
            return Expr(t.start, self.skip(), "", True)
        end = self.name().end
        while self.t.text == "." and self.ahead().kind == "name":
            self.next()
            end = self.name().end
        if self.t.text == "[" and self.ahead().text != "]":
            end = self.skip()
        while self.t.text == "|":
            self.next()
            end = self.type().end
        return Expr(t.start, end, "", True)

    def struct(self, fields: list[tuple[str, int, int]]) -> Expr:
        start = self.want("struct").start
        self.want("{")
        while self.t.text != "}":
            if self.named_field():
                while True:
                    n = self.name()
                    fields.append((n.text, n.start, n.end))
                    if not self.take(","):
                        break
            self.type()
            if self.t.kind == "string":
                self.next()
            self.semi()
        return Expr(start, self.want("}").end, "", True)

    def named_field(self) -> bool:
        if self.t.kind != "name":
            return False
        x = self.ahead()
        if x.text == "[":
            if self.ahead(2).text == "]":
                return True
            keep, self.i = self.i, self.i + 1
            stop = self.matching()
            self.i = keep
            after = self.toks[stop + 1]
            return after.kind == "name" or after.text in ("*", "[", "map", "chan", "func", "struct", "interface", "(", "<-")
        return x.kind == "name" or x.text in ("*", "(", "map", "chan", "func", "struct", "interface", "<-", ",")

    # -- expressions --

    def nested(self, read):  # noqa: ANN001, ANN202
        keep, self.control = self.control, False
        out = read()
        self.control = keep
        return out

    def expressions(self) -> list[Expr]:
        out = [self.expression()]
        while self.take(","):
            out.append(self.expression())
        return out

    def expression(self) -> Expr:
        left = self.unary()
        if self.t.kind == "op" and self.t.text in BINARY:
            end = left.end
            while self.t.kind == "op" and self.t.text in BINARY:
                if self.next().text in ("&&", "||"):
                    self.decide("boolean")
                end = self.unary().end
            return Expr(left.start, end)
        return left

    def unary(self) -> Expr:
        t = self.t
        if t.kind == "op" and t.text == "<-" and self.ahead().text != "chan":
            self.next()
            end = self.unary().end
            self.mark("channel_receive", "receive", t.start, end)
            return Expr(t.start, end)
        if t.kind == "op" and t.text in ("+", "-", "!", "^", "*", "&", "~"):
            self.next()
            return Expr(t.start, self.unary().end)
        return self.primary()

    def operand(self) -> Expr:
        t = self.t
        if t.kind in ("number", "string"):
            self.next()
            return Expr(t.start, t.end)
        if t.kind == "name":
            self.next()
            return Expr(t.start, t.end, t.text, True)
        if t.text == "(":
            self.next()
            self.nested(lambda: self.type() if self.t.text in ("chan", "<-") and self.ahead().text == "chan" else self.expression())
            return Expr(t.start, self.want(")").end)
        if t.text == "func":
            self.next()
            end = self.signature()
            if self.t.text == "{":
                end = self.nested(self.block)
            return Expr(t.start, end)
        if t.text in ("[", "map", "chan", "struct", "interface", "<-"):
            x = self.type()
            return Expr(x.start, x.end, "", t.text in ("[", "map", "struct"))
        raise SyntaxError(f"{self.s.place(t.start)}: expected an operand, found {t.text!r}")

    def primary(self) -> Expr:
        first = self.t.text
        x = self.operand()
        literal = first in ("[", "map", "struct")
        while True:
            t = self.t
            if t.kind != "op":
                return x
            if t.text == ".":
                self.next()
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    x = Expr(x.start, self.want(")").end)
                else:
                    n = self.name()
                    x = Expr(x.start, n.end, f"{x.name}.{n.text}" if x.name else n.text, x.typelike)
            elif t.text == "[":
                self.next()
                self.nested(self.inside)
                x = Expr(x.start, self.want("]").end, "", x.typelike)
            elif t.text == "(":
                self.next()
                self.nested(self.arguments)
                end = self.want(")").end
                if x.name and x.name not in BUILTINS:
                    self.s.calls.append((x.name, x.start, end))
                x = Expr(x.start, end)
            elif t.text == "{" and x.typelike and (literal or not self.control):
                x = Expr(x.start, self.nested(self.literal))
                literal = False
            else:
                return x

    def inside(self) -> None:
        """Index, slice bounds or type arguments."""
        while self.t.text != "]":
            if self.t.text in (":", ","):
                self.next()
            else:
                self.expression()

    def arguments(self) -> None:
        while self.t.text != ")":
            self.expression()
            self.take("...")
            if not self.take(","):
                break

    def literal(self) -> int:
        self.want("{")
        while self.t.text != "}":
            for _ in range(2):
                if self.t.text == "{":
                    self.literal()
                else:
                    self.expression()
                if not self.take(":"):
                    break
            if not self.take(","):
                break
        self.take(";")
        return self.want("}").end

    # -- statements --

    def block(self) -> int:
        self.want("{")
        self.nested(self.statements)
        return self.want("}").end

    def statements(self) -> None:
        while self.t.text not in ("}", "case", "default") and self.t.kind != "end" or self.t.kind == "string":
            self.statement()
            if self.t.text not in ("}", "case", "default"):
                self.semi()

    def statement(self) -> int:
        t = self.t
        if t.kind == "keyword" and t.text in ("var", "const", "type"):
            return self.declaration()
        reader = {"if": self.if_, "for": self.for_, "switch": self.switch, "select": self.select}.get(t.text) if t.kind == "keyword" else None
        if reader:
            self.next()
            return reader(t.start)
        if t.text in ("go", "defer") and t.kind == "keyword":
            self.next()
            end = self.expression().end
            self.mark(f"{t.text}_statement", t.text, t.start, end)
            return end
        if t.text == "return" and t.kind == "keyword":
            self.next()
            return self.expressions()[-1].end if self.t.text not in (";", "}") else t.end
        if t.text in ("break", "continue", "goto", "fallthrough") and t.kind == "keyword":
            self.next()
            if t.text == "goto":
                self.decide("goto")
            return self.next().end if self.t.kind == "name" else t.end
        if t.text == "{":
            return self.block()
        if t.text == ";":
            return t.end
        if t.kind == "name" and self.ahead().text == ":" and self.ahead().kind == "op":
            self.next()
            end = self.next().end
            return self.statement() if self.t.text != "}" else end
        return self.simple()

    def simple(self) -> int:
        left = self.expressions()
        if self.take("<-"):
            value = self.expression()
            self.mark("channel_send", "send", left[0].start, value.end)
            return value.end
        if self.t.text in ("++", "--"):
            return self.next().end
        if self.t.kind == "op" and self.t.text in ASSIGN:
            self.next()
            if self.take("range"):
                return self.expression().end
            return self.expressions()[-1].end
        return left[-1].end

    def header(self) -> bool:
        """Clauses before a block; whether there is a range among them."""
        keep, self.control = self.control, True
        ranged = False
        while self.t.text != "{":
            if self.t.text == ";":
                self.next()
            elif self.take("range"):
                ranged = True
                self.expression()
            else:
                begin = self.i
                self.simple()
                ranged = ranged or any(x.text == "range" and x.kind == "keyword" for x in self.toks[begin : self.i])
        self.control = keep
        return ranged

    def if_(self, start: int) -> int:
        self.decide("if")
        self.header()
        end = self.block()
        if self.take("else"):
            t = self.t
            if self.take("if"):
                return self.if_(t.start)
            end = self.block()
        return end

    def for_(self, start: int) -> int:
        self.decide("range" if self.header() else "for")
        return self.block()

    def switch(self, start: int) -> int:
        self.header()
        return self.clauses("case", "switch_default")

    def select(self, start: int) -> int:
        end = self.clauses("select_case", "select_default")
        self.s.markers.append(("select_statement", start, end))
        return end

    def clauses(self, case: str, default: str) -> int:
        self.want("{")
        while self.t.text != "}":
            if self.take("default"):
                self.decide(default)
            else:
                self.want("case")
                self.decide(case)
                self.nested(self.simple if case == "select_case" else self.expressions)
            self.want(":")
            self.nested(self.statements)
        return self.want("}").end
