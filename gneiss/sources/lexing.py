"""Tokens of Java and Kotlin source, and walking over them."""

from __future__ import annotations

import re
from itertools import accumulate, compress
from operator import ne, sub
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id, num, str, op, end
    text: str
    start: int
    end: int
    line: int
    fresh: bool  # first on its line


OPENERS = {"(": ")", "[": "]", "{": "}"}
NUMBER = re.compile(r"0[xXbB][\da-fA-F_]+[uUlL]*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[fFdDuUlL]*")
IDENTIFIER = re.compile(r"[^\W\d]\w*|\$[\w$]*")
# Longest first. ">" stays single, so that type arguments close one by one.
OPERATORS = ["===", "!==", "...", "..<", "->", "?.", "?:", "::", "!!", "++", "--", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", ".."]


def patterns(marks: str, string: str, comment: str) -> tuple[re.Pattern, re.Pattern]:
    """What comes next after white space, for scan(), where `mark` opens what it reads itself; and all pieces of a text,
    white space and comments too, for plain()."""
    operators = "|".join(map(re.escape, OPERATORS))
    # Operators stand before what is rarer, so they leave out what opens that.
    operator = rf"[(){{}}\[\],;@]|{operators}|/(?![/*])|(?![0-9])\d|[^\w\s{marks}/]"
    number = rf"(?=[0-9])(?:{NUMBER.pattern})|'[^'\\]*(?:\\.[^'\\]*)*'"
    one = rf"[^\S\n]*(?:(?P<id>{IDENTIFIER.pattern})|(?P<op>{operator})|(?P<line>\n\s*)|(?P<rest>//[^\n]*)|(?P<str>{string})|(?P<num>{number})|(?P<mark>/\*|[{marks}])|\Z)"
    return re.compile(one, re.DOTALL), re.compile(rf"\s+|{IDENTIFIER.pattern}|{operator}|{string}|{number}|//[^\n]*|{comment}|/\*|[{marks}]", re.DOTALL)


# Literals are those on one line without templates; unrolled, so that one that is not closed is given up in one go.
JAVA = patterns("\"'", r'"(?!"")[^"\\\n]*(?:\\.[^"\\\n]*)*"', r"/\*.*?(?:\*/|\Z)")
KOTLIN = patterns("\"'`", r'"(?!"")[^"\\\n$]*(?:(?:\\.|\$(?!\{))[^"\\\n$]*)*"', r"/\*(?:(?!/\*).)*?\*/")


class Pieces(dict):
    """The kind of each short piece met, none for what is no token; its line breaks; and whether a line begins after it."""

    def __missing__(self, text: str) -> tuple[str, int, int]:
        c = text[0]
        if c.isspace():
            found = "", text.count("\n"), int("\n" in text)
        elif text.startswith("//"):
            found = "", 0, 0
        elif text.startswith("/*") and text != "/*":
            found = "", text.count("\n"), 0
        elif text in MARKS:
            found = "mark", 0, 0
        else:
            found = "str" if c == '"' else "num" if c == "'" or c in "0123456789" else "id" if IDENTIFIER.match(text) else "op", 0, 0
        if len(text) <= 64:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[text] = found
        return found


#: What scan() reads itself, and how many pieces are remembered.
MARKS, MOST_PIECES = ("/*", '"', "'", "`"), 1 << 16
# A backtick is an operator in Java.
KNOWN = {False: Pieces({"`": ("op", 0, 0)}), True: Pieces()}


class SourceError(ValueError):
    """Source text that cannot be taken apart."""


def tokens(text: str, kotlin: bool) -> tuple[tuple, ...]:
    """The columns of Token's fields."""
    found = plain(text, kotlin) if text else None
    if found is None:
        out: list[tuple] = []
        scan(text, 0, 1, kotlin, out, None)
        found = zip(*out, strict=True) if out else [()] * 6
    end = "end", "", len(text), len(text), text.count("\n") + 1, True
    return tuple((*column, last) for column, last in zip(found, end, strict=True))


def plain(text: str, kotlin: bool) -> tuple | None:
    """The columns of a text without what scan() reads itself: as scan() makes them, with no step for each token."""
    pieces = (KOTLIN if kotlin else JAVA)[1].findall(text)
    kinds, breaks, news = zip(*map(KNOWN[kotlin].__getitem__, pieces), strict=True)
    if "mark" in kinds:
        return None
    texts = list(compress(pieces, kinds))
    ends = list(compress(accumulate(map(len, pieces)), kinds))
    begun = list(compress(accumulate(news), kinds))
    return compress(kinds, kinds), texts, map(sub, ends, map(len, texts)), ends, compress(accumulate(breaks, initial=1), kinds), (*[True][: len(texts)], *map(ne, begun, begun[1:]))


def scan(text: str, at: int, line: int, kotlin: bool, out: list[tuple], until: str | None) -> tuple[int, int]:
    """Tokens from `at` to the end, or to the brace that closes a template; the place and line after them."""
    depth, fresh = 0, True
    pieces, add = (KOTLIN if kotlin else JAVA)[0].finditer, out.append
    while at < len(text):
        for m in pieces(text, at):
            kind = m.lastgroup
            if kind == "line":
                line, fresh = line + m.group().count("\n"), True
                continue
            if kind == "mark" or kind is None:
                break
            if kind == "rest":
                continue
            begin, at = m.span(kind)
            found = text[begin:at]
            if until and kind == "op":
                if found == "{":
                    depth += 1
                elif found == "}":
                    if not depth:
                        return at, line
                    depth -= 1
            add((kind, found, begin, at, line, fresh))
            fresh = False
        if kind is None:
            at = len(text)
            break
        at, end = m.span(kind)
        c = text[at]
        if c == "/":
            level = 1
            while level and end < len(text):
                if text.startswith("*/", end):
                    level, end = level - 1, end + 2
                elif kotlin and text.startswith("/*", end):
                    level, end = level + 1, end + 2
                else:
                    end += 1
            line += text.count("\n", at, end)
            at = end
            continue
        if c == '"':
            at, line = string(text, at, line, kotlin, out, fresh)
            fresh = False
            continue
        if c == "`":
            end = text.find("`", at + 1)
            if end < 0 or "\n" in text[at:end]:
                at += 1
                continue
            add(("id", text[at + 1 : end], at, end + 1, line, fresh))
            at, fresh = end + 1, False
            continue
        # A quote that nothing closes.
        add(("num", text[at:], at, len(text) + 1, line, fresh))
        at = len(text)
    if until and not kotlin:
        raise SourceError(f"line {line}: unclosed template")
    return at, line


def string(text: str, at: int, line: int, kotlin: bool, out: list[tuple], fresh: bool) -> tuple[int, int]:
    """One token for the literal; what Kotlin templates hold follows between two others that close nothing."""
    quote = '"""' if text.startswith('"""', at) else '"'
    begin, first, inner = at, line, []
    at += len(quote)
    while True:
        if at >= len(text) or (quote == '"' and text[at] == "\n"):
            if kotlin:
                at = min(at, len(text))
                break
            raise SourceError(f"line {first}: unclosed string")
        if text.startswith(quote, at):
            at += len(quote)
            while quote == '"""' and text.startswith('"', at):
                at += 1
            break
        if text[at] == "\\" and not (kotlin and quote == '"""'):
            at += 2
        elif kotlin and text.startswith("${", at):
            held: list[tuple] = []
            at, line = scan(text, at + 2, line, kotlin, held, "}")
            inner.append(held)
        else:
            line += text[at] == "\n"
            at += 1
    out.append(Token("str", text[begin:at], begin, at, first, fresh))
    for held in inner:
        # A separator keeps the parts from being read as a continuation of the literal.
        out.append(Token("op", ";", begin, begin, first, False))
        out.extend(held)
        out.append(Token("op", ";", at, at, line, False))
        out.append(Token("str", '""', at, at, line, False))
    return at, line


#: Words that open a declaration at the start of a line.
OPENING = frozenset("fun val var class interface object typealias enum data sealed abstract open private public internal protected suspend inline".split())


def closed(tokens: list[tuple], text: str) -> list[tuple]:
    """Tokens whose brackets are in pairs; what is balanced comes back as it is.

    A closer without an opener in its braces is left out, and what is open inside of braces is closed where they are.
    Where braces stay open to the end, a declaration at the start of a line closes all that is open before it.
    """
    for by_column in (False, True):
        out, stack, open_at_end = [], [], False

        def close(n: int, out: list = out, stack: list = stack) -> None:
            while len(stack) > n:
                _, _, _, end, line, _ = out[-1]
                out.append(Token("op", OPENERS[stack.pop()], end, end, line, False))

        for t in map(Token._make, tokens):
            if t.kind == "end":
                open_at_end = "{" in stack
                close(0)
            elif by_column and stack and t.fresh and t.text in OPENING and t.kind == "id" and text[t.start - 1 : t.start] == "\n":
                close(0)
            if t.kind == "op" and t.text in OPENERS:
                stack.append(t.text)
            elif t.kind == "op" and t.text in ")]}":
                # The nearest opener of this kind; round and square brackets reach no further than their braces.
                n = len(stack) - 1
                while n >= 0 and OPENERS[stack[n]] != t.text and (t.text == "}" or stack[n] != "{"):
                    n -= 1
                if n < 0 or OPENERS[stack[n]] != t.text:
                    continue
                close(n + 1)
                stack.pop()
            out.append(t)
        if not open_at_end:
            break
    return out


BRACKETS = frozenset("()[]{}")


def pairs(kinds: tuple[str, ...], texts: tuple[str, ...], lines: tuple[int, ...]) -> tuple[dict[int, int], str]:
    """Where each bracket's partner is, and what is wrong with the first that has none."""
    partner: dict[int, int] = {}
    stack: list[int] = []
    for i, text in enumerate(texts):
        if text not in BRACKETS or kinds[i] != "op":
            continue
        if text in OPENERS:
            stack.append(i)
            continue
        if not stack or OPENERS[texts[stack[-1]]] != text:
            return partner, f"line {lines[i]}: {text} closes nothing"
        opener = stack.pop()
        partner[opener], partner[i] = i, opener
    if stack:
        return partner, f"line {lines[stack[-1]]}: {texts[stack[-1]]} is not closed"
    return partner, ""


class Cursor:
    """Tokens, one column for each of their fields, with a place, and where each bracket's partner is."""

    def __init__(self, text: str, kotlin: bool):
        self.source, self.at = text, 0
        columns = tokens(text, kotlin)
        self.partner, wrong = pairs(columns[0], columns[1], columns[4])
        if wrong and kotlin:
            columns = tuple(zip(*closed(list(zip(*columns, strict=True)), text), strict=True))
            self.partner, wrong = pairs(columns[0], columns[1], columns[4])
        if wrong:
            raise SourceError(wrong)
        if kotlin:
            # Room to step past the end where a file breaks off.
            columns = tuple(column + column[-1:] * 8 for column in columns)
        self.kinds, self.texts, self.starts, self.ends, self.lines, self.fresh = columns

    def text(self, i: int, j: int) -> str:
        """The source of tokens i to j, j left out."""
        return self.source[self.starts[i] : self.ends[j - 1]] if i < j else ""

    def is_(self, *texts: str, ahead: int = 0) -> bool:
        # No literal and no end has a text that is a name or an operator.
        return self.texts[min(self.at + ahead, len(self.texts) - 1) if ahead else self.at] in texts

    def take(self, *texts: str) -> bool:
        if self.texts[self.at] in texts:
            self.at += 1
            return True
        return False

    @property
    def done(self) -> bool:
        return self.kinds[self.at] == "end"

    def past(self, i: int) -> int:
        """The place after the bracket group that opens at i."""
        return self.partner[i] + 1

    def parts(self, i: int, j: int, angles: bool = True) -> list[tuple[int, int]]:
        """The stretches between commas outside of brackets, for tokens i to j; an empty last one is left out."""
        out, start, level = [], i, 0
        while i < j:
            text, kind = self.texts[i], self.kinds[i]
            if kind == "op" and text in OPENERS:
                i = self.past(i)
                continue
            if angles and text == "<" and kind == "op":
                level += 1
            elif angles and text == ">" and level:
                level -= 1
            elif text == "," and kind == "op" and not level:
                out.append((start, i))
                start = i + 1
            i += 1
        if start < j:
            out.append((start, j))
        return out

    def type_arguments(self, i: int) -> int | None:
        """The place after type arguments that open at i, or None if `<` compares."""
        level = 0
        while i < len(self.texts):
            text, kind = self.texts[i], self.kinds[i]
            if text == "<" and kind == "op":
                level += 1
            elif text == ">" and kind == "op":
                level -= 1
                if not level:
                    return i + 1
            elif text == "(" and kind == "op":
                i = self.past(i)
                continue
            elif not (kind == "id" or text in (",", ".", "?", "*", "[", "]", "&", "->", "@")):
                return None
            i += 1
        return None
