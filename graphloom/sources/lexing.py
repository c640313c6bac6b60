"""Tokens, brackets, definitions and complexity of sources in languages that write blocks in braces.

No grammar is needed for what is asked here: a file is a list of tokens, each bracket knows
its partner and each token the bracket that it lies in. Text that doesn't fit ends in
fewer findings, never in an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# Words that open types and callables, by language, and words that are never names of callables.
TYPE_WORDS = {
    "java": ("class", "interface", "enum", "record"), "kotlin": ("class", "interface", "object"), "typescript": ("class", "interface", "enum", "namespace"), "javascript": ("class",),
    "csharp": ("class", "interface", "struct", "enum", "record"), "rust": ("struct", "enum", "trait", "impl", "mod"), "go": ("type",), "scala": ("class", "trait", "object"),
    "php": ("class", "interface", "trait"), "c": ("struct",), "cpp": ("struct", "class", "namespace"),
}
CALLABLE_WORD = {"kotlin": "fun", "typescript": "function", "javascript": "function", "rust": "fn", "go": "func", "scala": "def", "php": "function"}
KEYWORDS = frozenset(
    "if else for foreach while do switch when match case default try catch finally return throw break continue new super this self function func fun fn def synchronized using lock "
    "class interface enum record struct trait impl object namespace type instanceof typeof in of as is null true false var let const val static final public private protected "
    "abstract extends implements import package async await yield void loop select go defer sizeof constructor".split()
)

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
    r'|(?P<string>r(?P<hashes>#*)".*?"(?P=hashes)|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`)'
    r"|(?P<quoted>'(?:\\.|[^'\\\n])*')"
    r"|(?P<number>\d[\w.]*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>=>|->|::|\?\.|&&|\|\||[^\w\s])",
    re.DOTALL,
)
_RUNE = re.compile(r"'(?:\\[^']*|[^'\\\n])'")
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


class Token(NamedTuple):
    kind: str  # string, number, name or op
    text: str
    line: int


def lex(text: str, language: str) -> list[Token]:
    """The tokens without white space and comments."""
    tokens: list[Token] = []
    at, line = 0, 1
    while at < len(text):
        found = None
        if text[at] == "'" and language in ("rust", "scala"):
            found, kind = _RUNE.match(text, at), "string"  # otherwise a lifetime or a symbol
            if found is None:
                tokens.append(Token("op", "'", line))
                at += 1
                continue
        elif text[at] == "/" and language in ("javascript", "typescript") and text[at : at + 2] not in ("//", "/*") and (not tokens or tokens[-1].text in ("(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "return")):
            found, kind = _PATTERN.match(text, at), "string"
        elif text[at] == "#" and language == "php":
            found, kind = re.compile(r"#[^\n]*").match(text, at), "skip"
        if found is None:
            found = _TOKEN.match(text, at)
            if found is None:
                at += 1
                continue
            kind = {"quoted": "string", "hashes": "string"}.get(found.lastgroup, found.lastgroup)
        piece = found[0]
        if kind != "skip":
            tokens.append(Token(kind, piece, line))
        line += piece.count("\n")
        at = found.end()
    return tokens


def brackets(tokens: list[Token]) -> tuple[list[int], list[int]]:
    """Of each token: its partner if it is a bracket (one that is never closed: the end), and the innermost open bracket around it or -1."""
    partner, inside, open_ = [-1] * len(tokens), [-1] * len(tokens), []
    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text in ")]}":
            wanted = "([{"[")]}".index(t.text)]
            if any(tokens[o].text == wanted for o in open_):
                while tokens[open_[-1]].text != wanted:
                    partner[open_.pop()] = i
                partner[i] = open_[-1]
                partner[open_.pop()] = i
        inside[i] = open_[-1] if open_ else -1
        if t.kind == "op" and t.text in "([{":
            open_.append(i)
    for o in open_:
        partner[o] = len(tokens)
    return partner, inside


class Definition(NamedTuple):
    kind: str  # type or callable
    word: str  # what opens a type
    name: str
    owner: str | None  # the type that a callable belongs to
    at: int  # the token of its name
    params: tuple[int, int]
    body: tuple[int, int] | None  # the tokens between the braces


class Source:
    """A file's tokens with brackets and definitions."""

    def __init__(self, text: str, language: str):
        self.language = language
        self.tokens = lex(text, language)
        self.partner, self.inside = brackets(self.tokens)
        self.types = list(self._types())
        self._type_bodies = {d.body[0] - 1: d for d in self.types if d.body is not None}
        self.callables = sorted(self._callables(), key=lambda d: d.at)
        self._holders: list[Definition | None] | None = None

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def line(self, i: int) -> int:
        return self.tokens[min(max(i, 0), len(self.tokens) - 1)].line if self.tokens else 1

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def past(self, i: int) -> int:
        """The place after a bracket's partner."""
        return min(self.partner[i], len(self.tokens)) + 1

    def seek(self, i: int, wanted: tuple[str, ...], stop: tuple[str, ...]) -> int | None:
        """The first of the wanted tokens from ``i`` on at the same level, None if a stop comes first."""
        while i < len(self.tokens):
            t = self.text(i)
            if t in wanted:
                return i
            if t in stop or t in (")", "]", "}") and self.tokens[i].kind == "op":
                return None
            i = self.past(i) if self.partner[i] > i else i + 1
        return None

    def type_at(self, i: int) -> Definition | None:
        """The innermost type whose body holds the token."""
        at = self.inside[i]
        while at >= 0:
            if at in self._type_bodies:
                return self._type_bodies[at]
            at = self.inside[at]
        return None

    def callable_at(self, i: int) -> Definition | None:
        """The innermost named callable whose body holds the token."""
        if self._holders is None:
            self._holders = [None] * len(self.tokens)
            for d in self.callables:  # inner ones begin later
                if d.body is not None:
                    self._holders[d.body[0] : d.body[1]] = [d] * (min(d.body[1], len(self.tokens)) - d.body[0])
        return self._holders[i]

    def _types(self) -> Iterator[Definition]:
        words = TYPE_WORDS.get(self.language, ())
        for i, t in enumerate(self.tokens):
            if t.kind != "name" or t.text not in words or self.text(i - 1) in (".", "::"):
                continue
            at = i + 1
            if t.text == "impl":
                start = self.seek(i, ("{",), (";",))
                names = [] if start is None else self._outer_names(i + 1, start)
                if not names:
                    continue
                at = names[names.index(next(n for n in names if self.text(n) == "for")) + 1] if any(self.text(n) == "for" for n in names[:-1]) else names[0]
            elif t.text == "type":
                if self.text(i + 2) not in ("struct", "interface"):
                    continue
                start = i + 3
            elif not self.is_name(at) or self.text(at) in KEYWORDS:
                continue
            else:
                start = self.seek(at, ("{",), (";", "=", *words, CALLABLE_WORD.get(self.language, ";")))
            if not self.is_name(at):
                continue
            body = (start + 1, self.partner[start]) if start is not None and self.text(start) == "{" else None
            word = self.text(i + 2) if t.text == "type" else t.text
            yield Definition("type", word, self.text(at), None, at, (at, at), body)

    def _outer_names(self, a: int, b: int) -> list[int]:
        """Names between two places that aren't inside angle brackets."""
        depth, names = 0, []
        for i in range(a, b):
            depth += (self.text(i) == "<") - (self.text(i) == ">")
            if depth <= 0 and self.is_name(i):
                names.append(i)
        return names

    def _callables(self) -> Iterator[Definition]:
        word = CALLABLE_WORD.get(self.language)
        script = self.language in ("javascript", "typescript")
        for i, t in enumerate(self.tokens):
            if word is not None and t.kind == "name" and t.text == word:
                yield from self._opened_by_word(i)
            elif script and t.text == "=>":
                yield from self._arrow(i)
            elif t.kind == "name" and self.text(i + 1) == "(" and t.text not in KEYWORDS - {"constructor"} and (script or word is None) and self.text(i - 1) not in (".", "?.", "new", "=", "(", "return", "::", "->", word or "."):
                yield from self._by_shape(i)

    def _opened_by_word(self, i: int) -> Iterator[Definition]:
        owner, at = None, i + 1
        if self.text(at) == "*":
            at += 1
        if self.language == "go" and self.text(at) == "(":  # the receiver
            names = [k for k in range(at, self.partner[at]) if self.is_name(k)]
            owner = self.text(names[-1]) if names else None
            at = self.past(at)
        if self.text(at) == "<":
            at = next((k for k in range(at, len(self.tokens)) if self.text(k) == ">"), at) + 1
        while self.is_name(at) and self.text(at + 1) in (".", "?."):  # a receiver's type
            at += 2
        if not self.is_name(at):
            yield from self._assigned(i, at)
            return
        start = self.seek(at, ("(",), ("{", ";", "="))
        if start is None:
            return
        end = self.past(start)
        # What follows the parameters up to the body: a type, which ends with its line where no brace opens one.
        here = next((k for k in range(end, len(self.tokens)) if self.text(k) in ("{", "=", ";", "}") or self.language in ("kotlin", "scala") and self.line(k) > self.line(end - 1) and self.text(k) != ":"), len(self.tokens))
        yield self._definition(at, owner, start, here)

    def _assigned(self, i: int, at: int) -> Iterator[Definition]:
        """``name = function (...) {``"""
        if self.text(at) == "(" and self.text(i - 1) == "=" and self.is_name(i - 2):
            yield self._definition(i - 2, None, at, self.past(at))

    def _arrow(self, i: int) -> Iterator[Definition]:
        start = self.partner[i - 1] if self.text(i - 1) == ")" else i - 1
        before = start - 1 - (self.text(start - 1) == "async")
        if start < 0 or self.text(before) != "=":
            return
        at = before - 1
        if self.text(at - 1) == ":":
            at -= 2
        if self.is_name(at):
            yield self._definition(at, None, start, i + 1)

    def _by_shape(self, i: int) -> Iterator[Definition]:
        """``name(...) {`` in a type, or outside of all blocks in C."""
        around = self._type_bodies.get(self.inside[i])
        if around is None and not (self.language in ("c", "cpp") and self.inside[i] < 0):
            return
        here = self.past(i + 1)
        while here < len(self.tokens) and self.text(here) not in ("{", ";", "=", "}", "(", "=>"):
            if self.text(here) == "<":
                depth = 0
                while here < len(self.tokens):
                    depth += (self.text(here) == "<") - (self.text(here) == ">")
                    if not depth:
                        break
                    here += 1
            here += 1
        ends = self.text(here) == ";" and around is not None and around.word == "interface"
        if self.text(here) == "{" or ends or self.text(here) == "=>" and self.language == "csharp":
            yield self._definition(i, None, i + 1, here)

    def _definition(self, at: int, owner: str | None, start: int, here: int) -> Definition:
        params = (start + 1, min(self.partner[start], len(self.tokens))) if self.text(start) == "(" else (start, start + 1)
        body = None
        if self.text(here) == "{":
            body = (here + 1, min(self.partner[here], len(self.tokens)))
        elif self.text(here) in ("=", "=>") or self.text(here - 1) == "=>":
            first = here + (self.text(here) in ("=", "=>"))
            body = (first, self.line_end(first))
        around = self.type_at(at)
        return Definition("callable", "", self.text(at), owner or (around.name if around is not None else None), at, params, body)

    def line_end(self, i: int) -> int:
        """Where an expression without a terminator ends: a semicolon, a closing bracket, or the end of a line that no operator continues."""
        first = i
        while i < len(self.tokens):
            t = self.text(i)
            if t in (";", ",") or t in (")", "]", "}") and self.tokens[i].kind == "op" or t == "else":
                return i
            if i > first and self.line(i) > self.line(i - 1) and self.text(i - 1) not in ("=", "+", "&&", "||", "=>", "?", ":", ".", "?.") and t not in (".", "?.", "+", "&&", "||", "?", ":"):
                return i
            i = self.past(i) if self.partner[i] > i else i + 1
        return i

    def arguments(self, start: int) -> list[tuple[int, int]]:
        """The places of each argument between a bracket and its partner."""
        return self.split(start + 1, min(self.partner[start], len(self.tokens)))

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        out, first, i = [], a, a
        while i < b:
            if self.text(i) == ",":
                out.append((first, i))
                first = i + 1
            i = self.past(i) if self.partner[i] > i else i + 1
        return [*out, (first, b)] if first < b else out

    def arity(self, d: Definition) -> int:
        depth, n, some = 0, 0, False
        i = d.params[0]
        while i < d.params[1]:
            t = self.text(i)
            depth += (t == "<") - (t == ">")
            n += t == "," and depth <= 0
            some = True
            i = self.past(i) if self.partner[i] > i else i + 1
        return n + some - (some and self.text(d.params[1] - 1) == ",")

    def calls(self) -> Iterator[tuple[int, str, str, int]]:
        """Of each call the place of its name, the receiver's text, the receiver's first name and the place of the opening bracket."""
        opened = {d.at for d in self.callables}
        for i, t in enumerate(self.tokens):
            if t.kind != "name" or i in opened or t.text in KEYWORDS:
                continue
            start = i + 1
            if self.text(start) == "<":  # type arguments
                end = start + 1
                while end < len(self.tokens) and (self.tokens[end].kind == "name" or self.text(end) in (",", ".", "<", ">", "[", "]", "?")):
                    end += 1
                    if self.text(end - 1) == ">" and self.text(end) == "(":
                        break
                start = end
            if self.text(start) != "(":
                continue
            first = i
            while self.text(first - 1) in (".", "?.", "::", "->"):
                k = first - 2
                while self.text(k) in (")", "]") and 0 <= self.partner[k] < k:
                    k = self.partner[k] - 1
                if not self.is_name(k):
                    break
                first = k
            receiver = "".join(x.text for x in self.tokens[first : i - 1]) if first < i else ""
            yield i, receiver, self.text(first) if first < i else "", start

    def complexity(self, a: int, b: int) -> dict[str, int]:
        """Cyclomatic and cognitive complexity and depth of loops of the tokens between two places.

        Cyclomatic: 1, and 1 for each branch, loop, case, handler, condition and logical
        operator. Cognitive: 1 and the depth of nesting for each construct, 1 for each
        logical operator and each jump to a label.
        """
        cyclomatic, cognitive, loops = 1, 0, 0
        open_: list[tuple[int, int, int]] = [(b, 0, 0)]  # where a construct ends, nesting and loops in it
        tails, known = set(), {}  # the while of a do; where statements end
        for i in range(a, min(b, len(self.tokens))):
            while len(open_) > 1 and i >= open_[-1][0]:
                open_.pop()
            t, (_, nesting, depth) = self.tokens[i], open_[-1]
            if t.kind == "op":
                if t.text in ("&&", "||"):
                    cyclomatic, cognitive = cyclomatic + 1, cognitive + 1
                elif t.text == "?" and self.language not in ("kotlin", "rust") and self.text(i + 1) not in (":", ")", ",", ".", ">", "="):
                    cyclomatic, cognitive = cyclomatic + 1, cognitive + 1 + nesting
                elif t.text == "=>" and self.language in ("javascript", "typescript") or t.text == "->" and self.language == "java":
                    end = self.past(i + 1) if self.text(i + 1) == "{" else self.line_end(i + 1)
                    open_.append((min(end, open_[-1][0]), 0, depth))
                continue
            if t.kind != "name" or self.text(i - 1) in (".", "?."):
                continue
            if t.text in ("break", "continue"):
                cognitive += self.is_name(i + 1) and self.line(i + 1) == t.line and self.text(i + 1) not in KEYWORDS
            elif t.text in ("case", "default"):
                cyclomatic += self.text(i + 1) not in (".", "(")
            elif t.text in ("if", "for", "foreach", "while", "do", "loop", "switch", "when", "match", "select", "try", "catch") and i not in tails:
                looping = t.text in ("for", "foreach", "while", "do", "loop")
                cyclomatic += looping or t.text in ("if", "catch")
                cognitive += 1 + nesting
                loops = max(loops, depth + looping)
                end = self._statement_end(i, tails, known)
                open_.append((min(end, b), nesting + 1, depth + looping))
        return {"cyclomatic": cyclomatic, "cognitive": cognitive, "loop_depth": loops}

    def _statement_end(self, i: int, tails: set[int], known: dict[int, int]) -> int:
        """The place after the statement that begins at ``i``. All links of a chain of branches end where it does."""
        chain = []
        while True:
            word = self.text(i)
            if i in known:
                end = known[i]
            elif word == "{":
                end = self.past(i)
            elif word not in ("if", "for", "foreach", "while", "do", "loop", "switch", "when", "match", "select", "try", "catch"):
                end = self.line_end(i)
                end += self.text(end) == ";"
            else:
                chain.append(i)
                here = i + 1
                if self.text(here) == "(":
                    here = self.past(here)
                elif word not in ("do", "try", "loop"):
                    found = self.seek(here, ("{",), (";;",))
                    here = len(self.tokens) if found is None else found
                end = here if here >= len(self.tokens) else self._statement_end(here, tails, known)
                if word == "do" and self.text(end) == "while":
                    tails.add(end)
                    end = self.past(end + 1) if self.text(end + 1) == "(" else end + 1
                while word == "try" and self.text(end) in ("catch", "finally"):
                    here = end + 1
                    end = self._statement_end(self.past(here) if self.text(here) == "(" else here, tails, known)
                if word == "if" and self.text(end) == "else":
                    i = end + 1
                    continue
            known.update(dict.fromkeys(chain, end))
            return end


def value_of(token: Token) -> str:
    """What a literal of text says, escapes left as they are."""
    text = token.text
    for mark in ('"""', '"', "'", "`"):
        if text.startswith(mark) and text.endswith(mark) and len(text) >= 2 * len(mark):
            return text[len(mark) : -len(mark)]
    return re.sub(r'^r#*"|"#*$', "", text)
