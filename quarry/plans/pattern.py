"""Patterns: parsed to a tree, written out as Java regular expressions of the same meaning, and read for literals.

Dialect: literals, `.` (any but a line end), `* + ? {n} {n,} {n,m}`, `|`, `( )` without captures, classes with ranges, negation and
escapes, `\\d \\w \\s \\D \\W \\S` over ASCII, `^ $` at line bounds, `\\b`, `\\n \\r \\t`, escaped characters. Where it has nothing to
repeat a quantifier is an ordinary character, as are `, ] }` outside classes and a `{` that opens no count. Look-around, lazy and
possessive quantifiers, back-references, `(?...)`, `\\B \\A \\z \\p` and POSIX classes are refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from quarry.functions.strings import latin1_str, quoted, rarest_index, rarity
from quarry.spec import SearchSpec


class UnsupportedPattern(ValueError):
    """The pattern is malformed or uses what the dialect doesn't have."""


@dataclass(frozen=True)
class Char:
    char: str


@dataclass(frozen=True)
class Any:
    pass


@dataclass(frozen=True)
class Set:
    """parts: characters, (low, high) ranges and one-letter names of d, w, s, D, W, S."""

    parts: tuple
    negated: bool = False


@dataclass(frozen=True)
class Bound:
    """kind: ^, $ or b."""

    kind: str


@dataclass(frozen=True)
class Seq:
    items: tuple


@dataclass(frozen=True)
class Either:
    items: tuple


@dataclass(frozen=True)
class Repeat:
    item: object
    least: int
    most: int | None


Node = Char | Any | Set | Bound | Seq | Either | Repeat

#: The ASCII sets.
SETS = {"d": "0-9", "w": "A-Za-z0-9_", "s": r" \t\n\r"}
CONTROLS = {"n": "\n", "r": "\r", "t": "\t"}
NOT_BEHIND_WORD, NOT_BEFORE_WORD = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
WORD_BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
MAX_REPEAT = 1000


class _Reader:
    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self, depth: int) -> Node:
        branches = [self.sequence(depth)]
        while self.peek() == "|":
            self.take()
            branches.append(self.sequence(depth))
        return branches[0] if len(branches) == 1 else Either(tuple(branches))

    def sequence(self, depth: int) -> Node:
        items: list[Node] = []
        while self.at < len(self.text) and self.peek() != "|":
            if self.peek() == ")":
                if depth:
                    break
                raise UnsupportedPattern("unmatched )")
            items.append(self.repeated(self.atom(depth)))
        return items[0] if len(items) == 1 else Seq(tuple(items))

    def count(self) -> tuple[int, int | None] | None:
        """The count that opens here, without moving on if there is none."""
        end = self.text.find("}", self.at)
        body = self.text[self.at + 1 : end] if end > 0 else ""
        low, comma, high = body.partition(",")
        if not low.isascii() or not low.isdigit() or (high and not (high.isascii() and high.isdigit())):
            return None
        self.at = end + 1
        least = int(low)
        most = least if not comma else int(high) if high else None
        if (most is not None and most < least) or max(least, most or 0) > MAX_REPEAT:
            raise UnsupportedPattern(f"bad count {{{body}}}")
        return least, most

    def repeated(self, item: Node) -> Node:
        while True:
            c = self.peek()
            if c and c in "*+?":
                self.take()
                bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            elif c == "{" and (found := self.count()):
                bounds = found
            else:
                return item
            if self.peek() and self.peek() in "?+":
                raise UnsupportedPattern("lazy and possessive quantifiers")
            item = Repeat(item, *bounds)

    def atom(self, depth: int) -> Node:
        c = self.take()
        if c == ".":
            return Any()
        if c in "^$":
            return Bound(c)
        if c == "[":
            return self.set()
        if c == "(":
            if self.peek() == "?":
                raise UnsupportedPattern("(?")
            inner = self.either(depth + 1)
            if self.peek() != ")":
                raise UnsupportedPattern("unmatched (")
            self.take()
            return inner if isinstance(inner, Either) else Seq((inner,))
        if c == "\\":
            return self.escape()
        return Char(c)

    def escape(self) -> Node:
        if self.at == len(self.text):
            raise UnsupportedPattern("trailing backslash")
        c = self.take()
        if c in "dwsDWS":
            return Set((_SetName(c.lower()),), c.isupper())
        if c == "b":
            return Bound("b")
        if c in CONTROLS:
            return Char(CONTROLS[c])
        if c in "123456789BAzZpPkGQE":
            raise UnsupportedPattern(f"\\{c}")
        return Char(c)

    def set(self) -> Node:
        negated = self.peek() == "^"
        if negated:
            self.take()
        parts: list = []
        first = True
        while True:
            if self.at == len(self.text):
                raise UnsupportedPattern("unmatched [")
            if self.peek(2) in ("[:", "[.", "[="):
                raise UnsupportedPattern("POSIX classes")
            c = self.take()
            if c == "]" and not first:
                return Set(tuple(parts), negated)
            first = False
            low = self.member(c)
            if len(low) == 1 and self.peek() == "-" and self.peek(2)[1:] not in ("", "]"):
                self.take()
                high = self.member(self.take())
                if len(high) != 1 or high < low:
                    raise UnsupportedPattern("bad range")
                parts.append((low, high))
            else:
                parts.append(low if len(low) == 1 else _SetName(low[1:]))

    def member(self, c: str) -> str:
        """One character, or `\\` and the name of a set."""
        if c != "\\":
            return c
        if self.at == len(self.text):
            raise UnsupportedPattern("unmatched [")
        c = self.take()
        if c in "dwsDWS":
            return "\\" + c
        if c in "pPB":
            raise UnsupportedPattern(f"\\{c}")
        return CONTROLS.get(c, c)


class _SetName(str):
    """Tells the name of a set from a character."""


def parse(pattern: str) -> Node:
    """The pattern's tree."""
    return _Reader(pattern).either(0)


def _java_char(c: str) -> str:
    return {"\n": r"\n", "\r": r"\r", "\t": r"\t"}.get(c) or quoted(c)


def _java_set(node: Set) -> str:
    """Sets such as \\W inside a class are written as a choice, as nested classes mean different things to different engines."""

    def part(p) -> str:
        if isinstance(p, tuple):
            return f"{_java_char(p[0])}-{_java_char(p[1])}"
        return SETS[p] if isinstance(p, _SetName) else _java_char(p)

    outside = [f"[^{SETS[p.lower()]}]" for p in node.parts if isinstance(p, _SetName) and p.isupper()]
    own = "".join(part(p) for p in node.parts if not (isinstance(p, _SetName) and p.isupper()))
    if not outside:
        return f"[{'^' if node.negated else ''}{own}]"
    either = "|".join(([f"[{own}]"] if own else []) + outside)
    return f"(?:(?!{either})(?s:.))" if node.negated else f"(?:{either})"


def _is_word(part) -> bool:
    if isinstance(part, _SetName):
        return part in ("d", "w")
    ends = part if isinstance(part, tuple) else (part, part)
    return any(all(low <= e <= high for e in ends) for low, high in ("az", "AZ", "09", "__"))


def edge_is_word(node: Node, first: bool) -> bool:
    """The first (or last) character of every match of the node is a word character."""
    match node:
        case Char(c):
            return _is_word(c)
        case Set(parts, negated):
            return not negated and bool(parts) and all(map(_is_word, parts))
        case Repeat(item, least, _):
            return least >= 1 and edge_is_word(item, first)
        case Seq(items):
            return bool(items) and edge_is_word(items[0 if first else -1], first)
        case Either(items):
            return all(edge_is_word(i, first) for i in items)
    return False


def _java_items(items: tuple, keeps: bool) -> str:
    """A sequence. A word bound next to what is surely a word character need only look to its other side."""
    out = []
    for i, item in enumerate(items):
        if item == Bound("b") and i + 1 < len(items) and edge_is_word(items[i + 1], True):
            out.append(NOT_BEHIND_WORD)
        elif item == Bound("b") and i and edge_is_word(items[i - 1], False):
            out.append(NOT_BEFORE_WORD)
        else:
            out.append(f"(?:{java(item, keeps)})" if isinstance(item, Either) else java(item, keeps))
    return "".join(out)


def java(node: Node, keeps: bool = False) -> str:
    """A Java regular expression that finds, in one line, what the tree describes. With keeps, repeats are possessive: they give nothing back."""
    match node:
        case Char(c):
            return _java_char(c)
        case Any():
            return r"[^\n]"
        case Set():
            return _java_set(node)
        case Bound(kind):
            return {"^": r"\A", "$": r"\z", "b": WORD_BOUND}[kind]
        case Seq(items):
            return _java_items(items, keeps)
        case Either(items):
            return "|".join(java(i, keeps) for i in items)
        case Repeat(item, least, most):
            inner = java(item, keeps)
            single = isinstance(item, (Char, Any, Set))
            count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most)) or (
                f"{{{least},{'' if most is None else most}}}"
            )
            return (inner if single else f"(?:{inner})") + count + ("+" if keeps else "")
    raise TypeError(node)


def pure_literal(node: Node) -> str | None:
    """The text if the pattern is nothing but text."""
    match node:
        case Char(c):
            return c
        case Seq(items):
            parts = [pure_literal(i) for i in items]
            return None if None in parts else "".join(parts)
    return None


def branch_literals(node: Node) -> list[str] | None:
    """The texts if the pattern is a choice of texts."""
    while isinstance(node, Seq) and len(node.items) == 1:
        node = node.items[0]
    if not isinstance(node, Either):
        return None
    parts = [x for i in node.items for x in (branch_literals(i) or [pure_literal(i)])]
    return None if None in parts or "" in parts else parts


def mandatory_runs(node: Node) -> list[str]:
    """Texts that every match holds. Nothing optional counts; a repeated part counts once and doesn't join its neighbours; a choice gives none."""
    runs: list[str] = []
    run = ""

    def walk(n: Node) -> None:
        nonlocal run
        match n:
            case Char(c):
                run += c
            case Seq(items):
                for i in items:
                    walk(i)
            case _:
                runs.append(run)
                run = ""
                if isinstance(n, Repeat) and n.least >= 1:
                    runs.extend(mandatory_runs(n.item))

    walk(node)
    runs.append(run)
    return [r for r in runs if r]


def required_literal(node: Node) -> str | None:
    """The longest text that every match holds, of equally long ones that with the rarest character."""
    runs = mandatory_runs(node)
    return max(runs, key=lambda r: (len(r), rarity(r[rarest_index(r)]))) if runs else None


@dataclass(frozen=True)
class Compiled:
    """literal: the pattern is this text. branches: it is one of these. required: every match holds it. java: the whole, for lines of up to
    `limit` characters (None: of any length); longer ones go through the automaton. linear: a Java regular expression that says of lines of any
    length whether there is a match, not where, in linear time and without recursion, if one is known."""

    spec: SearchSpec
    node: Node
    java: str
    literal: str | None
    branches: list[str] | None
    required: str | None
    limit: int | None = None
    automaton: object = None
    linear: str | None = None


@lru_cache(256)
def compile_pattern(spec: SearchSpec) -> Compiled:
    from quarry.plans import automaton

    text = latin1_str(spec.pattern) if spec.byte_mode else spec.pattern
    node = Seq(tuple(map(Char, text))) if spec.fixed else parse(text)
    body = java(node)
    if spec.whole_word:
        body = rf"(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])"
    if spec.ignore_case:
        body = f"(?i){body}"
    literal = None if spec.whole_word else pure_literal(node)
    branches = None if spec.whole_word else branch_literals(node)
    limit, made = automaton.safe_length(node, spec.ignore_case), None
    if limit is not None:
        try:
            made = automaton.build(node, spec.ignore_case, spec.whole_word)
        except automaton.TooLarge as error:
            if automaton.recurses(node):
                raise UnsupportedPattern(str(error)) from error
            limit = None  # slow on long lines, but in bounded memory
    linear = None
    if made and not spec.whole_word and (found := automaton.linear(node, spec.ignore_case)) is not None:
        linear = f"(?i){found}" if spec.ignore_case else found
    return Compiled(spec, node, body, literal, branches, pure_literal(node) or required_literal(node), limit, made, linear)
