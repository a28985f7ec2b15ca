"""Patterns as deterministic automata, for lines on which java.util.regex could take very long or overflow its stack.

A pattern's tree becomes a nondeterministic automaton, whose sets of states are the states of a table: one row a state, one column for
each class of characters that the pattern doesn't tell apart, and one for the end of the line. A line is read once, character by character, with an
aggregate over Spark expressions: time grows with the line's length, whatever the pattern, and nothing is called recursively.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from math import inf, prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.plans.pattern import Any, Bound, Char, Either, Node, Repeat, Seq, Set, _SetName, java

#: Larger automata are not made.
MAX_NODES, MAX_STATES, MAX_CELLS = 4_000, 2_000, 100_000
TOP = 0x110000
WORD = ((48, 58), (65, 91), (95, 96), (97, 123))
NAMED = {"d": ((48, 58),), "w": WORD, "s": ((9, 11), (13, 14), (32, 33))}

#: Lines of up to so many characters go to java.util.regex if it can't recurse more than this, or take many steps for each character.
SHALLOW, LONG, STEPS = 500, 4_096, 10_000_000
#: A pattern that can be read in at most so many ways from each place is looked for at any length.
WAYS = 64


class TooLarge(ValueError):
    """The pattern needs more states than are made."""


def _without(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], 0
    for a, b in sorted(ranges):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, TOP)] if at < TOP else out


def _folded(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """With the other case of ASCII letters."""
    out = list(ranges)
    for a, b in ranges:
        for low, high, by in ((65, 91, 32), (97, 123, -32)):
            if max(a, low) < min(b, high):
                out.append((max(a, low) + by, min(b, high) + by))
    return out


def ranges_of(node: Node, ignore_case: bool) -> list[tuple[int, int]]:
    """Half-open ranges of the characters that a single-character node takes."""
    if isinstance(node, Any):
        return _without([(10, 11)])
    if isinstance(node, Char):
        found = [(ord(node.char), ord(node.char) + 1)]
        return _folded(found) if ignore_case else found
    found = []
    for p in node.parts:
        if isinstance(p, _SetName):
            found += _without(list(NAMED[p.lower()])) if p.isupper() else NAMED[p]
        elif isinstance(p, tuple):
            found.append((ord(p[0]), ord(p[1]) + 1))
        else:
            found.append((ord(p), ord(p) + 1))
    found = _folded(found) if ignore_case else found
    return _without(found) if node.negated else found


class _Graph:
    """Nodes: ("take", ranges, next), ("split", next...), ("bound", kind, next), ("end",)."""

    def __init__(self, ignore_case: bool):
        self.ignore_case, self.nodes = ignore_case, [("end",)]

    def add(self, *node) -> int:
        if len(self.nodes) >= MAX_NODES:
            raise TooLarge("the pattern is too long")
        self.nodes.append(node)
        return len(self.nodes) - 1

    def before(self, node: Node, after: int) -> int:
        """Where to begin so that the node is read and `after` follows."""
        match node:
            case Char() | Any() | Set():
                return self.add("take", tuple(ranges_of(node, self.ignore_case)), after)
            case Bound(kind):
                return self.add("bound", kind, after)
            case Seq(items):
                for item in reversed(items):
                    after = self.before(item, after)
                return after
            case Either(items):
                return self.add("split", *[self.before(i, after) for i in items])
            case Repeat(item, least, most):
                if most is None:
                    loop = self.add("split")
                    self.nodes[loop] = ("split", self.before(item, loop), after)
                    after = loop
                else:
                    for _ in range(most - least):
                        after = self.add("split", self.before(item, after), after)
                for _ in range(least):
                    after = self.before(item, after)
                return after
        raise TypeError(node)


@dataclass(frozen=True)
class Automaton:
    """cuts: first characters of the classes. table[state * (classes + 1) + class]: the next state; the last class is the end. State 0 is a match, 1 is
    where a line begins."""

    cuts: tuple[int, ...]
    table: tuple[int, ...]

    def matches(self, line: str) -> bool:
        state, width = 1, len(self.cuts) + 1
        for c in line:
            state = self.table[state * width + bisect_right(self.cuts, ord(c)) - 1]
        return self.table[state * width + width - 1] == 0

    def column(self, line: Column) -> Column:
        """Whether the pattern is found in the line."""
        width = len(self.cuts) + 1
        table = F.split(F.lit(",".join(map(str, self.table))), ",").cast("array<int>")
        ascii_ = F.split(F.lit(",".join(str(bisect_right(self.cuts, c) - 1) for c in range(128))), ",").cast("array<int>")
        high = [c for c in self.cuts if c > 128]

        def step(state: Column, char: Column) -> Column:
            code = F.ascii(char)
            other = F.lit(bisect_right(self.cuts, 128) - 1)
            for c in high:
                other = F.when(code >= c, bisect_right(self.cuts, c) - 1).otherwise(other)
            kind = F.when(code < 128, F.get(ascii_, code)).otherwise(other)
            return F.when(state == 0, state).otherwise(F.get(table, state * width + kind))

        chars = F.regexp_extract_all(line, F.lit("(?s)(.)"), F.lit(1))
        return F.get(table, F.aggregate(chars, F.lit(1), step) * width + (width - 1)) == 0


def build(node: Node, ignore_case: bool = False, whole_word: bool = False) -> Automaton:
    graph = _Graph(ignore_case)
    if whole_word:
        node = Seq((Bound("<"), node, Bound(">")))
    start = graph.before(node, 0)
    cuts = _cuts(graph)
    kinds = [any(a <= c < b for a, b in WORD) for c in cuts]
    width = len(cuts) + 1
    numbers: dict[tuple, int] = {(frozenset(), "match"): 0}
    todo, table = [(frozenset([start]), None)], [[0] * width]
    numbers[todo[0]] = 1
    while todo:
        nodes, before = todo.pop(0)
        row = []
        for c in range(width):
            end = c == width - 1
            reached = _reached(graph, nodes, before, None if end else kinds[c])
            if 0 in reached:
                row.append(0)
                continue
            if end:
                row.append(numbers[nodes, before])  # any state but that of a match
                continue
            taken = {graph.nodes[k][2] for k in reached if graph.nodes[k][0] == "take" and _takes(graph.nodes[k][1], cuts[c])}
            after = (frozenset(taken | {start}), kinds[c])
            if after not in numbers:
                numbers[after] = len(numbers)
                if len(numbers) > MAX_STATES or len(numbers) * width > MAX_CELLS:
                    raise TooLarge("the pattern needs too many states")
                todo.append(after)
            row.append(numbers[after])
        table.append(row)
    return Automaton(tuple(cuts), tuple(x for row in table for x in row))


def _cuts(graph: _Graph) -> list[int]:
    ends = {0, *[x for r in WORD for x in r]}
    for n in graph.nodes:
        if n[0] == "take":
            ends |= {x for r in n[1] for x in r}
    return sorted(x for x in ends if x < TOP)


def _takes(ranges: tuple, code: int) -> bool:
    return any(a <= code < b for a, b in ranges)


def _reached(graph: _Graph, nodes, before: bool | None, after: bool | None) -> set[int]:
    """What can be reached without a character; before and after: whether the neighbours are word characters, None at the line's ends."""
    holds = {
        "^": before is None,
        "$": after is None,
        "b": bool(before) != bool(after),
        "<": not before,
        ">": not after,
    }
    out, open_ = set(), list(nodes)
    while open_:
        k = open_.pop()
        if k in out:
            continue
        out.add(k)
        n = graph.nodes[k]
        if n[0] == "split":
            open_ += n[1:]
        elif n[0] == "bound" and holds[n[1]]:
            open_.append(n[2])
    return out


def _one_way(node: Node, ignore_case: bool) -> bool:
    """From the start of a match on, each next character can be taken in one place only, so a backtracking matcher has nothing to try again."""
    graph = _Graph(ignore_case)
    start = graph.before(node, 0)
    cuts = _cuts(graph)
    seen, todo = set(), [start]
    while todo:
        k = todo.pop()
        if k in seen:
            continue
        seen.add(k)
        reached, open_ = set(), [k]
        while open_:  # as if all bounds held
            j = open_.pop()
            if j not in reached:
                reached.add(j)
                n = graph.nodes[j]
                open_ += n[1:] if n[0] == "split" else [n[2]] if n[0] == "bound" else []
        takes = [graph.nodes[j] for j in reached if graph.nodes[j][0] == "take"]
        for c in cuts:
            after = {t[2] for t in takes if _takes(t[1], c)}
            if sum(_takes(t[1], c) for t in takes) > 1:
                return False
            todo += after
    return True


def _repeats(node: Node) -> tuple[int, int]:
    """(unbounded repeats, how deep a recursive matcher may go for repeated groups; LONG stands for no bound)."""
    match node:
        case Seq(items) | Either(items):
            found = [_repeats(i) for i in items]
            return sum(f[0] for f in found), max((f[1] for f in found), default=0)
        case Repeat(item, _, most):
            inner, depth = _repeats(item)
            if not isinstance(item, (Char, Any, Set)):
                depth = LONG if most is None else max(1, depth) * most
            return inner + (most is None), depth
    return 0, 0


def recurses(node: Node) -> bool:
    """java.util.regex may call itself for each repetition of a group, without a bound that its stack holds."""
    return _repeats(node)[1] > SHALLOW


def safe_length(node: Node, ignore_case: bool = False) -> int | None:
    """Up to which length lines may go to java.util.regex; None: of any length."""
    repeats, depth = _repeats(node)
    if not repeats and depth <= SHALLOW:
        return None
    try:
        one_way = _one_way(node, ignore_case)
    except TooLarge:
        one_way = False
    if one_way:
        return SHALLOW if depth > SHALLOW else LONG
    if depth:  # a choice that is repeated and can be read in several ways: steps may double with each character
        return 0
    return min(LONG, int(STEPS ** (1 / (repeats + 1))))


def _nullable(node: Node) -> bool:
    """Surely matches nothing at all, whatever is around it."""
    match node:
        case Seq(items):
            return all(map(_nullable, items))
        case Either(items):
            return any(map(_nullable, items))
        case Repeat(item, least, _):
            return not least or _nullable(item)
    return False


def _plain(node: Node) -> Node:
    """The same texts by fewer ways of reading them: a choice of single characters is one set, and in a repeated group that begins with a repeat
    and may end there, the group's repeats do for those of its beginning."""
    match node:
        case Seq(items):
            made = tuple(map(_plain, items))
            return made[0] if len(made) == 1 else Seq(made)
        case Either(items):
            made = tuple(map(_plain, items))
            sets = [Set((i.char,)) if isinstance(i, Char) else i for i in made]
            if all(isinstance(i, Set) and not i.negated and not any(isinstance(p, _SetName) and p.isupper() for p in i.parts) for i in sets):
                return Set(tuple(p for i in sets for p in i.parts))
            return Either(made)
        case Repeat(item, least, most):
            item = _plain(item)
            if most is None:
                first, *rest = item.items if isinstance(item, Seq) and item.items else (item,)
                if isinstance(first, Repeat) and first.most is None and first.least <= 1 and not rest:
                    return Repeat(first.item, least if first.least else 0, None)
                if isinstance(first, Repeat) and first.most is None and first.least == 1 and all(map(_nullable, rest)):
                    item = Seq((first.item, *rest))
            return Repeat(item, least, most)
    return node


def _found(node: Node) -> Node:
    """A tree that is found in the same lines, maybe at other places: repeats at its ends needn't go on."""
    if isinstance(node, Either):
        return Either(tuple(map(_found, node.items)))
    items = list(node.items if isinstance(node, Seq) else (node,))
    for at in (0, -1):
        while items and isinstance(items[at], Repeat) and items[at].most is None:
            item, least = items[at].item, items[at].least
            if least:
                items[at] = item if least == 1 else Repeat(item, least, least)
                break
            items.pop(at)
    return items[0] if len(items) == 1 else Seq(tuple(items))


def _bounds(node: Node) -> int:
    match node:
        case Bound():
            return 1
        case Seq(items) | Either(items):
            return sum(map(_bounds, items))
        case Repeat(item, _, _):
            return _bounds(item)
    return 0


def _ways(node: Node) -> float:
    """In how many ways a matcher may read it, at most; infinite with unbounded repeats."""
    match node:
        case Seq(items):
            return prod(map(_ways, items))
        case Either(items):
            return sum(map(_ways, items))
        case Repeat(item, least, most):
            each = _ways(item)
            if most is None or each > 1 and most > WAYS:
                return inf
            return most - least + 1 if each == 1 else sum(each**k for k in range(least, most + 1))
    return 1


def linear(node: Node, ignore_case: bool = False) -> str | None:
    """A Java regular expression that tells whether a line holds the pattern, at any length in linear time and without recursion; None if none is found.

    It can be read in few ways at each place, without an unbounded repeat, or it begins where the line does, takes each next character in one place only, and its repeats, which
    then have nothing to give back, are possessive: java.util.regex runs those in a loop. A bound but at the ends could be met by giving back.
    """
    node = _found(_plain(node))
    if _ways(node) <= WAYS and _repeats(node)[1] <= SHALLOW:
        return java(node)
    items = node.items if isinstance(node, Seq) else ()
    if not items or items[0] != Bound("^") or _bounds(node) != 1 + (items[-1] == Bound("$")):
        return None
    try:
        return java(node, True) if _one_way(node, ignore_case) else None
    except TooLarge:
        return None
