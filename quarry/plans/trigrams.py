"""Which trigrams a document must hold to match a pattern: a small AND/OR plan, made on the driver.

Trigrams are of UTF-8 bytes: b0 + b1 * 256 + b2 * 65536.
"""

from __future__ import annotations

from dataclasses import dataclass

from quarry.plans.pattern import Char, Either, Node, Repeat, Seq


@dataclass(frozen=True)
class MatchAll:
    """No document can be ruled out."""


@dataclass(frozen=True)
class Need:
    """All of these trigrams."""

    trigrams: frozenset[int]


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


Plan = MatchAll | Need | And | Or


def trigram_list(data: bytes) -> list[int]:
    return [data[i] | data[i + 1] << 8 | data[i + 2] << 16 for i in range(len(data) - 2)]


def need_masks(data: bytes) -> dict[int, int]:
    """For each trigram of a literal the bits that its next-byte mask has to have; 0 for one that ends the literal."""
    out: dict[int, int] = {}
    for i, t in enumerate(trigram_list(data)):
        out[t] = out.get(t, 0) | (1 << data[i + 3] % 8 if i + 3 < len(data) else 0)
    return out


def _all(items: list[Plan]) -> Plan:
    kept = [i for i in dict.fromkeys(items) if not isinstance(i, MatchAll)]
    return MatchAll() if not kept else kept[0] if len(kept) == 1 else And(tuple(kept))


def _one(items: list[Plan]) -> Plan:
    items = list(dict.fromkeys(items))
    if any(isinstance(i, MatchAll) for i in items):
        return MatchAll()
    return items[0] if len(items) == 1 else Or(tuple(items))


def decompose(node: Node, byte_mode: bool = False) -> Plan:
    """Runs of text of three bytes or more are needed; a choice needs one of its branches; a repeated part is needed if it occurs at least once."""
    found: list[Plan] = []
    run = ""

    def close() -> None:
        nonlocal run
        grams = trigram_list(run.encode("latin-1" if byte_mode else "utf-8"))
        if grams:
            found.append(Need(frozenset(grams)))
        run = ""

    def walk(n: Node) -> None:
        nonlocal run
        match n:
            case Char(c):
                run += c
            case Seq(items):
                for i in items:
                    walk(i)
            case Either(items):
                close()
                found.append(_one([decompose(i, byte_mode) for i in items]))
            case Repeat(item, least, _):
                close()
                if least >= 1:
                    found.append(decompose(item, byte_mode))
            case _:
                close()

    walk(node)
    close()
    return _all(found)


def is_selective(plan: Plan) -> bool:
    return not isinstance(plan, MatchAll)


def leaves(plan: Plan) -> set[int]:
    match plan:
        case Need(t):
            return set(t)
        case And(items) | Or(items):
            return set().union(*map(leaves, items))
    return set()
