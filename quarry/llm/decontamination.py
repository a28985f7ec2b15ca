"""Benchmark decontamination by template windows.

Canonical template: a text's words without outer punctuation, in lower case, with placeholders for numbers, units behind a
number, names (capitalised words inside a sentence; neighbouring ones are one) and the word that opens a sentence, whose
capital tells nothing. Five neighbouring template words are a window; one with fewer than two plain words is too common and
doesn't count.
A second form of each text keeps names and opening words as plain words, so that a copy with other punctuation or capitals,
whose sentences open elsewhere, is still found.

Windows of documents and of benchmark items are hash-joined. Where matched windows within a stretch of a document cover at least
0.8 of an item's windows, the slots are checked: each value in the item has to stand for one value in the document
throughout (0.8 of them, at least). Places are aligned before, as an item may repeat a window with other values. Equal values are
a verbatim copy, others a re-parameterised question.

An item without a window that counts (of under five template words, or nearly all numbers) is looked for as a whole: its words, values
included, have to follow one another in a document; items of under MIN_WHOLE words have to be all that the document holds.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import grouped, pieces, staged

WINDOW = 5
COVERAGE = 0.8
#: Words of an item without windows from which on it counts anywhere in a document.
MIN_WHOLE = 3
#: Benchmark windows up to which their hashes are sent to every task (8 bytes each); beyond, all document windows are shuffled.
MAX_SENT = 2_000_000
MEMO = 300_000

#: Number words and units.
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "% percent km kilometer kilometers kilometre kilometres m meter meters metre metres cm mm mile miles foot feet ft inch inches yard yards kg kilogram kilograms g gram grams mg lb lbs pound pounds ounce ounces oz ton tons l liter liters litre litres ml gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros degree degrees mph kmh".split()
)
_NUMBER = re.compile(r"[+\-]?[$€£]?\d[\d.,:/]*\w{0,3}%?")
_ENDING = tuple(".!?:;")
_OUTER = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "%$") + "“”‘’«»„…–—¿¡·"

PLAIN, NUMBER, UNIT, NAME, OPENING = range(5)
_HASHES = np.array([0, *[xxhash.xxh64_intdigest(f"<{x}>") for x in ("number", "unit", "name", "opening")]], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Forms from here on are whole sequences, of as many words as the form is above it.
WHOLE = 2
ENDS, EMPTY, IS_NUMBER, IS_UNIT, CAPITAL = 1, 2, 4, 8, 16


class _Words(dict):
    """Place of each word seen, with its flags, hash and value; what a word is by itself is found out once."""

    def __init__(self):
        super().__init__()
        self.values: list[str] = []
        self.hash, self.flag = array("Q"), array("B")

    def __missing__(self, word: str) -> int:
        if word.isalpha():
            core, flag = word, 0
        else:
            core = word.strip(_OUTER)
            flag = ENDS if word.rstrip("\"'”’»)]")[-1:] in _ENDING else 0
        low = core.lower()
        if not core:
            flag |= EMPTY
        elif low in NUMBERS or (not core.isalpha() and _NUMBER.fullmatch(core)):
            flag |= IS_NUMBER
        elif low in UNITS:
            flag |= IS_UNIT
        if low is not core and low != core and core[0].isupper() and (len(core) == 1 or not core.isupper()):
            flag |= CAPITAL
        self[word] = at = len(self.values)
        self.values.append(low)
        self.hash.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")))
        self.flag.append(flag)
        return at


def _windows(
    kind: np.ndarray, own: np.ndarray, at: np.ndarray, form: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(at) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool), kind, at
    code = np.where(kind == PLAIN, own, _HASHES[kind])
    code ^= code >> np.uint64(29)
    out = code[:n] * _MIX[form]
    for i in range(1, WINDOW):
        out += code[i : i + n] * _MIX[i]
        out ^= out >> np.uint64(31)
        out *= _MIX[form]
    plain = np.concatenate(([0], np.cumsum(kind == PLAIN)))
    return out, plain[WINDOW:] - plain[:-WINDOW] >= 2, kind, at


#: A fixed odd multiplier of whole sequences, and its inverse modulo 2 ** 64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _runs(own: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of `length` words."""
    n = len(own) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, back = (np.cumprod(np.r_[np.uint64(1), np.full(len(own) - 1, f, np.uint64)], dtype=np.uint64) for f in (_FACTOR, _INVERSE))
    sums = np.r_[np.uint64(0), np.cumsum(own * powers, dtype=np.uint64)]
    out = (sums[length:] - sums[:n]) * back[:n]
    return (out ^ (out >> np.uint64(31))) * np.uint64(_FACTOR) + np.uint64(length)


class Templates:
    """Template windows of texts; MEMO different words are remembered at most."""

    def __init__(self):
        self.words = _Words()

    def forms(self, text: str) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """For each form: (hashes, usable) of the windows; (kind, word) of each template word, to read slots from. And all words' hashes."""
        if len(self.words) > MEMO:
            self.words = _Words()
        split = text.split()
        at = np.fromiter(map(self.words.__getitem__, split), np.int64, len(split))
        # copies, as the arrays grow with the next text
        flag, own = np.array(self.words.flag, copy=None)[at], np.array(self.words.hash, copy=None)[at]
        opens = np.ones(len(at), bool)
        opens[1:] = flag[:-1] & ENDS > 0
        empty = flag & EMPTY > 0
        if empty.any():  # a lone mark that ends a sentence opens the next word
            for i in np.flatnonzero(empty):
                if i + 1 < len(at) and opens[i]:
                    opens[i + 1] = True
            at, flag, own, opens = at[~empty], flag[~empty], own[~empty], opens[~empty]
        kind = np.where(flag & CAPITAL > 0, NAME, PLAIN).astype(np.int8)
        kind[opens] = OPENING
        number = flag & IS_NUMBER > 0
        if number.any():
            behind = np.zeros(len(at), bool)
            behind[1:] = number[:-1]
            kind[(flag & IS_UNIT > 0) & behind] = UNIT
            kind[number] = NUMBER
        loose = np.where((kind == NUMBER) | (kind == UNIT), kind, PLAIN)
        again = np.zeros(len(at), bool)
        again[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME)
        second, words = _windows(loose, own, at, 1), own
        if again.any():
            at, kind, own = at[~again], kind[~again], own[~again]
        return [_windows(kind, own, at, 0), second], words

    def slots(self, kind: np.ndarray, at: np.ndarray, i: int) -> str:
        """Kinds and values of a window's placeholders, in order."""
        return "\x1f".join([f"{kind[k]}{self.words.values[at[k]]}" for k in range(i, i + WINDOW) if kind[k]])


_templates = Templates()


def template_windows(
    rows: DataFrame, key: str, text: str, sent: np.ndarray | None = None, whole: list[int] | None = None
) -> DataFrame:
    """(__key, form, pos, window, slots, n): usable windows, only those in the sorted hashes `sent` if given; n counts all usable ones of the row and form.

    Form WHOLE + m stands for m words in a row with their values: for each of the lengths `whole` all of them; without `whole`, as in items,
    the one of a whole text that has no usable window.
    """
    kind_of = rows.schema[key].dataType.simpleString()
    names = ["__key", "form", "pos", "window", "slots", "n"]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32())

    def known(hashes: np.ndarray) -> np.ndarray:
        if sent is None:
            return np.ones(len(hashes), bool)
        if not len(sent) or not len(hashes):
            return np.zeros(len(hashes), bool)
        return sent[np.minimum(np.searchsorted(sent, hashes), len(sent) - 1)] == hashes

    def found_in(text: str, i: int):
        forms, words = _templates.forms(text)
        usable = 0
        for form, (hashes, use, kind, at) in enumerate(forms):
            n = int(use.sum())
            usable += n
            if n:
                use = use & known(hashes)
            for j in np.flatnonzero(use).tolist():
                yield i, form, j, int(hashes[j].view(np.int64)), _templates.slots(kind, at, j), n
        lengths = whole if whole is not None else [] if usable or not len(words) else [len(words)]
        for length in lengths:
            if length >= MIN_WHOLE or length == len(words):
                hashes = _runs(words, length)
                for j in np.flatnonzero(known(hashes)).tolist():
                    yield i, WHOLE + length, j, int(hashes[j].view(np.int64)), "", 1

    def run(batches):
        for batch in pieces(batches):
            found: list[tuple] = []

            def out(batch=batch):
                place, *rest = (pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))
                return pa.RecordBatch.from_arrays([batch.column(0).take(place), *rest], names)

            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    found.extend(found_in(t, i))
                if len(found) > 50_000:
                    yield out()
                    found.clear()
            if found:
                yield out()

    return rows.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).mapInArrow(
        run, f"__key {kind_of}, form int, pos int, window bigint, slots string, n int"
    )


def aligned(hits: list[tuple]) -> list[tuple]:
    """At most one hit for each place of the document and of the item: the chain of most hits that rises in both, less one for each
    change of offset, of equal ones that of most equal slots; then likewise among the places that are left."""
    out = []
    while hits:
        if len({h[0] for h in hits}) == len({h[1] for h in hits}) == len(hits):
            return out + hits
        hits = sorted(hits, key=lambda h: (h[0], h[1]))
        mine, item = np.array([h[0] for h in hits]), np.array([h[1] for h in hits])
        own = 1 + np.array([h[2] == h[3] for h in hits]) / (2 * len(hits))
        total, before = own.copy(), np.full(len(hits), -1)
        for k in range(1, len(hits)):
            able = np.where((mine[:k] < mine[k]) & (item[:k] < item[k]), total[:k] - (mine[:k] - item[:k] != mine[k] - item[k]), 0)
            j = int(able.argmax())
            if able[j] > 0:
                total[k], before[k] = own[k] + able[j], j
        k, chain = int(total.argmax()), []
        while k >= 0:
            chain.append(hits[k])
            k = int(before[k])
        out += chain
        used, taken = {h[0] for h in chain}, {h[1] for h in chain}
        hits = [h for h in hits if h[0] not in used and h[1] not in taken]
    return out


def judge(hits: list[tuple], n: int, coverage: float) -> tuple | None:
    """hits: (place in the document, place in the item, slots there, slots here) of one document and item with n windows.

    Of the stretches that cover enough of the item and whose slots agree, the one that covers most, a verbatim one
    before others, as (coverage, verbatim, first and last aligned place); None if there is none.
    """
    hits.sort()
    length = max(h[1] for h in hits) + WINDOW
    best = None
    inside: Counter = Counter()
    high = 0
    for low, hit in enumerate(hits):
        while high < len(hits) and hits[high][0] - hit[0] <= length + length // 4:
            inside[hits[high][1]] += 1
            high += 1
        found = len(inside)
        inside[hit[1]] -= 1
        if not inside[hit[1]]:
            del inside[hit[1]]
        if found < coverage * n or (low and hits[low - 1][0] == hit[0]) or (best and (found, True) <= best[:2]):
            continue
        meant: dict[str, Counter] = defaultdict(Counter)
        placed = aligned(hits[low:high])
        for _, _, mine, other in placed:
            for a, b in zip(other.split("\x1f"), mine.split("\x1f")):
                if a:
                    meant[a][b] += 1
        total = sum(sum(c.values()) for c in meant.values())
        if sum(max(c.values()) for c in meant.values()) < coverage * total:
            continue
        same = sum(c[a] for a, c in meant.items()) >= total
        if best is None or (found, same) > best[:2]:
            best = (found, same, min(h[0] for h in placed), max(h[0] for h in placed) + WINDOW - 1)
    return best and (min(1.0, best[0] / n), *best[1:])


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    coverage: float = COVERAGE,
    max_sent: int = MAX_SENT,
) -> DataFrame:
    """(key, item, coverage, verbatim, first_word, last_word): each benchmark item that a document holds.

    Both keys have to be integers of different names, and not of the other columns'; rows whose key or text is null hold nothing and are no item, nor are
    texts without words. Rows of one key are judged together; equal items are found each. An empty table on either side gives no rows.
    Other columns are ignored, whatever their names.

    The benchmark's window hashes go to all tasks if there are at most max_sent, so that other windows of documents never leave them;
    if there are more, all are shuffled. Either way the join itself is one of (window) keys in Spark.
    """
    items = staged(template_windows(benchmark.filter(F.col(item_key).isNotNull()), item_key, item_text), "items")
    count = items.count()
    sent = None
    if count <= max_sent:
        sent = np.unique(np.array([r[0] for r in items.select("window").distinct().collect()], np.int64).view(np.uint64))
    # as many as there are lengths of items without windows
    whole = sorted(r[0] - WHOLE for r in items.filter(F.col("form") >= WHOLE).select("form").distinct().collect())
    mine = template_windows(docs.filter(F.col(key).isNotNull()), key, text, sent, whole)
    theirs = items.select(
        F.col("__key").alias("__item"),
        "form",
        F.col("pos").alias("__pos"),
        "window",
        F.col("slots").alias("__slots"),
        F.col("n").alias("__n"),
    )
    both = mine.join(theirs, ["window", "form"]).select(
        F.xxhash64("__key", "__item").alias("__pair"),
        F.col("__key").cast("long").alias("__key"),
        F.col("__item").cast("long").alias("__item"),
        "form",
        "__n",
        "pos",
        "__pos",
        "slots",
        "__slots",
    )

    def work(part: pa.Table):
        rows = defaultdict(list)
        for _, k, item, form, n, *hit in zip(*[c.to_pylist() for c in part.columns], strict=True):
            rows[k, item, form, n].append(tuple(hit))
        best: dict[tuple, tuple] = {}
        for (k, item, form, n), hits in sorted(rows.items()):
            if form >= WHOLE:
                found = (1.0, True, min(hits)[0], min(hits)[0] + form - WHOLE - 1)
            else:
                found = judge(hits, n, coverage)
            if found and ((k, item) not in best or found[0] > best[k, item][0]):
                best[k, item] = found
        out = [(*pair, *found) for pair, found in best.items()]
        if out:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t) for c,
                    t in zip(
                        zip(*out, strict=True),
                        (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()),
                        strict=True,
                    )
                ],
                ["key", "item", "coverage", "verbatim", "first_word", "last_word"],
            )

    out = grouped(
        both, "__pair", work, "key bigint, item bigint, coverage double, verbatim boolean, first_word bigint, last_word bigint"
    )
    return out.withColumnRenamed("key", key).withColumnRenamed("item", item_key)
