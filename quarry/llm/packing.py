"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs its own rows. A document's tokens fill whole windows first; what is left is placed
online: for every fill level h the number N(h) of open windows at that level is kept in an array, and the piece of
s tokens goes to the level (or a new window) for which the sum of N(h) squared grows least. Windows that reach the length
close. When more windows stand open than memory is set aside for, half of them are settled: the
emptiest are cut up to fill the fullest exactly, and the level array goes on from those that stay open. At a task's end all are, and the last one
is cut into windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 4096
#: Open windows of one task before half of them are settled: 512 windows of 4096 four-byte ids are 8 MB.
MAX_OPEN = 512
MEMO = 500_000

_encoders: dict[str, WordEncoder] = {}


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(0x21, 0x180)) if unicodedata.category(c)[0] == kind)


#: How the supported tokenizers cut lower-case text into words: runs of letters, contractions, single numerals, runs of other marks. Of
#: the characters in _SIMPLE, which are composed already and which no version of Unicode classes differently; \u0307 comes from lowering.
WORDS = re.compile(rf"[{_class('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{_class('N')}]|[^\t\n\r \xa0{_class('L')}{_class('N')}]+")
_SIMPLE = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u017f]*")
#: The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


#: The rules of a tokenizer file that WORDS follows.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def cut_by_words(config: dict) -> bool:
    """Whether a tokenizer file's normalizer and pre-tokenizer are those of WORDS, and its model gives a word the same ids each time."""
    plain = not any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in config.get("added_tokens", ()))
    return config.get("normalizer") == _NORMALIZER and config.get("pre_tokenizer") == _CUTS and plain and not config["model"].get("dropout")


class _Remembered(dict):
    """Ids of words; a missing one is encoded by the tokenizer's model."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(_BYTES))]
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class WordEncoder:
    """Ids of whole texts by a tokenizer file; each different word is encoded once and remembered if the file's rules are those of WORDS.

    Then common texts are cut into words here and each new word goes through the tokenizer's own model; a text with
    other characters, or one that might hold an added token, goes through the whole tokenizer. With any other rules all texts do. The memory is emptied
    when MEMO words are in it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = _Remembered(self.tokenizer.model)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.by_words = cut_by_words(json.load(f))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            if not self.by_words or not _SIMPLE.fullmatch(text) or any(t in text for t in self.added):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            if len(self.memo) > MEMO:
                self.memo.clear()
            out.append(b"".join(map(self.memo.__getitem__, WORDS.findall(text.lower()))))
        return out


def encoder(path: str) -> WordEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Windows of `length` ids. Pieces are (document, start, ids); closed windows wait in `closed`."""

    def __init__(self, length: int = LENGTH, max_open: int = MAX_OPEN):
        self.length, self.max_open = length, max_open
        self.count = np.zeros(length + 1, np.int64)  # N(h); N(0) and N(length) stay 0
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.closed: list[list[tuple]] = []

    def add(self, doc, ids: bytes) -> None:
        whole = len(ids) // 4 // self.length * self.length
        for at in range(0, whole, self.length):
            self.closed.append([(doc, at, ids[at * 4 : (at + self.length) * 4])])
        if len(ids) // 4 > whole:
            self.place((doc, whole, ids[whole * 4 :]), len(ids) // 4 - whole)

    def place(self, piece: tuple, size: int) -> None:
        n, top = self.count, self.length
        # growth of the sum for a window of level h: it leaves N(h) and joins N(h + size); level `length` isn't counted
        levels = np.arange(1, top - size + 1)
        after = n[size + 1 :].copy()
        growth = 2 * (after - n[1 : top - size + 1]) + 2
        if len(growth):
            growth[-1] = 1 - 2 * n[top - size]
        growth = np.where(n[1 : top - size + 1] > 0, growth, np.iinfo(np.int64).max)
        level = 0
        if len(growth):
            best = len(growth) - 1 - int(np.argmin(growth[::-1]))  # ties: the fullest
            if growth[best] <= 2 * n[size] + 1:
                level = int(levels[best])
        window = [] if not level else self._take(level)
        window.append(piece)
        self._put(window, level + size)
        if self.n_open > self.max_open:
            self._settle(self.max_open // 2)

    def _take(self, level: int) -> list[tuple]:
        window = self.open[level].pop()
        self.count[level] -= 1
        self.n_open -= 1
        return window

    def _put(self, window: list[tuple], level: int) -> None:
        if level == self.length:
            self.closed.append(window)
        elif level:
            self.open.setdefault(level, []).append(window)
            self.count[level] += 1
            self.n_open += 1

    def _settle(self, keep: int) -> None:
        """Until at most `keep` windows are open: fills the fullest with pieces cut from the emptiest. The level array follows each move, so that
        later pieces are still placed by the sum of squares of all windows that are open."""
        while self.n_open > max(keep, 1):
            level = int(np.flatnonzero(self.count)[-1])
            window, room = self._take(level), self.length - level
            while room and self.n_open:
                low = int(np.flatnonzero(self.count)[0])
                donor = self._take(low)
                while room and donor:
                    doc, start, ids = donor.pop()
                    size = len(ids) // 4
                    if size > room:
                        donor.append((doc, start, ids[: (size - room) * 4]))
                        start, ids, size = start + size - room, ids[(size - room) * 4 :], room
                    window.append((doc, start, ids))
                    room -= size
                    low -= size
                self._put(donor, low)
            self._put(window, self.length - room)

    def finish(self) -> None:
        """Settles what is open and cuts the last window into powers of two."""
        self._settle(1)
        rest = [p for windows in self.open.values() for w in windows for p in w]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        left = sum(len(p[2]) for p in rest) // 4
        rest.reverse()
        while left:
            room = size = 1 << (left.bit_length() - 1)
            window = []
            while room:
                doc, start, ids = rest.pop()
                take = min(room, len(ids) // 4)
                if take < len(ids) // 4:
                    rest.append((doc, start + take, ids[take * 4 :]))
                window.append((doc, start, ids[: take * 4]))
                room -= take
            self.closed.append(window)
            left -= size


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    max_open: int = MAX_OPEN,
) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece of a document.

    ids are little-endian unsigned 32-bit integers. Every document ends with end_id, so a null or empty text is one piece with that id alone.
    sequence_id is the task's number in the upper bits and a counter; offsets run gapless from 0. Null keys and repeated rows are
    packed like others; an empty table gives no rows; other columns are ignored.

    No shuffle: a task packs what it reads, in bounded memory, and repeats the same result if it is run again.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        base, made, packer, keys_type = TaskContext.get().partitionId() << 33, 0, Packer(length, max_open), None

        def out():
            nonlocal made
            rows = []
            for window in packer.closed:
                at = 0
                for (doc, total), start, ids in window:
                    n = len(ids) // 4
                    rows.append((doc, start, n, ids, total, base + made, at))
                    at += n
                made += 1
            packer.closed = []
            for i in range(0, len(rows), 2048):
                cols = list(zip(*rows[i : i + 2048], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, t) for c,
                        t in zip(
                            cols,
                            (keys_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()),
                            strict=True,
                        )
                    ],
                    names,
                )

        for batch in batches:
            keys_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, ids in zip(
                    part.column(0).to_pylist(), encoder(tokenizer).encode(part.column(1).to_pylist()), strict=True
                ):
                    ids += end
                    packer.add((doc, len(ids) // 4), ids)
                yield from out()
        packer.finish()
        if packer.closed:
            yield from out()

    rows = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    return rows.mapInArrow(
        run, f"`{key}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
