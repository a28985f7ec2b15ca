"""What to search for and how results are shaped; no Spark here."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchSpec:
    """One search. fixed wins over a regular expression reading of pattern; an empty pattern matches every line.

    byte_mode matches over the UTF-8 bytes, one character each, instead of code points. With opens a final line end opens one more, empty line,
    as splitting by SQL does, and an empty text is one empty line.
    """

    pattern: str
    fixed: bool = False
    ignore_case: bool = False
    invert: bool = False
    whole_word: bool = False
    byte_mode: bool = False
    max_count: int | None = None
    before: int = 0
    after: int = 0
    opens: bool = False

    def __post_init__(self):
        if "\n" in self.pattern:
            raise ValueError("a pattern is matched against single lines and can't hold a line end")
        if self.max_count is not None and self.max_count < 0:
            raise ValueError("max_count is 0 or more")
        if self.before < 0 or self.after < 0:
            raise ValueError("context is 0 lines or more")
