"""Why a file can't be opened: a closed set, all of them ``OpenError``."""

from __future__ import annotations


class OpenError(ValueError):
    """A file that can't be opened; the message says why."""


class Unreadable(OpenError):
    """It isn't there, is a directory where a file is needed, or can't be read."""


class UnrecognizedFormat(OpenError):
    def __init__(self, path: str):
        super().__init__(f"unrecognized format: {path}")


class EmptyFile(OpenError):
    def __init__(self) -> None:
        super().__init__("empty file: no data to read")


class SingleColumnFile(OpenError):
    def __init__(self) -> None:
        super().__init__("single-column file: only the time index is present, no data series to plot")


class InvalidTimestamp(OpenError):
    """Cells of the time column that a chosen format doesn't read."""

    def __init__(self, cells: int, fmt: str):
        super().__init__(f"invalid timestamp: {cells} cells are not {fmt}")
        self.cells, self.format = cells, fmt


class BudgetExceeded(OpenError):
    """Refused before reading: the file would need more memory than the budget."""

    def __init__(self, needed: int, cap: int):
        super().__init__(f"operation needs {needed} bytes, over the {cap}-byte memory budget (a quarter of the memory, at most 4 GiB)")
        self.needed, self.cap = needed, cap
