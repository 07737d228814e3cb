"""Header clean-up: names only, no data."""

from __future__ import annotations

import re

from tabwright.columns import BLANKS

# Names that spreadsheets give to columns without a header.
PLACEHOLDER = re.compile(r"__EMPTY(_[0-9]+)?")
UNNAMED = "列{position}"


def clean_names(raw: list[str | None]) -> tuple[list[str], bool]:
    """Trimmed, non-empty, distinct names, and whether a repeat was renamed."""
    names: list[str] = []
    renamed = False
    for position, text in enumerate(raw, start=1):
        base = (text or "").strip(BLANKS) or UNNAMED.format(position=position)
        name, suffix = base, 1
        while name in names:
            suffix += 1
            name = f"{base}_{suffix}"
        renamed = renamed or name != base
        names.append(name)
    return names, renamed


def drop_placeholders(raw: list[str | None]) -> list[int]:
    """Positions of the columns to keep."""
    return [i for i, text in enumerate(raw) if not PLACEHOLDER.fullmatch(text or "")]
