"""Key specifications: the four keys of the native record, or any columns."""

from __future__ import annotations

from collections.abc import Sequence

RECID, NUM, STR, NUM_STR = 0, 1, 2, 3

_FIELD_COLUMNS = {RECID: ("recid",), NUM: ("num",), STR: ("str",), NUM_STR: ("num", "str")}

MIN_MEMORY_BLOCKS = 3


def resolve_key(key: int | str | Sequence[str], columns: Sequence[str]) -> list[str]:
    """Turn a field number (0 to 3), a column name or a list of names into key columns.

    Raises ValueError for an unknown field number, an empty list, a name that
    occurs twice or one that ``columns`` lacks.
    """
    if isinstance(key, bool) or (isinstance(key, int) and key not in _FIELD_COLUMNS):
        raise ValueError(f"unknown key field {key!r}: expected 0, 1, 2 or 3")
    if isinstance(key, int):
        names = list(_FIELD_COLUMNS[key])
    elif isinstance(key, str):
        names = [key]
    else:
        names = list(key)
    if not names:
        raise ValueError("a key needs at least one column")
    if len(set(names)) != len(names):
        raise ValueError(f"a key column occurs twice: {names}")
    missing = [n for n in names if n not in columns]
    if missing:
        raise ValueError(f"key columns {missing} are not among {list(columns)}")
    return names


def check_memory_blocks(nmem_blocks: int) -> None:
    """Every operator needs three blocks of memory at least."""
    if nmem_blocks < MIN_MEMORY_BLOCKS:
        raise ValueError(f"at least {MIN_MEMORY_BLOCKS} memory blocks are needed, got {nmem_blocks}")
