"""The characters of JIS X 0208 and GB 2312 by row and cell."""

from __future__ import annotations

#: What stands for a cell without a character.
EMPTY = "�"


def _table(codec: str) -> str:
    """The characters of the 94 by 94 cells in their order, one a cell."""
    cells = [bytes([0xA1 + r, 0xA1 + c]).decode(codec, "replace") for r in range(94) for c in range(94)]
    return "".join(x if len(x) == 1 else EMPTY for x in cells)


JIS, GB = _table("euc_jp"), _table("gb2312")
CHARS = JIS.replace(EMPTY, "")


def row(n: int) -> str:
    """The characters of row n, from 1."""
    return JIS[94 * (n - 1) : 94 * n].replace(EMPTY, "")
