"""Characters that all Unicode tables agree on.

The tokenizers' library, Python and its regex module bring tables of different Unicode versions. They can differ where characters
were assigned lately only: what Unicode 3.2 has (which Python keeps a table of), and the blocks of ideographs and
emoji named here, is cut, composed and lowered alike by all; tests/llm compares them. The one rule that is not by
character is Python's final sigma.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

#: Whole blocks besides Unicode 3.2's part of the first plane.
FURTHER = ((0x1F000, 0x1FAFF), (0x20000, 0x2A6D6))


def _settled_ranges() -> list[tuple[int, int]]:
    known = (c for c in range(0x10000) if unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs"))
    runs = [[c for _, c in run] for _, run in groupby(enumerate(known), lambda x: x[1] - x[0])]
    return [(r[0], r[-1]) for r in runs] + list(FURTHER)


_LATE = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _settled_ranges()) + "]")


def agreed(text: str) -> bool:
    """Whether all tables treat the text alike."""
    return text.isascii() or _LATE.search(text) is None


def lowered(text: str) -> str:
    """Composed (NFC) and in lower case, each character by itself."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
