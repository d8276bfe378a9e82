"""Values of options as text."""

from __future__ import annotations


def memory_entries(size: str) -> int:
    """How many 4-byte entries fit into a size such as 512M or 2G; other suffixes are refused."""
    units = {"M": 10**6, "G": 10**9}
    text = size.strip()
    if len(text) < 2 or text[-1].upper() not in units or not text[:-1].isdigit():
        raise ValueError(f"a size is a whole number and M or G, not {size!r}")
    return int(text[:-1]) * units[text[-1].upper()] // 4


def policy(text: str, parts: int = 2) -> list[str]:
    """A comma-separated list of strategy names, one for each part."""
    names = [x.strip() for x in text.split(",")]
    if len(names) != parts or not all(names):
        raise ValueError(f"a policy names {parts} strategies, not {text!r}")
    return names
