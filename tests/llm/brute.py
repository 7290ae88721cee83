"""Plain re-statements of the operators, for small tables."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, width: int) -> set:
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near_components(texts: dict[int, str | None], width: int = 2, percent: int = 80) -> dict[int, int]:
    """Least reachable id of each id."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    at: dict = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in sets.items():
        common: dict = {}
        for x in s:
            for j in at[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


def repeated_bytes(texts: dict[int, str | None], length: int = 100) -> dict[int, tuple[int, int, bytes]]:
    """n_removed, n_spans and the bytes left, by id."""
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


def thue_morse(n: int) -> str:
    """A word of n letters whose complement has the same hash under any polynomial modulo a power of two."""
    return "".join("ab"[k.bit_count() & 1] for k in range(n))
