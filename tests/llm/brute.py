"""Plain Python versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall(lower(text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def closed(links: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    root = {n: n for n in nodes}

    def find(n: int) -> int:
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def similar(docs: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    sets = {i: shingle_set(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common: dict[tuple[int, int], int] = defaultdict(int)
    for held in holders.values():
        for k, a in enumerate(held):
            for b in held[:k]:
                common[min(a, b), max(a, b)] += 1
    links = [
        (a, b)
        for (a, b), n in common.items()
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]
    part = closed(links, list(sets))
    return {i: (len(s), part[i]) for i, s in sets.items()}


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(repeated),
        len(words) < 10 or 100 * len(repeated) > 20 * len(words),
    )


def conversations(rows: list[tuple]) -> dict[int, tuple[int, str, int, str]]:
    """rows: conv_id, turn, role, text."""
    import hashlib

    out = {}
    held = defaultdict(list)
    for conv_id, turn, role, text in rows:
        held[conv_id].append((turn, role, text or ""))
    for conv_id, turns in held.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss)]
        out[conv_id] = (len(turns), digest[0], len(loss), digest[1])
    return out


def without_repeats(docs: list[tuple[int, str | None]], size: int = 50) -> dict[int, tuple[int, int, int, str]]:
    import hashlib

    texts = {i: (t or "").encode() for i, t in docs}
    first: dict[bytes, int] = {}
    for i in sorted(texts):
        t = texts[i]
        for k in range(len(t) - size + 1):
            first.setdefault(t[k : k + size], i)
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if first[t[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
