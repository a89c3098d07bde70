"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def covered_units(docs, units, size):
    """docs: (id, text). Flags per unit; first occurrence by (id, start)."""
    seen = {}
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    flags = {}
    for doc, text in ordered:
        parts = units(text)
        gone = [False] * len(parts)
        for start in range(len(parts) - size + 1):
            window = parts[start : start + size] if isinstance(parts, bytes) else tuple(parts[start : start + size])
            if seen.setdefault(window, (doc, start)) != (doc, start):
                gone[start : start + size] = [True] * size
        flags[doc] = (parts, gone)
    return flags


def words_removed(docs, size=20):
    out = {}
    for doc, (parts, gone) in covered_units(docs, lambda t: (t or "").encode().split(), size).items():
        kept = b" ".join(p for p, g in zip(parts, gone) if not g)
        out[doc] = (len(parts), sum(gone), sha(kept))
    return out


def bytes_removed(docs, size=100):
    out = {}
    for doc, (parts, gone) in covered_units(docs, lambda t: (t or "").encode(), size).items():
        kept = bytes(p for p, g in zip(parts, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(parts), sum(gone), runs, sha(kept))
    return out


def fingerprint(text, shingle=3):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(gram), 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def linked(prints, radius=3):
    """prints: {id: fingerprint} -> {id: smallest id reachable}."""
    names = sorted(prints, key=lambda d: (d is not None, d or 0))
    found = {}
    for name in names:
        if name in found:
            continue
        queue = [name]
        found[name] = name
        while queue:
            at = queue.pop()
            for other in names:
                if other not in found and (prints[at] ^ prints[other]).bit_count() <= radius:
                    found[other] = name
                    queue.append(other)
    return found


def quality(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for window in windows:
        counts[window] = counts.get(window, 0) + 1
    again = {i + k for i, window in enumerate(windows) if counts[window] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again),
    )


def lines_left(docs, min_lines=3, min_words=50):
    """docs: (id, text) -> {id: (worded lines, removed, text)}"""
    import re

    worded = re.compile(r"[^\x20\x09-\x0D]").search
    seen, out = {}, {}
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        if text is None:
            out[doc] = (0, 0, None)
            continue
        lines = text.split("\n")
        places = [p for p, line in enumerate(lines) if worded(line)]
        gone = set()
        for i in range(len(places)):
            # every longer run is made of runs of two lines or more that share a line
            for n in range(1, min(max(min_lines, 2), len(places) - i) + 1):
                block = tuple(lines[p] for p in places[i : i + n])
                enough = n >= min_lines or sum(len(re.findall(r"[^\x20\x09-\x0D]+", line)) for line in block) >= min_words
                if enough and seen.setdefault(block, (doc, i)) != (doc, i):
                    gone |= set(range(places[i], places[i + n - 1] + 1))
        left = [line for p, line in enumerate(lines) if p not in gone]
        out[doc] = (len(places), sum(p in gone for p in places), "\n".join(left))
    return out


def conversations(rows):
    """rows: (conv, turn, role, text) -> {conv: (turns, digest of turns, loss length, digest of loss)}"""
    by_id = {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, held in by_id.items():
        held.sort()
        loss = "".join(text for _, _, role, text in held if role == "assistant")
        body = "".join(f"{role}\n{text}\n" for _, _, role, text in held)
        out[conv] = (len(held), sha(body.encode()), len(loss), sha(loss.encode()))
    return out
