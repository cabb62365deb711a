"""Plain Python versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

SPACE = " \t\n\x0b\x0c\r"


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(raw: bytes | str) -> str:
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


def components(nodes, links) -> dict:
    """The smallest node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def line_dedup(docs: dict[int, str | None]) -> dict[int, tuple[int, int, str]]:
    """Lines, lines dropped and the text left."""
    key = lambda line: lower_ascii(line.strip(SPACE))
    holders = defaultdict(set)
    for doc_id, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc_id)
    gone = {k: max(ids) for k, ids in holders.items() if len(ids) >= 3}
    out = {}
    for doc_id, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), doc_id) == doc_id]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower_ascii(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def near_duplicates(docs: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """Fingerprint and component."""
    ids = sorted(docs)
    prints = {i: fingerprint(docs[i]) for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    found = components(ids, links)
    return {i: (prints[i], found[i]) for i in ids}


def suffix_dedup(docs: dict[int, str | None], length: int = 100) -> dict[int, tuple[int, int, bytes]]:
    """Bytes removed, runs and the bytes left."""
    seen, out = set(), {}
    for doc_id in sorted(docs):
        raw = (docs[doc_id] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if (part := raw[i : i + length]) in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(part)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out[doc_id] = (sum(gone), runs, bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


def usable(vector) -> bool:
    return vector is not None and len(vector) > 0 and all(v is not None and np.isfinite(v) for v in vector) and any(vector)


def vector_links(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    """rows: vec_id, embedding, label. Links and component of each."""
    good = [(i, np.array(v, dtype=float), y) for i, v, y in rows if usable(v) and y is not None]
    links = [(a, b) for k, (a, v, x) in enumerate(good) for b, w, y in good[k + 1 :] if x == y and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93]
    count = Counter(n for link in links for n in link)
    found = components([r[0] for r in rows], links)
    return {r[0]: (count[r[0]], found[r[0]]) for r in rows}
