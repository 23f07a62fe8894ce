"""Plain single-process versions of the operators' contracts."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SECRET = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    "access": (r"AKIA[A-Z0-9]+", re.A, 0, 20),
    "hex": (r"[0-9a-f]+", re.A, 0, 24),
}


def secrets(text):
    text = text or ""
    found = []
    for rank, (kind, (pattern, flags, group, least)) in enumerate(SECRET.items()):
        for m in re.finditer(pattern, text.replace("\u017f", "\0").replace("\u212a", "\0") if kind == "assign" else text, flags):
            if len(m[group]) >= least:
                found.append((m.start(), rank, kind, m.end()))
    found.sort()
    n = Counter(k for _, _, k, _ in found)
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()
    return n["assign"], n["access"], n["hex"], digest


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    at = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if at[tuple(w[i:i + 3])] > 1:
            hit.update((i, i + 1, i + 2))
    n = len(w)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
            "base_failed": n < 50 or 100 * len(hit) > 50 * n}


def simhash(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, near):
    """Smallest index reachable, for ``near(i)`` giving a mask of neighbours."""
    label = np.arange(n)
    while True:
        new = np.array([min(label[i], label[near(i)].min(initial=n)) for i in range(n)], int)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def simhash_components(rows):
    """rows: (doc_id, text). {doc_id: (fingerprint, component_id)} of non-null, unique ids."""
    rows = sorted(rows)
    f = np.array([simhash(t) for _, t in rows], dtype=np.uint64)
    label = components(len(f), lambda i: np.bitwise_count(f ^ f[i]) <= 4)
    return {d: (f"{int(x):016x}", rows[i][0]) for (d, _), x, i in zip(rows, f, label)}


def pieces_hold(pieces, docs, encode, size=2048, end=1):
    """Whether the pieces (dicts) are the documents' ids cut into full sequences."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids = np.array(encode(text or "") + [end], "<u4")
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for k, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == size or k == max(by_sequence) and at <= size
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return True


def pii(text):
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        double = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(double) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            found.append(("phone", *m.span()))
    n = Counter(k for k, _, _ in found)
    spans = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(spans.encode()).hexdigest(), found


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(w)):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def warc(pages):
    """pages: (page_id, html), ids unique and not null."""
    first, out = {}, {}
    for page, html in sorted(pages):
        data = (html or "").encode()
        one = first.setdefault(data, page)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[page] = (len(data), digest, "response" if one == page else "revisit", None if one == page else one)
    return out


def unigram(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)} for (doc_id, text)."""
    tokens = {d: [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(t)] + [None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    count = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    return {d: (held[d], len(ws), sum(count[w] > 0 for w in ws), n,
                sum(np.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ws)) for d, ws in tokens.items()}
