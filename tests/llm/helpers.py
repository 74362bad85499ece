"""Small corpora with every awkward case, and plain restatements of what the operators compute."""

from __future__ import annotations

import hashlib
import math
import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, count int, rank string"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "tu") for b in ("ren", "sol", "vat", "dim", "pek") for c in ("a", "os", "in", "urn", "ely")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls, empty and long texts, equal texts, repeated rows, one doc_id with two texts, and columns with clashing names."""
    base, long = prose(1, 200), prose(2, 30_000)
    lines = "\n".join(prose(100 + i, 12) for i in range(8))
    row = lambda i, t, lang="en": (i, t, lang, "s", len(t) if t else None, 1, "r")
    rows = [row(0, base), row(1, base), row(2, "x" + base[1:]), row(3, None), row(4, ""), row(5, " \n\t "), row(6, long), row(7, long + " tail"), row(8, lines), row(9, "head line\n" + lines + "\nlast"), row(10, "12 34 !! ..", None)]
    rows += [row(11, "a"), row(11, "a"), row(12, prose(3, 40)), row(12, prose(4, 40)), row(None, base), row(13, "é" * 150 + " naïve ☃ ▁ " + "é" * 150), row(14, "ab" * 400), row(15, prose(5, 300) + "\n" + base)]
    return rows


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


def cut(raw: bytes, covered: list[bool]) -> tuple[int, int, int, str]:
    kept = bytes(b for b, c in zip(raw, covered) if not c)
    runs = sum(c and not p for p, c in zip([False, *covered], covered))
    return len(raw), sum(covered), runs, digest(kept)


def in_order(rows: list[tuple]) -> list[tuple]:
    """Distinct (doc_id, text) in the order of doc_id, null first."""
    return sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0))


def removed_windows(docs: list[tuple], k: int) -> dict[tuple, tuple]:
    """(doc_id, text) -> (bytes, removed, spans, digest) of distinct documents in order, if every k-byte string that starts earlier too is removed."""
    seen, out = set(), {}
    for doc_id, text in docs:
        raw = (text or "").encode()
        covered = [False] * len(raw)
        for i in range(len(raw) - k + 1):
            if raw[i : i + k] in seen:
                covered[i : i + k] = [True] * k
            seen.add(raw[i : i + k])
        out[doc_id, text] = cut(raw, covered)
    return out


def is_letter(byte: int) -> bool:
    return byte >= 128 or 65 <= byte <= 90 or 97 <= byte <= 122


def plain_words(text: str) -> list[list[int]]:
    """Buckets of the trigrams around each byte of each word of letters, lower-cased, where bytes between words read as spaces."""
    raw = text.encode()
    low = [(b + 32 if 65 <= b <= 90 else b) if is_letter(b) else 32 for b in raw]
    words, own = [], []
    for i, b in enumerate(raw):
        if is_letter(b):
            before, after = low[i - 1] if i else 32, low[i + 1] if i + 1 < len(raw) else 32
            own.append(((((before << 16) | (low[i] << 8) | after) * 2654435761) % 2**32) >> 16)
        elif own:
            words.append(own)
            own = []
    return words + [own] * bool(own)


def plain_model(rows: list[tuple]) -> dict[str, dict]:
    """lang -> log-probability of each bucket, of (text, lang) rows."""
    counts: dict[str, list[float]] = {}
    for text, lang in rows:
        if text is not None and lang is not None and plain_words(text):
            own = counts.setdefault(lang, [0.5] * 65536)
            for w in plain_words(text):
                for g in w:
                    own[g] += 1
    totals = {lang: math.log(sum(own)) for lang, own in counts.items()}
    return {lang: [math.log(x) - totals[lang] for x in own] for lang, own in sorted(counts.items())}


def plain_mixture(logs: list[list[float]], penalty: float = 2.0) -> list[float]:
    """Language proportions of words with these log-likelihoods (one list for each word)."""
    like = [[math.exp(x - max(w)) for x in w] for w in logs]
    n = len(logs[0])

    def em(share, rounds):
        for _ in range(rounds):
            total = [0.0] * n
            for w in like:
                joint = [a * b for a, b in zip(w, share)]
                for k, x in enumerate(joint):
                    total[k] += x / max(sum(joint), 1e-30) / len(like)
            share = total
        return share, sum(math.log(max(sum(a * b for a, b in zip(w, share)), 1e-30)) for w in like)

    full, _ = em([1 / n] * n, 8)
    lead = sorted(range(n), key=lambda k: -full[k])
    best, best_value = full, -math.inf
    for size in range(1, n + 1):
        start = [max(full[k], 1e-6) if k in lead[:size] else 0.0 for k in range(n)]
        share, value = em([x / sum(start) for x in start], 3 if size > 1 else 0)
        value -= penalty * (size - 1) * 0.5 * math.log(max(len(like), 2))
        if value > best_value:
            best, best_value = share, value
    return best


def plain_language(text: str | None, model: dict[str, list[float]]) -> tuple[str, float, float]:
    """(language, its proportion, mean log-likelihood per trigram under the mixture)."""
    words = plain_words(text) if text else []
    if not words or not model or not any(c.isalpha() for c in text):
        return "und", 0.0, -math.inf
    logs = [[sum(own[g] for g in w) for own in model.values()] for w in words]
    share = plain_mixture(logs)
    top = max(range(len(share)), key=lambda k: (share[k], -k))
    fit = sum(max(w) + math.log(max(sum(s * math.exp(x - max(w)) for s, x in zip(share, w)), 1e-30)) for w in logs)
    return list(model)[top], share[top], fit / sum(map(len, words))
