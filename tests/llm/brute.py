"""The operators once more, each in the plainest way, for small tables."""

from __future__ import annotations

import re

import xxhash

from leafmill.llm import linededup, quality


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", s or "") if w]


def alnum(s):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s)) if w]


def components(n, pairs):
    of = list(range(n))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def fingerprint(s):
    w = lower(s).encode()
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(docs):
    """Component (place of its first document) of each text."""
    fps = [fingerprint(t) for t in docs]
    return fps, components(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])


def line_classes(lines):
    """Class of each different line."""
    return components(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= 2 and edit_distance(lines[i], lines[j]) <= 2])


def dedup_lines(docs):
    """Lines of each (text) that stay; documents in order of their ids. Lines without words stay, short ones go where they are equal."""
    spoken = {x for t in docs for x in (t or "").split("\n") if words(x)}
    own = sorted(x for x in spoken if len(x) >= linededup.LONG)
    of = dict(zip(own, line_classes(own), strict=True)) | {x: x for x in spoken if len(x) < linededup.LONG}
    seen, out = set(), []
    for t in docs:
        kept = []
        for x in (t or "").split("\n"):
            if x in of:
                if of[x] in seen:
                    continue
                seen.add(of[x])
            kept.append(x)
        out.append(kept)
    return out


def line_fails(line):
    chars, n = len("".join(words(line))), len(words(line))
    symbols = sum(c in quality.SYMBOLS for c in line)
    marks = sum(c in quality.SEPARATORS for c in line)
    shout = 2 * line.count("!!")
    found = len(re.findall(quality.BOILERPLATE, line.lower()))
    boiler = found and found * quality.BOILERPLATE_WORDS >= n
    off = line.rstrip(" \t\n\v\f\r])").endswith(("...", "…"))
    own = re.findall(f"[{quality._LETTERS}]+", line.lower())
    menu = sum(x in quality.MENU for x in own)
    if off or (own and own[0] in quality.MENU and menu >= quality.MENU_LEAST and 2 * menu >= len(own)):
        return True
    return 100 * symbols > quality.MAX_SYMBOL_PERCENT * chars or (shout > n and n >= quality.SHOUT_WORDS) or (marks >= 3 and 4 * marks >= n) or bool(boiler)


def judge(text):
    """(base_failed, kept, clean text)."""
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else _twice(grams)
    hit = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    base = len(w) < quality.MIN_WORDS or 100 * len(hit) > quality.MAX_REPEAT_PERCENT * len(w)
    lines = (text or "").split("\n")
    lost = sum(len("".join(words(x))) for x in lines if line_fails(x))
    kept = not base and 100 * lost <= quality.MAX_LOST_PERCENT * len("".join(w))
    return base, kept, "\n".join(x for x in lines if not line_fails(x))


def _twice(grams):
    from collections import Counter

    return {g for g, n in Counter(grams).items() if n > 1}


def contaminated(texts, items):
    """Items with an occurring window, for each text."""
    windows = {}
    for k, t in items:
        w = alnum(t)
        n = min(8, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    sizes = {len(g) for g in windows}
    out = []
    for t in texts:
        w = alnum(t)
        out.append(set().union(*[windows.get(tuple(w[i : i + n]), set()) for n in sizes for i in range(len(w) - n + 1)]) if sizes else set())
    return out
