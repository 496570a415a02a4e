"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
import sys

sys.set_int_max_str_digits(0)
KINDS = ("email", "ip", "card", "phone")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group(0))
    checks = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group(0).split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in zip(KINDS, checks) for m in re.finditer(p, text or "") if ok(m)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items, size=10):
    """doc -> (n_words, n_hit, n_items, items_sha256)."""
    windows = {}
    for i, text in items:
        w = alnum_words(text)
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + size]), set()).update([str(i)] if i is not None else [])  # no name, but its words are hit
    out = []
    for text in docs:
        w, hit, met = alnum_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    met |= found
        out.append((len(w), len(hit), len(met), sha(",".join(sorted(met)))))
    return out


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(docs, size=3, percent=85):
    """docs: id -> text. id -> (n_shingles, component)."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    least = {i: i for i in docs}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in docs}


def deduplicated(texts, least=50):
    """Texts in order; the same with later copies of runs of ``least`` words deleted."""
    seen, out = set(), []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        lines = text.split("\n")
        at = [k for k, line in enumerate(lines) if line.strip()]
        w = [len(lines[k].split()) for k in at]
        runs = set()
        for i in range(len(at)):
            for j in range(i + 1, len(at) + 1):
                if sum(w[i:j]) >= least:
                    runs.add((i, j))
                    break
            for j in range(i, -1, -1):
                if sum(w[j : i + 1]) >= least:
                    runs.add((j, i + 1))
                    break
        gone = set()
        for i, j in sorted(runs):
            key = tuple(lines[k] for k in at[i:j])
            if key in seen:
                gone |= set(range(at[i], at[j] if j < len(at) else len(lines)))
                # a blank line goes with the line with words before it
            seen.add(key)
        out.append("\n".join(line for k, line in enumerate(lines) if k not in gone))
    return out
