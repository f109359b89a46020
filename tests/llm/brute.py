"""Plain restatements of the contracts, one text or one small table at a time."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def components(rows, n, percent):
    """(size, component) per row; rows without words are on their own."""
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        known = [k for k in least[find(i)] if k is not None]
        out.append((key, len(sets[i]), key if not sets[i] else min(known) if known else None))
    return out


def repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if times[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        rest = bytes(c for c, g in zip(t, gone) if not g)
        out.append((key, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(rest)))
    return out


def personal(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1])) % 10 == 0
    found = [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    ]
    listed = [f"{k}:{a}:{b}" for k, spans in zip(("email", "ip", "card", "phone"), found) for a, b in spans]
    return (*map(len, found), sha(",".join(listed))), listed


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    listed = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]
    return (*(sum(s[1] == k for s in spans) for k in range(3)), sha(",".join(listed))), listed


def contaminated(rows, items, n):
    patterns = defaultdict(set)
    for item, text in items:
        w = PLAIN.findall(lower(text))
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if k else ():
            patterns[tuple(w[i:i + k])].add(str(item) if item is not None else "")
    lengths = {len(p) for p in patterns}
    out = []
    for key, text in rows:
        w = PLAIN.findall(lower(text))
        hit, names = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (got := patterns.get(tuple(w[i:i + k]))) is not None:
                    hit.update(range(i, i + k))
                    names |= got
        out.append((key, len(w), len(hit), sorted(names)))
    return out
