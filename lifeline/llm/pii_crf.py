"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field.

The patterns give the base spans (email, ip, card, phone). The field then reads every
zone of a text that holds digits, an at sign or a spelled one: candidate segments of up
to ``LONGEST`` tokens are scored as wholes (shape, digits, check sum, length, cue words
before), and one dynamic program over the zone chooses boundaries and types together, at
a cost linear in its tokens. Segments it finds beyond the base (numbers without a plus
sign, spelled-out addresses) are added if they beat the reading without them clearly.

It is trained here by gradient ascent on the log-likelihood. Labels come from the base
spans of at most ``sample`` zones (documented bound, chosen by hash: of the first four zones
of a document those of up to 400 characters), each also rewritten in forms the base does not
know, with and without a cue before it, and from the unlabelled rest of the zones. Segments
of several tokens stay on one line and within 80 characters.

Offsets are code points. Defined results: null texts are empty and have no spans; repeated
rows are judged each on its own; an empty table gives an empty table (the model then rests
on built-in examples); input columns named like an added one are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline.llm.columns import without

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
LONGEST = 12             # tokens of a segment; a spelled address of five labels has eleven
MARGIN = 1.0             # log odds a segment must have over leaving its tokens out
ADDED = ("pii_base", "pii_spans")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Starting inside a run of digits never helps, so these look at run starts only.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]      # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Around each at sign, so that no run of letters is tried from every place in it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield 0, start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    spans = list(emails(text))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(digits := only_digits(m[0])) <= 19 and luhn(digits):
            spans.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            spans.append((3, *m.span()))
    return spans


# Zones, segments and features

TOKEN = re.compile(r"[^\s,;:!?#*$&<>|\"'\[\]{}]+")
TRIGGER = re.compile(r"[0-9@]|\b(?:at|AT)\b")
STRONG = re.compile(r"@|[0-9]{3}|\(at\)|(?i:\bat [A-Za-z0-9-]+ dot\b)")
BORDER = re.compile(r"[ \n]")
NEAR = 3                 # tokens kept around a trigger
CUES = {
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax"), "email": ("mail", "email", "contact"),
    "card": ("card", "visa", "credit", "payment"), "ip": ("ip", "host", "server", "address"),
}
SHAPES = (
    ("email", re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+")),
    ("spelled", re.compile(r"(?i)[\w.%+-]+ (at|\(at\)) [\w-]+( (dot|\(dot\)) [\w-]+| ?\.[\w.-]+)*( (dot|\(dot\)) [\w-]+)")),
    ("half", re.compile(r"(?i)[\w.%+-]+ (at|\(at\)) [\w-]+(\.[\w-]+)+")),
    ("ip", re.compile(r"([0-9]{1,3}\.){3}[0-9]{1,3}")),
    ("plus", re.compile(r"\+[0-9][ ().0-9-]+[0-9]")),
    ("grouped", re.compile(r"(1[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")),
    ("national", re.compile(r"\(?0[0-9]{1,4}\)?([ ./-][0-9]{2,8}){1,4}")),
    ("block4", re.compile(r"([0-9]{4}[ .-]){3}[0-9]{1,7}")),
    ("solid", re.compile(r"[0-9]+")),
    ("word", re.compile(r"[^\W\d]+")),
)
FEATURES = ("bias", *(f"shape:{s}" for s, _ in SHAPES), "shape:none", *(f"digits:{d}" for d in ("0", "1-6", "7-9", "10-12", "13-19", "20+")),
            "luhn", "octets", *(f"tokens:{n}" for n in range(1, 7)), *(f"cue:{c}" for c in CUES), "at", "edge")
SHAPE = dict(SHAPES)
INDEX = {f: i for i, f in enumerate(FEATURES)}


def zones(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of tokens around triggers; texts without a strong one have none."""
    if not STRONG.search(text):
        return []
    out: list[tuple[int, int]] = []
    borders = [m.start() for m in BORDER.finditer(text)]
    for m in STRONG.finditer(text):
        k = bisect_left(borders, m.start()) - (NEAR + 1)  # token borders to the left
        lo = borders[k] if k >= 0 else 0
        k = bisect_left(borders, m.end() + 1) + LONGEST + NEAR - 1
        hi = borders[k] if k < len(borders) else len(text)
        # A trigger inside the last zone widens it: what it starts may end behind it.
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return [tokens for lo, hi in out if (tokens := tokens_of(text, lo, hi))]


def tokens_of(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Tokens without closing stops, and without brackets around them or opened before and closed behind."""
    tokens = []
    for m in TOKEN.finditer(text, lo, hi):
        start, end = m.span()
        while end > start + 1 and text[end - 1] in ".)" and not (text[end - 1] == ")" and "(" in text[start:end]):
            end -= 1
        if end - start > 7 and text[start] == "(" and text[end - 1] == ")":
            start, end = start + 1, end - 1
        while end > start + 1 and text[start] == "(" and text.count("(", start, end) > text.count(")", start, end):
            start += 1
        tokens.append((start, end))
    return tokens


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[int]:
    """Features of the whole segment of tokens i to j - 1."""
    start, end = tokens[i][0], tokens[j - 1][1]
    span = text[start:end]
    digits = only_digits(span)
    n = len(digits)
    names = ["bias", "tokens:%d" % min(j - i, 6)]       # six stands for more
    names.append("shape:" + next((s for s, p in SHAPES if p.fullmatch(span)), "none"))
    names.append("digits:" + ("0" if not n else "1-6" if n < 7 else "7-9" if n < 10 else "10-12" if n < 13 else "13-19" if n < 20 else "20+"))
    if 13 <= n <= 19 and luhn(digits):
        names.append("luhn")
    if span.count(".") == 3 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in span.split(".")):
        names.append("octets")
    if "@" in span:
        names.append("at")
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        names.append("edge")
    if i:
        before = text[tokens[i - 1][0]:tokens[i - 1][1]].lower().strip(".")
        names.extend(f"cue:{c}" for c, words in CUES.items() if before in words)
    return [INDEX[x] for x in names]


def segments(text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int], list[int]]:
    """Features of every segment that can be one: single tokens, and short runs on one line
    that begin with a digit, plus, bracket or word and hold a digit or an at sign."""
    out = {}
    for i, (start, _) in enumerate(tokens):
        for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
            span = text[start:tokens[j - 1][1]]
            if j > i + 1 and ("\n" in span or len(span) > 80):
                break
            if j == i + 1 or span[0] in "+(0123456789" and span[-1].isdigit() and not any(c.isalpha() for c in span) or " at " in span or " AT " in span or "(at)" in span:
                out[i, j] = features(text, tokens, i, j)
    return out


class Field:
    """Weights of (label, feature) and of neighbouring labels."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def scores(self, found: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for (i, j), f in found.items():
            s = self.weights[:, f].sum(axis=1)
            if j > i + 1:
                s = s.copy()
                s[0] = -np.inf                           # what is nothing is read token by token
            out[i, j] = s
        return out

    def forward(self, n: int, scores) -> np.ndarray:
        alpha = np.full((n + 1, len(LABELS)), -np.inf)
        alpha[0, 0] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(1, n + 1):
                parts = [_logsum(alpha[i][:, None] + self.steps, 0) + scores[i, j]
                         for i in range(max(0, j - LONGEST), j) if (i, j) in scores]
                alpha[j] = _logsum(np.array(parts), 0)
        return alpha

    def backward(self, n: int, scores) -> np.ndarray:
        beta = np.full((n + 1, len(LABELS)), -np.inf)
        beta[n] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in range(n - 1, -1, -1):
                parts = [_logsum(self.steps + (scores[i, j] + beta[j])[None, :], 1)
                         for j in range(i + 1, min(n, i + LONGEST) + 1) if (i, j) in scores]
                beta[i] = _logsum(np.array(parts), 0)
        return beta

    def best(self, n: int, scores) -> list[tuple[int, int, int, float]]:
        """Segments (label, i, j, gain over leaving the tokens out) of the best reading."""
        value = np.full((n + 1, len(LABELS)), -np.inf)
        value[0, 0] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                if (i, j) not in scores:
                    continue
                paths = value[i][:, None] + self.steps
                came = paths.argmax(axis=0)
                total = paths.max(axis=0) + scores[i, j]
                for y in np.flatnonzero(total > value[j]).tolist():
                    value[j, y] = total[y]
                    back[j, y] = (i, int(came[y]))
        out, j, y = [], n, int(value[n].argmax())
        while j:
            i, before = back[j, y]
            if y:
                plain = sum(float(scores[k, k + 1][0]) for k in range(i, j))
                out.append((y, i, j, float(scores[i, j][y]) - plain))
            j, y = i, before
        return out[::-1]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    safe = np.where(np.isfinite(top), top, 0)
    return np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis=axis)) + safe


Example = tuple[str, list[Span]]

BUILT_IN: list[Example] = [
    ("write to ann.lee@mail.example.com today", [(0, 9, 33)]), ("the host 10.20.30.40 answered", [(1, 9, 20)]),
    ("paid with 4111 1111 1111 1111 then", [(2, 10, 29)]), ("paid with 4111111111111111 then", [(2, 10, 26)]),
    ("call +1 (212) 555-0100 now", [(3, 5, 22)]), ("contact ann@mail.example.com today", [(0, 8, 28)]),
    ("ask joe@mail.example.co.uk for it", [(0, 4, 26)]), ("reach sue@firm.org soon", [(0, 6, 18)]),
    ("the list of lee@some-site.net is here", [(0, 12, 29)]),
    ("version 1.2.3 of 2024-05-06 has 12345 lines in 300 files", []), ("order 4111111111111112 and 12 345 678 units", []),
    ("we met at 1200 hours at gate 310 dot", []), ("room 555 and 0100 and 20250101 at 900", []),
    ("more at www.example.com in 300 words", []), ("look at example.net or 2024-05-06 10:15:00", []),
    ("between 100-200-300 and 2001-2002 or 2024.05.06", []), ("level 0 12 15 of 1000 000 000 in all", []),
]
NEUTRAL = ("to", "and", "see", "now", "under", "or")   # words that stand in for a cue


def forms(kind: int, old: str) -> list[str]:
    """A span of the base in forms that the base does not know."""
    digits = only_digits(old)
    if kind == 0:
        local, domain = old.split("@")
        labels = domain.split(".")
        return [f"{local} at {' dot '.join(labels)}", f"{local} at {' dot '.join(labels[-2:])}",
                f"{local} (at) {' (dot) '.join(labels)}", f"{local} (at) {domain}"]
    if kind == 2:
        return [".".join(digits[i:i + 4] for i in range(0, len(digits), 4))] if len(digits) == 16 else []
    if kind == 3 and len(digits) >= 10:
        x, y, z = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"0{x} {y} {z}", f"{x}.{y}.{z}", f"0{x}/{y}{z}", f"{x} {y} {z}"]
    return []


def rewritten(text: str, spans: list[Span], turn: int | None = None) -> list[Example]:
    """The text with each span in other forms, as it stands and with no cue before it.

    All forms, or two of them each if a ``turn`` is given, so that many texts share them out.
    """
    out = []
    for kind, a, b in spans:
        known = forms(kind, text[a:b])
        for shift in (0, 1):
            for n, new in enumerate(known):
                if turn is not None and (n - turn - shift) % len(known) not in (0, 2):
                    continue
                before, word = re.fullmatch(r"(?s)(.*?)(\S*)", text[:a].rstrip(" ")).groups() if shift else (text[:a], "")
                if shift and word:
                    before += NEUTRAL[((turn or 0) + n) % len(NEUTRAL)] + " "
                out.append((before + new + text[b:], [(kind, len(before), len(before) + len(new))]))
    return out


def train(examples: list[Example], rounds: int = 25, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Gradient ascent on the log-likelihood of the labelled readings, one zone at a time."""
    prepared = []
    for text, spans in examples:
        tokens = tokens_of(text, 0, len(text))
        gold, fits = {}, True
        for kind, a, b in spans:
            inside = [k for k, (s, e) in enumerate(tokens) if s < b and a < e]
            fits &= len(inside) <= LONGEST               # else its tokens would be labelled as nothing
            if inside:
                gold[inside[0], inside[-1] + 1] = kind + 1
        found = segments(text, tokens)
        if tokens and fits and all(k in found for k in gold):
            covered = {t for i, j in gold for t in range(i, j)}
            gold |= {(k, k + 1): 0 for k in range(len(tokens)) if k not in covered}
            prepared.append((len(tokens), found, sorted((i, j, y) for (i, j), y in gold.items())))
    field = Field(np.zeros((len(LABELS), len(FEATURES))), np.zeros((len(LABELS), len(LABELS))))
    seen_w, seen_s = np.full_like(field.weights, 1e-6), np.full_like(field.steps, 1e-6)
    for _ in range(rounds):
        for n, found, gold in prepared:
            scores = field.scores(found)
            alpha, beta = field.forward(n, scores), field.backward(n, scores)
            total = float(_logsum(alpha[n], 0))
            g_w, g_s = -decay * field.weights, -decay * field.steps
            before = 0
            for i, j, y in gold:
                np.add.at(g_w[y], found[i, j], 1)
                g_s[before, y] += 1
                before = y
            for (i, j), f in found.items():
                joint = np.exp(alpha[i][:, None] + field.steps + (scores[i, j] + beta[j])[None, :] - total)
                g_s -= joint
                g_w[:, f] -= joint.sum(axis=0)[:, None]
            seen_w += g_w ** 2
            seen_s += g_s ** 2
            field.weights += rate * g_w / np.sqrt(seen_w)
            field.steps += rate * g_s / np.sqrt(seen_s)
    return field


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    out = []
    for tokens in zones(text):
        found = segments(text, tokens)
        if len(found) == len(tokens) and not any("@" in text[a:b] or len(only_digits(text[a:b])) >= 9 for a, b in tokens):
            continue                                     # only short single tokens: nothing to join
        for y, i, j, gain in field.best(len(tokens), field.scores(found)):
            a, b = tokens[i][0], tokens[j - 1][1]
            if gain >= MARGIN and not any(s < b and a < e for _, s, e in base) and plausible(y - 1, text, a, b):
                out.append((y - 1, a, b))
    return out


def plausible(kind: int, text: str, a: int, b: int) -> bool:
    """What the forms of a kind have in common, whatever the field has learned."""
    span, digits = text[a:b], only_digits(text[a:b])
    if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    if kind == 0:
        return shaped(span, "email", "spelled") or "(at)" in span and shaped(span, "half")
    if kind == 1:
        return shaped(span, "ip") and all(int(p) <= 255 for p in span.split("."))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return shaped(span, "plus", "grouped") or 9 <= len(digits) <= 12 and shaped(span, "national")


def shaped(span: str, *names: str) -> bool:
    return any(SHAPE[n].fullmatch(span) is not None for n in names)


# Spark


def labelled_zones(docs: DataFrame, text: str, key: str, sample: int) -> list[Example]:
    """At most ``sample`` zones with their base spans, the first ones by a hash of the document."""
    schema = "at bigint, text string, kind array<int>, first array<int>, last array<int>"

    def read(batches):
        for batch in batches:
            out = []
            for at, whole in zip(*[batch.column(c).to_pylist() for c in ("at", "text")]):
                base = base_spans(whole or "")
                for tokens in zones(whole or "")[:4]:
                    lo, hi = tokens[0][0], tokens[-1][1]
                    inside = [(k, a - lo, b - lo) for k, a, b in base if a >= lo and b <= hi]
                    if hi - lo <= 400:
                        out.append((at, whole[lo:hi], *([x[c] for x in inside] for c in range(3))))
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3))],
                    ["at", "text", "kind", "first", "last"])

    rows = docs.select(F.xxhash64(F.col(f"`{key}`")).alias("at"), F.col(f"`{text}`").alias("text")).mapInArrow(read, schema)
    found = rows.orderBy("at", "text").limit(sample).collect()
    return [(r.text, list(zip(r.kind, r["first"], r["last"]))) for r in found]


def default_field(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 300) -> Field:
    examples = labelled_zones(docs, text, key, sample)
    return train(BUILT_IN * 4 + examples + [x for t, s in BUILT_IN * 4 for x in rewritten(t, s)]
                 + [x for n, (t, s) in enumerate(examples) for x in rewritten(t, s, n)])


def find_personal(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """Add pii_base and pii_spans: arrays of (kind, start, end), the second with the added ones,
    by kind as in ``KINDS``, then start."""
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    ddl = "array<struct<kind:string,start:bigint,end:bigint>>"
    shipped = docs.sparkSession.sparkContext.broadcast((field.weights, field.steps))

    def named(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]

    def read(batches):
        model = Field(*shipped.value)
        for batch in batches:
            base_all, spans_all = [], []
            for whole in batch.column(batch.schema.get_field_index(text)).to_pylist():
                base = base_spans(whole) if whole else []
                base_all.append(named(base))
                spans_all.append(named(base + added_spans(whole, base, model)) if whole else [])
            names = batch.schema.names
            new = {"pii_base": pa.array(base_all, spans_type), "pii_spans": pa.array(spans_all, spans_type)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(i) for i, c in enumerate(names)], names)

    empty = F.array().cast(ddl)
    rows = without(docs, *ADDED).select("*", empty.alias("pii_base"), empty.alias("pii_spans"))
    return rows.mapInArrow(read, rows.schema)
