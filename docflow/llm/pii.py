"""Personal data: rules for four kinds, and a bidirectional character LSTM with a CRF on top.

The network is trained in numpy on labelled spans: windows of a bounded sample of the corpus, labelled by the
rules, and as many windows with written variants of each kind set into them (parted addresses,
phones without a plus, cards and addresses with other separators), of which the spans are known. Texts are
read in overlapping windows; each is decoded on its own, and the spans of all windows of a text
are reconciled together. Spans of the rules always stay. The network adds those that touch none of them and
pass the check of their kind (digits, checksum, parts). A span of the network must hold an anchor
(a digit, an at sign or a bracketed `at`), so windows without one are not read.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share_below, text_slices

# Fixed values of the rules.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ANCHOR = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]", re.IGNORECASE)
#: Characters of a window, and between the starts of two; a span of up to STRIDE lies whole in one.
WINDOW, STRIDE = 96, 48
#: Characters of the examples that the network is trained on.
EXAMPLE = 72
#: Windows of the corpus that the network is trained on, at most about so many; as many written ones.
SAMPLE = 2_000
HIDDEN, EMBED, CHARS = 20, 12, 131
#: Outside, then beginning and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
#: Least mean probability of a span's labels.
SURE = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) < 4 and int(p or 0) <= 255


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _card(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the rules' matches, leftmost and not overlapping within a kind; linear in the text."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if _card(m[0])]
    return out + [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


def _codes() -> np.ndarray:
    """Character -> number for ASCII: 0 is no character, digits are one, other letters 129, other characters 130."""
    out = np.arange(1, 129)
    out[48:58] = 49
    return out


_CODE = _codes()


def coded(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, _CODE[np.minimum(c, 127)], np.where((c >= 0x2000) & (c < 0x3000), 130, 129))


def grid(length: int) -> int:
    """Number of windows of a text: the last one reaches its end."""
    return 1 + max(0, -(-(length - WINDOW) // STRIDE))


def anchored(text: str) -> list[int]:
    """Numbers of the windows that hold an anchor."""
    last, out = grid(len(text)) - 1, set()
    for m in ANCHOR.finditer(text):
        k = m.start() // STRIDE
        out.update((min(k, last), max(0, min(k - 1, last))))
    return sorted(out)


def _labels(spans, length: int) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        y[a:b] = 2 + 2 * kind
        y[a] -= 1
    return y


# Legal transitions: inside only after the beginning or inside of the same kind.
_LEGAL = np.ones((LABELS, LABELS))
for _k in range(len(KINDS)):
    _LEGAL[:, 2 + 2 * _k] = 0
    _LEGAL[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 1
_FIRST = np.array([1.0] + [1.0, 0.0] * len(KINDS))


@dataclass
class Tagger:
    """Embeddings, an LSTM a direction (gates in, forget, out, new come first), emissions, transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 7, kind=np.float32) -> Tagger:
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[-2]), s)
        bias = np.zeros((4, 2, 1, HIDDEN))
        bias[1] = 1
        p = {"e": r.normal(0, 0.3, (CHARS, EMBED)), "w": draw(4, 2, EMBED, HIDDEN), "u": draw(4, 2, HIDDEN, HIDDEN), "b": bias, "v": draw(2 * HIDDEN, LABELS), "c": np.zeros(LABELS), "t": np.zeros((LABELS, LABELS))}
        return cls({k: v.astype(kind) for k, v in p.items()})

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x (time, windows) -> emissions (time, windows, labels), and what the gradient needs."""
        p, (n, w), kind = self.p, x.shape, self.p["e"].dtype
        g = p["e"][x]
        pre = np.empty((n, 4, 2, w, HIDDEN), kind)
        for k, way in enumerate((g, g[::-1])):
            for gate in range(4):
                pre[:, gate, k] = way @ p["w"][gate, k]
        pre += p["b"]
        h, c = np.zeros((2, w, HIDDEN), kind), np.zeros((2, w, HIDDEN), kind)
        hs, kept = np.empty((n, 2, w, HIDDEN), kind), []
        for t in range(n):
            z = h @ p["u"]
            z += pre[t]
            z[:3] *= 0.5
            np.tanh(z, out=z)
            z[:3] *= 0.5
            z[:3] += 0.5
            before, c = c, z[1] * c + z[0] * z[3]
            tc = np.tanh(c)
            h = hs[t] = z[2] * tc
            if keep:
                kept.append((z, before, tc))
        both = np.concatenate([hs[:, 0], hs[::-1, 1]], 2)
        return both @ p["v"] + p["c"], (g, hs, both, kept)

    def chain(self, em: np.ndarray):
        """Scaled forward and backward sums of the CRF: (forward, backward, exp of emissions, transitions)."""
        tr = np.exp(self.p["t"]) * _LEGAL.astype(em.dtype)
        e = np.exp(em - em.max(2, keepdims=True))
        a, b = np.empty_like(e), np.empty_like(e)
        f = e[0] * _FIRST.astype(em.dtype)
        for t in range(len(e)):
            f = f if t == 0 else (f @ tr) * e[t]
            f = a[t] = f / f.sum(1, keepdims=True)
        f = b[-1] = np.ones(e.shape[1:], e.dtype)
        for t in range(len(e) - 2, -1, -1):
            f = (e[t + 1] * f) @ tr.T
            f = b[t] = f / f.sum(1, keepdims=True)
        return a, b, e, tr

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of labels y (time, windows)."""
        p, (n, w) = self.p, x.shape
        em, (g, hs, both, kept) = self.emissions(x, keep=True)
        a, b, e, tr = self.chain(em)
        marginal = a * b
        marginal /= marginal.sum(2, keepdims=True)
        pair = a[:-1, :, :, None] * tr * (e[1:] * b[1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        out = {"t": pair.sum((0, 1)) / w}
        np.add.at(out["t"], (y[:-1], y[1:]), -1 / w)
        d = marginal
        d[np.arange(n)[:, None], np.arange(w), y] -= 1
        d /= w
        out["c"], out["v"] = d.sum((0, 1)), np.tensordot(both, d, ((0, 1), (0, 1)))
        dboth = d @ p["v"].T
        dhs = np.stack([dboth[..., :HIDDEN], dboth[::-1, :, HIDDEN:]], 1)
        dz, dh, dc, back = np.empty((n, 4, 2, w, HIDDEN), em.dtype), 0.0, 0.0, p["u"].transpose(0, 1, 3, 2).copy()
        for t in range(n - 1, -1, -1):
            (i, f, o, new), before, tc = kept[t]
            dh = dhs[t] + dh
            dc = dc + dh * o * (1 - tc * tc)
            q = dz[t]
            q[0], q[1] = dc * new * i * (1 - i), dc * before * f * (1 - f)
            q[2], q[3] = dh * tc * o * (1 - o), dc * i * (1 - new * new)
            dc, dh = dc * f, (q @ back).sum(0)
        out["b"] = dz.sum((0, 3))[:, :, None]
        sums = lambda x, y: x.reshape(-1, x.shape[-1]).T @ y.reshape(-1, y.shape[-1])
        ways = (g, g[::-1])
        out["u"] = np.stack([[sums(hs[:-1, k], dz[1:, gate, k]) for k in (0, 1)] for gate in range(4)])
        out["w"] = np.stack([[sums(ways[k], dz[:, gate, k]) for k in (0, 1)] for gate in range(4)])
        dg = sum(dz[:, gate, 0] @ p["w"][gate, 0].T + (dz[:, gate, 1] @ p["w"][gate, 1].T)[::-1] for gate in range(4))
        out["e"] = np.zeros_like(p["e"])
        np.add.at(out["e"], x, dg)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, size: int = 64, rate: float = 0.02, seed: int = 11) -> Tagger:
        """Adam over groups of windows (windows, time), all shuffled anew when they are used up; the rate falls to a tenth."""
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        while step < steps:
            order = r.permutation(len(x))
            for at in range(0, len(x), size):
                rows, step = order[at : at + size], step + 1
                grads = self.gradient(x[rows].T, y[rows].T)
                norm = np.sqrt(sum(float((d * d).sum()) for d in grads.values()))
                for k, d in grads.items():
                    d = d * min(1.0, 5 / (norm + 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * d * d
                    fall = rate * (1 - 0.9 * min(1.0, step / steps))
                    self.p[k] -= fall * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (windows, time) -> the best label sequence of each, and the probability of each of its labels."""
        em, _ = self.emissions(x.T)
        a, b, *_ = self.chain(em)
        marginal = a * b
        marginal /= marginal.sum(2, keepdims=True)
        with np.errstate(divide="ignore"):
            tr, score = self.p["t"] + np.log(_LEGAL), em[0] + np.log(_FIRST)
        came = np.zeros(em.shape, np.int64)
        for t in range(1, len(em)):
            ways = score[:, :, None] + tr
            came[t] = ways.argmax(1)
            score = np.take_along_axis(ways, came[t][:, None], 1)[:, 0] + em[t]
        best = np.empty(em.shape[:2], np.int64)
        best[-1] = score.argmax(1)
        for t in range(len(em) - 1, 0, -1):
            best[t - 1] = np.take_along_axis(came[t], best[t][:, None], 1)[:, 0]
        return best.T, np.take_along_axis(marginal, best[..., None], 2)[..., 0].T


def window_of(codes: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    part = codes[k * STRIDE : k * STRIDE + WINDOW]
    out[: len(part)] = part
    return out


def reconcile(found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """Spans of all windows of a text, as (kind, start, end, certainty, cut by the window) -> spans that do not overlap.

    Cut spans of one kind that overlap are joined first. Whole ones go before cut ones, then the surer, then the first.
    """
    cut, joined = sorted((f for f in found if f[4]), key=lambda f: (f[0], f[1])), []
    for kind, a, b, sure, _ in cut:
        if joined and joined[-1][0] == kind and a < joined[-1][2]:
            joined[-1] = (kind, joined[-1][1], max(b, joined[-1][2]), min(sure, joined[-1][3]), True)
        else:
            joined.append((kind, a, b, sure, True))
    out: list = []
    taken: dict[int, list[tuple[int, int]]] = {}  # by stretch of STRIDE characters, so that each span meets its neighbours only
    for kind, a, b, sure, _ in sorted([*(f for f in found if not f[4]), *joined], key=lambda f: (f[4], -f[3], f[1], f[0], f[2])):
        near = range(a // STRIDE, (b - 1) // STRIDE + 1)
        if sure < SURE or any(x < b and a < y for k in near for x, y in taken.get(k, ())):
            continue
        for k in near:
            taken.setdefault(k, []).append((a, b))
        out.append((kind, a, b))
    return sorted(out)


def _holds(kind: int, s: str) -> bool:
    """The check of a span of the network."""
    d = _digits(s)
    if kind == 0:
        return bool(re.search(r"[A-Za-z0-9]\s?(?:@|[\[({]\s?at\s?[\])}])\s?[A-Za-z0-9]", s, re.IGNORECASE)) and bool(re.search(r"[A-Za-z0-9]\s?(?:\.|[\[({]\s?dot\s?[\])}])\s?[A-Za-z0-9]+$", s, re.IGNORECASE))
    if kind == 1:
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(p and _part(p) for p in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and len(re.findall(r"[^0-9]+", s)) >= 2


def network_spans(texts: list[str], tagger: Tagger, group: int = 512) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans of the network in each text, windows of all texts decoded in groups."""
    found: list = [[] for _ in texts]
    where = [(i, k) for i, t in enumerate(texts) for k in anchored(t)]
    codes: dict[int, np.ndarray] = {}
    for at in range(0, len(where), group):
        some = where[at : at + group]
        codes = {i: codes[i] if i in codes else coded(texts[i]) for i in dict.fromkeys(i for i, _ in some)}
        best, sure = tagger.decode(np.stack([window_of(codes[i], k) for i, k in some]))
        for row in np.flatnonzero(best.any(1)).tolist():
            (i, k), y = some[row], best[row]
            begins = np.flatnonzero(y % 2).tolist()
            for a in begins:
                kind, b = (int(y[a]) - 1) // 2, a + 1
                while b < WINDOW and y[b] == 2 + 2 * kind:
                    b += 1
                start, end = k * STRIDE + a, min(k * STRIDE + b, len(texts[i]))
                cut = (a == 0 and k > 0) or (b == WINDOW and end < len(texts[i]))
                if start < end:
                    found[i].append((kind, start, end, float(sure[row, a:b].mean()), cut))
    alone = lambda t, a, b: not (t[a - 1 : a].isalnum() or t[b : b + 1].isalnum())  # noqa: E731  chance finds inside longer words go
    return [[(kind, a, b) for kind, a, b in reconcile(f) if ANCHOR.search(t[a:b]) and alone(t, a, b) and _holds(kind, t[a:b])] for t, f in zip(texts, found)]


def all_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, by a rule) of each text, by kind and start."""
    out = []
    for text, extra in zip(texts, network_spans(texts, tagger)):
        rules = rule_spans(text)
        covered = sorted((a, b) for _, a, b in rules)
        firsts, lasts = np.array([a for a, _ in covered]), np.maximum.accumulate(np.array([b for _, b in covered], np.int64))
        free = []
        for kind, a, b in extra:
            k = int(np.searchsorted(firsts, b)) - 1  # the last rule span that starts before b
            if k < 0 or lasts[k] <= a:
                free.append((kind, a, b, False))
        out.append(sorted([*((kind, a, b, True) for kind, a, b in rules), *free]))
    return out


def written(rng: random.Random, kind: int) -> str:
    """One of the ways in which a kind is written; the rules know some of them."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    if kind == 0:
        at, dot = rng.choice([("@", ".")] * 3 + [(" @ ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), ("{at}", "{dot}")])
        local = rng.choice([word(), f"{word()}.{word()}", f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}{digits(2)}"])
        return local + at + dot.join([rng.choice([word(), word() + digits(1)]), *([word()] * rng.randrange(2)), rng.choice(["com", "org", "net", "de", "fr", "es", "example"])])
    if kind == 1:
        return rng.choice([".", ".", ".", "[.]", " . ", "(.)", "-", " dot "]).join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        d = rng.choice("3456") + digits(14)
        d += next(x for x in "0123456789" if luhn(d + x))
        sep = rng.choice(["", "", " ", "-", ".", "_", "/", "  "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))
    a, b, c, cc = digits(3), digits(3), digits(4), rng.choice(["1", "44", "49", "33", "34"])
    return rng.choice([f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{cc} {a} {b} {c}", f"({a}) {b} {c}", f"{a} / {b} {c}"])


def _harmless(rng: random.Random) -> str:
    """Numbers and signs that are nobody's data."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([
        lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40])))}"',
        lambda: f"version {rng.randrange(10)}.{rng.randrange(10)}", lambda: f"v{rng.randrange(10)}.{rng.randrange(30)}.{rng.randrange(30)}", lambda: f"CC BY-NC {rng.randrange(5)}.0",
        lambda: str(rng.randrange(1900, 2030)), lambda: f"20{digits(2)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", lambda: f"{rng.randrange(1, 13)}/{rng.randrange(1, 29)}/20{digits(2)}",
        lambda: f"{rng.randrange(24)}:{digits(2)}:{digits(2)}", lambda: f"${rng.randrange(1, 999)},{digits(3)}.{digits(2)}", lambda: digits(rng.randrange(1, 8)), lambda: f"{rng.randrange(100)}.{digits(1)} %",
        lambda: f"@{''.join(rng.choice('abcdefghij') for _ in range(6))}", lambda: f"no. {digits(3)}", lambda: f"({rng.randrange(100)})", lambda: f"p. {digits(2)}-{digits(2)}", lambda: ".".join(str(rng.randrange(256, 999)) for _ in range(4)),
    ])()


def examples(windows: list[str], seed: int = 5, number: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of the corpus windows, labelled by the rules, and of `number` windows with something written into corpus text."""
    rng, xs, ys = random.Random(seed), [], []
    plain = [ANCHOR.sub(" ", w) for w in windows] or ["and the other one of those was for all, with some of it there. That is how it was then, or so they said"]

    def add(text, spans):
        x, y = np.zeros(EXAMPLE, np.int64), np.zeros(EXAMPLE, np.int64)
        x[: len(text)], y[: len(text)] = coded(text), _labels(spans, len(text))
        xs.append(x)
        ys.append(y)

    for w in windows:
        # What stands inside a longer word is chance, not data; an anchor at an end may be a part of data that is cut.
        first = next((m.start() for m in ANCHOR.finditer(w)), 0)
        w = w[max(0, min(first - rng.randrange(8, 24), len(w) - EXAMPLE)) :][:EXAMPLE]
        spans = rule_spans(w)
        if all((a == 0 or not w[a - 1].isalnum()) and (b == len(w) or not w[b].isalnum()) for _, a, b in spans) and not any(ANCHOR.search(w[i]) for i in (0, -1)):
            add(w, spans)
    for _ in range(number):
        base, text, spans = rng.choice(plain), "", []
        cuts = sorted(rng.randrange(len(base) + 1) for _ in range(rng.randrange(1, 4)))
        for lo, hi in zip([0, *cuts], cuts):
            text += base[lo:hi].rstrip() + rng.choice([" ", " ", " ", "\n", " (", ": "]) if hi > lo else ""
            if rng.random() < 0.7:
                kind = rng.randrange(4)
                new = written(rng, kind)
                spans.append((kind, len(text), len(text) + len(new)))
            else:
                new = _harmless(rng)
            text += new + rng.choice([" ", " ", " ", ". ", ", ", ") ", "\n"])
        text += base[cuts[-1] :]
        at = rng.randrange(max(1, min(len(text) - EXAMPLE, spans[0][1] if spans else len(text)) + 1))
        text, spans = text[at:], [(k, a - at, b - at) for k, a, b in spans]
        whole = [s for s in spans if s[2] <= EXAMPLE]
        stop = min([EXAMPLE, *(s[1] for s in spans if s[2] > EXAMPLE)])
        add(text[:stop], whole)
    return np.stack(xs), np.stack(ys)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def sample_windows(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """About `sample` distinct anchored windows of the corpus, drawn by hash after they are counted."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [t[k * STRIDE : k * STRIDE + WINDOW] for t in _texts(part) for k in anchored(t)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["w"])

    found = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null").mapInArrow(run, "w string").distinct()
    share = sample / max(1, found.count())
    return sorted(r.w for r in found.filter(share_below(share, "w")).collect())


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Fitted on about `sample` windows of the corpus and as many written ones; of those two sets only, whatever the table's size."""
    return Tagger.new().fit(*examples(sample_windows(docs, sample), number=sample))


def personal_data(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents -> doc_id, text, spans array<struct<kind, start, end, rule>> by kind (email, ip, card, phone) and start.

    start and end count code points, end is exclusive; rule says whether a rule found the span, else
    the network did. Null and empty texts have no spans; each row comes out once, repeated and null ids
    too; other columns are ignored; empty in, empty out. Texts of any length are read whole, in windows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.bool_())]))

    def run(batches):
        tagger = shared.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                spans = [[{"kind": KINDS[k], "start": a, "end": b, "rule": rule} for k, a, b, rule in x] for x in all_spans(_texts(part), tagger)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], names=["doc_id", "text", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, spans array<struct<kind: string, start: long, end: long, rule: boolean>>")


def masked(found: DataFrame) -> DataFrame:
    """personal_data() -> doc_id, text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    ordered = "array_sort(spans, (x, y) -> cast(sign(if(x.start = y.start, y.end - x.end, x.start - y.start)) as int))"
    step = (
        "if(s.start < acc.at, named_struct('out', acc.out, 'at', greatest(acc.at, s.end)), "
        "named_struct('out', concat(acc.out, substring(text, cast(acc.at + 1 as int), cast(s.start - acc.at as int)), '[', s.kind, ']'), 'at', s.end))"
    )
    folded = f"aggregate({ordered}, named_struct('out', '', 'at', 0L), (acc, s) -> {step}, acc -> concat(acc.out, substring(text, cast(acc.at + 1 as int))))"
    return found.select("doc_id", F.expr(folded).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """personal_data() -> doc_id, counts and SHA-256 of the rules' spans, and all spans as text."""
    listed = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    rows = found.withColumn("base", F.expr("filter(spans, s -> s.rule)"))
    return rows.select(
        "doc_id",
        *[F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(listed.format("base")), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )
