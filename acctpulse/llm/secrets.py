"""Secret scans: base patterns, and a character network over every other candidate and its surroundings.

The network is a one-layer convolution over characters in numpy. It learns from labelled findings of the corpus itself:
values that the base patterns confirm are secrets, other long strings are not. Each is also shown in another form, so that
keys of alphabets that no pattern knows are learned too. A part of the findings is held out to
calibrate its scores and to choose the threshold: the highest at which the wanted share of held-out secrets is still found.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acctpulse.llm import spans as S
from acctpulse.llm.spans import Span
from acctpulse.session import staged

KINDS = ["assign", "access", "hex", "learned"]
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# What the network is asked about: long strings of letters and digits.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_LETTER_AND_DIGIT = re.compile(r"[A-Za-z].*[0-9]|[0-9].*[A-Za-z]")
# What it also learns from, as examples of no secrets.
_LONG = re.compile(r"(?<![^\s\"'(<>)])[^\s\"'(<>)]{10,}")

# Invented findings count as so many rows of either kind in all, beside the real ones.
MOST_FINDINGS, PRIOR_FINDINGS = 1500, 30
RECALL, CONTEXT, BODY, STRIDE = 0.98, 16, 48, 16
WIDTH, FILTERS, EPOCHS, BATCH = 5, 16, 12, 64
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\"'=:+/_.-"
_CODES = {c: i + 2 for i, c in enumerate(_ALPHABET)}  # 0: outside the text, 1: any other character
_N = len(_ALPHABET) + 2


def base_spans(text: str) -> list[Span]:
    """The base patterns. Non-overlapping per kind, leftmost first; what fails its length is dropped."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _overlap(start: int, end: int, spans: list[Span]) -> bool:
    return any(s < end and start < e for _, s, e in spans)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Every long string of letters and digits that no base span touches."""
    found = [m.span() for m in _CANDIDATE.finditer(text) if _LETTER_AND_DIGIT.search(m[0])]
    return [(a, b) for a, b in found if not _overlap(a, b, base)]


def findings(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, label)`` to learn from: values the base patterns confirm (1), other long strings (0)."""
    base = base_spans(text)
    values = {m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12} | {(a, b) for kind, a, b in base if kind != "assign"}
    others = [m.span() for m in _LONG.finditer(text) if not _overlap(*m.span(), base)]
    return [(a, b, 1) for a, b in sorted(values)] + [(a, b, 0) for a, b in others]


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover a candidate to its end; one where it fits."""
    if end - start <= BODY:
        return [(start, end)]
    return [(a, a + BODY) for a in (*range(start, end - BODY, STRIDE), end - BODY)]


def encoded(text: str, start: int, end: int, context: bool = True) -> np.ndarray:
    """Character codes of a window of a candidate and of its surroundings, a fixed number of each."""
    body = [_CODES.get(c, 1) for c in text[start : min(end, start + BODY)]]
    before = [_CODES.get(c, 1) for c in text[max(0, start - CONTEXT) : start]] if context else []
    after = [_CODES.get(c, 1) for c in text[end : end + CONTEXT]] if context else []
    row = [0] * (CONTEXT - len(before)) + before + body + [0] * (BODY - len(body)) + after
    return np.array(row + [0] * (2 * CONTEXT + BODY - len(row)), np.int16)


@dataclass
class Network:
    """Convolution over characters, the largest and the mean answer of each filter, and a logistic output.

    ``conv`` has weights by place (before, inside and after the candidate), offset, character and filter.
    """

    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    @staticmethod
    def fresh(seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        conv = rng.normal(0, 0.2, (3, WIDTH, _N, FILTERS)).astype(np.float32)
        return Network(conv, np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), 0.0)

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, tuple]:
        length = rows.shape[1]
        steps = length - WIDTH + 1
        place = np.repeat([0, 1, 2], [CONTEXT, BODY, CONTEXT])
        hidden = np.tile(self.bias, (len(rows), steps, 1))
        for k in range(WIDTH):
            hidden += self.conv[place[k : k + steps], k, rows[:, k : k + steps]]
        active = np.maximum(hidden, 0)
        top = active.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(active, top[:, None], 1)[:, 0], active.mean(axis=1)], 1)
        return pooled @ self.out + self.shift, (place, hidden, top, pooled)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        parts = [self.forward(rows[i : i + 256])[0] for i in range(0, len(rows), 256)]
        raw = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * raw + self.offset, -30, 30)))

    def step(self, rows: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss."""
        raw, (place, hidden, top, pooled) = self.forward(rows)
        n, steps = hidden.shape[:2]
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - wanted) * weight / n
        back = np.repeat((error[:, None] * self.out[FILTERS:] / steps)[:, None], steps, axis=1)
        at = np.arange(n)[:, None], top, np.arange(FILTERS)[None]
        back[at] += error[:, None] * self.out[:FILTERS]
        back *= hidden > 0
        conv = np.zeros_like(self.conv)
        for k in range(WIDTH):
            np.add.at(conv[:, k], (np.broadcast_to(place[k : k + steps], (n, steps)), rows[:, k : k + steps]), back)
        return {"conv": conv, "bias": back.sum(axis=(0, 1)), "out": pooled.T @ error, "shift": error.sum()}


def train(rows: np.ndarray, labels: np.ndarray, seed: int = 0, epochs: int = EPOCHS, recall: float = RECALL, lots: np.ndarray | None = None, worth: np.ndarray | None = None) -> Network:
    """Fit by Adam on three quarters of the rows; calibrate and choose the threshold on the rest. Rows of a lot stay together.

    ``worth`` weighs the rows, in the fit, the calibration and the recall.
    """
    worth = np.ones(len(rows)) if worth is None else worth
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = np.zeros(len(rows), bool)
    for label in (0, 1):
        own = order[labels[order] == label]
        if lots is None:
            held[own[: max(1, len(own) // 4)]] = True
        else:
            _, first = np.unique(lots[own], return_index=True)
            drawn = lots[own][np.sort(first)]
            held |= (labels == label) & np.isin(lots, drawn[: max(1, len(drawn) // 4)])
    learn = order[~held[order]]
    net = Network.fresh(seed)
    share = np.average(labels[learn], weights=worth[learn])
    weight = worth / np.average(worth[learn]) * np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    weight = weight.astype(np.float32)
    state = {k: [np.zeros_like(getattr(net, k), dtype=np.float64), np.zeros_like(getattr(net, k), dtype=np.float64)] for k in ("conv", "bias", "out", "shift")}
    turn = 0
    for _ in range(epochs):
        rng.shuffle(learn)
        for i in range(0, len(learn), BATCH):
            some = learn[i : i + BATCH]
            turn += 1
            for k, g in net.step(rows[some], labels[some], weight[some]).items():
                first, second = state[k]
                first += 0.1 * (g - first)
                second += 0.001 * (np.square(g) - second)
                move = 0.01 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
                setattr(net, k, getattr(net, k) - (move.astype(np.float32) if k != "shift" else float(move)))
    raw = np.concatenate([net.forward(rows[held][i : i + 256])[0] for i in range(0, held.sum(), 256)])
    net.scale, net.offset = _platt(raw, labels[held], worth[held])
    known = held & (labels == 1)
    secrets, share = net.scores(rows[known]), worth[known] / worth[known].sum()
    order = np.argsort(secrets, kind="stable")
    # The highest threshold that keeps the wanted recall.
    lost = np.cumsum(share[order])
    net.threshold = float(secrets[order][min(np.searchsorted(lost, 1 - recall + 1e-12, side="right"), len(order) - 1)])
    return net


def _platt(raw: np.ndarray, labels: np.ndarray, worth: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the raw scores, by Newton's method with smoothed labels."""
    yes, no = (labels * worth).sum(), ((1 - labels) * worth).sum()
    wanted = np.where(labels == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.stack([raw, np.ones_like(raw)], 1).astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (worth * (p - wanted)) + 1e-3 * (w - [1.0, 0.0])
        w = w - np.linalg.solve((x * (worth * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    return max(float(w[0]), 1e-3), float(w[1])


_ALPHABETS = ["0123456789ABCDEF", "0123456789abcdefABCDEF", _ALPHABET[:62], _ALPHABET[:62] + "_-", _ALPHABET[:62] + "+/"]


def variant(text: str, start: int, end: int, label: int, draw: int) -> tuple[str, int, int]:
    """A finding in another form: a secret of other letters in its place, or words of the text joined to a long name.

    A third are windows inside a longer string: a secret behind a name, or the later part of a name.
    """
    rng = random.Random(draw)
    words = re.findall("[A-Za-z]{2,}", text[max(0, start - 80) : end + 80]) or ["name"]
    name = rng.choice("-_/").join(rng.sample(words, min(len(words), rng.randrange(2, 5))))
    left, inner, at = text[max(0, start - CONTEXT) : start], rng.random() < 0.33, 0
    if label:
        letters = rng.choice(_ALPHABETS)
        value = "".join(rng.choice(letters) for _ in range(rng.randrange(18, 49)))
        if inner:
            left += name + rng.choice("-_/")
            at = -min(rng.randrange(STRIDE + 1), len(left))
    else:
        value = name + rng.choice("-_/") + str(rng.randrange(10 ** rng.randrange(1, 5)))
        at = rng.randrange(len(value) // 2) if inner else 0
    at += len(left)
    return left + value + text[end : end + CONTEXT], at, min(at + BODY, len(left) + len(value)) if inner else len(left) + len(value)


LOT_GROUPS = 64
_FINDINGS = "codes array<smallint>, label int, lot bigint"


def _forms(text: str, start: int, end: int, label: int, draw: int) -> list[list[int]]:
    """Rows of a finding as it stands and in another form. Half are shown without their surroundings, which the base patterns know already."""
    rows = []
    for k, (shown, a, b) in enumerate(((text, start, end), variant(text, start, end, label, draw))):
        parts = windows(a, b)
        rows.append(encoded(shown, *parts[draw // 8 % len(parts)], context=draw % 2 == k).tolist())
    return rows


def labelled_findings(docs: DataFrame, most: int = MOST_FINDINGS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, labels and lots of at most ``most`` rows of either label, the smallest by hash of all documents.

    A task keeps the smallest of its own and a group of lots those of all tasks, so what the driver is sent is bounded whatever
    the number of tasks, and nothing is sampled before it is labelled.
    """
    import heapq

    import pyarrow as pa
    import xxhash

    def run(batches):
        kept = {0: [], 1: []}  # heaps of the smallest draws, largest first, each with its rows
        seen = {0: set(), 1: set()}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                for start, end, label in findings(text):
                    draw = xxhash.xxh64_intdigest(f"{doc_id}:{start}:{text[start:end]}".encode("utf-8", "replace")) >> 1
                    heap = kept[label]
                    if draw in seen[label] or (len(heap) >= most and draw >= -heap[0][0]):
                        continue
                    seen[label].add(draw)
                    heapq.heappush(heap, (-draw, _forms(text, start, end, label, draw)))
                    if len(heap) > most:
                        seen[label].discard(-heapq.heappop(heap)[0])
        out = [(row, label, -lot) for label in (0, 1) for lot, rows in kept[label] for row in rows]
        columns = [pa.array([r for r, _, _ in out], pa.list_(pa.int16())), pa.array([y for _, y, _ in out], pa.int32()), pa.array([x for _, _, x in out], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["codes", "label", "lot"])

    found = staged(docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, _FINDINGS), "findings")
    group = Window.partitionBy("label", F.pmod("lot", F.lit(LOT_GROUPS))).orderBy("lot", "codes")
    few = staged(found.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= most).drop("rank"), "few_findings")
    got = [r for label in (1, 0) for r in few.filter(F.col("label") == label).orderBy("lot", "codes").limit(most).collect()]
    codes = np.array([r.codes for r in got], np.int16).reshape(len(got), 2 * CONTEXT + BODY)
    return codes, np.array([r.label for r in got], np.int64), np.array([r.lot for r in got], np.int64)


# Plain words that invented findings are made of.
WORDS = """the of and to in that is was for on are with as his they at be this from have or by one had not but what all were when we
there can an your which their said if do will each about how up out them then she many some so these would other into has more her two
like him see time could no make than first been its who now people my made over did down only way find use may water long little very
after words called just where most know get through back much before go good new write our used me man too any day same right look
think also around another came come work three word must because does part even place well such here take why things help put years
different away again off went old number great tell men say small every found still between name should home big give air line set own
under read last never us left end along while might next sound below saw something thought both few those always looked show large
often together asked house world going want school important until form food keep children feet land side without boy once animals
life enough took sometimes four head above kind began almost live page got earth need far hand high year mother light parts country
father let night following picture being study second eyes soon times story boys since white days ever paper hard near sentence better
best across during today others however sure means knew its try told young miles sun ways thing whole hear example heard several
change answer room sea against top turned learn point city play toward five using himself usually configuration administrator
documentation environment repository extraordinary understanding temperature responsibility"""


def made_findings(n: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed invented findings: keys among plain words, and words, names, paths, dates."""
    rng = random.Random(0)
    words = WORDS.split()
    rows, labels, lots = [], [], []
    for i in range(n):
        label = i % 2
        text = " ".join(rng.choice(words) for _ in range(24)) + " "
        start, long = len(text), [rng.choice(words) for _ in range(rng.randrange(2, 9))]
        plain = [rng.choice("-_/").join(long), f"https://{long[0]}.example/{'/'.join(long)}", "".join(long[:3]), f"20{rng.randrange(10, 40)}-01-{rng.randrange(10, 30)}T10:20:{rng.randrange(10, 60)}Z", f"{long[0]}.{long[1]}@example.com"]
        value = "".join(rng.choice(_ALPHABETS[2]) for _ in range(32)) if label else rng.choice(plain)
        text += value + " " + " ".join(rng.choice(words) for _ in range(8))
        draw = rng.getrandbits(62)
        for row in _forms(text, start, start + len(value), label, draw):
            rows.append(row)
            labels.append(label)
            lots.append(draw)
    return np.array(rows, np.int16), np.array(labels, np.int64), np.array(lots, np.int64)


def fitted(docs: DataFrame, **options) -> Network:
    """The network for a corpus, learned from its own labelled findings and from invented ones.

    Invented rows of a kind count for ``PRIOR_FINDINGS`` rows in all, shrinking as the corpus has more of its own, without a
    step. Among the other strings of a corpus are the keys that no pattern knows, which matters where it has few labelled
    secrets, so those strings count less there, by the same rule.
    """
    (codes, labels, lots), made = labelled_findings(docs, **options), made_findings()
    secrets, others = (labels == 1).sum(), (labels == 0).sum()
    prior = {1: PRIOR_FINDINGS / (secrets + PRIOR_FINDINGS), 0: PRIOR_FINDINGS / (min(secrets, others) + PRIOR_FINDINGS)}
    worth = np.concatenate([np.where(labels == 1, 1.0, 1 - prior[0]), np.where(made[1] == 1, prior[1], prior[0])])
    rows = np.concatenate([codes, made[0]])
    return train(rows, np.concatenate([labels, made[1]]), lots=np.concatenate([lots, made[2]]), worth=worth)


def finder(net: Network | None) -> Callable[[str], tuple[list[Span], list[Span]]]:
    def find(text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        asked = candidates(text, base) if net else []
        if not asked:
            return base, []
        parts = [windows(a, b) for a, b in asked]
        scores = net.scores(np.stack([encoded(text, a, b) for part in parts for a, b in part]))
        firsts = np.cumsum([0, *map(len, parts[:-1])])
        best = np.maximum.reduceat(scores, firsts)  # the window that looks most like a secret
        return base, [("learned", a, b) for (a, b), p in zip(asked, best) if p >= net.threshold]

    return find


def find_secrets(docs: DataFrame, net: Network | None = None, **options) -> DataFrame:
    """``doc_id, base, added``: spans ``(kind, start, end)`` in code points of every whole text.

    The network is fitted on a bounded sample of all labelled findings of ``docs`` (``most`` rows of either label) unless
    one is given; every candidate of every text is then scored. Added spans never overlap base ones. Null text is
    empty; a null ``doc_id`` stays null; repeated rows are returned each; no rows give no rows.
    """
    net = net or fitted(docs, **options)
    return S.find_spans(docs, lambda: finder(net))


def redact(docs: DataFrame, net: Network | None = None, **options) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in brackets, and ``n_chars`` brought up to date.

    A null text stays null, with a null ``n_chars``; an empty one stays as it is. Rows, repeated or with null ids, and their other
    columns, whatever their names, stay as they are. No rows give no rows.
    """
    net = net or fitted(docs, **options)

    @F.pandas_udf("string")
    def clean(texts):
        import pandas as pd

        find = finder(net)
        return pd.Series([None if t is None else S.redacted(t, [s for part in find(t) for s in part]) for t in texts], dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    return S.digest(found, KINDS[:3], ["start", "place"], KINDS)
