"""Secret scan: patterns propose, a character convolutional network judges every candidate in its context.

Candidates are the spans of three base patterns, which always stay, and what else may be a key: passwords in URLs and long
runs of key-like characters with a letter, dots within them included. The network (embedding, one convolution, maximum
over places, logistic output) sees a candidate's characters apart from those around it. It is trained on the distinct
labelled findings of all documents, spans of the base patterns against two ordinary words or numbers of each
document, and on made-up ones in the text around those: keys of shapes that no pattern knows, and identifiers, paths,
UUIDs and addresses that are none. All come in upper case too, as text is often shouted, and keys also behind other
text. A fifth of the findings is held out; on all of it the scores are calibrated and the threshold is set to the highest
that still recalls the wanted share. The driver trains the start on few findings; where there are more, tasks go on from
there, each over its part of all findings, and the mean of their weights counts (iterative parameter mixing).
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Collection, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, sliced

KINDS = ("assign", "access", "hex", "model")
MODEL = 3
MAX_POSITIVES, MAX_NEGATIVES = 1_500, 3_000  # findings on the driver, where training starts; tasks go on with all
PART, ROUNDS = 40_000, 2  # findings of a task's part of the training, about, and how often the parts' weights are mixed
TEMPERATURES = tuple(float(t) for t in np.geomspace(0.25, 8, 41))
MADE_UP = 150  # findings of each made-up shape, whatever the documents hold
RECALL = 0.98

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_IN_URL = re.compile(r"://[^\s/:@]*:([^\s/@]{6,})@")
_LETTER = re.compile(r"[A-Za-z]")
_DIGIT = re.compile(r"[0-9]")
_ORDINARY = re.compile(r"\S{6,}")

BEFORE, STEP, WIDTH = 24, 48, 88  # characters before a window's own part, of that part, and of the window
INSIDE = 99  # pad, 95 printable, line break, other ASCII, beyond ASCII
CLASSES = 2 * INSIDE  # of the candidate, then the same of the text around it
SIZE, REACH, FILTERS = 8, 5, 32
WEIGHTS = ("letters", "filters", "bias", "out", "offset")

Span = tuple[int, int, int]  # start, kind, end


def _apart(taken: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Tells whether a stretch overlaps none of the taken ones."""
    ordered = sorted(taken)
    starts, ends = [s for s, _ in ordered], list(accumulate((e for _, e in ordered), max))

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or ends[before - 1] <= start

    return free


def _left_over(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key-like characters outside the taken stretches, without dots at their ends."""
    ordered, first = sorted(taken), 0
    for run in _LONG.finditer(text):
        at, pieces = run.start(), []
        while first < len(ordered) and ordered[first][1] <= at:
            first += 1
        later = first
        while later < len(ordered) and ordered[later][0] < run.end():
            pieces.append((at, ordered[later][0]))
            at = max(at, ordered[later][1])
            later += 1
        for start, end in (*pieces, (at, run.end())):
            while start < end and text[start] == ".":
                start += 1
            while start < end and text[end - 1] == ".":
                end -= 1
            if end - start >= 16:
                yield start, end


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans in order, and the other candidates in order; places are code points, ends exclusive."""
    base: list[Span] = []
    lowered = text.lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # A run of hex digits lies within one run of key-like characters.
    for m in _LONG.finditer(text):
        if m.end() - m.start() >= 24:
            base += [(h.start(), 2, h.end()) for h in _HEX.finditer(text, m.start(), m.end())]
    base.sort()
    taken = [(s, e) for s, _, e in base]
    others: list[Span] = []
    if "://" in text and "@" in text:
        free = _apart(taken)
        others = [(m.start(1), MODEL, m.end(1)) for m in _IN_URL.finditer(text) if free(*m.span(1))]
    taken += [(s, e) for s, _, e in others]
    others += [(s, MODEL, e) for s, e in _left_over(text, taken) if _LETTER.search(text, s, e)]
    return base, sorted(others)


_CODES = np.full(128, 97, np.int16)
_CODES[32:127] = np.arange(1, 96)
_CODES[10] = 96


def windows(text: str, span: Span) -> Iterator[np.ndarray]:
    """Character classes in and around a span; one window for every ``STEP`` characters of it."""
    start, _, end = span
    for at in range(start, end, STEP):
        left = at - BEFORE
        part = text[max(left, 0) : at - BEFORE + WIDTH]
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        codes = np.where(points < 128, _CODES[np.minimum(points, 127)], 98)
        window = np.zeros(WIDTH, np.int64)
        window[max(-left, 0) : max(-left, 0) + len(codes)] = codes
        places = np.arange(left, left + WIDTH)
        yield np.where((window > 0) & ((places < start) | (places >= end)), window + INSIDE, window)


@dataclass
class Network:
    """Weights, the temperature of the scores and the threshold on the calibrated probability."""

    letters: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float
    temperature: float = 1.0
    threshold: float = 0.5
    findings: int = 0  # distinct ones of the documents, held-out ones included

    def _convolved(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = np.lib.stride_tricks.sliding_window_view(self.letters[codes], REACH, axis=1)  # n, place, letter size, reach
        patches = seen.reshape(*seen.shape[:2], -1)
        return patches, patches @ self.filters + self.bias

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [
            np.maximum(self._convolved(codes[i : i + 512])[1].max(axis=1), 0) @ self.out + self.offset for i in range(0, len(codes), 512)
        ]
        return np.concatenate(parts) if parts else np.empty(0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(codes) / self.temperature, -30, 30)))

    @classmethod
    def trained(
        cls, codes: np.ndarray, labels: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 8, start: Network | None = None
    ) -> Network:
        """Adam on the logistic loss, both labels weighted alike; goes on from ``start`` if there is one."""
        draw = np.random.default_rng(seed)
        net = replace(start) if start else cls(
            draw.normal(0, 0.5, (CLASSES, SIZE)), draw.normal(0, (SIZE * REACH) ** -0.5, (SIZE * REACH, FILTERS)),
            np.zeros(FILTERS), draw.normal(0, 0.3, FILTERS), 0.0,
        )
        weights = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        first, second, step = {k: 0.0 for k in WEIGHTS}, {k: 0.0 for k in WEIGHTS}, 0
        for _ in range(epochs):
            order = draw.permutation(len(codes))
            for start in range(0, len(order), 64):
                own = order[start : start + 64]
                patches, heights = net._convolved(codes[own])
                top = heights.argmax(axis=1)
                pooled = np.take_along_axis(heights, top[:, None], 1)[:, 0]
                active = np.maximum(pooled, 0)
                error = (1 / (1 + np.exp(-np.clip(active @ net.out + net.offset, -30, 30))) - labels[own]) * weights[own] / len(own)
                back = error[:, None] * net.out * (pooled > 0)
                used = np.take_along_axis(patches, top[:, :, None], 1)  # n, filter, patch
                to_patch = back[:, :, None] * net.filters.T
                at = codes[own][np.arange(len(own))[:, None, None], top[:, :, None] + np.arange(REACH)]
                parts = to_patch.reshape(*to_patch.shape[:2], SIZE, REACH).transpose(2, 0, 1, 3)
                letters = np.stack([np.bincount(at.ravel(), p.ravel(), CLASSES) for p in parts], axis=1)
                slopes = {
                    "letters": letters, "filters": np.einsum("nfp,nf->pf", used, back), "bias": back.sum(axis=0),
                    "out": active.T @ error, "offset": error.sum(),
                }
                step += 1
                for k in WEIGHTS:
                    first[k] = 0.9 * first[k] + 0.1 * slopes[k]
                    second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
                    move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(net, k, getattr(net, k) - move)
        return net

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float) -> Network:
        """Temperature of least loss on held-out findings, then a threshold that recalls the wanted share of them."""
        logits = self.logits(codes)

        def loss(t: float) -> float:
            return float(np.mean(np.logaddexp(0, np.where(labels == 1, -logits, logits) / t)))

        self.temperature = min(TEMPERATURES, key=loss)
        found = np.sort(self.probabilities(codes)[labels == 1])
        spare = int((1 - recall) * len(found))
        # Half way from the last finding that must be recalled to the highest score of an ordinary run, if that is lower.
        # Without a held-out positive nothing but a sure score counts.
        ordinary = float(self.probabilities(codes)[labels == 0].max(initial=0.0))
        self.threshold = float(min(found[spare], (found[spare] + ordinary) / 2)) if len(found) else 0.99
        return self


def _findings(batches) -> Iterator[pa.RecordBatch]:
    """Labelled windows: all base spans, and up to two ordinary runs of each document; ``rank`` is a hash of the window."""
    for batch in sliced(batches):
        kept: dict[int, set[bytes]] = {1: set(), 0: set()}
        for text in batch.column(0):
            text = text.as_py() or ""
            base, others = find(text)
            doubtful = [s for s in others if _DIGIT.search(text, s[0], s[2]) or text.startswith("@", s[2])]
            free = _apart((s, e) for s, _, e in base + doubtful)
            plain = [(m.start(), MODEL, m.end()) for m in _ORDINARY.finditer(text) if free(*m.span())]
            plain = heapq.nsmallest(2, plain, key=lambda s: (zlib.crc32(text[s[0] : s[2]].encode("utf-8", "surrogatepass")), s))
            for label, spans in ((1, base), (0, plain)):
                kept[label].update(next(windows(text, span)).astype(np.uint8).tobytes() for span in spans)
        rows = [(window, label, zlib.crc32(window)) for label, found in kept.items() for window in found]
        codes, labels, ranks = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(labels, pa.int32()), pa.array(ranks, pa.int64())], names=["codes", "label", "rank"])


_LOW, _CAPS, _NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ANY = _LOW + _CAPS + _NUM


class _Shapes:
    """Made-up findings by shape: ``keys`` and what only looks like one. ``words`` are words of the documents."""

    def __init__(self, words: list[str], seed: int = 9):
        self.draw, self.words = np.random.default_rng(seed), words or ["value"]
        self.keys: dict[str, Callable[[], str]] = {
            "github": lambda: str(self.draw.choice(["ghp_", "gho_", "ghs_"])) + self.of(_ANY, 36),
            "stripe": lambda: str(self.draw.choice(["sk_live_", "rk_live_", "sk_test_"])) + self.of(_ANY, 24, 40),
            "slack": lambda: f"xoxb-{self.of(_NUM, 11, 14)}-{self.of(_NUM, 11, 14)}-{self.of(_ANY, 24)}",
            "google": lambda: "AIza" + self.of(_ANY + "-_", 35),
            "jwt": lambda: f"eyJ{self.of(_ANY, 17, 33)}.eyJ{self.of(_ANY, 30, 90)}.{self.of(_ANY + '-_', 43)}",
            "url_password": lambda: self.of(_ANY + "!$%^&*_-", 8, 20),
            "password": lambda: self.of(_ANY + "!$%^&*_-", 8, 20),
            "pem_body": lambda: "MII" + self.of(_ANY + "+/", 61),
            "base64": lambda: self.of(_ANY + "+/", 24, 48) + str(self.draw.choice(["", "=", "=="])),
            "capitals": lambda: self.of(_CAPS + _NUM, 20, 40),
            "hex_capitals": lambda: self.of(_NUM + "ABCDEF", 24, 64),
            "lower": lambda: self.of(_LOW + _NUM, 20, 40),
            "letters": lambda: self.of(_LOW + _CAPS, 24, 40),
        }
        self.harmless: dict[str, Callable[[], str]] = {
            "snake": lambda: "_".join(self.some(3, 6)),
            "kebab": lambda: "-".join(self.some(3, 7)),
            "camel": lambda: "".join(w.capitalize() for w in self.some(3, 6)),
            "constant": lambda: "_".join(self.some(3, 6)).upper(),
            "path": lambda: "/".join(self.some(3, 7)) + str(self.draw.choice(["", ".py", ".html", ".json", "/"])),
            "address": lambda: f"www.{'.'.join(self.some(1, 3))}.com/{'/'.join(self.some(1, 4))}?page={self.of(_NUM, 1, 5)}",
            "dotted": lambda: ".".join(self.some(3, 6)),
            "host": lambda: f"{self.some(1, 2)[0]}{self.of(_NUM, 1, 3)}.{'.'.join(self.some(1, 3))}.org",
            "mail_host": lambda: f"{self.some(1, 2)[0].lower()}{self.of(_NUM, 1)}.{self.some(1, 2)[0].lower()}.{self.draw.choice(['com', 'org', 'net', 'de'])}",
            "mail_name": lambda: ".".join(self.some(2, 4)) + self.of(_NUM, 1, 4),
            "uuid": lambda: "-".join(self.of(_NUM + "abcdef", n) for n in (8, 4, 4, 4, 12)),
            "time": lambda: f"20{self.of(_NUM, 2)}-{self.of('01', 2)}-{self.of('012', 2)}T{self.of('012', 2)}",
            "dated_file": lambda: f"{'_'.join(self.some(1, 4))}_20{self.of(_NUM, 6)}.csv",
            "version": lambda: f"{'-'.join(self.some(1, 4))}-{self.of(_NUM, 1)}.{self.of(_NUM, 1, 3)}.{self.of(_NUM, 1, 4)}.tar.gz",
            "number": lambda: f"{self.some(1, 2)[0]}-{self.of(_NUM, 8, 17)}",
            "rule": lambda: self.of("=-_", 1) * int(self.draw.integers(16, 60)),
            "long_word": lambda: "".join(self.some(3, 6)).lower(),
            "sentence_end": lambda: ".".join(self.some(2, 4)) + "." + self.of(_NUM, 1, 4),
        }

    def of(self, letters: str, least: int, most: int | None = None) -> str:
        size = least if most is None else int(self.draw.integers(least, most))
        return "".join(self.draw.choice(list(letters), size))

    def some(self, least: int, most: int) -> list[str]:
        return [self.words[i] for i in self.draw.integers(0, len(self.words), int(self.draw.integers(least, most)))]


def _text(codes: np.ndarray) -> str:
    """Characters of a window, as far as their classes tell them."""
    classes = codes[codes > 0] % INSIDE
    return "".join(chr(31 + c) if c < 96 else "\n" if c == 96 else "\t" if c == 97 else "\u00e9" for c in classes.tolist())


def made_up(number: int, ordinary: np.ndarray, without: Collection[str] = (), seed: int = 9) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and shapes of ``number`` findings of every shape but those ``without``, in the text of ordinary ones."""
    texts = [_text(w) for w in ordinary]
    shapes = _Shapes(sorted({w for t in texts for w in re.findall(r"[A-Za-z]{2,12}", t)}), seed)
    draw, codes, labels, names = shapes.draw, [], [], []
    frames = [("", ""), (" ", " "), (" ", "\n"), ("\n", "\n"), (' "', '" '), ("='", "'"), (": ", "\n"), ("(", ")"), (" ", ". "), (" ", ", ")]
    for label, kinds in ((1, shapes.keys), (0, shapes.harmless)):
        for name, make in kinds.items():
            for _ in range(0 if name in without else number):
                left, right = texts[draw.integers(len(texts))], texts[draw.integers(len(texts))]
                before, after = frames[draw.integers(len(frames))]
                if name == "url_password":
                    before, after = f" {draw.choice(['https', 'ftp', 'postgres'])}://{shapes.some(1, 2)[0]}:", f"@{shapes.some(1, 2)[0]}.com/ "
                elif name == "mail_host":
                    before = f"{before}{'.'.join(shapes.some(1, 3))}{shapes.of(_NUM, 1, 3)}@"
                elif name == "mail_name":
                    after = f"@{shapes.some(1, 2)[0]}.com{after}"
                key = make()
                text = left + before + key + after + right
                start = len(left) + len(before)
                seen = list(windows(text, (start, MODEL, start + len(key))))
                codes.append(seen[draw.integers(len(seen))])
                labels.append(label)
                names.append(name)
    return np.stack(codes), np.array(labels, np.int64), names


_UPPER = np.arange(CLASSES)
for _first in (ord("a") - 31, ord("a") - 31 + INSIDE):
    _UPPER[_first : _first + 26] -= 32


def _varied(codes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The findings, also with other text in front of the positives, and all of it in upper case too."""
    ordinary, found = codes[labels == 0], codes[labels == 1].copy()
    if len(ordinary):
        found[:, :BEFORE] = ordinary[np.arange(len(found)) % len(ordinary), :BEFORE]
    codes, labels = np.concatenate([codes, found]), np.concatenate([labels, np.ones(len(found), labels.dtype)])
    return np.concatenate([codes, _UPPER[codes]]), np.concatenate([labels, labels])


def _in_parts(findings: DataFrame, number: int, work: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on the codes and labels of every part; parts and the order in them follow from the findings alone."""

    def run(batches):
        rows = sorted(row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in ("rank", "codes", "label")), strict=True))
        if rows:
            yield work(np.stack([np.frombuffer(codes, np.uint8) for _, codes, _ in rows]), np.array([label for *_, label in rows], np.int64))

    return findings.repartition(max(1, -(-number // PART)), "codes").mapInArrow(run, schema)


def _mixed(findings: DataFrame, number: int, start: Network, codes: np.ndarray, labels: np.ndarray) -> Network:
    """Training goes on from ``start`` over all ``findings``: tasks learn from their parts and the made-up ``codes``, their mean weights count."""
    context, network = findings.sparkSession.sparkContext, start
    for turn in range(ROUNDS):
        shared = context.broadcast((network, codes.astype(np.uint8), labels))

        def learn(own: np.ndarray, kinds: np.ndarray, shared=shared, turn=turn) -> pa.RecordBatch:
            before, more, more_kinds = shared.value
            varied = _varied(np.concatenate([own, more]), np.concatenate([kinds, more_kinds]))
            after = Network.trained(*varied, epochs=1, rate=0.002, seed=turn, start=before)
            weights = np.concatenate([np.ravel(getattr(after, k)) for k in WEIGHTS])
            return pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64()), pa.array([weights], pa.list_(pa.float64()))], names=["n", "weights"])

        places = _in_parts(findings, number, learn, "n long, weights array<double>").select("n", F.posexplode("weights").alias("place", "weight"))
        means = places.groupBy("place").agg((F.sum(F.col("n") * F.col("weight")) / F.sum("n")).alias("weight"))
        # One row, of as many numbers as a network has, however many parts there are.
        mean = np.array([w for _, w in means.agg(F.array_sort(F.collect_list(F.struct("place", "weight")))).first()[0]])
        at, network = 0, replace(network)
        for k in WEIGHTS:
            shape = np.shape(getattr(network, k))
            size = int(np.prod(shape))
            setattr(network, k, mean[at : at + size].reshape(shape) if shape else float(mean[at]))
            at += size
    return network


def _calibrated(held: DataFrame, number: int, network: Network, codes: np.ndarray, labels: np.ndarray, recall: float) -> Network:
    """:meth:`Network.calibrate` on all ``held`` findings and the made-up ``codes``, without bringing them to the driver."""
    shared = held.sparkSession.sparkContext.broadcast(network)

    def score(own: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        own, kinds = _varied(own, kinds)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(shared.value.logits(own), pa.float64())], names=["label", "logit"])

    own, kinds = _varied(codes, labels)
    made = held.sparkSession.createDataFrame(list(zip(kinds.tolist(), network.logits(own).tolist(), strict=True)), "label long, logit double")
    scores = cut(_in_parts(held, number, score, "label long, logit double").union(made))
    wrong = F.when(F.col("label") == 1, -F.col("logit")).otherwise(F.col("logit"))
    losses = [F.avg(F.greatest(wrong / t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(wrong / t)))) for t in TEMPERATURES]
    *losses, n, ordinary = scores.agg(*losses, F.count_if(F.col("label") == 1), F.max(F.when(F.col("label") == 0, F.col("logit")))).first()
    lowest = scores.where("label = 1").orderBy("logit").offset(int((1 - recall) * n)).limit(1).first()
    temperature = TEMPERATURES[int(np.argmin(losses))]
    sure = lambda logit: float(1 / (1 + np.exp(-np.clip(logit / temperature, -30, 30))))
    threshold = min(sure(lowest.logit), (sure(lowest.logit) + sure(ordinary)) / 2) if lowest else 0.99
    return replace(network, temperature=temperature, threshold=threshold)


def train(documents: DataFrame, recall: float = RECALL, without: Collection[str] = ()) -> Network | None:
    """A network from the distinct findings of all documents and ``MADE_UP`` of each made-up shape.

    The driver trains on ``MAX_POSITIVES`` and ``MAX_NEGATIVES`` findings at most, those of the smallest hashes. If there are
    more, this is only the start: tasks go on over all findings, and temperature and threshold come from all held-out ones.
    Shapes named in ``without`` are not shown, so that recall on an unknown kind can be measured. None without ordinary
    runs; then the base patterns alone decide.
    """
    findings = cut(documents.select("text").mapInArrow(_findings, "codes binary, label int, rank long").dropDuplicates(["codes", "label"]))
    rows = []
    for label, most in ((1, MAX_POSITIVES), (0, MAX_NEGATIVES)):
        rows += findings.where(F.col("label") == label).orderBy("rank", "codes").limit(most).collect()
    labels = np.array([r.label for r in rows], np.int64)
    if not (labels == 0).any():
        return None
    number = findings.count()
    codes = np.stack([np.frombuffer(bytes(r.codes), np.uint8).astype(np.int64) for r in rows])
    held = np.array([r.rank % 5 == 0 for r in rows])
    more, kinds, _ = made_up(MADE_UP, codes[labels == 0], without)
    more_held = np.arange(len(more)) % 5 == 0
    codes, labels, held = np.concatenate([codes, more]), np.concatenate([labels, kinds]), np.concatenate([held, more_held])
    network = Network.trained(*_varied(codes[~held], labels[~held]))
    if number == len(rows):
        network.calibrate(*_varied(codes[held], labels[held]), recall)
    else:
        network = _mixed(findings.where("rank % 5 <> 0"), number, network, more[~more_held], kinds[~more_held])
        network = _calibrated(findings.where("rank % 5 = 0"), number, network, more[more_held], kinds[more_held], recall)
    return replace(network, findings=number)


def judged(texts: list[str], network: Network | None) -> list[tuple[list[Span], list[Span], float | None]]:
    """Base spans, all spans and the highest score of any candidate, for each text."""
    found = [find(t) for t in texts]
    scores: dict[tuple[int, Span], float] = {}
    if network is not None:
        owners, codes = [], []
        for number, (text, (base, others)) in enumerate(zip(texts, found, strict=True)):
            for span in base + others:
                for window in windows(text, span):
                    owners.append((number, span))
                    codes.append(window)
        if codes:
            for owner, p in zip(owners, network.probabilities(np.stack(codes)).tolist(), strict=True):
                scores[owner] = max(p, scores.get(owner, 0.0))
    out = []
    for number, (base, others) in enumerate(found):
        more = [s for s in others if scores.get((number, s), 0.0) >= network.threshold] if network else []
        own = [scores[number, s] for s in base + others if (number, s) in scores]
        out.append((base, sorted(base + more), max(own) if own else None))
    return out


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(documents: DataFrame, **training: float) -> DataFrame:
    """``doc_id``, base counts and digest, ``spans`` and ``top_score`` of every row of ``documents``.

    Null texts count as empty, an empty table gives an empty one. Spans of the network never overlap those of the
    patterns. ``top_score`` is the highest calibrated score of a candidate, null without candidates or network. Equal
    texts get equal results; repeated rows and null ids are scanned like any row. Texts of any length are searched
    whole; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, **training))

    def run(batches):
        for batch in sliced(batches):
            found = judged([t or "" for t in batch.column(1).to_pylist()], shared.value)
            counts = [[sum(k == kind for _, k, _ in base) for base, _, _ in found] for kind in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(written_spans(base).encode()).hexdigest() for base, _, _ in found], pa.string()),
                    pa.array([written_spans(spans) for _, spans, _ in found], pa.string()),
                    pa.array([None if p is None else round(p, 3) for _, _, p in found], pa.float64()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "top_score"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, top_score double"
    )


def mask(text: str, spans: list[Span], sign: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by ``sign``."""
    parts, at, last = [], 0, -1
    for start, _, end in spans:
        if start >= last:
            parts += [text[at:start], sign]
        at = last = max(last, end)
    return "".join(parts) + text[at:]


def masked(documents: DataFrame, sign: str = "[secret]", **training: float) -> DataFrame:
    """``documents`` with every secret replaced in ``text``, and ``n_chars``, where that is a whole number, counted again."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, **training))
    names = [f.name for f in documents.schema.fields]
    length = next((f.name for f in documents.schema.fields if f.name == "n_chars" and isinstance(f.dataType, T.IntegralType)), None)

    def run(batches):
        for batch in sliced(batches):
            texts = batch.column(names.index("text")).to_pylist()
            found = judged([t or "" for t in texts], shared.value)
            if any(spans for _, spans, _ in found):
                clean = [mask(t, spans, sign) if spans else t for t, (_, spans, _) in zip(texts, found, strict=True)]
                columns = list(batch.columns)
                at = names.index("text")
                columns[at] = pa.array(clean, columns[at].type)
                if length is not None:
                    at = names.index(length)
                    counts = [len(c) if spans else n for c, (_, spans, _), n in zip(clean, found, columns[at].to_pylist(), strict=True)]
                    columns[at] = pa.array(counts, columns[at].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return documents.mapInArrow(run, documents.schema)
