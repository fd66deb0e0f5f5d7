"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

Each format is learned from its labelled strings as a prefix tree over character classes, whose states are merged while
their outgoing frequencies agree within the Hoeffding bound. Labelled strings come from two places: formats built by
rule, and a bounded sample of the corpus (SAMPLE_ROWS documents in expectation, PER_KIND strings of a label), where the
values of base matches are credentials and other candidates ordinary runs.

Every candidate, a run of eight or more of the characters that credentials are made of, is scored by all automata: its
likelihood under a credential format against that under the best ordinary format. Each credential format has a threshold
that no ordinary string of a held-out set reaches. A candidate that passes is a span of kind ``format``, unless it lies
inside a base span.

Defined results: a null text is the empty text and holds nothing; places are code points, ends exclusive; of formats
with equal scores the first is named; repeated rows give a row each; an empty table gives no rows; very long texts are
scanned whole; further columns are not read by the scan, and kept by ``redacted``.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, map_arrow, table

# fixed values: the base patterns, in the order of their kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as maximal runs of 32 and more
KINDS = ("assign", "access", "hex", "format")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
ALPHA, PER_KIND, SEED = 0.05, 200, 20240613
#: characters that are scanned together, and scores that are remembered at the most
CHUNK, KNOWN = 1 << 20, 1 << 16
#: documents whose strings are labelled, in expectation; formats with fewer strings than LEAST are not learned, as their states would all seem to agree
SAMPLE_ROWS, LEAST = 4000, 20

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in this order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def labelled_strings(per_kind: int = PER_KIND, seed: int = SEED) -> list[tuple[str, bool, str]]:
    """Labelled strings (format, whether a credential, string), built by rule: public credential formats, and ordinary long runs of the same characters."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    number = lambda a, b: int(rng.integers(a, b + 1))
    syllables = "an be ca de en fi ga he in jo ka le ment no or pre qui re sch tion un ver wi ing er st th".split()
    word = lambda a, b: "".join(rng.choice(syllables, number(a, b)))
    words = lambda join, a, b: join.join(word(1, 3) for _ in range(number(a, b)))
    formats: list[tuple[str, bool, Callable[[], str]]] = [
        ("hex", True, lambda: pick(DIGITS + "abcdef", number(24, 64))),
        ("upper_hex", True, lambda: pick(DIGITS + "ABCDEF", number(24, 64))),
        ("access_key", True, lambda: rng.choice(["AKIA", "ASIA"]) + pick(UPPER + DIGITS, 16)),
        ("base64", True, lambda: pick(UPPER + LOWER + DIGITS + "+/", number(24, 64)) + "=" * number(0, 2)),
        ("prefixed", True, lambda: rng.choice(["ghp_", "gho_", "sk_live_", "pk_test_", "glpat-", "AIza"]) + pick(UPPER + LOWER + DIGITS, number(20, 40))),
        ("dashed", True, lambda: f"xoxb-{pick(DIGITS, 12)}-{pick(DIGITS, 12)}-{pick(UPPER + LOWER + DIGITS, 24)}"),
        ("web_token", True, lambda: ".".join(pick(UPPER + LOWER + DIGITS + "_-", number(20, 40)) for _ in range(3))),
        ("word", False, lambda: word(3, 20)),
        ("capital", False, lambda: word(3, 20).capitalize()),
        ("shout", False, lambda: word(3, 20).upper()),
        ("camel", False, lambda: "".join(word(1, 3).capitalize() for _ in range(number(2, 7)))),
        ("number", False, lambda: pick(DIGITS, number(8, 20))),
        ("domain", False, lambda: f"{word(2, 4)}{number(0, 99)}.{word(2, 4)}.com"),
        ("path", False, lambda: words("/", 2, 9)),
        ("snake", False, lambda: words("_", 2, 9)),
        ("kebab", False, lambda: words("-", 2, 9)),
        ("sentence", False, lambda: words(".", 2, 9)),
        ("date", False, lambda: f"{number(1990, 2030)}-{number(10, 12)}-{number(10, 28)}-{number(10, 23)}-{pick(DIGITS, 6)}"),
        ("dotted", False, lambda: ".".join(str(number(0, 255)) for _ in range(number(3, 4)))),
        ("phone", False, lambda: "-".join(pick(DIGITS, number(2, 5)) for _ in range(number(2, 4)))),
        ("amount", False, lambda: f"{number(1, 10**6)}.{pick(DIGITS, number(2, 4))}"),
        ("numbered", False, lambda: f"{word(2, 6)}{rng.choice(['', '-', '_', '.'])}{pick(DIGITS, number(1, 4))}"),
        ("rule", False, lambda: str(rng.choice(["-", "=", "_", ".", "+"])) * number(8, 60)),
    ]
    return [(name, secret, str(make())) for name, secret, make in formats for _ in range(per_kind)]


def codes_of(strings: list[str]) -> list[np.ndarray]:
    lookup = np.zeros(256, np.uint8)
    for k, letters in enumerate(CLASSES):
        lookup[[ord(c) for c in letters]] = k
    return [lookup[np.frombuffer(s.encode("latin-1"), np.uint8)] for s in strings]


class Automaton:
    """A deterministic probabilistic automaton inferred by merging states of a prefix tree."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.alpha = alpha
        self.count, self.end, self.next = [0], [0], [{}]
        for codes in codes_of(strings):
            at = 0
            self.count[0] += 1
            for c in codes.tolist():
                edge = self.next[at].get(c)
                if edge is None:
                    self.count.append(0)
                    self.end.append(0)
                    self.next.append({})
                    edge = self.next[at][c] = [len(self.count) - 1, 0]
                edge[1] += 1
                at = edge[0]
                self.count[at] += 1
            self.end[at] += 1
        self._merge_states()

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > (math.sqrt(1 / n) + math.sqrt(1 / m)) * math.sqrt(0.5 * math.log(2 / self.alpha))

    def _agree(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.count[a], self.count[b]
            if self._differ(self.end[a], n, self.end[b], m):
                return False
            for c in {**self.next[a], **self.next[b]}:
                x, y = self.next[a].get(c), self.next[b].get(c)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    stack.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.count[a] += self.count[b]
            self.end[a] += self.end[b]
            for c, (child, n) in self.next[b].items():
                if mine := self.next[a].get(c):
                    mine[1] += n
                    stack.append((mine[0], child))
                else:
                    self.next[a][c] = [child, n]

    def _merge_states(self) -> None:
        """Settled states keep their place; a state next to them joins the first one it agrees with, or settles itself."""
        settled = [0]
        while fringe := [(self.count[e[0]], s, c) for s in settled for c, e in self.next[s].items() if e[0] not in settled]:
            _, s, c = max(fringe, key=lambda x: (x[0], -x[1], -x[2]))
            edge = self.next[s][c]
            for other in settled:
                if self._agree(other, edge[0]):
                    child, edge[0] = edge[0], other
                    self._fold(other, child)
                    break
            else:
                settled.append(edge[0])
        self.states = settled

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-probabilities, next states, log-probabilities of the end); the last state stands for unseen steps."""
        place, k = {s: i for i, s in enumerate(self.states)}, len(CLASSES)
        n = len(self.states)
        logp, step, end = np.full((n + 1, k), math.log(1 / (k + 1)) - 2), np.full((n + 1, k), n), np.full(n + 1, math.log(1 / (k + 1)))
        for s, i in place.items():
            total = self.count[s] + 0.1 * (k + 1)
            logp[i] = math.log(0.1 / total)
            end[i] = math.log((self.end[s] + 0.1) / total)
            for c, (child, m) in self.next[s].items():
                logp[i, c], step[i, c] = math.log((m + 0.1) / total), place[child]
        return logp, step, end


@dataclass
class Model:
    logp: np.ndarray
    step: np.ndarray
    end: np.ndarray
    starts: np.ndarray
    secret: np.ndarray
    names: list[str]
    #: by credential format
    thresholds: np.ndarray | None = None

    def likelihoods(self, strings: list[str]) -> np.ndarray:
        """The log-likelihood of each string under each format; all strings advance together."""
        codes = codes_of(strings)
        sizes = np.array([len(c) for c in codes])
        order = np.argsort(-sizes, kind="stable")
        total = np.zeros((len(codes), len(self.starts)))
        state = np.tile(self.starts, (len(codes), 1))
        flat, begin = np.concatenate(codes), (np.cumsum(sizes) - sizes)[order]
        ordered = sizes[order]
        for t in range(int(ordered[0])):
            m = int(np.searchsorted(-ordered, -t, side="left"))
            c = flat[begin[:m] + t][:, None]
            total[:m] += self.logp[state[:m], c]
            state[:m] = self.step[state[:m], c]
        total += self.end[state]
        out = np.empty_like(total)
        out[order] = total
        return out

    def ratios(self, strings: list[str]) -> np.ndarray:
        """By string and credential format the log-likelihood ratio against the best ordinary format."""
        found = self.likelihoods(strings)
        return found[:, self.secret] - found[:, ~self.secret].max(axis=1)[:, None]

    def scores(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of the format) of each string: how far the ratio is above its format's threshold, for the best format; zero and more are credentials."""
        above = self.ratios(strings) - self.thresholds
        best = above.argmax(axis=1)
        return above[np.arange(len(best)), best], np.flatnonzero(self.secret)[best]


def fit(labelled: list[tuple[str, bool, str]], held_out: list[tuple[str, bool, str]], alpha: float = ALPHA) -> Model:
    """An automaton for each format; the thresholds lie above all held-out strings that are no credentials."""
    parts, starts, names, secret, at = [], [], [], [], 0
    for name, is_secret in dict.fromkeys((n, s) for n, s, _ in labelled):
        logp, step, end = Automaton([x for n, s, x in labelled if (n, s) == (name, is_secret)], alpha).arrays()
        parts.append((logp, step + at, end))
        starts.append(at)
        at += len(end)
        names.append(name)
        secret.append(is_secret)
    model = Model(*(np.concatenate(x) for x in zip(*parts, strict=True)), np.array(starts), np.array(secret), names)
    model.thresholds = np.maximum(model.ratios([x for _, s, x in held_out if not s]).max(axis=0) + 1.0, 3.0)
    return model


@functools.cache
def rule_strings() -> tuple[list[tuple[str, bool, str]], list[tuple[str, bool, str]]]:
    return labelled_strings(), labelled_strings(PER_KIND, SEED + 1)


@functools.cache
def default_model() -> Model:
    """Learned from the strings built by rule alone."""
    return fit(*rule_strings())


VALUES = ("corpus_assign", "corpus_access", "corpus_hex")


def corpus_strings(texts: list[str], model: Model) -> list[tuple[str, bool, str]]:
    """Labelled strings of texts: values of base matches, and the candidates that are neither near a base match nor credentials by the rules."""
    out: list[tuple[str, bool, str]] = []
    plain: dict[str, None] = {}
    for text in texts:
        spans = base_spans(text)
        for a, kind, b in spans:
            value = ASSIGN.match(text, a).group(2) if kind == 0 else text[a:b]
            if CANDIDATE.fullmatch(value):
                out.append((VALUES[kind], True, value))
        reach = Reach(spans)
        plain.update((m.group(), None) for m in CANDIDATE.finditer(text) if not reach.touches(*m.span()))
    if plain:
        score, _ = model.scores(list(plain))
        out += [("corpus_plain", False, x) for x, s in zip(plain, score.tolist(), strict=True) if s < 0]
    return out


def corpus_labels(df: DataFrame, rows: int = SAMPLE_ROWS, most: int = PER_KIND, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, bool, str, bool]]:
    """(format, whether a credential, string, whether held out) from a sample of the corpus; at most ``most`` strings of a format on either side."""
    texts, model = ids_and_texts(df, id_col, text_col), default_model()
    total = texts.count()
    share = min(1.0, rows / max(1, total))
    chosen = texts.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = corpus_strings(batch.column("text").to_pylist(), model)
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.string(), pa.bool_(), pa.string()), strict=True)], names=["format", "secret", "value"])

    found = map_arrow(chosen, run, "format string, secret boolean, value string").distinct()
    found = found.withColumn("mark", F.xxhash64(F.lit(SEED + 1), "value")).withColumn("held_out", F.pmod("mark", F.lit(2)) == 1)
    # the sample is bounded, and so is a format's share of it
    place = F.row_number().over(Window.partitionBy("format", "held_out").orderBy("mark", "value"))
    return [tuple(r) for r in found.withColumn("place", place).where(F.col("place") <= most).orderBy("format", "held_out", "place").select("format", "secret", "value", "held_out").collect()]


def corpus_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learned from the strings built by rule and from labelled strings of the corpus."""
    own = corpus_labels(df, id_col=id_col, text_col=text_col)
    train, held = rule_strings()
    enough = Counter(x[0] for x in own if not x[3])
    return fit(train + [x[:3] for x in own if not x[3] and enough[x[0]] >= LEAST], held + [x[:3] for x in own if x[3]])


class Reach:
    """Which stretches meet spans, and which lie inside one."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [s for s, _, _ in spans]
        self.ends = [0, *itertools.accumulate((e for _, _, e in spans), max)]  # the furthest end of the first so many spans

    def touches(self, a: int, b: int) -> bool:
        return self.ends[bisect.bisect_left(self.starts, b)] > a

    def holds(self, a: int, b: int) -> bool:
        return self.ends[bisect.bisect_right(self.starts, a)] >= b


@dataclass
class Scan:
    base: list[tuple[int, int, int]]
    #: base spans and those of formats
    spans: list[tuple[int, int, int]]
    #: (start, end, name of the format, score) of each candidate that passes, inside a base span or not
    formats: list[tuple[int, int, str, float]]
    candidates: int = 0
    best: float | None = None


def scan(texts: list[str], model: Model) -> Iterator[Scan]:
    """For each text its base spans and all its spans, every candidate scored. Texts are taken CHUNK characters at a time, and a score is remembered for the strings met lately."""
    known: dict[str, tuple[float, int]] = {}
    begin, held = 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text) + 1
        if held >= CHUNK or end == len(texts):
            yield from _scan(texts[begin:end], model, known)
            begin, held = end, 0
            if len(known) > KNOWN:
                known.clear()


def _scan(texts: list[str], model: Model, known: dict[str, tuple[float, int]]) -> list[Scan]:
    found = [Scan(b, list(b), []) for b in map(base_spans, texts)]
    places = [[(m.start(), m.end(), m.group()) for m in CANDIDATE.finditer(text)] for text in texts]
    unlike = [x for x in dict.fromkeys(p[2] for own in places for p in own) if x not in known]
    for a in range(0, len(unlike), 4096):
        some = unlike[a : a + 4096]
        known.update(zip(some, zip(*(x.tolist() for x in model.scores(some)), strict=True), strict=True))
    for own, here in zip(found, places, strict=True):
        reach = Reach(own.base)
        for a, b, value in here:
            s, f = known[value]
            own.candidates += 1
            own.best = s if own.best is None else max(own.best, s)
            if s >= 0:
                own.formats.append((a, b, model.names[f], s))
                if not reach.holds(a, b):
                    own.spans.append((a, 3, b))
        own.spans.sort()
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of each whole text. n_candidates were scored, best_score is the highest above a format's threshold; formats names the format and score of each candidate that passes, as start:end:format:score."""
    model = model or corpus_model(df, id_col, text_col)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string, n_candidates long, best_score double, formats string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for own in scan(batch.column("text").to_pylist(), model):
            counts = [sum(k == want for _, k, _ in own.spans) for want in range(4)]
            formats = ",".join(f"{a}:{b}:{name}:{s:.3f}" for a, b, name, s in own.formats)
            rows.append((*counts, hashlib.sha256(joined(own.base).encode()).hexdigest(), joined(own.spans), own.candidates, own.best, formats))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string()]
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return map_arrow(ids_and_texts(df, id_col, text_col), run, schema)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, model: Model | None = None, mark: str = "<secret>", text_col: str = "text") -> DataFrame:
    """df with each stretch of secrets in its texts replaced by mark; a null text stays null."""
    model, place = model or corpus_model(df.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))), df.columns.index(text_col)
    schema = df.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(place).to_pylist()
        new = [masked(t, own.spans, mark) if own.spans else t for t, own in zip(texts, scan([t or "" for t in texts], model), strict=True)]
        columns = list(batch.columns)
        columns[place] = pa.array(new, columns[place].type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(df, run, schema)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The secrets of all documents; nulls, repeated rows and empty tables as in this module's docstring."""
    return secrets(table(spark, sf_dir, "documents"))
