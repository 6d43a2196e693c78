"""Secret scans: base rules, and probabilistic automata inferred from labelled credentials that score every candidate's format."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialise, pick, session
from loomtext.llm.spans import Span, digest, joined

KINDS = ("assign", "access", "hex", "format")
#: Labelled credentials of each kind that the automata are fitted to, the first by hash: a bounded sample; a kind with fewer than LEAST has none.
SAMPLE, LEAST = 400, 20
#: Significance of the compatibility tests; the likelihood a candidate must reach is that quantile of held-out labelled ones'.
ALPHA, QUANTILE = 0.05, 0.02
#: Strings that both of two states at different depths must have seen before they may merge.
EVIDENCE = 30
#: How much likelier, as a logarithm, a candidate must be as a credential than as text of the corpus.
ODDS = math.log(1e5)

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}+")
#: What labelled credentials consist of, and marks after which another one may begin or before which it may end.
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CUTS = re.compile(r"[=/._+-]+")


def base_spans(text: str) -> tuple[list[Span], list[tuple[str, str]]]:
    """Spans of the base rules, and the credential each of them labels, by kind."""
    spans: list[Span] = []
    labelled: list[tuple[str, str]] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                spans.append((*m.span(), "assign"))
                labelled.append(("assign", m[2]))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= 20:
                spans.append((*m.span(), "access"))
                labelled.append(("access", m[0]))
    for m in _HEX.finditer(text):
        spans.append((*m.span(), "hex"))
        labelled.append(("hex", m[0]))
    return spans, labelled


#: Classes of characters: a state that has seen some of a class knows the others of it a little.
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-")
_CLASS = {c: k for k in _CLASSES for c in k}


class Automaton:
    """A probabilistic deterministic automaton from strings: their prefix tree, with statistically compatible states merged.

    States are reached from the root outwards. A state merges with one of its own depth unless their next characters or the lengths left
    differ significantly, so formats with other prefixes stay apart and what is random becomes one state a place. With a state of another
    depth it merges only if both have seen EVIDENCE strings, so a loop needs proof and a fixed length is kept.
    """

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.alpha = alpha
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.ends, self.total = [0], [0]
        self.left: list[Counter] = [Counter()]
        for s in sorted(strings):
            at = 0
            for i in range(len(s) + 1):
                self.total[at] += 1
                self.left[at][len(s) - i] += 1
                if i == len(s):
                    self.ends[at] += 1
                    break
                self.count[at][s[i]] += 1
                if s[i] not in self.next[at]:
                    self.next[at][s[i]] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.left.append(Counter())
                    self.ends.append(0)
                    self.total.append(0)
                at = self.next[at][s[i]]
        self._merge()
        self._prepare()

    def _bound(self, n1: int, n2: int) -> float:
        """Hoeffding's bound on the difference of two observed frequencies."""
        return math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _alike(self, x: int, y: int) -> bool:
        bound = self._bound(self.total[x], self.total[y])
        n, m, cx, cy = self.total[x], self.total[y], self.count[x], self.count[y]
        if bound >= 1:
            return True
        if any(abs(cx[c] / n - cy[c] / m) > bound for c in cx.keys() | cy.keys()):
            return False
        a = b = worst = 0.0
        for k in sorted(self.left[x].keys() | self.left[y].keys()):
            a, b = a + self.left[x][k] / n, b + self.left[y][k] / m
            worst = max(worst, abs(a - b))
        return worst <= bound

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            if not self._alike(x, y):
                return False
            todo += [(self.next[x][c], self.next[y][c]) for c in self.next[x].keys() & self.next[y].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            self.ends[x] += self.ends[y]
            self.total[x] += self.total[y]
            self.count[x] += self.count[y]
            self.left[x] += self.left[y]
            for c, to in self.next[y].items():
                if c in self.next[x]:
                    todo.append((self.next[x][c], to))
                else:
                    self.next[x][c] = to

    def _merge(self) -> None:
        layer, settled = [0], [0]
        while layer:
            kept: list[int] = []
            for c, p in sorted(((c, p) for p in layer for c in self.next[p]), key=lambda e: (-self.count[e[1]][e[0]], e)):
                b = self.next[p][c]
                if b in kept or b in settled:
                    continue
                for r in kept:
                    if self._compatible(r, b):
                        break
                else:
                    r = next((r for r in settled if min(self.total[r], self.total[b]) >= EVIDENCE and self._compatible(r, b)), None)
                    if r is None:
                        kept.append(b)
                        continue
                self.next[p][c] = r
                self._fold(r, b)
            settled += kept
            layer = kept
        self.kept = settled
        self.states = len(settled)

    def _prepare(self) -> None:
        """For each state log-probabilities of characters and of the end, and where each leads: seen ones by count; others of a class that was
        seen by the share that characters seen once have (Good and Turing); they lead where most go."""
        self.step: dict[int, dict[str, tuple[float, int]]] = {}
        self.end: dict[int, float] = {}
        for x in self.kept:
            n, seen = self.total[x], self.count[x]
            unseen = (sum(k == 1 for k in seen.values()) + 1e-4) / (n + 1) if seen else 0.0
            going = sum(seen.values())
            by_class: Counter = Counter()
            for c, k in seen.items():
                by_class[_CLASS[c]] += k
            most = self.next[x][max(seen, key=lambda c: (seen[c], c))] if seen else x
            row = {}
            for kind, k in by_class.items():
                for c in kind:
                    p = (1 - unseen) * seen[c] / n + unseen * k / going / len(kind) * (going / n)
                    row[c] = (math.log(p), self.next[x].get(c, most))
            self.step[x] = row
            self.end[x] = math.log((self.ends[x] + 0.01) / (n + 0.02))
        self.longest = max(self.left[0], default=0)

    def prefixes(self, s: str, start: int) -> Iterator[tuple[int, float]]:
        """(end, log-likelihood) of each s[start:end] that the automaton can read."""
        at, total, step = 0, 0.0, self.step
        for i in range(start, len(s)):
            to = step[at].get(s[i])
            if to is None:
                return
            total += to[0]
            at = to[1]
            if self.ends[at]:
                yield i + 1, total + self.end[at]
            if total < -1e4:
                return

    def likelihood(self, s: str) -> float:
        """The log-likelihood of the whole string, minus infinity where the automaton can't read it."""
        return next((x for end, x in self.prefixes(s, 0) if end == len(s)), -math.inf)


_CODE = np.zeros(256, np.int64)
for _i, _c in enumerate(CHARACTERS):
    _CODE[ord(_c)] = _i + 1
_N = len(CHARACTERS) + 1


def pair_counts(data: bytes) -> np.ndarray:
    """How often each character follows each other (0: any character that credentials don't have), over one string."""
    x = _CODE[np.frombuffer(data, np.uint8)]
    return np.bincount(x[:-1] * _N + x[1:], minlength=_N * _N) if len(x) > 1 else np.zeros(_N * _N, np.int64)


class Background:
    """How likely a string is as text of the corpus: by the counts of neighbouring characters over all of it."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(_N, _N) + 0.5
        self.log = np.log(c / c.sum(axis=1, keepdims=True))

    def running(self, s: str) -> np.ndarray:
        """Entry i: the log-likelihood of the first i characters one after another."""
        x = _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]
        return np.concatenate(([0.0], np.cumsum(self.log[np.concatenate(([0], x[:-1])), x])))

    def between(self, s: str, running: np.ndarray, a: int, b: int) -> float:
        """Of s[a:b] after and before a character that isn't of a credential."""
        x, y = _CODE[ord(s[a])], _CODE[ord(s[b - 1])]
        return float(self.log[0, x] + running[b] - running[a + 1] + self.log[y, 0])


class Formats:
    """An automaton for each kind of labelled credential, with the likelihood a character that held-out ones of its kind reach."""

    def __init__(self, labelled: dict[str, list[str]], counts: np.ndarray | None = None):
        self.models: list[tuple[Automaton, float]] = []
        self.background = Background(counts if counts is not None else np.zeros(_N * _N))
        shortest = []
        for kind in sorted(labelled):
            strings = sorted(set(labelled[kind]))
            if len(strings) < LEAST:
                continue
            held = []
            for k in (0, 1):  # each half is scored by an automaton of the other
                half = Automaton(strings[k::2])
                held += [half.likelihood(s) / (len(s) + 1) for s in strings[1 - k :: 2]]
            held = sorted(x for x in held if x > -math.inf)
            if held:
                self.models.append((Automaton(strings), held[int(QUANTILE * len(held))]))
                shortest.append(min(map(len, strings)))
        self.shortest = min(shortest, default=0)

    def find(self, s: str) -> list[tuple[int, int]]:
        """Non-overlapping credentials in an unbroken string: it may begin or end at marks in it; of those that begin at a place the likeliest counts."""
        if not self.models or len(s) < self.shortest:
            return []
        edges = [0]
        for m in _CUTS.finditer(s):
            edges += [m.start(), m.end()]
        edges = sorted({*edges, len(s)})
        ends, running = set(edges), self.background.running(s)
        out, free = [], 0
        for a in edges:
            if a < free or len(s) - a < self.shortest:
                continue
            best = (0.0, 0)
            for model, least in self.models:
                for b, x in model.prefixes(s, a):
                    if b in ends and x >= least * (b - a + 1):
                        odds = x - self.background.between(s, running, a, b)
                        if odds >= ODDS:
                            best = max(best, (odds, b))
            if best[1]:
                out.append((a, best[1]))
                free = best[1]
        return out

    def accepts(self, s: str) -> bool:
        return self.find(s) == [(0, len(s))]


#: Distinct strings whose verdict a worker remembers (results don't depend on it).
CACHE = 500_000


def format_spans(text: str, taken: list[Span], formats: Formats, runs: re.Pattern, known: dict[str, list[tuple[int, int]]]) -> list[Span]:
    """Credentials by format outside of the base spans, in time proportional to the text and the spans."""
    base = sorted((a, b) for a, b, _ in taken)
    starts, reach = [a for a, _ in base], []
    for _, b in base:
        reach.append(max(b, reach[-1] if reach else b))
    out = []
    for m in runs.finditer(text):
        s = m[0]
        found = known.get(s)
        if found is None:
            found = formats.find(s)
            if len(known) < CACHE and len(s) <= 256:
                known[s] = found
        for a, b in found:
            a, b = a + m.start(), b + m.start()
            i = bisect_right(starts, b - 1) - 1
            if i < 0 or reach[i] <= a:
                out.append((a, b, "format"))
    return out


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format) for every row; offsets are code points, ends exclusive.

    A first pass applies the base rules and counts neighbouring characters over all texts. The credentials the rules label, of each kind
    the first `sample` distinct ones by hash, train the automata. The second pass scores every unbroken string of every text, and the parts
    of it between marks, and those that are as likely as held-out labelled ones and 1e5 times likelier than text become spans of
    kind `format`. Null texts count as empty; very long texts take time in proportion; repeated rows stay, each with its result; ties are
    broken by start; an empty table gives an empty result; other columns may have any names. A kind with fewer than LEAST distinct labelled
    credentials has no automaton.
    """
    session(docs)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sent = np.zeros(_N * _N, np.int64), set()
        names, types = ["kind", "s", "n"], [pa.string(), pa.string(), pa.int64()]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                if t:
                    pairs += pair_counts(t.encode("utf-8", "surrogatepass"))
                    for x in base_spans(t)[1]:
                        if x not in sent:
                            if len(sent) < CACHE:
                                sent.add(x)
                            out.append((*x, 1))
            yield make(out)
        yield make([("pair", str(i), int(pairs[i])) for i in np.flatnonzero(pairs)])

    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learned = materialise(plain.select("text").mapInArrow(learn, "kind string, s string, n long").groupBy("kind", "s").agg(F.sum("n").alias("n")), "secrets")
    counts = np.zeros(_N * _N)
    for r in learned.filter("kind = 'pair'").select(F.col("s").cast("int").alias("i"), "n").collect():  # at most 69 * 69 rows
        counts[r["i"]] = r["n"]
    labelled = {k: [r["s"] for r in learned.filter(F.col("kind") == k).orderBy(F.xxhash64("s"), "s").limit(sample).collect()] for k in KINDS[:3]}
    formats = Formats(labelled, counts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, known = re.compile(rf"[A-Za-z0-9+/_.=-]{{{max(1, formats.shortest)},}}+"), {}
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format")}
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base = base_spans(t)[0] if t else []
                more = format_spans(t, base, formats, runs, known) if t and formats.models else []
                out["doc_id"].append(d)
                for k in KINDS[:3]:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(digest(base, KINDS))
                out["spans"].append(joined(base + more, KINDS))
                out["n_format"].append(len(more))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], names=list(out))

    return plain.mapInArrow(score, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
