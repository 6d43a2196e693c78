"""Personal data: base rules seed entities, lexical patterns around them are scored on a pattern-instance graph and find more."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialise, pick, session
from loomtext.llm.spans import Span, digest, joined

KINDS = ("email", "ip", "card", "phone", "context")
#: The share of a pattern's instances that must be known, how many known ones it must have, and what an instance must reach;
#: instances without a digit need patterns of PLAIN.
PRECISION, SUPPORT, CONFIDENCE, PLAIN = 0.6, 3.0, 0.6, 0.8
#: Two words lead to instances if a seed follows them in this share of the places where they stand.
LEAD = 0.25
#: Bits of the filter that holds the contexts of seeds; its size doesn't depend on the data, and what it lets through too much is joined away.
FILTER_BITS = 22
#: A hot string or pattern is dealt to so many tasks.
SALTS = 16

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _DIGIT_RUN = re.compile(r"[0-9]"), re.compile(r"[0-9]+")
#: What may fill a slot: groups of digits with separators, or one token without the marks around it.
_SLOT = re.compile(r"\+?[(]?[0-9][0-9().\x20-]*[0-9](?![\w@])|\w[\w.@+/_-]*\w|\w")
_GROUPS = re.compile(r"(?<![\w+])[+(]?[0-9](?:[().\x20-]{0,2}[0-9])+(?![\w@])")
_TOKEN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._+-]*[A-Za-z0-9])?")
_WORD = re.compile(r"\w+")
_BEFORE = re.compile(r"(\w+)\W*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base rule; each rule takes time in proportion to the text."""
    spans: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            spans.append((start, m.end(), "email"))
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            parts = list(_DIGIT_RUN.finditer(m[0])) if "." in m[0] else ()
            for i in range(0, len(parts) - 3, 4):
                if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                    spans.append((m.start() + parts[i].start(), m.start() + parts[i + 3].end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append((*m.span(), "phone"))
    return spans


def shape(s: str) -> str:
    """Letters and digits by kind, with the length of each run."""
    return re.sub(r"(.)\1*", lambda m: f"{m[1]}{len(m[0])}", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", s))))


def free_of(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """A test whether a range overlaps none of the spans, by search in them."""
    spans = sorted(spans)
    starts, reach = [a for a, _ in spans], []
    for _, b in spans:
        reach.append(max(b, reach[-1] if reach else b))

    def free(a: int, b: int) -> bool:
        i = bisect_right(starts, b - 1) - 1
        return i < 0 or reach[i] <= a

    return free


def contexts(words: list[tuple[int, int]], text: str, a: int, b: int) -> list[str]:
    """The lexical patterns around text[a:b]: two words before, word before with the format, format with the word after, format.

    words: places of all words of the text. Whole words count, however long, within the text's order.
    """
    form = shape(text[a:b])
    i, j = bisect_right(words, (a, a)) - 1, bisect_left(words, (b, b))
    while i >= 0 and words[i][1] > a:
        i -= 1
    before = [text[x:y].lower() for x, y in words[max(0, i - 1) : i + 1]]
    after = text[slice(*words[j])].lower() if j < len(words) else ""
    patterns = [f"form {form}"]
    if before:
        patterns.append(f"{before[-1]} _ {form}")
    if len(before) == 2:
        patterns.append(f"{' '.join(before)} _")
    if after:
        patterns.append(f"{form} _ {after}")
    return patterns


def pair_places(words: list[str]) -> np.ndarray:
    """For each two neighbouring words their place in the filter, without case."""
    if len(words) < 2:
        return np.empty(0, np.int64)
    each = "\n".join(words).lower().encode("utf-8", "surrogatepass").split(b"\n")
    h = np.fromiter(map(zlib.crc32, each), np.uint64, len(each))
    return ((h[:-1] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) ^ h[1:]).astype(np.int64) & ((1 << FILTER_BITS) - 1)


def known_places(places: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, bool)
    out[places] = True
    return out


def instances(text: str, spans: list[Span], filled: np.ndarray) -> list[tuple[int, int, str, bool, list[str]]]:
    """(start, end, string, known, patterns) for the base entities and for all else that may be one.

    That is every group of digits and every token with five digits or more, and whatever stands after two words that stand before seeds
    (filled: the filter of those). Time is proportional to the text and the entities.
    """
    hits = np.flatnonzero(filled[pair_places(_WORD.findall(text))]).tolist()
    digits = _DIGIT.search(text)
    if not (hits or spans or digits):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    free = free_of([s[:2] for s in spans])
    places = {(a, b): True for a, b, _ in spans}
    if digits:
        for pattern in (_GROUPS, _TOKEN):
            for m in pattern.finditer(text):
                a, b = m.span()
                if b - a >= 5 and sum("0" <= c <= "9" for c in m[0]) >= 5 and free(a, b):
                    places.setdefault((a, b), False)
    for i in hits:
        m = _SLOT.search(text, words[i + 1][1])
        if m and (i + 2 >= len(words) or m.start() <= words[i + 2][0]) and free(*m.span()):
            places.setdefault(m.span(), False)
    taken, last = [], -1
    for (a, b), known in sorted(places.items(), key=lambda p: (p[0][0], -p[0][1])):
        if known or a >= last:  # of candidates that overlap the first and longest counts
            taken.append((a, b, known))
            last = last if known else b
    return [(a, b, text[a:b], known, contexts(words, text, a, b)) for a, b, known in taken]


_ROW = "doc_id long, spans array<struct<a: int, b: int, k: string>>, found array<struct<a: int, b: int, s: string, known: boolean, patterns: array<string>>>"


def _salted(table: DataFrame, on: str, small: DataFrame, spread: str) -> DataFrame:
    """Inner join of a table with a smaller one of distinct `on`: the smaller one is repeated for SALTS parts of the table's rows, so a hot value
    burdens no task."""
    part = F.pmod(F.xxhash64(spread), F.lit(SALTS)).alias("_part")
    parts = small.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return table.select("*", part).join(parts, [on, "_part"]).drop("_part")


def discover(edges: DataFrame) -> DataFrame:
    """(s, confidence) of the instances that patterns make out, from distinct (pattern, s, known).

    Seeds are sure. In each round a pattern's score is the mean confidence of its distinct instances, patterns with enough known ones
    are strong, and an instance's confidence is the noisy-or of its strong patterns; one that reaches CONFIDENCE is known from then on
    and may make further patterns strong. The rounds end when no instance is added.
    """
    sure = edges.filter("known").select("s").distinct().withColumn("confidence", F.lit(1.0))
    found = materialise(sure, "pii0")
    n, k = found.count(), 0
    while n:
        k += 1
        known = _salted(edges, "s", found, "pattern").groupBy("pattern").agg(F.sum("confidence").alias("support"))
        every = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        strong = known.filter(F.col("support") >= SUPPORT).join(every, "pattern").select("pattern", (F.col("support") / F.col("n")).alias("score")).filter(F.col("score") >= PRECISION)
        told = _salted(edges.filter("NOT known"), "pattern", strong, "s").filter(F.col("s").rlike("[0-9]") | (F.col("score") >= PLAIN))
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-6)))))
        new = told.groupBy("s").agg((1 - miss).alias("confidence")).filter(F.col("confidence") >= CONFIDENCE)
        found = materialise(found.unionByName(new.join(found.select("s"), "s", "left_anti")), f"pii{k}")
        before, n = n, found.count()
        if n == before:
            break
    return found.join(sure.select("s"), "s", "left_anti")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context) for every row; offsets are code points, ends exclusive.

    Base entities are the seeds. A first pass collects the two words before each, a second one counts how often those stand anywhere. Two words that
    stand before SUPPORT distinct seeds, and before a seed in LEAD of all places, go into a filter of fixed size; so what follows them
    grows with the seeds and no faster. The last pass takes as instances the seeds, digits in groups and tokens with digits, and what follows such
    words (of at most 200 characters), whatever it is, each with the patterns it occurs in; discover() scores them on the graph of patterns and instances, and
    those found become spans of kind `context`. Null texts count as empty and have no spans; very long texts take time in proportion
    to them; repeated rows stay, each with its spans; ties of start go by kind; an empty table gives an empty result; other columns may have
    any names.
    """
    session(docs)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs, out = [], []
            for t in b.column("text").to_pylist():
                spans = base_spans(t) if t else []
                for a, e, _ in spans:
                    y = _BEFORE.search(t, max(0, a - 200), a)
                    x = _BEFORE.search(t, max(0, a - 400), y.start()) if y else None
                    if x:
                        pairs += [x[1], y[1]]
                        out.append(t[a:e])
            yield pa.RecordBatch.from_arrays([pa.array(pair_places(pairs)[::2], pa.int64()), pa.array(out, pa.string())], names=["place", "s"])

    def places_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, total = known_places(led["place"].to_numpy()), np.zeros(1 << FILTER_BITS, np.int32)
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    at = pair_places(_WORD.findall(t))
                    np.add.at(total, at[filled[at]], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = [("a", pa.int32()), ("b", pa.int32())]
        spans_type = pa.list_(pa.struct([*place, ("k", pa.string())]))
        found_type = pa.list_(pa.struct([*place, ("s", pa.string()), ("known", pa.bool_()), ("patterns", pa.list_(pa.string()))]))
        schema = pa.schema([("doc_id", pa.int64()), ("spans", spans_type), ("found", found_type)])
        filled = known_places(places)
        for b in batches:
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                spans = base_spans(t) if t else []
                found = instances(t, spans, filled) if t else []
                rows.append({"doc_id": d, "spans": [{"a": x, "b": y, "k": k} for x, y, k in spans], "found": [{"a": x, "b": y, "s": s, "known": known, "patterns": p} for x, y, s, known, p in found]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    led = plain.select("text").mapInArrow(seeds, "place long, s string").groupBy("place").agg(F.countDistinct("s").alias("distinct"), F.count("*").alias("seeds"))
    led = led.filter(F.col("distinct") >= SUPPORT).select("place", "seeds").toArrow()  # at most 2 ** FILTER_BITS rows, as below
    places = np.empty(0, np.int64)
    if led.num_rows:
        every = plain.select("text").mapInArrow(places_of, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(1 << FILTER_BITS, np.int64)
        n[every["place"].to_numpy()] = every["n"].to_numpy()
        at = led["place"].to_numpy()
        places = at[led["seeds"].to_numpy() >= LEAD * n[at]]
    rows = materialise(plain.mapInArrow(run, _ROW).withColumn("rid", F.monotonically_increasing_id()), "pii")
    found = rows.select(F.explode("found").alias("x")).select("x.s", "x.known", F.explode("x.patterns").alias("pattern"))
    edges = materialise(found.groupBy("pattern", "s").agg(F.max("known").alias("known")), "piiedges")
    extra = rows.select("rid", F.explode("found").alias("x")).filter("NOT x.known").select("rid", "x.a", "x.b", "x.s")
    more = _salted(extra, "s", discover(edges).select("s"), "rid").groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("more"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_context")}
            for r in b.to_pylist():
                base = [(s["a"], s["b"], s["k"]) for s in r["spans"]]
                new = [(s["a"], s["b"], "context") for s in r["more"] or []]
                out["doc_id"].append(r["doc_id"])
                for k in KINDS[:4]:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(digest(base, KINDS))
                out["spans"].append(joined(base + new, KINDS))
                out["n_context"].append(len(new))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], names=list(out))

    done = rows.select("rid", "doc_id", "spans").join(more, "rid", "left").select("doc_id", "spans", "more")
    return done.mapInArrow(finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_context long")
