"""Operator 11: personal data, by candidates that boosted trees judge.

1. Base rules name spans of four kinds, leftmost and without overlaps in a kind: these always stay.
2. Generators propose every span that might be one, overlapping and far too many: windows over groups of digits, names
   around an at sign or a word for it, groups between dots however these are written.
3. Trees, boosted on log loss over histograms, score a candidate by its format and by what stands around it.
4. A threshold for each kind is calibrated on documents that the trees have not seen. Candidates from there on are
   added, the best first, where they overlap neither a base span nor one already added.

No table says what is personal, so the base rules teach: a candidate that equals a base span is one, any other is none,
but for those in a match that a rule dropped as too long (several numbers in a row): they teach nothing and are only judged.
Each span found is also taught in other spellings (at and dot as words, a phone number without its sign) and beside
another number, which the base rules don't know. Every candidate of every row teaches: equal ones are counted together,
tasks sum the histograms of each level of a tree, and only these sums, whose size the bins bound, reach the driver.
Sums are of whole numbers, so the order of rows doesn't matter. Thresholds count scores in steps of 1 / SCORES.

Offsets are code points, ends exclusive. n_email to n_phone and base_sha256 count base spans, `spans` holds all, n_added
the number that the trees added. Null or empty text: no spans. Null doc_id: judged like any. Rows of one doc_id: each.
Very long texts are scanned in time linear in their length, candidates in portions. Ties: the longer, then earlier span.
No base span to learn from: nothing is added. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import string_blocks, written

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, BINS, RATE, LEAST = 60, 3, 24, 0.2, 1.0
#: Share of added candidates that must be right among the documents held back, which are one in HELD.
PRECISION, HELD = 0.97, 4
#: Steps of scores when thresholds are calibrated, units of a gradient's sum, and trees after which scores are written.
SCORES, UNITS, KEPT = 1 << 16, 1 << 20, 10
#: Different candidates that a task takes, and tasks at most; candidates counted in a task before they are told.
TASK_ROWS, TASKS, TOLD = 100_000, 256, 50_000
#: Candidates that are scored at once.
PORTION = 4096

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_OCTETS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(group: str) -> bool:
    return len(group.lstrip("0")) <= 3 and int(group) <= 255


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans (kind, start, end) by the base rules, by kind and start; and the matches that a rule dropped as
    too long: it may have taken several numbers for one."""
    found, too_long = [], []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return found, too_long
    for chain in _OCTETS.finditer(text):
        if chain.group().count(".") >= 3:
            at, groups = chain.start(), chain.group().split(".")
            for i in range(0, len(groups), 4):
                four = groups[i : i + 4]
                to = at + sum(map(len, four)) + len(four) - 1
                if len(four) == 4 and all(map(_octet, four)):
                    found.append((1, at, to))
                at = to + 1
    for match in _CARD.finditer(text):
        digits = _only_digits(match.group())
        if len(digits) > 19:
            too_long.append(match.span())
        elif len(digits) >= 16 and luhn(digits):
            found.append((2, *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            digits = _only_digits(match.group())
            if len(digits) > 15:
                too_long.append(match.span())
            elif len(digits) >= 8:
                found.append((3, *match.span()))
    return found, too_long


#: A chain of groups of digits, with up to two signs or blanks between two.
_CHAIN = re.compile(r"[+(]?[0-9]++(?:[ ().\[\]-]{1,3}+[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
#: Names around an at sign, or a word for it, with dots or words for them.
_AT = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}+ ?(?:@|＠|[(\[{] ?(?:at|AT|@) ?[)\]}]|(?<= )(?:at|AT)(?= )) ?[\w-]{1,63}+(?: ?(?:\.|[(\[{] ?(?:dot|DOT|\.) ?[)\]}]|(?<= )(?:dot|DOT)(?= )) ?[\w-]{1,63}+){1,5}")
_AT_HINT = re.compile(r"[@＠]|\b(?:at|AT)\b")


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """Spans (kind, start, end) that might be personal data: a bounded number for each group of digits and each at sign."""
    if _AT_HINT.search(text):
        for match in _AT.finditer(text):
            ends = {match.end()}
            # a sentence may go on after the name: also without its last parts
            for cut in re.finditer(r" ?(?:\.|[(\[{] ?(?:dot|DOT|\.) ?[)\]}]|(?:dot|DOT)) ?[\w-]+$", match.group()):
                ends.add(match.start() + cut.start())
            for end in ends:
                yield 0, match.start(), end
    if not _DIGIT.search(text):
        return
    for chain in _CHAIN.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *chain.span())]
        sizes = [b - a for a, b in groups]
        for i, (start, _) in enumerate(groups):
            first = start - (start > 0 and text[start - 1] in "+(")
            if first and text[first] == "(" and text[first - 1] == "+":
                first -= 1
            digits = 0
            for j in range(i, len(groups)):
                digits += sizes[j]
                if digits > 19:
                    break
                end = groups[j][1]
                if j == i + 3 and max(sizes[i : j + 1]) <= 3 and all("." in text[groups[k][1] : groups[k + 1][0]] for k in range(i, j)):
                    yield 1, start, end
                if digits >= 13:
                    yield 2, start, end
                if 7 <= digits <= 15:
                    yield 3, first, end


_CLASSES = (str.isspace, str.isdigit, str.isalpha)
#: Words that tell what a number is (fixed values).
HINTS = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
}
_LAST_WORD = re.compile(r"([^\W\d_]+)\W*$")


def _class(c: str) -> int:
    return next((i for i, f in enumerate(_CLASSES) if f(c)), 3) if c else 4


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span = text[start:end]
    digits = _only_digits(span)
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    before, after = text[max(0, start - 24) : start], text[end : end + 3]
    word = _LAST_WORD.search(before)
    name = word.group(1).lower() if word else ""
    octets = [g for g in re.findall("[0-9]+", span)]
    return [
        kind, len(span), len(digits), len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        sum(map(str.isalpha, span)), span.count(" "), span.count("-"), span.count("."), span.count("(") + span.count("["), span.count("@"), span.startswith("+"), span.startswith("("),
        kind == 2 and luhn(digits), kind == 1 and all(map(_octet, octets)), int(digits[0]) if digits else -1, len(set(digits)),
        len(re.split(r"[^\w-]+", span)[-1]) if kind == 0 else 0, sum(ord(c) > 127 for c in span),
        _class(before[-1:]), _class(before[-2:-1]), _class(after[:1]), _class(after[1:2]), before[-1:] in ".+-@_/", after[:1] in (".", "-", "@", "_", "/") and _class(after[1:2]) in (1, 2),
        bool(re.search(r"[0-9][ ().-]{0,2}$", before)), bool(re.match(r"[ ().-]{0,2}[0-9]", after)), name in HINTS[KINDS[kind]], len(name),
    ]


@dataclass
class Trees:
    """edges: the bins of each feature. For each tree and inner node a feature and bin; for each tree and leaf a value."""

    edges: list[np.ndarray]
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    start: float
    thresholds: np.ndarray

    def node(self, tree: int, binned: np.ndarray, levels: int = DEPTH) -> np.ndarray:
        """Where rows are in a tree after so many levels."""
        rows, node = np.arange(len(binned)), np.zeros(len(binned), np.int64)
        for _ in range(levels):
            node = 2 * node + 1 + (binned[rows, self.feature[tree, node]] > self.bin[tree, node])
        return node

    def told(self, tree: int, binned: np.ndarray) -> np.ndarray:
        return self.value[tree, self.node(tree, binned) - (1 << DEPTH) + 1]

    def of_bins(self, binned: np.ndarray) -> np.ndarray:
        total = np.full(len(binned), self.start)
        for t in range(TREES):
            total += self.told(t, binned)
        return 1 / (1 + np.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.of_bins(_binned(self.edges, x))

    def sums(self, tree: int, level: int, binned: np.ndarray, total: np.ndarray, n: np.ndarray, true: np.ndarray) -> np.ndarray:
        """Gradients and their slopes by node of the level, feature and bin, in whole units. total: the scores so far."""
        p = 1 / (1 + np.exp(-total))
        width, count = binned.shape[1], 1 << level
        at = (self.node(tree, binned, level) - count + 1)[:, None] * (width * BINS) + binned + np.arange(width) * BINS
        both = (np.rint(w * UNITS) for w in (true - n * p, n * p * (1 - p)))
        return np.stack([np.bincount(at.ravel(), np.repeat(w, width), count * width * BINS) for w in both]).astype(np.int64)

    def grow(self, tree: int, level: int, found: np.ndarray) -> None:
        """Splits the nodes of a level by the sums over all rows; the last level's splits give the leaves too."""
        count, width = 1 << level, len(self.edges)
        sums = (found / UNITS).reshape(2, count, width, BINS).cumsum(axis=3)
        rest = sums[:, :, :, -1:] - sums
        gain = sum(a * a / (b + LEAST) for a, b in (sums, rest))
        best = gain.reshape(count, -1).argmax(axis=1)
        nodes = slice(count - 1, 2 * count - 1)
        self.feature[tree, nodes], self.bin[tree, nodes] = best // BINS, best % BINS
        if level == DEPTH - 1:
            sides = np.stack([x.reshape(2, count, -1)[:, np.arange(count), best] for x in (sums, rest)], axis=2)
            self.value[tree] = RATE * (sides[0] / (sides[1] + LEAST)).reshape(-1)


def _binned(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)


def _edges(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bounds of a feature's bins: between its values if these are few, else at even shares of the rows."""
    if len(values) <= BINS:
        return (values[1:] + values[:-1]) / 2
    upto = np.cumsum(counts)
    return np.unique(values[np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS)])


def _planted(edges: list[np.ndarray], n: int, true: int) -> Trees:
    share, inner = min(max(true / n, 1e-6), 1 - 1e-6), (1 << DEPTH) - 1
    return Trees(edges, np.zeros((TREES, inner), np.int64), np.full((TREES, inner), BINS), np.zeros((TREES, inner + 1)), float(np.log(share / (1 - share))), np.ones(len(KINDS)))


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees of a fixed depth, each fitted to the gradients of log loss that those before it leave, by histograms."""
    trees = _planted([_edges(*np.unique(c, return_counts=True)) for c in x.T], len(y), int(y.sum()))
    binned, total = _binned(trees.edges, x), np.full(len(x), trees.start)
    for t in range(TREES):
        for level in range(DEPTH):
            trees.grow(t, level, trees.sums(t, level, binned, total, np.ones(len(y)), y))
        total += trees.told(t, binned)
    return trees


def respelled(text: str, kind: int, start: int, end: int) -> list[tuple[str, int, int]]:
    """The span's surroundings with it in other spellings, and where it is then."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 40]
    other: list[str] = []
    if kind == 0:
        name, host = span.split("@")
        other = [f"{name} (at) {host.replace('.', ' (dot) ')}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} at {host.replace('.', ' dot ')}", f"{name}＠{host}"]
    elif kind == 1:
        other = [span.replace(".", "[.]"), span.replace(".", " . ")]
    elif kind == 2:
        digits = _only_digits(span)
        other = [sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for sep in " -."]
    else:
        bare = span.lstrip("+")
        other = ["00" + bare, bare[bare.index("(") :] if "(" in bare else bare]
    out = [(before + s + after, len(before), len(before) + len(s)) for s in other if s != span]
    if kind >= 2:  # beside another number, which makes a rule's match too long
        number = _only_digits(span)[::-1]
        out.append((f"{before}{span} {number}{after}", len(before), len(before) + len(span)))
        out.append((f"{before}{number} {span}{after}", len(before) + len(number) + 1, len(before) + len(number) + 1 + len(span)))
    return out


def taught(text: str) -> Iterator[tuple[list[float], bool]]:
    """Candidates of a text, in their spelling and others, and whether the base rules say that they are personal data."""
    spans, too_long = base_spans(text)
    known, merged = set(spans), []
    for a, b in sorted(too_long):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    ends = [b for _, b in merged]
    for c in candidates(text):
        i = bisect_right(ends, c[1])
        if c in known or i == len(ends) or merged[i][0] >= c[2]:
            yield features(text, *c), c in known
    for kind, start, end in spans:
        for other, a, b in respelled(text, kind, start, end):
            for c in candidates(other):
                if c[1] < b and a < c[2]:
                    yield features(other, *c), c == (kind, a, b)


def _lessons(docs: DataFrame) -> DataFrame:
    """x, held, n, true: each different candidate of all rows, how often it is there and how often personal data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bytes, bool], list[int]] = {}

        def told() -> pa.RecordBatch:
            columns = zip(*((x, held, n, true) for (x, held), (n, true) in seen.items()))
            kinds = (pa.binary(), pa.bool_(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["x", "held", "n", "true"])

        for part, texts in string_blocks(batches):
            for text, held in zip(texts, part.column("held").to_pylist()):
                for x, true in taught(text):
                    counts = seen.setdefault((np.array(x, np.int16).tobytes(), held), [0, 0])
                    counts[0] += 1
                    counts[1] += true
                    if len(seen) >= TOLD:
                        yield told()
                        seen.clear()
        if seen:
            yield told()

    rows = docs.where("text IS NOT NULL AND text <> ''").select("text", F.expr(f"xxhash64(text) % {HELD} = 0").alias("held"))
    found = rows.mapInArrow(run, "x binary, held boolean, n long, true long")
    return found.groupBy("x", "held").agg(F.sum("n").alias("n"), F.sum("true").alias("true"))


def _rows(batch: pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind).reshape(batch.num_rows, -1)


def _values(rows: DataFrame) -> list[np.ndarray]:
    """The bounds of each feature's bins, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.column("n").to_numpy()
                for k, column in enumerate(_rows(batch, "x", np.int16).T):
                    values, at = np.unique(column, return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(values), pa.int32()), pa.array(values, pa.int32()), pa.array(np.bincount(at, n).astype(np.int64))], ["k", "value", "n"]
                    )

    # a row a value of a feature, which the lengths of candidates bound
    found = rows.mapInArrow(run, "k int, value int, n long").groupBy("k", "value").agg(F.sum("n").alias("n")).collect()
    table = np.array(sorted(map(tuple, found)), np.int64)
    return [_edges(of[:, 1].astype(float), of[:, 2]) for of in np.split(table, np.flatnonzero(np.diff(table[:, 0])) + 1)]


def _grown(rows: DataFrame, trees: Trees) -> None:
    """Grows all trees over rows b, n, true."""
    rows = written(rows.withColumn("total", F.lit(trees.start)), "pii-scores-0")
    tasks = max(1, min(TASKS, -(-rows.count() // TASK_ROWS)))
    for t in range(TREES):
        first = t - t % KEPT

        def totals(batch: pa.RecordBatch, binned: np.ndarray, since: int, upto: int) -> np.ndarray:
            total = batch.column("total").to_numpy().copy()
            for k in range(since, upto):
                total += trees.told(k, binned)
            return total

        if t and t == first:

            def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        total = totals(batch, _rows(batch, "b", np.uint8).astype(np.int64), first - KEPT, first)
                        yield batch.set_column(batch.schema.get_field_index("total"), "total", pa.array(total))

            rows = written(rows.coalesce(tasks).mapInArrow(scored, rows.schema), f"pii-scores-{t}")
        for level in range(DEPTH):

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros((2, (1 << level) * len(trees.edges) * BINS), np.int64)
                for batch in batches:
                    if batch.num_rows:
                        binned = _rows(batch, "b", np.uint8).astype(np.int64)
                        out += trees.sums(t, level, binned, totals(batch, binned, first, t), batch.column("n").to_numpy(), batch.column("true").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

            # a row a task, of which there are TASKS at most
            found = [np.frombuffer(r.sums, np.int64) for r in rows.coalesce(tasks).mapInArrow(run, "sums binary").collect()]
            trees.grow(t, level, sum(found).reshape(2, -1))


def fit(docs: DataFrame) -> Trees | None:
    """Trees and thresholds from all rows; None where the base rules find nothing in them."""
    lessons = written(_lessons(docs), "pii-lessons")
    counts = {r.held: r for r in lessons.groupBy("held").agg(F.sum("n").alias("n"), F.sum("true").alias("true")).collect()}
    if not sum(r.true for r in counts.values()):
        return None
    apart = True in counts and False in counts and counts[False].true > 0
    fitted = lessons.where("NOT held") if apart else lessons
    check = lessons.where("held") if True in counts else lessons
    known = [r for held, r in counts.items() if not (apart and held)]
    trees = _planted(_values(fitted), sum(r.n for r in known), sum(r.true for r in known))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                binned = _binned(trees.edges, _rows(batch, "x", np.int16)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in binned], pa.binary()), batch.column("n"), batch.column("true")], ["b", "n", "true"])

    binned = fitted.select("x", "n", "true").mapInArrow(bins, "b binary, n long, true long")
    _grown(binned.groupBy("b").agg(F.sum("n").alias("n"), F.sum("true").alias("true")), trees)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, "x", np.int16)
                steps = np.floor(trees.score(x) * SCORES).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0], pa.int32()), pa.array(steps), batch.column("n"), batch.column("true")], ["kind", "step", "n", "true"])

    scores = check.select("x", "n", "true").mapInArrow(judged, "kind int, step long, n long, true long")
    # a row a kind and step
    steps = np.array(list(map(tuple, scores.groupBy("kind", "step").agg(F.sum("n"), F.sum("true")).collect())), np.int64).reshape(-1, 4)
    for k in range(len(KINDS)):
        own = steps[steps[:, 0] == k]
        trees.thresholds[k] = calibrated(own[:, 1] / SCORES, own[:, 3], own[:, 2])
    return trees


def calibrated(scores: np.ndarray, true: np.ndarray, n: np.ndarray | None = None) -> float:
    """The least score from which on PRECISION of the candidates are right; above 1 where there is none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(true[order]) / np.cumsum(np.ones(len(order)) if n is None else n[order])
    last = np.append(scores[order][1:] != scores[order][:-1], True) if len(order) else np.zeros(0, bool)
    fit = np.flatnonzero((right >= PRECISION) & last & (np.cumsum(true[order]) > 0))
    return max(0.5, float(scores[order][fit[-1]])) if len(fit) else 2.0


def _portions(text: str) -> Iterator[list[tuple[int, int, int]]]:
    held = []
    for c in candidates(text):
        held.append(c)
        if len(held) == PORTION:
            yield held
            held = []
    if held:
        yield held


def added(text: str, trees: Trees | None, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the trees add to those of the base rules."""
    if trees is None:
        return []
    good = []
    known = set(spans)
    for some in _portions(text):
        some = [c for c in some if c not in known]
        if some:
            scores = trees.score(np.array([features(text, *c) for c in some], np.float64))
            good += [(-s, a - b, a, k, b) for s, (k, a, b) in zip(scores.tolist(), some) if s >= trees.thresholds[k]]
    out, taken = [], {}
    for k, a, b in spans:
        taken.update((i, True) for i in range(a, b))
    for _, _, a, k, b in sorted(good):
        if not any(i in taken for i in range(a, b)):
            out.append((k, a, b))
            taken.update((i, True) for i in range(a, b))
    return out


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def found(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in string_blocks(batches):
            base = [base_spans(t)[0] for t in texts]
            more = [added(t, trees, b) for t, b in zip(texts, base)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    *(pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))),
                    pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([_written(b + m) for b, m in zip(base, more)], pa.string()),
                    pa.array([len(m) for m in more], pa.int64()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id long, {kinds}, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of docs with each span replaced by its kind in brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in string_blocks(batches):
            out = []
            for text, known in zip(texts, part.column("text").is_null().to_pylist()):
                spans = base_spans(text)[0]
                pieces, at = [], 0
                for k, a, b in sorted(spans + added(text, trees, spans), key=lambda s: (s[1], -s[2])):
                    if b > at:
                        pieces += [text[at : max(a, at)], f"[{KINDS[k]}]"]
                        at = b
                out.append(None if known else "".join(pieces) + text[at:])
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)
