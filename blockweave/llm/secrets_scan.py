"""Secret scans with inferred grammars.

Three base patterns find candidates whose form is given. Values that they
capture are labelled credentials: of each kind a prefix tree of characters is
built, and states whose futures are statistically alike are merged (Alergia:
Hoeffding bounds on stop and transition frequencies, tested recursively, in the
order of a red core and its blue fringe). How readily states merge, and whether
edges go by symbol or by class of symbols, is chosen by the likelihood of values
held out. The result is a probabilistic automaton by
kind, and one of ordinary tokens is learned the same way. Every token of the
texts is then scored by how much likelier a credential automaton makes it than
the ordinary one. Of tokens that the ordinary automaton draws, whatever their
lengths, at most 2 ** -MARGIN come out as MARGIN bits likelier.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import U, Chunk, arrow_schema, bound_batches, each_chunk, id_column, over_chunks, record, settle, signed, with_text_kind

KINDS = ("assign", "access", "hex")
PLAIN = len(KINDS)
#: Different values of a kind, and ordinary tokens, learned from at most, and their characters together: those of the least hashes, each whole.
SAMPLE_VALUES, SAMPLE_PLAIN, SAMPLE_CHARS = 2_000, 8_000, 200_000
#: Ordinary tokens weigh so much together, however large the corpus: what a state's frequencies are held to doesn't tighten with it.
PLAIN_WEIGHT = 20_000.0
#: Tokens of fewer characters are no candidates, as the shortest labelled value has so many. The margin, in bits.
MIN_TOKEN, MARGIN = 6, 16.0
_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{24,}")  # runs of fewer characters would fail; a run is taken whole
# The characters that the automata read.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-"
STOP = len(SYMBOLS)
_symbol = np.full(256, 255, np.uint8)
_symbol[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(STOP)
_ALNUM = 62  # the first symbols are digits and letters
ALPHAS = (0.0001, 0.01, 0.2, 0.8)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, in code points."""
    out = []
    for m in _assign.finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _access.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in _hex.finditer(text)]
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


class Automaton:
    """A probabilistic automaton over SYMBOLS: next state, and log2 probability of each symbol or of stopping, by state."""

    def __init__(self, to: np.ndarray, log: np.ndarray):
        self.to, self.log = to, log

    def bits(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """log2 likelihood of each byte range: all ranges a character at a time, the last few of very long ones by themselves."""
        state, out, live = np.zeros(len(s), np.int64), np.zeros(len(s)), np.arange(len(s))
        j = 0
        while len(live := live[s[live] + j < e[live]]):
            if j >= 256 and len(live) < 16:
                to, log = self.to.tolist(), self.log.tolist()
                for i in live.tolist():
                    q, sum_ = int(state[i]), 0.0
                    for c in _symbol[data[s[i] + j : e[i]]].tolist():
                        sum_ += log[q][c]
                        q = to[q][c]
                    state[i], out[i] = q, out[i] + sum_
                break
            c = _symbol[data[s[live] + j]]
            out[live] += self.log[state[live], c]
            state[live] = self.to[state[live], c]
            j += 1
        return out + self.log[state, STOP]

    def of(self, values: list[str]) -> np.ndarray:
        """log2 likelihood of each value."""
        lens = np.array([len(v) for v in values], np.int64)
        ends = np.cumsum(lens)
        return self.bits(np.frombuffer("".join(values).encode(), np.uint8), ends - lens, ends)


class Either:
    """The likeliest of several automata, each taken to be as usual as the others."""

    def __init__(self, *parts: Automaton):
        self.parts = parts

    def bits(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.max([p.bits(data, s, e) for p in self.parts], 0) - np.log2(len(self.parts))

    def of(self, values: list[str]) -> np.ndarray:
        return np.max([p.of(values) for p in self.parts], 0) - np.log2(len(self.parts))


class _Tree:
    """A prefix tree with weights, whose states are merged in place. Edges go by class of symbols; each state counts the symbols themselves."""

    def __init__(self):
        self.to: list[dict[int, int]] = [{}]
        self.count: list[dict[int, float]] = [{}]
        self.stop, self.total = [0.0], [0.0]

    def add(self, symbols: list[int], classes: list[int], weight: float) -> None:
        q = 0
        for s, c in zip(symbols, classes, strict=True):
            self.count[q][s] = self.count[q].get(s, 0.0) + weight
            self.total[q] += weight
            if c not in self.to[q]:
                self.to[q][c] = len(self.to)
                self.to.append({})
                self.count.append({})
                self.stop.append(0.0)
                self.total.append(0.0)
            q = self.to[q][c]
        self.stop[q] += weight
        self.total[q] += weight

    def alike(self, a: int, b: int, bound: float) -> bool:
        """Whether no frequency of the two states, or of states that the same classes lead to, differs by more than chance allows."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.total[a], self.total[b]
            if not na or not nb:
                continue
            far, ca, cb = bound * (na**-0.5 + nb**-0.5), self.count[a], self.count[b]
            if abs(self.stop[a] / na - self.stop[b] / nb) > far:
                return False
            if far < 1:
                for c in ca.keys() | cb.keys():
                    if abs(ca.get(c, 0.0) / na - cb.get(c, 0.0) / nb) > far:
                        return False
            todo += [(x, self.to[b][c]) for c, x in self.to[a].items() if c in self.to[b] and x != self.to[b][c]]
        return True

    def fold(self, a: int, b: int) -> list[int]:
        """Add the subtree b to state a; the states that got something."""
        todo, touched = [(a, b)], []
        while todo:
            a, b = todo.pop()
            touched.append(a)
            self.stop[a] += self.stop[b]
            self.total[a] += self.total[b]
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0.0) + n
            for c, x in self.to[b].items():
                if c not in self.to[a]:
                    self.to[a][c] = x
                else:
                    todo.append((self.to[a][c], x))
        return touched


def classes_of(values: dict[str, float]) -> np.ndarray:
    """The class of each symbol: types (digits, letters up to f and past it, in each case) whose symbols values use equally often, as far as chance tells, are one; marks are their own."""
    n = np.zeros(STOP)
    for v, w in values.items():
        np.add.at(n, _symbol[np.frombuffer(v.encode(), np.uint8)], w)
    types = [np.arange(10), np.arange(10, 16), np.arange(16, 36), np.arange(36, 42), np.arange(42, 62)]
    share = [n[t].sum() / max(1.0, n.sum()) / len(t) for t in types]
    out, number = np.arange(STOP), list(range(len(types)))
    for i in range(len(types)):
        for j in range(i):
            mean = (share[i] + share[j]) / 2
            if share[i] and share[j] and abs(share[i] - share[j]) <= 4 * np.sqrt(mean * (1 / len(types[i]) + 1 / len(types[j])) / max(1.0, n.sum())):
                number[i] = min(number[i], number[j])
    for i, t in enumerate(types):
        out[t] = types[number[i]][0]
    return out


def infer(values: dict[str, float] | list[str], alpha: float = 0.01, classes: np.ndarray | None = None) -> Automaton:
    """Alergia over values, each with a weight; edges go by class (each symbol its own, if not given), so that a state can stand for what follows any symbol of it. What a state hasn't seen has a small probability: that of all values, and a little for each symbol."""
    classes = np.arange(STOP) if classes is None else classes
    tree, overall = _Tree(), np.full(STOP + 1, 0.5)
    for v, n in sorted((values if isinstance(values, dict) else Counter(values)).items()):
        symbols = _symbol[np.frombuffer(v.encode(), np.uint8)]
        tree.add(symbols.tolist(), classes[symbols].tolist(), float(n))
        np.add.at(overall, [*symbols, STOP], float(n))
    overall /= overall.sum()
    bound = float(np.sqrt(np.log(2 / alpha) / 2))
    red, is_red = [0], {0}
    fringe = [(-tree.total[x], 0, c) for c, x in tree.to[0].items()]
    heapq.heapify(fringe)
    while fringe:
        _, p, c = heapq.heappop(fringe)
        b = tree.to[p][c]
        if b in is_red:
            continue
        for r in red:
            if tree.alike(r, b, bound):
                tree.to[p][c] = r
                touched = [q for q in tree.fold(r, b) if q in is_red]
                break
        else:
            red.append(b)
            is_red.add(b)
            touched = [b]
        for q in dict.fromkeys(touched):
            for c, x in tree.to[q].items():
                if x not in is_red:
                    heapq.heappush(fringe, (-tree.total[x], q, c))
    number, size = {q: i for i, q in enumerate(red)}, len(red)
    # One state more for what was never seen.
    to, n = np.full((size + 1, STOP), size), np.tile(2 * overall, (size + 1, 1))
    for q, i in number.items():
        for c, x in tree.to[q].items():
            to[i, classes == c] = number[x]
        for s, w in tree.count[q].items():
            n[i, s] += w
        n[i, STOP] += tree.stop[q]
    return Automaton(to, np.log2(n / n.sum(1, keepdims=True)))


def _halves(values: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """Values to learn from, and one in four to be held out, by hash; few values are both."""
    held = {v: n for v, n in values.items() if hashlib.md5(v.encode()).digest()[0] % 4 == 0}
    rest = {v: n for v, n in values.items() if v not in held}
    return (rest, held) if held and rest else (values, values)


#: How an automaton can be learned: how readily states merge, and whether edges go by class.
WAYS = tuple((a, by_type) for by_type in (False, True) for a in ALPHAS)


def likelihood(values: dict[str, float], way: tuple[float, bool]) -> float:
    """log2 likelihood of the values held out, by an automaton of the rest."""
    learn, held = _halves(values)
    names, weight = list(held), np.array(list(held.values()))
    return float((infer(learn, way[0], classes_of(learn) if way[1] else None).of(names) * weight).sum())


def inferred(values: dict[str, float], way: tuple[float, bool]) -> Automaton:
    return infer(values, way[0], classes_of(values) if way[1] else None)


def fitted(values: dict[str, float]) -> Automaton:
    """The automaton learned from all values in the way that makes held-out values likeliest."""
    return inferred(values, max(WAYS, key=lambda w: likelihood(values, w)))


def fitted_all(spark: SparkSession, lists: list[dict[str, float]]) -> list[Automaton]:
    """``fitted`` of each list: all ways of all lists in tasks of their own, then the chosen ones."""
    sent = spark.sparkContext.broadcast(lists)

    def each(jobs: list[tuple[int, tuple]], fn) -> list:
        def run(batches):
            for b in batches:
                for i in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(fn(sent.value[jobs[i][0]], jobs[i][1]))], pa.binary())], ["i", "out"])

        got = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "i long, out binary").collect()
        return [pickle.loads(r.out) for r in sorted(got, key=lambda r: r.i)]

    # The longest first, as they take the most time.
    jobs = sorted(((i, w) for i in range(len(lists)) for w in WAYS), key=lambda x: -len(lists[x[0]]))
    score = dict(zip(jobs, each(jobs, likelihood), strict=True))
    return each([(i, max(WAYS, key=lambda w: score[i, w])) for i in range(len(lists))], inferred)


def tokens(c: Chunk, least: int = MIN_TOKEN) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of runs of SYMBOLS inside one text, from their first digit or letter to their last, of at least so many characters."""
    sym = _symbol[c.data]
    ok = sym != 255
    start, end = ok.copy(), ok.copy()
    start[1:] &= ~ok[:-1]
    end[:-1] &= ~ok[1:]
    inner = c.offs[:-1][c.offs[:-1] < len(ok)]
    start[inner] = ok[inner]
    last = c.offs[1:][c.offs[1:] > 0] - 1
    end[last] = ok[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    s, e = s[e - s >= least], e[e - s >= least]
    at = np.flatnonzero(sym < _ALNUM)
    lo, hi = np.searchsorted(at, s), np.searchsorted(at, e)
    lo, hi = lo[hi > lo], hi[hi > lo]
    s, e = at[lo], at[hi - 1] + 1
    return s[e - s >= least], e[e - s >= least]


class Grammars:
    """An automaton by kind, and those of ordinary tokens."""

    def __init__(self, by_kind: dict[int, Automaton], plain: Either | None):
        self.by_kind, self.plain = by_kind, plain

    def found(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, kind) of the tokens that a credential automaton makes likelier than the ordinary one by the margin."""
        s, e = tokens(c)
        if self.plain is None or not self.by_kind or not len(s):
            return s[:0], e[:0], s[:0]
        _, first, back = np.unique(c.span_hash(s, e), return_index=True, return_inverse=True)  # each token once
        plain = self.plain.bits(c.data, s[first], e[first])
        kinds = sorted(self.by_kind)
        gain = np.stack([self.by_kind[k].bits(c.data, s[first], e[first]) - plain - MARGIN for k in kinds])
        ok, kind = (gain.max(0) >= 0)[back], np.array(kinds)[gain.argmax(0)][back]
        return s[ok], e[ok], kind[ok]


def _texts(c: Chunk) -> list[str]:
    raw = c.data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(c.offs[:-1], c.offs[1:], strict=True)]


def _trimmed(value: str) -> str:
    return value.strip("+/_.=-")


def _spans_of(c: Chunk) -> tuple[list[list[tuple]], np.ndarray, np.ndarray]:
    """Base spans by text, and the first and last byte of each in the chunk."""
    spans = [base_spans(t) for t in _texts(c)]
    points = np.flatnonzero(c.char_starts())  # the byte of each code point
    points = np.append(points, len(c.data))
    shift = np.searchsorted(points, c.offs[:-1])
    doc = np.repeat(np.arange(c.n), [len(x) for x in spans])
    lo, hi = (np.array([y[i] for x in spans for y in x], np.int64) for i in (0, 2))
    lo, hi = (np.minimum(x + shift[doc], len(points) - 1) for x in (lo, hi))
    return spans, points[lo], points[hi]


def _touched(s: np.ndarray, e: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of the ranges (s, e) overlap one of (lo, hi), which stand in the order of lo."""
    reach = np.concatenate([[-1], np.maximum.accumulate(hi)]) if len(lo) else np.array([-1])
    return reach[np.searchsorted(lo, e)] > s


def samples(docs: DataFrame, rows: int = SAMPLE_VALUES, plain: int = SAMPLE_PLAIN) -> DataFrame:
    """(kind, h, value, n): different captured values by kind, and ordinary tokens that touch no base span, with how often they occur. A task sends those of its least hashes, which hold the least of all."""
    schema = "kind int, h long, value string, n long"
    out, most = arrow_schema(schema), [rows, rows, rows, plain]

    def run(batches):
        held: list[dict[str, list[int]]] = [{} for _ in most]
        limit = [1 << 64] * len(most)

        def prune(k, size):
            if len(held[k]) > size:
                keep = heapq.nsmallest(most[k], held[k].items(), key=lambda x: (x[1][0], x[0]))
                held[k] = dict(keep)
                limit[k] = keep[-1][1][0]

        def note(k, value, h, n):
            if h <= limit[k]:
                held[k].setdefault(value, [h, 0])[1] += n
                prune(k, 4 * most[k])

        for c in each_chunk(batches):
            spans, lo, hi = _spans_of(c)
            for k, v in ((k, _trimmed(v)) for x in spans for _, k, _, v in x):
                if v:
                    note(k, v, int.from_bytes(hashlib.md5(v.encode()).digest()[:8], "little"), 1)
            s, e = tokens(c)
            free = ~_touched(s, e, lo, hi)
            s, e = s[free], e[free]
            h, first, n = np.unique(c.span_hash(s, e), return_index=True, return_counts=True)
            raw = c.data.tobytes()
            for i in range(int(np.searchsorted(h, U(min(limit[PLAIN], (1 << 64) - 1)), "right"))):
                note(PLAIN, raw[s[first[i]] : e[first[i]]].decode(), int(h[i]), int(n[i]))
        for k in range(len(most)):
            prune(k, most[k])
            if held[k]:
                yield record({"kind": [k] * len(held[k]), "h": signed(np.array([x[0] for x in held[k].values()], U)), "value": list(held[k]), "n": [x[1] for x in held[k].values()]}, out)

    bound_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, schema).groupBy("kind", "h", "value").agg(F.sum("n").alias("n"))


def grammars(by: dict[int, dict[str, float]], spark: SparkSession | None = None) -> Grammars:
    """Automata of the kinds that have values, one of ordinary tokens, and one of those without a letter (dates, amounts, phone numbers), which are too few beside words to shape the other. Without ordinary tokens, or without values, nothing is inferred. With a session its executors learn."""
    if not by.get(PLAIN) or len(by) < 2:
        return Grammars({}, None)
    kinds = sorted(k for k in by if k != PLAIN)
    numbers = {v: 1.0 for v in by[PLAIN] if not re.search("[A-Za-z]", v)}
    lists = [*(by[k] for k in kinds), by[PLAIN], *[numbers] * bool(numbers)]
    got = fitted_all(spark, lists) if spark else [fitted(x) for x in lists]
    return Grammars(dict(zip(kinds, got, strict=False)), Either(*got[len(kinds) :]))


def learn(docs: DataFrame, rows: int = SAMPLE_VALUES, plain: int = SAMPLE_PLAIN, chars: int = SAMPLE_CHARS) -> Grammars:
    """Automata from at most ``rows`` different values of each kind and ``plain`` ordinary tokens, each whole and of so many characters together, which come to the driver. A value that occurs n times weighs 1 + log2 n, so that copies of one text don't drown all others; an ordinary token weighs by n, PLAIN_WEIGHT for all, so that credentials without context, which are among them, weigh little."""
    got = settle(samples(with_text_kind(docs), rows, plain))
    by: dict[int, dict[str, float]] = {}
    for k, most in enumerate([rows] * len(KINDS) + [plain]):
        # Hashes are unsigned: those that are negative as signed numbers come last.
        order = [F.col("h") < 0, "h", "value"]
        least = got.where((F.col("kind") == k) & (F.length("value") <= chars)).orderBy(*order).limit(most)
        held = F.sum(F.length("value")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over the sample alone
        some = least.withColumn("held", held).where(F.col("held") <= chars).select("value", "n").collect()
        if some:
            by[k] = {r.value: float(r.n) if k == PLAIN else 1 + float(np.log2(r.n)) for r in some}
    if PLAIN in by:
        share = min(1.0, PLAIN_WEIGHT / sum(by[PLAIN].values()))
        by[PLAIN] = {v: n * share for v, n in by[PLAIN].items()}
    return grammars(by, docs.sparkSession)


def scan_secrets(docs: DataFrame, grammars: Grammars | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_inferred for each row of docs (doc_id, text).

    Base spans are the leftmost that don't overlap, by kind; those too short
    fail. spans has them and the inferred ones (kind "like_" and the kind of the
    likeliest automaton): tokens that overlap no base span, or hold all of each
    that they overlap and more. Positions are code points, ends exclusive. Null
    and empty texts have none; very long texts and tokens are read whole;
    repeated rows, with null doc_ids too, get the same; without captured values
    no span is inferred. An empty table gives an empty one; other columns are
    ignored.
    """
    grammars = grammars or learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(grammars)

    def rows(c):
        spans, lo, hi = _spans_of(c)
        s, e, kind = shared.value.found(c)
        free = ~_touched(s, e, lo, hi)
        reach = np.maximum.accumulate(hi) if len(hi) else hi  # base spans stand in the order of their begins
        for j in np.flatnonzero(~free):
            mine = slice(np.searchsorted(reach, s[j], "right"), np.searchsorted(lo, e[j]))
            x, y = lo[mine], hi[mine]
            x, y = x[y > s[j]], y[y > s[j]]
            free[j] = bool(((x >= s[j]) & (y <= e[j]) & (y - x < e[j] - s[j])).all())
        s, e, kind = s[free], e[free], kind[free]
        doc = np.searchsorted(c.offs, s, "right") - 1
        cuts = np.searchsorted(doc, np.arange(c.n + 1))
        points = np.concatenate([[0], np.cumsum(c.char_starts())])  # code points before each byte
        first, last = points[s] - points[c.offs[doc]], points[e] - points[c.offs[doc]]
        out = []
        for i, base in enumerate(spans):
            more = [((int(first[j]), PLAIN), (int(first[j]), f"like_{KINDS[kind[j]]}", int(last[j]))) for j in range(cuts[i], cuts[i + 1])]
            named = [(x[0], KINDS[x[1]], x[2]) for x in base]
            every = [y for _, y in sorted([((x[0], x[1]), n) for x, n in zip(base, named, strict=True)] + more)]
            n = Counter(x[1] for x in base)
            out.append((n[0], n[1], n[2], hashlib.sha256(joined(named).encode()).hexdigest(), joined(every), len(more)))
        cols = list(zip(*out, strict=True))
        yield {"doc_id": id_column(c)} | dict(zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_inferred"), cols, strict=True))

    return over_chunks(with_text_kind(docs).select("doc_id", "text"), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_inferred long")
