"""Toxicity by a counterfactual-regularised classifier.

A logistic model over words and the four-byte strings in them, each with the
log-odds it has in the labelled texts as its scale. Strings let it know words
that labels don't hold by their parts, and so give weight to mentions of groups
that no label speaks of ("brown" ends like "clown"). Besides labels, training
sees labelled sentences that mention a group with the mention swapped for each
of its counterparts, and penalises the squared change of the score's log-odds: a
text doesn't score higher for whom it mentions. For groups that no labelled sentence
mentions, mentions are put into sentences of the labelled texts.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import FOLDED, U, Chunk, id_column, over_chunks, settle, with_text_kind

#: Labelled rows learned from at most, and words that they have together (different ones of a text, and those of its sentences with mentions): rows of the least hashes, each whole, the first whatever its length.
SAMPLE_ROWS, SAMPLE_WORDS = 12_000, 8_000_000
#: Sentences into which mentions of each group are put that labels don't mention.
TEMPLATES = 40
GRAM = 4
FAIRNESS = 1.0
# Terms for groups of people; those of one line are counterparts.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("black", "white", "brown", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrants", "natives"), ("disabled", "able-bodied"), ("homeless", "housed"), ("old", "young"), ("african", "european", "american"), ("transgender", "cisgender"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("étrangers", "français"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "españoles"),
)
EDGE = b".,;:!?\"'()[]*#$%&|<>-"
_EDGE = np.isin(np.arange(256), np.frombuffer(EDGE, np.uint8))
_sentence = re.compile(rb"[^.!?\n]+")
_TERMS = {w.encode(): g for g, group in enumerate(IDENTITY) for w in group}


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text in order: A-Z folded, punctuation at their ends left out; words of punctuation alone are none."""
    return [w for x in raw.lower().split() if (w := x.strip(EDGE))]


def grams_of(word: bytes) -> list[int]:
    """The strings of GRAM bytes in a word between two spaces, as numbers."""
    b = b" " + word + b" "
    return [int.from_bytes(b[i : i + GRAM], "big") for i in range(len(b) - GRAM + 1)]


def hash_of(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(Chunk(None, data, np.array([0, len(data)])).span_hash(np.array([0]), np.array([len(data)]), FOLDED)[0])


def _held_out(col):
    return (F.crc32(F.coalesce(col.cast("long").cast("string"), F.lit(""))) % 5) == 0


class Model:
    """Weights of words, by their hash, and of strings, by their number; a text's score adds up those of its different words."""

    def __init__(self, words: dict[bytes, float], grams: dict[int, float], bias: float):
        h = np.array([hash_of(w) for w in words], U)
        order = np.argsort(h)
        self.h, self.word = h[order], np.array(list(words.values()), np.float64)[order]
        g = np.array(sorted(grams), np.int64)
        self.g, self.gram, self.bias = g, np.array([grams[x] for x in g.tolist()], np.float64), bias

    def _look(self, keys, known, weight):
        if not len(known):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, weight[at], 0.0)

    def scores(self, c: Chunk) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(c), -500, 500)))

    def logits(self, c: Chunk) -> np.ndarray:
        """The log-odds of each text."""
        c.words()
        at = np.flatnonzero(~_EDGE[c.data])
        lo, hi = np.searchsorted(at, c.ws), np.searchsorted(at, c.we)
        some = hi > lo
        z = np.full(c.n, self.bias)
        if some.any():
            s, e, doc = at[lo[some]], at[hi[some] - 1] + 1, c.wdoc[some]
            h, first, back = np.unique(c.span_hash(s, e, FOLDED), return_index=True, return_inverse=True)
            s, e = s[first], e[first]
            value = self._look(h, self.h, self.word)
            # Strings of the chunk's different words, each between two spaces.
            lens = e - s
            begin = np.cumsum(lens + 2) - (lens + 2)
            b = np.full(int((lens + 2).sum()), 0x20, np.int64)
            inside = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
            low = c.data[np.repeat(s, lens) + inside].astype(np.int64)
            b[np.repeat(begin + 1, lens) + inside] = np.where((low >= 65) & (low <= 90), low + 32, low)
            n = np.maximum(0, lens + 2 - (GRAM - 1))
            own = np.repeat(np.arange(len(lens)), n)
            start = np.repeat(begin, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            gram = np.zeros(len(start), np.int64)
            for j in range(GRAM):
                gram = gram << 8 | b[start + j]
            value += np.bincount(own, self._look(gram, self.g, self.gram), len(lens))
            pair = np.unique(doc * len(h) + back)
            z += np.bincount(pair // len(h), value[pair % len(h)], c.n)
        return z

    def logit(self, text: bytes) -> float:
        return float(self.logits(Chunk(None, np.frombuffer(text, np.uint8), np.array([0, len(text)])))[0])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text.encode()), -500, 500))))


@dataclass
class Example:
    """A labelled text: its different words, joined by spaces, its sentences that mention a group, and its first sentence."""

    toxic: bool
    text: bytes
    mentions: list[list[bytes]]
    first: list[bytes]


def example(raw: bytes, toxic: bool) -> Example:
    said = [w for m in _sentence.finditer(raw.lower()) if (w := words_of(m[0]))]
    mentions = [w for w in said if not _TERMS.keys().isdisjoint(w)]
    return Example(toxic, b" ".join(sorted({w for s in said for w in s} | set(words_of(raw)))), mentions, said[0] if said else [])


def swaps_of(texts: list[Example]) -> list[tuple[list[bytes], bytes, bytes]]:
    """(sentence, mention, counterpart): each mention in a labelled sentence with all its counterparts; for groups without any, mentions put at the end of first sentences."""
    out, seen = [], set()
    for x in texts:
        for s in x.mentions:
            for w in sorted(set(s) & _TERMS.keys()):
                seen.add(_TERMS[w])
                out += [(s, w, other.encode()) for other in IDENTITY[_TERMS[w]] if other.encode() != w]
    for g, group in enumerate(IDENTITY):
        if g not in seen:
            for i, x in enumerate([x for x in texts if x.first][:TEMPLATES]):
                w, other = group[i % len(group)].encode(), group[(i + 1 + i // len(group) % (len(group) - 1)) % len(group)].encode()
                out.append(([*x.first, w], w, other))
    return out


def fit(texts: list[Example], l2: float = 0.2, fairness: float = FAIRNESS, steps: int = 150) -> Model:
    """Gradient descent (Adam, full batches) on log loss + l2 + the mean squared change of the log-odds under swaps, which in a linear model the rest of the sentence takes no part in."""
    y, n = np.array([x.toxic for x in texts], np.float64), len(texts)
    if not n or y.min() == y.max():
        p = float(np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3))
        return Model({}, {}, float(np.log(p / (1 - p))))
    swaps = swaps_of(texts)
    # Words by number, and the numbers of the strings in each; a feature is a word, or past these a string.
    ids: dict[bytes, int] = {}
    words, ends = array("i"), array("q", [0])
    for x in texts:
        words.extend(ids.setdefault(w, len(ids)) for w in x.text.split())
        ends.append(len(words))
    for pair in swaps:
        for w in pair[1:]:
            ids.setdefault(w, len(ids))
    grams: dict[int, int] = {}
    parts, part_ends = array("i"), array("q", [0])
    for w in ids:
        parts.extend(grams.setdefault(g, len(grams)) for g in grams_of(w))
        part_ends.append(len(parts))
    words, ends, parts, part_ends = (np.frombuffer(x, np.int32 if x.typecode == "i" else np.int64) for x in (words, ends, parts, part_ends))
    n_words, size = len(ids), len(ids) + len(grams)

    def features(own):
        """(position in own, feature) of each word of ``own`` and of the strings in it."""
        count = part_ends[own + 1] - part_ends[own]
        at = np.repeat(part_ends[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return np.concatenate([np.arange(len(own)), np.repeat(np.arange(len(own)), count)]), np.concatenate([own, parts[at] + n_words])

    def blocks(rows=128):
        """(text, feature) of a few texts at a time, repeated as often as words of the text have it."""
        for lo in range(0, n, rows):
            hi = min(n, lo + rows)
            at, f = features(words[ends[lo] : ends[hi]].astype(np.int64))
            yield np.repeat(np.arange(lo, hi), np.diff(ends[lo : hi + 1]))[at], f

    df, pos = np.zeros(size), np.zeros(size)
    for who, f in blocks():
        pair = np.unique(who * size + f)
        df += np.bincount(pair % size, minlength=size)
        pos += np.bincount(pair % size, y[pair // size], size)
    # What a random feature of so many texts differs by has no scale; mentions of groups keep one, for the penalty to move.
    a, b, mean = (pos + 0.5) / (y.sum() + 1), (df - pos + 0.5) / (n - y.sum() + 1), y.mean()
    odds = np.log(a / (1 - a)) - np.log(b / (1 - b))
    z = (pos - df * mean) / np.sqrt(np.maximum(df, 1) * mean * (1 - mean))
    scale = np.where(df >= 3, odds * np.clip(np.abs(z) - 2, 0, None) / (np.abs(z) + 1e-9), 0.0)
    terms = [ids[w] for w in _TERMS if w in ids]
    scale[terms] = np.where(np.abs(scale[terms]) < 0.1, 1.0, scale[terms])
    use = np.flatnonzero(scale)
    index = np.full(size, -1)
    index[use] = np.arange(len(use))
    scale, m = scale[use], len(use)

    def kept(row, col):
        return row[index[col] >= 0], index[col[index[col] >= 0]]

    got = [tuple(v.astype(np.int32) for v in kept(*x)) for x in blocks()]
    doc, col = (np.concatenate([x[i] for x in got]) for i in (0, 1))
    (out, out_col), (into, into_col) = (kept(*features(np.array([ids[x[i]] for x in swaps], np.int64))) for i in (1, 2))
    w, bias, g1, g2, k = np.zeros(m), float(np.log(mean / (1 - mean))), np.zeros(m + 1), np.zeros(m + 1), len(swaps)
    for t in range(1, steps + 1):
        v = w * scale
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, v[col], n) + bias, -50, 50)))
        grad = np.bincount(col, (p - y)[doc], m) * scale / n + l2 * w / n
        gb = (p - y).mean()
        if k and fairness:
            change = np.bincount(out, v[out_col], k) - np.bincount(into, v[into_col], k)
            d = 2 * fairness * change / k
            grad += (np.bincount(out_col, d[out], m) - np.bincount(into_col, d[into], m)) * scale
        g = np.append(grad, gb)
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.999 * g2 + 0.001 * g * g
        step = 0.1 * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:m], bias - step[m]
    by_word, by_gram, found = list(ids), list(grams), w * scale
    return Model({by_word[f]: float(x) for f, x in zip(use, found, strict=True) if f < n_words}, {by_gram[f - n_words]: float(x) for f, x in zip(use, found, strict=True) if f >= n_words}, float(bias))


def gap(model: Model, texts: list[Example]) -> float:
    """The mean absolute change of the log-odds when a mention is swapped."""
    change = [abs(model.logit(b" ".join(s)) - model.logit(b" ".join([*(w for w in s if w != out), into]))) for s, out, into in swaps_of(texts)]
    return float(np.mean(change)) if change else 0.0


def examples(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS) -> list[Example]:
    """Labelled texts whose rows aren't held out: at most ``rows`` rows of labels (doc_id, toxic), and of documents that have these ids, by least hash, up to so many words in all. Texts are read whole."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~_held_out(F.col("doc_id"))).withColumn("o", F.xxhash64("doc_id")).orderBy("o", "toxic").limit(rows)
    texts = with_text_kind(docs).select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most ``rows`` short rows

    def read(c):
        raw, get = c.data.tobytes(), lambda n: c.rows.column(c.rows.schema.get_field_index(n))
        toxic = get("toxic").to_pylist()
        got = [example(raw[a:b], t != 0) for a, b, t in zip(c.offs[:-1], c.offs[1:], toxic, strict=True)]
        lines = lambda x: b"\n".join(b" ".join(s) for s in x)
        size = [len(x.text.split()) + sum(map(len, x.mentions)) for x in got]
        yield {"o": get("o"), "toxic": get("toxic"), "size": size, "words": pa.array([x.text for x in got], pa.binary()), "mentions": pa.array([lines(x.mentions) for x in got], pa.binary()), "first": pa.array([b" ".join(x.first) for x in got], pa.binary())}

    order = ["o", "toxic", "words", "mentions", "first"]
    got = settle(over_chunks(texts, read, "o long, toxic int, size long, words binary, mentions binary, first binary").orderBy(*order).limit(rows))
    before = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")  # over the sample alone
    some = got.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= words)).orderBy(*order).toPandas()
    return [Example(bool(r.toxic), r.words, [s.split() for s in r.mentions.split(b"\n") if s], r.first.split()) for r in some.itertuples()]


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text).

    Learned from labels of rows whose crc32(doc_id as text) mod 5 is not 0; a
    null doc_id is the empty text there and has no label. Scores depend on the
    text alone: null and empty texts get that of no words, repeated rows the
    same, very long texts are read whole. Without labels every score is low and
    equal. An empty table gives an empty one; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(examples(docs, labels)))

    def rows(c):
        s = model.value.scores(c)
        yield {"doc_id": id_column(c), "held_out": c.rows.column(c.rows.schema.get_field_index("held_out")), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    docs = with_text_kind(docs).select("doc_id", "text", _held_out(F.col("doc_id")).alias("held_out"))
    return over_chunks(docs, rows, "doc_id long, held_out boolean, score double, predicted int")
