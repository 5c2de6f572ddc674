"""Quality rules as a learned decision list.

Sequential covering: rules for label 0 are grown one after the other as
conjunctions of thresholds on text statistics (by FOIL's gain), each is pruned
on rows that growing did not see, and the rows it covers leave the set. The list
becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import U, Chunk, mix, per_text, with_columns, with_text_kind

#: Labelled rows that a list is learned from at most: those of the least hashes.
SAMPLE_ROWS = 20_000
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_marks long, n_distinct long"
_table = lambda chars: np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8))
_SYMBOL, _UPPER, _DIGIT, _MARK = _table("#*$%&|<>"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table("!?")


def _keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h + doc.astype(U) * U(0x9E3779B97F4A7C15))


def statistics(c: Chunk) -> dict:
    """The COUNTS of each text of a chunk."""
    c.words()
    wh = c.word_hashes()
    inside = np.zeros(len(c.data) + 1, np.int8)
    inside[c.ws] += 1
    np.subtract.at(inside, c.we, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    # Words in 3-word windows that occur again in the same text.
    h, at = c.shingles(wh, 3)
    _, back, times = np.unique(_keyed(h, c.wdoc[at]), return_inverse=True, return_counts=True)
    again = at[times[back] > 1]
    cover = np.zeros(len(wh), bool)
    for j in range(3):
        cover[again + j] = True
    # Lines with a word; of equal ones all but the first.
    nl = np.flatnonzero(c.data == 10)
    s, e = np.sort(np.concatenate([c.offs[:-1], nl + 1])), np.sort(np.concatenate([nl, c.offs[1:]]))
    some = np.searchsorted(c.ws, e) > np.searchsorted(c.ws, s)
    s, e = s[some], e[some]
    doc = np.searchsorted(c.offs, s, "right") - 1
    _, first = np.unique(_keyed(c.span_hash(s, e), doc), return_index=True)
    lines = np.bincount(doc, minlength=c.n)
    words, first_word = np.unique(_keyed(wh, c.wdoc), return_index=True)
    return {
        "n_words": c.n_words, "word_chars": per_text(c, inside & c.char_starts()), "n_symbols": per_text(c, _SYMBOL[c.data]), "n_dup_lines": lines - np.bincount(doc[first], minlength=c.n),
        "n_repeat_words": np.bincount(c.wdoc[cover], minlength=c.n), "n_lines": lines, "n_upper": per_text(c, _UPPER[c.data]), "n_digits": per_text(c, _DIGIT[c.data]), "n_marks": per_text(c, _MARK[c.data]), "n_distinct": np.bincount(c.wdoc[first_word], minlength=c.n),
    }


#: name: (numerator, denominator) of the shares that rules test; without words all are 0.
SHARES = {"mean_word": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "marks": ("n_marks", "n_words"), "distinct": ("n_distinct", "n_words")}


def share(name: str) -> Column:
    a, b = SHARES[name]
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Rule:
    """A text is of label 0 if all tests (name of a share, ">=" or "<=", threshold) hold."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, way, x in self.tests:
            out = out & (share(name) >= x if way == ">=" else share(name) <= x)
        return out

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, way, v in self.tests:
            out &= (x[name] >= v).to_numpy() if way == ">=" else (x[name] <= v).to_numpy()
        return out


def grow(x: pd.DataFrame, bad: np.ndarray, thresholds: int = 64) -> list[tuple[str, str, float]]:
    """Add the test of the largest FOIL gain until only bad rows are covered or nothing gains."""
    tests, live = [], np.ones(len(x), bool)
    while (p0 := (bad & live).sum()) and (live & ~bad).any() and len(tests) < 4:
        was, best = np.log2(p0 / live.sum()), (0.0, None)
        for name in x:
            v = x[name].to_numpy()
            cuts = np.unique(np.quantile(v[live & bad], np.linspace(0, 1, thresholds)))
            for way in (">=", "<="):
                for cut in cuts:
                    m = live & (v >= cut if way == ">=" else v <= cut)
                    p, n = (m & bad).sum(), m.sum()
                    if p and (gain := p * (np.log2(p / n) - was)) > best[0] + 1e-9:
                        best = (gain, (name, way, float(cut)))
        if best[1] is None:
            break
        tests.append(best[1])
        live &= Rule((best[1],)).holds(x)
    return tests


def learn_list(x: pd.DataFrame, bad: np.ndarray, order: np.ndarray, max_rules: int = 12, precision: float = 0.95) -> list[Rule]:
    """Cover and separate: grow on two thirds (by order), prune on the rest, stop when a rule is not precise there."""
    rules, live, held = [], np.ones(len(x), bool), order % 3 == 0
    while len(rules) < max_rules and (bad & live & ~held).sum() >= 5:
        tests = grow(x[live & ~held], bad[live & ~held])
        if not tests:
            break

        def worth(k, tests=tests):
            m = Rule(tuple(tests[:k])).holds(x) & live & held
            return ((m & bad).sum() + 1) / (m.sum() + 2) if k else 0

        k = max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))
        rule = Rule(tuple(tests[:k]))
        m = rule.holds(x) & live
        if (m & bad).sum() < max(3, precision * m.sum()):
            break
        rules.append(rule)
        live &= ~m
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """true (keep) or false: the first rule that holds rejects."""
    out = F
    for r in rules:
        out = out.when(r.column(), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from at most ``rows`` rows of labels (doc_id, quality), and of documents that have these ids, by least hash; rows without a label teach nothing, and without any there are no rules."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null").withColumn("o", F.xxhash64("doc_id")).orderBy("o", "quality").limit(rows)
    # At most ``rows`` short rows: small enough to broadcast.
    texts = with_text_kind(docs).select("doc_id", "text").join(F.broadcast(some), "doc_id")
    got = with_columns(texts, statistics, COUNTS).drop("text").select("o", "quality", *(share(n).alias(n) for n in SHARES)).orderBy("o", "quality", *SHARES).limit(rows).toPandas()
    if not len(got):
        return []
    return learn_list(got[list(SHARES)], (got["quality"] == 0).to_numpy(), got["o"].to_numpy().view(np.uint64) % 3)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the COUNTS, base_failed and kept.

    Nulls and empty texts have counts of 0 and fail the base rules (fewer than
    50 words); very long texts are counted whole; repeated rows are judged
    alike; columns of docs that clash with a new name give way; an empty table
    stays empty.
    """
    out = with_columns(with_text_kind(docs), statistics, COUNTS)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", F.when(failed, False).otherwise(rules_column(rules)))
