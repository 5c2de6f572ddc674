"""Exact BPE encoding by a dynamic program over prefixes, and decoding.

The encoding of a text's prefix ends in exactly one token, and that token fits
the last token of the prefix before it: the pair, encoded by itself, stays those
two tokens. So for each prefix an Aho-Corasick automaton gives the vocabulary's
tokens that end there, longest first, the first one that fits is stored, and
following the stored tokens back from the end yields the ids that merging by
rank would have left, in time linear in the text.

Whether two tokens fit is read off the merges: while merging goes on, the last
part of the left token and the first part of the right one grow at known ranks,
and the pair breaks if at some time those two parts merge with each other.

Texts are split into pieces as the tokenizer file says. Encoding is a map over
rows, without a shuffle; what a task keeps between texts is bounded.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .textkit import arrow_schema, bound_batches

#: Added to a symbol's code point where it ends a word.
WORD_END = 0x400
#: Pieces and pairs whose results a task keeps before it starts afresh.
KEPT_PIECES, KEPT_PAIRS = 1 << 18, 1 << 20
NEVER = 1 << 62

#: The one chain of normalizers and splits that is also done here, without the library's.
KNOWN_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN_PRE = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": KNOWN_SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where Latin-1 prints it, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Kept(dict):
    """What ``make`` gives for each key, kept until there are ``most``."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = out = self.make(key)
        return out


class Merges:
    """Tokens as strings of symbols, how each is merged, and which neighbours fit."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        def symbols(token: str) -> str:
            if suffix and token.endswith(suffix) and len(token) > len(suffix):
                body = token[: -len(suffix)]
                return body[:-1] + chr(ord(body[-1]) + WORD_END)
            return token

        self.length = {i: len(symbols(t)) for t, i in vocab.items()}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, t = vocab[a], vocab[b], vocab[a + b]
            if t in self.rank:
                raise ValueError("a token that two merges make")
            self.rank[t], self.parts[t], self.pair[a, b] = r, (a, b), r
        if any(self.rank.get(p, -1) > self.rank[t] for t, parts in self.parts.items() for p in parts):
            raise ValueError("a merge that stands before one it needs")
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if self.whole(i):
                s = symbols(t)
                self.automaton.add_word(s, (i, len(s)))
        self.automaton.make_automaton()
        self.fit = Kept(lambda ab: self.fits(*ab), KEPT_PAIRS)

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank at which it grows) of the parts at one side, from the token itself, which never grows."""
        out, grows = [], NEVER
        while True:
            out.append((token, grows))
            if token not in self.parts:
                return out
            grows, token = self.rank[token], self.parts[token][side]

    def broken(self, left: int, right: int, by: int) -> bool:
        """Whether, before rank ``by``, the last part of left merges with the first part of right. Of equal ranks the one further left comes first."""
        ls, rs = self.edge(left, 1), self.edge(right, 0)
        i, j = len(ls) - 1, len(rs) - 1
        while True:
            (a, a_grows), (b, b_grows) = ls[i], rs[j]
            m = self.pair.get((a, b), NEVER)
            if m < by and m < a_grows and m <= b_grows:
                return True
            if i == 0 and j == 0:
                return False
            if j == 0 or (i > 0 and a_grows <= b_grows):
                i -= 1
            else:
                j -= 1

    def whole(self, token: int) -> bool:
        """Whether the token's own string is encoded as the token: no merge across its parts comes before its own."""
        todo = [token]
        while todo:
            t = todo.pop()
            if t in self.parts:
                a, b = self.parts[t]
                if self.broken(a, b, self.rank[t]):
                    return False
                todo += [a, b]
        return True

    def fits(self, left: int, right: int) -> bool:
        return not self.broken(left, right, NEVER)

    def encode(self, s: str) -> tuple[int, ...]:
        """ids of a string of symbols; symbols that the vocabulary lacks are left out, as a model without an unknown token does."""
        last = [-1] * (len(s) + 1)
        fit = self.fit
        for end, (token, n) in self.automaton.iter(s):
            end += 1
            if last[end] < 0:
                start = end - n
                if start == 0 or (before := last[start]) < 0 or fit[before, token]:
                    last[end] = token
        out, at = [], len(s)
        while at > 0:
            if (token := last[at]) < 0:
                at -= 1
            else:
                out.append(token)
                at -= self.length[token]
        return tuple(reversed(out))


class Tokenizer:
    """A BPE tokenizer from the text of its file: pieces, ids and strings."""

    def __init__(self, spec: str):
        self.spec, d = spec, json.loads(spec)
        m = d["model"]
        if m["type"] != "BPE" or m.get("dropout") or m.get("unk_token") or m.get("continuing_subword_prefix") or m.get("byte_fallback") or m.get("ignore_merges") or d.get("post_processor") not in (None,) and d["post_processor"]["type"] != "ByteLevel":
            raise ValueError("a BPE model without dropout, unknown token, prefix, byte fallback and whole-piece lookup is needed")
        added = d.get("added_tokens") or []
        if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("added tokens must be found as they are written")
        suffix = m.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in added}
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if added else None
        self.merges = Merges(m["vocab"], m["merges"], suffix)
        names = {i: t for t, i in m["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.spaced = d.get("decoder") is None
        self.known = d.get("normalizer") == KNOWN_NORMAL and d.get("pre_tokenizer") == KNOWN_PRE
        self.split = regex.compile(KNOWN_SPLIT)
        table = byte_symbols()
        self.symbols = str.maketrans({i: c for i, c in enumerate(table)})
        self.word_end = WORD_END if suffix else 0
        self.by_piece = Kept(lambda p: self.of_symbols(p.encode().decode("latin-1").translate(self.symbols)), KEPT_PIECES)
        self.by_symbols = Kept(self.of_symbols, KEPT_PIECES)
        #: Characters newer than Python's tables: their class and case are the library's to say.
        self.new_char = Kept(lambda c: unicodedata.category(c) == "Cn", 1 << 16)

    @property
    def library(self):
        if not hasattr(self, "_library"):
            from tokenizers import Tokenizer as Library

            self._library = Library.from_str(self.spec)
        return self._library

    def of_symbols(self, s: str) -> tuple[int, ...]:
        return self.merges.encode(s[:-1] + chr(ord(s[-1]) + self.word_end)) if self.word_end and s else self.merges.encode(s)

    def plain(self, text: str) -> Iterable[int]:
        """ids of a text without added tokens."""
        if self.known and (text.isascii() or not any(map(self.new_char.__getitem__, set(text)))):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a capital sigma lowers alike at a word's end
            return chain.from_iterable(map(self.by_piece.__getitem__, self.split.findall(text.lower())))
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)] if self.library.pre_tokenizer else [text]
        return chain.from_iterable(map(self.by_symbols.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        if self.special is None or not self.special.search(text):
            return np.fromiter(self.plain(text), np.int32)
        out, at = [], 0
        for hit in self.special.finditer(text):
            out += [*self.plain(text[at : hit.start()]), self.added[hit[0]]]
            at = hit.end()
        return np.array([*out, *self.plain(text[at:])], np.int32)


@lru_cache(maxsize=2)
def load(spec: str) -> Tokenizer:
    return Tokenizer(spec)


def read_spec(path: str) -> str:
    """The tokenizer file, read once where the job is planned; its size is the vocabulary's, not the data's."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with ``ids``: the whole text's token ids, as the library's encode gives without special tokens around.

    A null or empty text has no ids; texts of any length are encoded whole, and
    one piece without end, such as a million letters, in linear time. Strings of
    added tokens inside a text are those tokens. Repeated rows stay; no other
    column is read, and one of docs named as ``ids`` gives way. An empty table
    stays empty.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def fn(texts: pa.Array) -> pa.Array:
        tok = load(spec.value)
        rows = [tok.encode(t) if t else np.zeros(0, np.int32) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return _lists(ends, pa.array(flat, pa.int32()))

    return _more(docs, text, ids, "array<int>", fn)


def _lists(ends: np.ndarray, flat: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens with ``text``: the strings of the ids, special ones too, as the library's decode gives for a file without a decoder, joined by spaces.

    A null list, or one of no ids, gives an empty text; an id that the
    vocabulary lacks, or a null, is left out, as the library does. A column
    named as ``text`` gives way.
    """
    spec = tokens.sparkSession.sparkContext.broadcast(read_spec(path))

    def fn(lists: pa.Array) -> pa.Array:
        tok = load(spec.value)
        if not tok.spaced:
            return pa.array([tok.library.decode([i for i in x or [] if i is not None], skip_special_tokens=False) for x in lists.to_pylist()], pa.string())
        flat, parent = pc.cast(pc.list_flatten(lists), pa.int64()).to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy()
        known = (flat >= 0) & (flat < len(tok.names))
        flat, parent = flat[known].astype(np.int64), parent[known]
        named = np.array([x is not None for x in tok.names])[flat]
        flat, parent = flat[named], parent[named]
        ends = np.searchsorted(parent, np.arange(len(lists) + 1))
        names = pa.array(tok.names, pa.string()).take(pa.array(flat))
        return pc.fill_null(pc.binary_join(_lists(ends, names), " "), "")

    return _more(tokens, ids, text, "string", fn)


def _more(df: DataFrame, source: str, name: str, kind: str, fn) -> DataFrame:
    """df with the column ``name``, which fn makes of each batch's column ``source``; other columns pass as they are."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructField, StructType

    kept = [c for c in df.columns if c != name]
    if source in kept:
        rows = df.select(*(F.col(f"`{c}`") for c in kept))
    else:
        raise ValueError(f"no column {source}")
    if kind == "array<int>":
        rows = rows.withColumn(source, F.col(f"`{source}`").cast("string")) if dict(rows.dtypes)[source] != "string" else rows
    new = arrow_schema(f"x {kind}").field(0).type
    schema = StructType([*rows.schema.fields, StructField(name, StructType.fromDDL(f"x {kind}")[0].dataType)])
    at = kept.index(source)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = fn(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, got.cast(new)], names=[*kept, name])

    bound_batches(df.sparkSession)
    return rows.mapInArrow(run, schema)
