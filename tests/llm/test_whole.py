"""What operators once left out: each test holds a case that a cut would lose."""

import math
import random
import zlib
from collections import Counter, defaultdict

from .test_llm import low


def ppm_scores(texts, times=()):
    """log10 probabilities by PPM of depth 5, method C with exclusions, from every context that training texts hold; times: rows of a text, by doc_id, where not one."""
    end = -1
    seq = lambda t: [*low(t or "").encode(), end]
    seen = [defaultdict(Counter) for _ in range(6)]
    for d, t in texts:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1:
            s = [end] * 5 + seq(t)
            for i in range(5, len(s)):
                for k in range(6):
                    seen[k][tuple(s[i - k : i])][s[i]] += dict(times).get(d, 1)
    known = set(seen[0][()])
    unknown = len({low(chr(b)) if b < 128 else b for b in range(256)}) - len(known - {end})

    def log(ctx, x):
        out, gone = 0.0, set()
        for k in range(5, -1, -1):
            c = {y: n for y, n in seen[k][tuple(ctx[5 - k :])].items() if y not in gone}
            n = sum(c.values()) + len(c)
            if x in c:
                return out + math.log10(c[x] / n)
            if c:
                out, gone = out + math.log10(len(c) / n), gone | set(c)
        return out - math.log10(unknown)

    got = []
    for d, t in texts:
        s = [end] * 5 + seq(t)
        got.append((d, t, sum(log(s[i - 5 : i], s[i]) for i in range(5, len(s)))))
    return got


def sample(n):
    """Latin texts with a few Cyrillic and Chinese ones: more than 62 byte values, some of them in held-out texts alone."""
    r = random.Random(8)
    latin = ["".join(r.choice("abcdefghijklmnop ,.0123456789QRSTUV[]{}<>#%&") for _ in range(r.randrange(2, 9))) for _ in range(90)]
    other = ["привет", "мир", "дом", "語言", "模型", "ёж", "это"]
    return [(i, " ".join(r.choice(other if i % 9 == 0 else latin) for _ in range(r.randrange(0, 60))) + ("\x01\x02" if zlib.crc32(str(i).encode()) % 5 == 1 else "")) for i in range(n)]


def test_op8_all_bytes_are_symbols(spark):
    from blockweave.llm.ppm import score_texts

    texts = sample(120)
    want = {d: s for d, _, s in ppm_scores(texts)}
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[d], want[d], rel_tol=1e-4, abs_tol=1e-4) for d in want)


def test_op8_rare_contexts_count_in_a_large_corpus(spark):
    """Beside 17 MB of other text, what training has once still predicts."""
    from blockweave.llm.ppm import score_texts

    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1)
    free = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 != 1]
    filler = " ".join(sample(20)[1][1] for _ in range(4)) + "filler " * 200
    passage = "a quick zebra vexed the dwarf king"
    texts, times = [(free[0], filler), (free[1], passage), (held, passage)], 17_000_000 // len(filler.encode())
    many = spark.range(times).selectExpr(f"{free[0]}L as doc_id").crossJoin(spark.createDataFrame([(filler,)], "text string"))
    got = score_texts(many.union(spark.createDataFrame(texts[1:], "doc_id long, text string"))).where(f"doc_id = {held}").first().score
    assert math.isclose(got, ppm_scores(texts, {free[0]: times})[-1][2], rel_tol=1e-4)


def test_op8_pairs_scores_with_their_own_row(spark):
    """Texts of one doc_id, or of none, with equally many tokens keep their own two scores, however the table is cut."""
    from blockweave.llm.ppm import score_texts

    texts = [(7, "one two three"), (7, "zzz yyy xxx"), (None, "one one one"), (None, "qqq two vvv"), (None, None), (8, "one two three"), (7, "one two three"), (9, "")]
    texts += [(i, f"word{i} one two") for i in range(20, 40)]
    want = Counter((d, len((t or "").split()) + 1, round(s, 3)) for d, t, s in ppm_scores(texts))
    words_ = Counter(w for d, t in texts if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1 for w in [*(t or "").split(), None])
    n, v = sum(words_.values()), len(words_)
    base = Counter((d, round(sum(math.log10((words_[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(t or "").split(), None]), 4), round(s, 3)) for d, t, s in ppm_scores(texts))
    for parts in (1, 5):
        got = score_texts(spark.createDataFrame([(*x, 1) for x in texts], "doc_id long, text string, score int").repartition(parts)).collect()
        assert Counter((r.doc_id, r.n_tokens, round(r.score, 3)) for r in got) == want
        assert Counter((r.doc_id, round(r.base_score, 4), round(r.score, 3)) for r in got) == base


def test_op2_number_of_links_is_exact(spark, monkeypatch):
    """Near copies that all link with each other, and others that mostly link with the base alone."""
    from blockweave.llm import ngram_join
    from blockweave.llm.ngram_join import jaccard_components

    from .test_llm import shingles

    r = random.Random(9)
    texts = []
    for group, most in ((0, 2), (1, 8), (2, 4)):
        base = [f"w{group}n{r.randrange(10**6)}" for _ in range(200)]
        for i in range(40):
            w = list(base)
            for j in r.sample(range(200), r.randrange(0, most + 1) if i else 0):
                w[j] = f"x{i}y{j}"
            texts.append((100 * group + i, " ".join(w)))
    # Small blocks, so that a component is several of them.
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    sets = {d: frozenset(shingles(t)) for d, t in texts}
    want = {d: len({b for b in sets.values() if b != a and 100 * len(a & b) >= 80 * len(a | b)}) for d, a in sets.items()}
    got = {x.doc_id: x.n_links for x in jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want and max(want.values()) > 20


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice, this
#    list of conditions and the following disclaimer.
#
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation
#    and/or other materials provided with the distribution.
#
# 3. Neither the name of the copyright holder nor the names of its
#    contributors may be used to endorse or promote products derived from
#    this software without specific prior written permission.
"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
"""


def test_op4_wrapped_texts():
    from blockweave.llm.licences import Book

    identify, match = lambda t: Book().identify(t)[0], Book().match
    want = [(MIT, ["MIT"]), (BSD, ["BSD-3-Clause"]), (GPL, ["GPL-3.0-or-later"]), (GPL.replace("General", "Lesser General"), ["LGPL-3.0-or-later"])]
    for text, names in want:
        for t in (text, text.replace("\n", "\r\n"), "Some words. " + text + "more words\n"):
            assert match(identify(t)) == names
    assert identify("this program is free software\n\nall rights\n\nreserved") == ["gnu_free"]
    assert identify("licensed under\nthe\nlicensed under the mit license") == ["mit_notice"]
