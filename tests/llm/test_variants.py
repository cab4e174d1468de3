"""Spelling variants against a plain reading of their definition."""

import random
import re
import zlib
from collections import Counter

import pytest

from curbside.llm import spelling_variants as V

DOCS = "doc_id long, text string, n long, shard string"


def brute_words(rows):
    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def documents(seed, letters):
    """Texts whose words come with slips, some words a hundred times as often."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    base = [word(rng.randint(6, 12)) for _ in range(25)] + [letters[0] * 9, letters[0] * 10, letters[0] * 8 + letters[1], "ÿ" * 8, "ÿ" * 9]

    def slip(w):
        k, c = rng.randrange(len(w)), rng.choice(letters)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])

    out = []
    for _ in range(150):
        w = [rng.choice(base[: rng.choice([2, 30])]) for _ in range(rng.randrange(25))]
        for k in range(len(w)):
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[k] = slip(w[k])
            w[k] = rng.choice([w[k], w[k].upper() if w[k].isascii() else w[k]])
        out.append(rng.choice([" ", ", ", "-", "日"]).join(w))
    return out


@pytest.mark.parametrize(("seed", "letters", "shard", "asked"), [(1, "ab", 20_000, 5_000), (2, "abcdeé", 7, 3), (3, "stÿ", 40, 1000)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, letters, shard, asked):
    monkeypatch.setattr(V, "SHARD", shard)
    monkeypatch.setattr(V, "ASKED", asked)
    monkeypatch.setattr(V, "COMBINE", 30)
    rows = list(enumerate(documents(seed, letters))) + [(500, None), (501, ""), (None, "repeated repeated"), (7, "repeated"), (7, "repeated")]
    rows += [(502, "q" * 300 + " " + "q" * 300), (503, "q" * 299 + "z " + "q" * 299 + "z"), (504, "q" * 299 + "z " + "q" * 301 + " " + "q" * 301)]
    got = V.variants(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(4)).collect()
    want = brute(rows)
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got) == want
    assert seed == 3 or any(f and r != f for _, f, r, *_ in want) or any(f for _, f, *_ in want)


def test_pairs_of_a_sorted_list():
    rng = random.Random(8)
    for _ in range(60):
        words = sorted({bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(7, 10))) for _ in range(rng.randrange(1, 200))})
        want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and one_edit(a, b)}
        a, w = V.near_words(words, words)
        got = set(zip(a.tolist(), w.tolist()))
        assert len(got) == len(a) and got == {(i, j) for i, j in want if words[i][: V.half(len(words[i]))] == words[j][: V.half(len(words[i]))]}
        back = sorted(x[::-1] for x in words)
        a, w = V.near_words(back, back)
        rest = ~V.same_half(back, back, a, w)
        other = {(words.index(back[i][::-1]), words.index(back[j][::-1])) for i, j in zip(a[rest].tolist(), w[rest].tolist())}
        assert got | other == want and not got & other
        for x in words[:20]:
            for y in words[:20]:
                if y.startswith(x[: V.half(len(x))]) and V.far_from(y[:6], x):
                    assert not any(one_edit(x, z) for z in words if z.startswith(y[:6]))


def test_empty_table(spark):
    assert V.variants(spark.createDataFrame([], DOCS)).collect() == []
