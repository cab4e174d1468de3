"""Token alignment against a plain reading of its definition."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from curbside.llm import token_alignment as T

DOCS = "doc_id long, text string, block string, n long"


def brute_groups(text, tokens):
    """[(a ids, b ids)] from decoded bytes alone; None if the tokens spell another text."""
    if not text:
        return None
    whole = (" " + text).encode()
    a = tokens.a.encode(" " + text, add_special_tokens=False).ids
    b = tokens.b.encode(text)
    if b"".join(tokens.a_bytes[i] for i in a) != whole or b"".join(tokens.b_bytes[i] for i in b) != whole:
        return None
    out, x, y, at_a, at_b = [([], [])], 0, 0, 0, 0
    while x < len(a) or y < len(b):
        if at_a <= at_b and x < len(a):
            at_a += len(tokens.a_bytes[a[x]])
            out[-1][0].append(a[x])
            x += 1
        else:
            at_b += len(tokens.b_bytes[b[y]])
            out[-1][1].append(b[y])
            y += 1
        if at_a == at_b:
            out.append(([], []))
    return out[:-1]


def brute(rows):
    tokens = T.pair()
    groups = [(i, brute_groups(t, tokens)) for i, t in rows]
    held = Counter()
    for _, g in groups:
        held.update({(x, y) for a, b in g or () for x in a for y in b})
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for i, g in groups:
        links = [(x, y) for a, b in g or () for x in a for y in b]
        show = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        out.append((i, sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), len(links), sum(held[k] == top[k[0]] for k in links), sum(held[k] for k in links),
                    hashlib.sha256(show.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "thndsh", "Ünïcode", "naïve", "😀", "👩‍👩‍👧", "日本語のテキスト", "don't", "a.b@c.de", "12,345.6", "<|endoftext|>", "<s>", "<0x41>", "...", "x" * 50, "é́", "​", "\x00", "\x1c", "ﬁ", "ẞ", "𝔘"]
    gaps = [" ", " ", " ", " ", "  ", "\n", "\n\n", " \n ", "\t", "   ", "　", "\r\n", "\xa0", "", " " * 40]
    out = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 30))) for _ in range(120)]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    return out + plain + [" lead", "trail ", " ", "\n", "  ", "a▁b", "▁", "\t\tx", "word " * 3000, "ab" * 4000, " " * 3000, "\n" * 500]


@pytest.mark.parametrize(("block", "call"), [(16_000_000, 100_000), (400, 50)])
def test_alignment_equals_brute_force(spark, monkeypatch, block, call):
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "CALL", call)
    rows = list(enumerate(texts(block))) + [(900, None), (901, ""), (None, "null id"), (3, "the thndsh"), (3, "the thndsh")]
    got = T.align_documents(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(i, a, b, g, n, best, total, sha) for i, a, b, g, n, best, total, sha in brute(rows)]
    assert len(got) == len(rows)


def test_long_groups_and_refusals(monkeypatch):
    tokens = T.pair()
    monkeypatch.setattr(T, "WIDE", 2)
    for t in texts(5):
        ends = T.np.array([len((" " + t).encode())])
        found, groups = T.align(t, ends, tokens) if t else None, brute_groups(t, tokens)
        assert (found is None) == (groups is None)
        if found:
            want = Counter((x << 32) | y for a, b in groups for x in a for y in b)
            got = Counter()
            for k, n in zip(found.key.tolist(), found.times.tolist()):
                got[k] += n
            assert got == want
    assert T.align("two words", T.np.array([3, 10]), tokens) is None  # a token goes across the given end


def test_texts_that_do_not_come_back_are_read_whole(spark, monkeypatch):
    """A block in which a joined call fails is done again text by text."""
    monkeypatch.setattr(T, "_ODD", T.re.compile("(?!)"))
    rows = list(enumerate(texts(9)))
    columns, *_ = T.block([t for _, t in rows], T.pair())
    assert columns["groups_sha256"] == [r[-1] for r in sorted(brute(rows), key=lambda r: r[0])]


def test_empty_table(spark):
    assert T.align_documents(spark.createDataFrame([], DOCS)).collect() == []
