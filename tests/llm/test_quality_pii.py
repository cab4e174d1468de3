"""Quality rules and personal data against brute force and on edge rows."""

import hashlib
import random
import re

import pytest

from curbside.llm import pii as P
from curbside.llm import quality_rules as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]


def brute_repeat_words(words):
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({k for starts in seen.values() if len(starts) > 1 for i in starts for k in range(i, i + 5)})


def test_counts_equal_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "ab ", "é#", "\n", "x\ty ", "\x85", "  ", "A|B "]) for _ in range(rng.randrange(0, 60)))
        t, words = Q.Text(text), re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (t.n_words, t.word_chars, t.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text))
        assert t.n_dup_lines == len(lines) - len(set(lines))
        assert t.n_repeat_words == brute_repeat_words(words)


def test_many_distinct_words_do_not_overflow():
    words = [f"w{i}" for i in range(9000)] * 2
    assert Q.Text(" ".join(words)).n_repeat_words == len(words)


def test_order_changes_time_not_verdict(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["good", "word", "###", "AAA", "77"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", "x" * 100_000]
    df = spark.createDataFrame(rows_of(texts) * 2, DOCS).withColumnRenamed("source", "n_words")  # a clashing extra column
    kept = sorted(r.doc_id for r in Q.apply_rules(df).collect() if r.kept)
    again = sorted(r.doc_id for r in Q.apply_rules(df, Q.RULES[::-1]).collect() if r.kept)
    assert kept == again and len(kept) % 2 == 0
    whole = spark.createDataFrame(rows_of(texts), DOCS)
    assert sorted(r.doc_id for r in Q.kept_documents(whole).collect()) == sorted(set(kept))
    assert Q.apply_rules(whole.limit(0)).count() == 0 and Q.kept_documents(whole.limit(0)).columns == whole.columns


def test_cascade_prefers_rejections_per_cost():
    stats = {"too_short": (1e-6, 0.0), "symbols": (1e-3, 0.9), "digits": (1e-5, 0.1)}
    rules = [r for r in Q.RULES if r.name in stats]
    assert [r.name for r in Q.cascade_order(stats, rules)] == ["digits", "symbols", "too_short"]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    digits = lambda s: [int(c) for c in s if c.isdigit()]
    luhn = lambda d: sum(d[-1::-2] + [x * 2 - 9 * (x > 4) for x in d[-2::-2]]) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(7)
    parts = ["a", "b.c", "@", "@x", ".", "d-e.fg", "1", "25", "300", "4111 1111 1111 1111", "4111111111111111", "+1 (499) 555-6503", "+", " ", "-", "(", ")", "é", "0.0", "10.1.2.3", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        assert P.detect(text) == brute_spans(text), text


def test_disguises_map_back_to_source_offsets():
    cases = {
        "write to jo.doe (at) mail [dot] example (dot) com now": ("email", "jo.doe (at) mail [dot] example (dot) com"),
        "call plus four nine five five five one two three four five six": ("phone", "plus four nine five five five one two three four five six"),
        "jоhn@exаmple.com!": ("email", "jоhn@exаmple.com"),
        "at １０.２.3.4 it is": ("ip", "１０.２.3.4"),
        "mail a​b@c.de": ("email", "a​b@c.de"),
        "mail jоhn@x.org": ("email", "jоhn@x.org"),
    }
    for text, (kind, part) in cases.items():
        base, spans = P.personal_data(text)
        at = text.index(part)
        assert (kind, at, at + len(part)) in spans, text
        assert all(s in spans for s in base)


def test_at_disguises_need_no_other_hint_and_any_number_of_pieces():
    for part in ("jane.doe at example.com", "a.b.c.d.e (at) x.org", "a dot b dot c dot d dot e dot f at x.org", "Dot at x dot org"):
        text = f"mail: {part}, please"
        assert P.personal_data(text)[1] == [("email", 6, 6 + len(part))], text
        assert P.masked(text) == "mail: [email], please"
    for extra in ("", " They met on a dot here."):
        assert P.personal_data(f"It arrived at 3.15 and sold at 2.5.{extra}")[1] == []
    for text in ("a dot " * 20_000, "a at " * 20_000, "a.b@" * 20_000, "a" * 50_000 + " at x.org"):
        P.personal_data(text)


def test_bare_at_signs():
    """Known endings, or a marked local part before two small letters; a space left out after a full stop is no address."""
    for part in ("jane at example.com", "jane @ example.com", "j.doe at firma.de", "ann7 @ x dot fr", "Max at Example.org"):
        assert P.personal_data(f"to {part}!")[1] == [("email", 3, 3 + len(part))], part
    for text in ("Look at this.It was good", "we met at noon.Then left", "look at this.it was", "3 @ 4.5 each", "sold at shop.Now open", "jane at example.de"):
        assert P.personal_data(text) == ([], []), text
        assert P.masked(text) == text


def test_clean_prose_has_no_spans():
    for text in ("We met at noon. One or two of them left, three stayed at home.", "Il y a sept ou huit maisons.", "See chapter 12.3 and 4, at point A."):
        assert P.personal_data(text) == ([], [])


def test_masking_and_edge_rows(spark):
    texts = [None, "", "mail a@b.de and 10.0.0.1", "9" * 50_000, "@" * 10_000, "a" * 100_000]
    df = spark.createDataFrame(rows_of(texts) * 2, DOCS)
    got = {r.doc_id: r for r in P.find_personal_data(df).collect()}
    assert got[2].spans == "email:5:11,ip:16:24" and got[2].n_email == got[2].n_ip == 1
    assert got[2].n_spans == 2 and got[0].n_spans == 0
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].spans == ""
    masked = {r.doc_id: r for r in P.mask_documents(df).collect()}
    assert masked[2].text == "mail [email] and [ip]" and masked[2].n_chars == len(masked[2].text)
    assert masked[0].text is None and masked[3].text == texts[3]
    assert P.mask_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a@b.c" * 3, "+1 2 3 4 5 6 7 8 9 0"])
def test_mask_leaves_no_base_span(text):
    assert P.detect(P.masked(text)) == []
