"""Token counts, quality, decontamination and PII."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from helixframe.llm import decontaminate, pii, quality, token_counts

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_token_counts(spark, docs_of):
    P = pytest.importorskip("public_tokenizers")
    import base64

    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    texts = [None, "", " ", "  a  b ", "<s> x </s> <|endoftext|>", "word " * 3000, "é ñ\n\n" * 500, "a" * 5000, "▁a ▁ b", "x " + "y" * 3000 + " z " * 1500]
    sp = sentencepiece.SentencePieceProcessor(model_file=str(P.path("piece_bpe_32k.model")))
    js = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for name, own, pattern in (("piece_bpe_32k.model", lambda t: len(sp.encode(t)), None),
                               ("byte_bpe_50k.json", lambda t: len(js.encode(t, add_special_tokens=False).ids), None),
                               ("byte_bpe_50k.tiktoken", lambda t: len(tk.encode_ordinary(t)), P.PATTERN)):
        got = token_counts.count_tokens(docs_of(list(enumerate(texts)) + [(3, texts[3]), (None, "a")]), str(P.path(name)), pattern=pattern, batch_bytes=4000, segment=200)
        want = [(i, len((t or "").encode()), own(t or "")) for i, t in [*enumerate(texts), (3, texts[3]), (None, "a")]]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), name


def test_quality(spark, docs_of, rng):
    words = ["thon", "ander", "of", "the", "ion", "wher", "estin"]
    rows, labels = [], []
    for i in range(600):
        n = rng.randint(20, 200)
        good = rng.random() < .8
        t = " ".join(rng.choice(words) + ("" if good else rng.choice(["$$$", "&&&", "###"])) for _ in range(n))
        rows.append((i, t))
        labels.append((i, int(good), 0))
    rows += [(1000, None), (1001, ""), (None, "the of"), (1002, rows[0][1]), (1002, rows[0][1]), (1003, "of " * 100_000)]
    lab = spark.createDataFrame(labels + [(2000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    got = {(r["doc_id"], r["score"]): r for r in quality.classify(docs, lab).collect()}
    assert len(quality.classify(docs, lab).collect()) == len(rows)
    truth = dict((a, b) for a, b, _ in labels)
    for (d, s), r in got.items():
        assert 0 <= s <= 1 and r["predicted"] == int(s >= .3)
        assert r["held_out"] == (d is None or zlib.crc32(str(d).encode()) % 5 == 0)
        if d in truth and r["held_out"]:
            assert r["predicted"] == truth[d]
    nothing = quality.classify(docs, lab.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}
    assert quality.classify(docs.limit(0), lab).collect() == []


def test_statistics_do_not_depend_on_the_batch(rng):
    import pyarrow as pa
    texts = [None, "", "a a b\nb b\n\na a b", "!! X | Y", "é" * 50, "one\ntwo\none\ntwo"]
    whole = quality.statistics(pa.array(texts))
    assert np.array_equal(whole, np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts]))


def brute_contained(docs, items, share=.8):
    def words(t):
        return [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]

    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            x = words(it)
            k = min(5, len(x))
            if d is None or i is None or not k:
                continue
            own = {tuple(x[j:j + k]) for j in range(len(x) - k + 1)}
            both = own & {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
            if len(both) >= share * len(own):
                key = (len(both) / len(own), len(own), len(both))
                out[d, i] = max(out.get((d, i), key), key)
    return sorted((d, i, v[1], v[2], v[0]) for (d, i), v in out.items())


def test_decontaminate(spark, docs_of, rng, monkeypatch):
    words = [f"w{i}é" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 60)))) for i in range(30)]
    items += [(100, "w1é w2é w3é"), (101, "w5é"), (102, None), (103, " !? "), (None, "w1é w2é"), (104, items[3][1]), (3, items[3][1]), (3, items[4][1])]
    docs = []
    for d in range(120):
        t = [rng.choice(words) for _ in range(rng.randint(0, 80))]
        if rng.random() < .5:
            own = rng.choice(items[:30])[1].split()
            if rng.random() < .5:
                own[rng.randrange(len(own))] = "odd"
            t[rng.randint(0, len(t)):0] = own
        docs.append((d, ", ".join(t).upper() if rng.random() < .3 else " ".join(t)))
    docs += [(900, None), (901, ""), (902, docs[0][1] + " " + items[2][1]), (902, docs[0][1]), (None, items[1][1]), (903, "w1é " * 60_000 + items[5][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    want = brute_contained(docs, items)
    got = lambda: sorted(map(tuple, decontaminate.find_items(docs_of(docs), bench).collect()))
    assert got() == want
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 10)
    assert got() == want
    assert decontaminate.find_items(docs_of(docs).limit(0), bench).collect() == []
    assert decontaminate.find_items(docs_of(docs), bench.limit(0)).collect() == []


def brute_base(t):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_pii_base(rng):
    parts = ["a@b.c", "@", "a.b", ".", "x@y", "1.2.3.4", "300.1.1.1", "4539 1488 0343 6467", "1234", "-", " ", "+", "+1 (743) 555-3824", "é", "9", "a@b.c@d.e", "001.2.3.4.5"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert pii.base_spans(t) == brute_base(t), t
    for long in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000, "one " * 50_000, "at dot " * 50_000, "[at](" * 50_000):
        pii.all_spans(long)


@pytest.mark.parametrize("text,kind,part", [
    ("write john [at] example (dot) com now", "email", "john [at] example (dot) com"),
    ("mail john.doe at example dot com ok", "email", "john.doe at example dot com"),
    ("x аdmin@exаmple.com y", "email", "аdmin@exаmple.com"),
    ("card 4５３９ 1488 0343 6467 x", "card", "4５３９ 1488 0343 6467"),
    ("call plus one five five five one two three four five six seven", "phone", "plus one five five five one two three four five six seven"),
    ("host one nine two dot one six eight dot one dot two up", "ip", "one nine two dot one six eight dot one dot two"),
])
def test_pii_added(text, kind, part):
    assert [(k, text[a:b]) for k, a, b, base in pii.all_spans(text) if not base] == [(kind, part)]
    assert pii.redacted(text) == text.replace(part, f"[{kind.upper()}]")


@pytest.mark.parametrize("text,kind,part,fragment", [
    ("to jоhn@example.com now", "email", "jоhn@example.com", "hn@example.com"),
    ("to john dot smith@example.com now", "email", "john dot smith@example.com", "smith@example.com"),
    ("to user@mail.example dot com now", "email", "user@mail.example dot com", "user@mail.example"),
    ("to user@example.cоm now", "email", "user@example.cоm", "user@example.c"),
    ("to jоhn@example.cоm now", "email", "jоhn@example.cоm", "hn@example.c"),
    ("at 10.20.30.4４ up", "ip", "10.20.30.4４", "10.20.30.4"),
    ("call +1 743 555 382４ now", "phone", "+1 743 555 382４", "+1 743 555 382"),
])
def test_pii_added_beside_a_fragment(text, kind, part, fragment):
    assert [(k, text[a:b], base) for k, a, b, base in sorted(pii.all_spans(text), key=lambda s: s[3])] == [(kind, part, False), (kind, fragment, True)]
    assert pii.redacted(text) == text.replace(part, f"[{kind.upper()}]")


def test_pii_adds_nothing_inside_a_base_span():
    text = "Привет, a.b@c.de, 1.2.3.4, +1 743 555 3824"
    assert all(base for *_, base in pii.all_spans(text)) and len(pii.all_spans(text)) == 3


def test_pii_leaves_clean_texts_alone():
    for t in ("look at the dot there", "one two three", "I was at home (at last) on top", "two at one dot", "Привет, мир", "", "[at]"):
        assert pii.all_spans(t) == [] and pii.redacted(t) == t


def test_pii_frame(spark, docs_of):
    rows = [(1, "a@b.c and 1.2.3.4 john [at] x [dot] org"), (1, "a@b.c and 1.2.3.4 john [at] x [dot] org"), (2, None), (3, ""), (None, "q@w.e"), (4, "w " * 100_000)]
    got = {r["doc_id"]: r for r in pii.digest(pii.find_spans(docs_of(rows))).collect()}
    assert got[1]["n_email"] == 1 and got[1]["n_ip"] == 1 and got[1]["n_added"] == 1
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:0:5,ip:10:17").hexdigest()
    assert got[1]["spans"] == "email:0:5,email:18:39,ip:10:17"
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[None]["n_email"] == 1
    clean = pii.redact(docs_of(rows))
    assert clean.columns == docs_of(rows).columns
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {1: "[EMAIL] and [IP] [EMAIL]", 2: None, 3: "", None: "[EMAIL]", 4: "w " * 100_000}
