"""Alignments of two tokenizers against a token-by-token version."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import align

P = pytest.importorskip("public_tokenizers")
A, B = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))


def naive(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, hash) and groups of each text, from whole encodings."""
    import sentencepiece
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(A)
    tk.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    table = align.byte_table()
    docs = []
    for t in texts:
        ids_a = tk.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = sp.encode(t) if t else []
        raw_a = [bytes(table[c] for c in tk.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            docs.append(([], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for c in cuts:
            x, y = i, j
            while i < len(ends_a) and ends_a[i] <= c:
                i += 1
            while j < len(ends_b) and ends_b[j] <= c:
                j += 1
            groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
        links, j = [], 0
        for i, e in enumerate(ends_a):
            s = ends_a[i - 1] if i else 0
            while ends_b[j] <= s:
                j += 1
            k = j
            while k < len(ends_b) and (ends_b[k - 1] if k else 0) < e:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        docs.append((ids_a, ids_b, links, ";".join(groups)))
    count = Counter(p for _, _, links, _ in docs for p in set(links))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    return [(len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "", g) for a, b, links, g in docs], count, top


def test_align(spark, docs_of, rng):
    words = ["thon", "ander", "of", "1234567", "naïve", "漢字", "🙂", "<s>", "<|endoftext|>", "it's", "a-b_c", "HELLO", "x=1;", "ſ", "é"]
    texts = [None, "", " ", "a", "a b", "a b", "  two  spaces  ", "▁mark", "tab\tand\nline\r\n", " wide　", "\x00\x01", "ﬁne ① ½", "﻿x", "a" * 3000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += ["".join(rng.choice("ab Z'1 \n\t.,é漢🙂-_%") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(20_000))]
    rows = list(enumerate(texts)) + [(3, texts[20]), (None, texts[21]), (None, texts[21])]
    want, count, top = naive([t for _, t in rows])
    for chunk, piece in ((align.CHUNK, align.PIECE), (2000, 300)):
        docs, pairs = align.align(docs_of(rows), A, B, keep_groups=True, chunk=chunk, piece=piece)
        got = [tuple(r) for r in docs.select("doc_id", *align.NUMBERS, "n_best", "count_sum", "groups_sha256", "groups").collect()]
        assert sorted(got, key=str) == sorted(((d, *w) for (d, _), w in zip(rows, want, strict=True)), key=str)
        assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {p: (n, int(n == top[p[0]])) for p, n in count.items()}
    empty, _ = align.align(docs_of(rows).limit(0), A, B)
    assert empty.collect() == [] and "groups" not in empty.columns


def test_shared_cuts_without_any(rng):
    for _ in range(200):
        n = rng.randint(2, 400)
        a = np.array([0, *sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n])
        b = np.array([0, *sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n])
        x, y = align.shared_cuts(a, b, np.array([0, len(a) - 1]), np.array([0, len(b) - 1]))
        assert a[x].tolist() == b[y].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    even, odd = np.append(np.arange(0, 20_000, 2), 20_001), np.append(np.append(0, np.arange(1, 20_000, 2)), 20_001)
    x, y = align.shared_cuts(even, odd, np.array([0, len(even) - 1]), np.array([0, len(odd) - 1]))
    assert even[x].tolist() == odd[y].tolist() == [0, 20_001]
