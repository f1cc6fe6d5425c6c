"""Cross-tokenizer alignment, the divergence of sources, and repeated passages, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import alignment, divergence, relative_lz
from shelfwatch.llm.transducer import Transducer

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def byte_table():
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {chr(b if b in visible else next(hidden)): b for b in range(256)}


@pytest.fixture(scope="module")
def naive_tokens():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, letters = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_table()
    a.encode_special_tokens = True

    def tokens(text):
        if not text:
            return [], []
        x = a.encode(" " + text, add_special_tokens=False)
        x = [(i, bytes(letters[c] for c in t)) for i, t in zip(x.ids, x.tokens, strict=True)]
        y = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in y]
        whole = (" " + text).encode()
        return (x, y) if all(b"".join(t for _, t in s) == whole for s in (x, y)) else ([], [])

    return tokens


def naive_alignment(tokens):
    ends = [np.cumsum([len(t) for _, t in s]).tolist() for s in tokens]
    links = [(i, j) for (i, _), e in zip(tokens[0], ends[0]) for (j, _), f in zip(tokens[1], ends[1]) if e == f]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    groups, last = [], 0
    for cut in cuts:
        part = [",".join(str(i) for (i, _), e in zip(s, ends_) if last < e <= cut) for s, ends_ in zip(tokens, ends)]
        groups.append("|".join(part))
        last = cut
    return links, groups


TEXTS = [
    "a ▁b", " x", "tab\tand\n\nlines  two", "𝔘𝔫𝔦 ﬁ ｆ", "it's <|endoftext|> <s> <0x41> here", "é" * 40, " ", "  x  ",
    "naïve café, 日本語 text", "1234567 89", "\x00\x01",
]


def test_alignment(spark, docs, no_docs, naive_tokens):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    frame = docs.filter("doc_id is null or doc_id <> 9").select("doc_id", "text").union(more)
    aligned = alignment.align(frame, A, B).persist()
    counts = alignment.link_counts(aligned)
    rows = alignment.score_links(aligned, counts).collect()
    naive = {r.text: naive_alignment(naive_tokens(r.text)) for r in rows}
    pairs = Counter(x for r in rows for x in naive[r.text][0])
    best = defaultdict(int)
    for (_, j), n in pairs.items():
        best[j] = max(best[j], n)
    assert {((r.a_id, r.b_id)): r.n for r in counts.collect()} == pairs
    for r in rows:
        a, b = naive_tokens(r.text)
        links, groups = naive[r.text]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (len(a), len(b), len(groups), len(links), ";".join(groups))
        assert r.n_best == sum(pairs[x] == best[x[1]] for x in links) and r.count_sum == sum(pairs[x] for x in links)
    assert any(r.text and not r.n_a for r in rows) and len(rows) == frame.count()
    whole = alignment.align(docs.withColumn("links", F.lit(1)), A, B)
    assert whole.columns == [*docs.columns, *alignment.RESULTS] and whole.count() == docs.count()
    empty = alignment.align(no_docs, A, B)
    assert alignment.score_links(empty, alignment.link_counts(empty)).count() == 0


def test_long_chains_converge():
    """Tokens that overlap over the whole text are one group; equal cuts are groups of their own."""
    n = 1000
    a, b = alignment.terminals(np.append(np.arange(2, n, 2), n), np.append(np.arange(1, n, 2), n))
    assert set(a) == set(b) == {len(b) - 1}
    a, b = alignment.terminals(np.arange(1, n + 1), np.arange(1, n + 1))
    assert (a == np.arange(n)).all() and (b == a).all()


def test_transducer():
    pick = np.random.default_rng(3)
    words = sorted({bytes(pick.integers(97, 101, pick.integers(1, 9)).tolist()) for _ in range(2000)} | {"größe".encode(), b"a"})
    made = Transducer.loads(Transducer.of(words).dumps())
    assert len(made.final) < len({w[:i] for w in words for i in range(len(w) + 1)}) / 2
    asked = [*words, b"", b"zzz", b"abcdabcdabcd", "größ".encode(), b"x" * 1000]
    data = np.frombuffer(b" ".join(asked), np.uint8)
    stop = np.cumsum([len(w) + 1 for w in asked]) - 1
    found = made.ordinals(data, stop - [len(w) for w in asked], stop)
    assert found.tolist() == [*range(len(words)), -1, -1, -1, -1, -1]
    with pytest.raises(ValueError):
        Transducer.of([b"b", b"a"])
    assert Transducer.of([]).ordinals(data, stop[:3] - 1, stop[:3]).tolist() == [-1] * 3


def naive_audit(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    rows = [(lang or "", source or "", term.findall((text or "").translate(low))) for lang, source, text in rows]
    df, used = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in rows:
        df[lang].update(set(terms))
        used[lang, source].update(terms)
    out = []
    kept = {lang: sorted((t for t, n in c.items() if n >= min_docs), key=str.encode) for lang, c in df.items()}

    def shares(lang, counts):
        total = sum(counts[t] for t in kept[lang]) + 5 * len(kept[lang])
        return [1 + 10**9 * (counts[t] + 5) // total for t in kept[lang]]

    for (lang, source), counts in used.items():
        p, q = shares(lang, counts), shares(lang, sum((c for (x, _), c in used.items() if x == lang), Counter()))
        pairs = [
            (-sum(abs(x - y) for x, y in zip(p, shares(lang, other), strict=True)), s.encode())
            for (x, s), other in used.items() if x == lang and s != source
        ]
        terms = [(y - x, t.encode()) for x, y, t in zip(p, q, kept[lang], strict=True) if counts[t] and x > y]
        for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("shard_terms", [1 << 15, 3])
def test_divergence(spark, docs, no_docs, shard_terms):
    pick = np.random.default_rng(8)
    words = "der die das Und ÄPFEL äpfel prefix12a prefix12b prefix1234a prefix1234b prefix1234 zu x-y No1Two ünïcode ünïcod the".split()
    rows = [
        (pick.choice(["de", "en", None]), pick.choice(["a", "b", "Ä", None]), " ".join(pick.choice(words, pick.integers(0, 30))))
        for _ in range(150)
    ]
    rows = [tuple(None if x is None else str(x) for x in r) for r in rows] + [("fr", "a", None), ("fr", "b", "seul"), ("xx", "q", "")]
    rows += [(r.lang, r.source, r.text) for r in docs.collect()]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("rank", F.lit("x")).repartition(4)
    found = divergence.audit(frame, min_docs=6, top=5, shard_terms=shard_terms).collect()
    assert sorted(tuple(r) for r in found) == naive_audit(rows, 6, 5)
    assert divergence.audit(no_docs).count() == 0


def naive_removal(rows):
    first, out = {}, []
    split = [(LAST if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, words in split:
        for at in range(len(words) - 49):
            w = tuple(words[at : at + 50])
            first[w] = min(first.get(w, i), i)
    for i, words in split:
        gone = np.zeros(len(words), bool)
        for at in range(len(words) - 49):
            if first[tuple(words[at : at + 50])] < i:
                gone[at : at + 50] = True
        out.append((i, len(words), int(gone.sum()), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return sorted(out)


LAST = np.iinfo(np.int64).max


def passages():
    """Texts that share runs of words of every length around the window, some of few different words."""
    pick = np.random.default_rng(13)
    base = [[f"w{k}" for k in pick.integers(0, 400, 400)] for _ in range(5)] + [[f"r{k}" for k in pick.integers(0, 2, 300)]]
    texts = []
    for i in range(120):
        words = []
        for _ in range(pick.integers(1, 5)):
            run, at = base[pick.integers(0, 6)], int(pick.integers(0, 250))
            words += run[at : at + int(pick.integers(20, 110))] + [f"own{i}"] * int(pick.integers(0, 4))
        texts.append(pick.choice([" ", "\n", " \t"]).join(words))
    lines = [" ".join([*(f"x{i}-{k}" for k in range(30)), *base[0][:40], *(f"y{i}-{k}" for k in range(30))]) for i in range(40)]
    return texts + lines + ["a " * 49, "a " * 50, "a " * 120, "é " * 60, "a " * 50]


@pytest.mark.parametrize("portion_bytes, crowd", [(1 << 20, 256), (3000, 256), (3000, 2)])
def test_repeated_passages(spark, docs, no_docs, portion_bytes, crowd):
    rows = [(i * 37 % 181, t) for i, t in enumerate(passages())]
    rows += [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id != 9]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = relative_lz.remove_repeats(frame, portion_bytes=portion_bytes, crowd=crowd).collect()
    got = sorted((LAST if r.doc_id is None else r.doc_id, r.n_words, sum(s.length for s in r.spans), r.kept) for r in found)
    assert got == naive_removal(rows) and any(n for _, _, n, _ in got)
    assert all(a.start + a.length < b.start for r in found for a, b in zip(r.spans, r.spans[1:]))


def test_repeated_passages_of_edge_rows(docs, no_docs):
    out = relative_lz.remove_repeats(docs)
    assert out.columns == [c for c in docs.columns if c != "kept"] + ["n_words", "kept", "spans"]
    assert out.count() == docs.count() and relative_lz.remove_repeats(no_docs).count() == 0
    digests = {hashlib.sha256(r.kept.encode()).hexdigest() for r in out.filter("doc_id = 9").collect()}
    text = docs.filter("doc_id = 9").first().text
    assert digests == {hashlib.sha256(text.encode()).hexdigest()}
