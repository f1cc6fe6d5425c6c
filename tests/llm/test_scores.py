"""Context trees, quality ranking and source mixing."""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfwatch.llm import context_tree, mixing, quality
from shelfwatch.llm.packed import pack_counts, pack_sorted, unpack_counts, unpack_sorted
from shelfwatch.session import cut_lineage

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def test_packed_numbers():
    for values in ([], [5], [0, 1, 2**63, 2**64 - 1], list(range(0, 10**6, 997))):
        values = np.array(values, np.uint64)
        assert (unpack_sorted(pack_sorted(values)) == values).all()
    counts = np.array([0, 1, 255, 256, 2**31])
    assert (unpack_counts(pack_counts(counts)) == counts).all()


def naive_scores(learn, texts, depth):
    """The definition, node by node."""
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def bits(text):
        data = b"\xff" * depth + text.lower() + b"\xff"
        for i in range(depth, len(data)):
            for k in range(8):
                node, bit = (1 << k) | data[i] >> (8 - k), data[i] >> (7 - k) & 1
                yield node, bit, [data[i - d : i] for d in range(depth + 1)]

    for text in learn:
        for node, bit, contexts in bits(text):
            for d, c in enumerate(contexts):
                counts[node, c][bit] += 1
                if d:
                    children[node, contexts[d - 1]].add(c)
    lg, memo = math.lgamma, {}

    def estimate(key):
        a, b = counts[key]
        return lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)

    def weighted(node, c):
        if (node, c) not in memo:
            own = estimate((node, c))
            if len(c) < depth:
                own = math.log(0.5) + np.logaddexp(own, sum(weighted(node, x) for x in children[node, c]))
            memo[node, c] = own
        return memo[node, c]

    out = []
    for text in texts:
        total = 0.0
        for node, bit, contexts in bits(text):
            q = None
            for c in reversed(contexts):
                a, b = counts[node, c] if (node, c) in counts else (0, 0)
                p = ((b if bit else a) + 0.5) / (a + b + 1)
                if q is None or not seen:
                    q = p
                else:
                    share = 0.5 * math.exp(estimate((node, c)) - weighted(node, c)) if a + b else 0.5
                    q = share * p + (1 - share) * q
                seen = a + b > 0
            total += math.log10(q)
        out.append(total)
    return out


def test_context_trees(spark, docs, no_docs):
    rows = docs.filter("doc_id is null or doc_id <> 9").select("doc_id", "text", "size")
    found = context_tree.score_texts(rows, depth=2, folds=3, block_bytes=200).collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in rows.collect()]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 3 == 0 for d, _ in texts}
    assert any(held.values()) and len(found) == len(texts)
    learn = [t for d, t in texts if not held[d]]
    scores = defaultdict(list)
    for (d, t), s in zip(texts, naive_scores(learn, [t for _, t in texts], 2), strict=True):
        scores[d].append((s, t))
    words = Counter(w for t in learn for w in [*t.lower().split(), b""])
    total = sum(words.values())
    for r in found:
        s, t = scores[r.doc_id][0]
        tokens = [*t.lower().split(), b""]
        assert abs(r.score - s) < 1e-3
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(tokens), total)
        assert r.n_known == sum(words[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.1) / (total + 0.1 * (len(words) + 1))) for w in tokens))
    assert context_tree.score_texts(no_docs).count() == 0
    alone = context_tree.score_texts(docs.filter("doc_id = 11"), folds=1).first()
    assert alone.held_out and alone.train_tokens == 0 and alone.score == pytest.approx(4 * 8 * math.log10(0.5), abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_quality_held_out(spark):
    sf_dir = SF_DIR.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    featured = cut_lineage(quality.with_features(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "features"))
    rows = quality.classify(featured, quality.learn(featured, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all((r.predicted == 1) == (r.score >= 0.5) for r in rows)


def test_quality_edges(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, none).columns == docs.columns
    assert quality.keep_good(docs, none).count() == docs.count()
    labels = spark.createDataFrame([(4, 1), (5, 1), (5, None), (7, 1), (9, 0), (10, 0), (2, 0)], none.schema)
    rows = quality.with_features(docs)
    model = quality.learn(rows, labels)
    scores = quality.classify(rows, model).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality.keep_good(no_docs, labels).count() == 0
    assert not [r for r in scores if r.doc_id is None and r.held_out]


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, total, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped)
        out = {s: 3 * sizes[s] if s in capped else left * weights[s] / free for s in names}
        over = {s for s in names if s not in capped and out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mixing(spark, docs, no_docs):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").split())
    expected, taken = targets(sizes), Counter()
    for r in rows:
        assert r.target == pytest.approx(expected[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert len(rows) == docs.count() and sum(taken.values()) == sum(sizes.values())
    assert all(abs(taken[s] - t) <= len(sizes) for s, t in expected.items())
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, rows))
    assert mixing.mix(no_docs).count() == 0
    blank = mixing.mix(docs.filter("doc_id < 4")).collect()
    assert [r.taken for r in blank] == [0, 0, 0]


def test_mixed_documents(docs, no_docs):
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got, texts = Counter(), {r.text for r in docs.collect()}
    for r in out.collect():
        got[r.source] += len(r.text.split())
        assert any(t is not None and t.startswith(r.text) for t in texts) and r.n_chars == len(r.text) and r["rest"] == "rest"
    assert {s: n for s, n in want.items() if n} == dict(got)
    assert mixing.mixed_documents(no_docs).count() == 0
