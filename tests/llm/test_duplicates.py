"""Repeated strings, close fingerprints, close vectors, and the pipeline."""

import os

import numpy as np
import pytest
import xxhash

from shelfwatch.llm import lattice, simhash, suffix_dedup
from shelfwatch.llm.components import components, spanning_links

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def roots_of(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    pick = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in pick.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    expected = roots_of(500, pairs)
    found = {r.node: r.root for r in components(spark.createDataFrame([*pairs, *pairs, (None, 3)], "a long, b long")).collect()}
    assert found == {i: expected[i] for p in pairs if p[0] != p[1] for i in p}
    a, b = np.array(pairs).T
    nodes, roots = spanning_links(a, b)
    assert roots_of(500, zip(nodes.tolist(), roots.tolist(), strict=True)) == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("at_once", [0, 1 << 19])
def test_components_settle_few_links_at_once(spark, at_once):
    """Every job leaves something in the driver: links that one task can hold are not settled in rounds."""
    pairs = [(i, i + 1) for i in range(64) if i % 16] + [(-5, 3), (-5, -9), (100, 200)]
    links = spark.createDataFrame(pairs, "a long, b long")
    spark.sparkContext.setJobGroup(f"components-{at_once}", "components")
    found = {r.node: r.root for r in components(links, at_once=at_once).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{at_once}"))
    spark.sparkContext.setJobGroup("", "")
    shift = roots_of(300, [(a + 9, b + 9) for a, b in pairs])
    assert found == {i: shift[i + 9] - 9 for p in pairs for i in p}
    assert at_once == 0 or jobs <= 8


def removed_bytes(rows):
    """Brute force: which bytes of each (id, text) go."""
    first = {}
    for i, text in rows:
        for at in range(len(text) - 49):
            w = text[at : at + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - 49):
            if first[text[at : at + 50]] < i:
                gone[at : at + 50] = True
        out.append(gone)
    return out


def hard_texts():
    pick = np.random.default_rng(5)
    base = [bytes(pick.integers(97, 100, 300).tolist()).decode() for _ in range(8)]
    texts = []
    for i in range(60):
        cut = sorted(pick.integers(0, 300, 4).tolist())
        texts.append(base[i % 8][cut[0] : cut[2]] + "é" * (i % 3) + base[(i * 3) % 8][cut[1] : cut[3]] + "z" * (i % 70))
    return texts + ["ab" * 200, "ab" * 150, "", "short", "q" * 49, "q" * 50, "q" * 51]


def test_equal_rows_by_digits():
    pick = np.random.default_rng(3)
    for width in (1, 8, 50):
        rows = pick.integers(0, 2, (400, width)).astype(np.uint8)
        rows[200:300] = rows[:100]
        rows[300:, : width - 1] = rows[:100, : width - 1]  # differ, if at all, in the last byte
        live, group = suffix_dedup.equal_rows(rows)
        texts = [r.tobytes() for r in rows]
        assert sorted(live) == [i for i, t in enumerate(texts) if texts.count(t) > 1]
        assert len({(texts[i], g) for i, g in zip(live, group)}) == len(set(group)) == len({texts[i] for i in live})
    assert not len(suffix_dedup.equal_rows(np.zeros((0, 50), np.uint8))[0])


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_repeated_strings(spark, docs, no_docs, block_bytes):
    rows = [(i * 37 % 101, t) for i, t in enumerate(hard_texts())]
    rows += [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id != 9]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.remove_repeats(frame, block_bytes=block_bytes).collect()
    plain = [(1 << 62 if i is None else i, (t or "").encode()) for i, t in rows]
    expected = sorted((i, t, t and np.frombuffer(t, np.uint8)[~g].tobytes()) for (i, t), g in zip(plain, removed_bytes(plain), strict=True))
    got = sorted((1 << 62 if r.doc_id is None else r.doc_id, (r.text or "").encode(), r.kept) for r in found)
    assert got == expected
    for r in found:
        gone = sum(s.length for s in r.spans)
        assert len((r.text or "").encode()) - gone == len(r.kept)
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))
    whole = suffix_dedup.remove_repeats(frame, whole_characters=True, block_bytes=block_bytes).collect()
    assert all(r.kept.decode() is not None for r in whole)
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == [c for c in docs.columns if c != "kept"] + ["kept", "spans"] and out.count() == docs.count()
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def naive_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_groups(docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [naive_print(r.text) for r in rows if r.doc_id != 9]
    rows = [r for r in rows if r.doc_id != 9]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    roots = roots_of(len(rows), pairs)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r.doc_id is not None:
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    expected = sorted((str(r.doc_id), f"{p:016x}", str(least.get(root))) for r, p, root in zip(rows, prints, roots, strict=True))
    found = simhash.near_duplicates(docs.filter("doc_id is null or doc_id <> 9")).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected
    assert simhash.near_duplicates(no_docs).count() == 0


def test_close_links_are_exact(spark):
    pick = np.random.default_rng(3)
    centres = pick.integers(-(2**63), 2**63, 40)
    prints = set(map(int, pick.integers(-(2**63), 2**63, 1500)))
    for c in centres:
        for _ in range(40):
            flips = pick.choice(64, pick.integers(0, 9), replace=False)
            mask = sum(1 << int(b) for b in flips)
            prints.add(int(np.uint64((int(c) ^ mask) & (2**64 - 1)).astype(np.int64)))
    prints = sorted(prints)
    points = np.array(prints, np.int64).view(np.uint64)
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    expected = roots_of(len(prints), zip(*(x.tolist() for x in np.nonzero(close)), strict=True))
    frame = spark.createDataFrame([(p, p) for p in prints], "id long, print long")
    at = {p: i for i, p in enumerate(prints)}
    links = [(at[r.a], at[r.b]) for r in simhash.close_links(frame).collect()]
    assert roots_of(len(prints), links) == expected
    home = np.ones(len(points), bool)
    a, b = simhash.shell_links(points, home, None, 0)
    assert roots_of(len(prints), zip(a.tolist(), b.tolist(), strict=True)) == expected


def test_one_of_each_stays(spark, docs, no_docs):
    words = [f"word{i}" for i in range(300)]
    near = words.copy()
    near[150] = "other"
    far = [w if i % 5 else w + "x" for i, w in enumerate(words)]
    texts = [(20, " ".join(near)), (21, " ".join(words)), (22, " ".join(words)), (23, " ".join(far))]
    frame = docs.unionByName(spark.createDataFrame(texts, "doc_id long, text string"), allowMissingColumns=True)
    out = simhash.keep_one_of_each(frame)
    assert out.columns == frame.columns
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == sorted("1 4 6 7 9 10 11 20 23 None".split())
    assert simhash.keep_one_of_each(no_docs).count() == 0


def five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = five_words(a), five_words(b)
    return len(a & b) / len(a | b)


def edited_copies():
    """Originals with appended, prefixed, truncated and short near copies, all at a similarity of 0.8 at least."""
    rows, pick = [], np.random.default_rng(12)
    for i in range(150):
        n = (20, 60, 200)[i % 3]
        words = [f"v{x}" for x in pick.integers(0, 10**6, n)]
        new = [f"n{x}" for x in pick.integers(0, 10**6, n)]
        run = (n - 4) // 4
        for k, copy in enumerate([words + new[:run], new[:run] + words, words[: n - (n - 4) // 5], [*words[:-1], new[0]]]):
            own = [f"{w}.{k}" for w in words]
            copy = [w if w in new else f"{w}.{k}" for w in copy]
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(copy))]
    return rows


def test_edited_copies_are_found(spark):
    rows = edited_copies()
    similar = [jaccard(a[1], b[1]) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert min(similar) >= 0.8 and np.median(similar) < 0.9
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in simhash.keep_one_of_each(frame).collect()}
    assert found == {i for i, _ in rows[::2]}


def mixed_copies():
    """Short chains, sets of 4 to 40 words around the least similarity, repeated words, and a template's pages."""
    rows, pick = [], np.random.default_rng(13)
    for i in range(120):
        words = [f"u{i}.{x}" for x in range(pick.integers(4, 40))]
        for k in range(4):
            text = " ".join(words)
            rows.append((len(rows), text if k % 2 else f" {text.upper()}  "))
            words[pick.integers(0, len(words)) if k % 2 else -1] = f"x{i}.{k}"
            words = words + [f"y{i}.{k}"] * int(pick.integers(0, 3))
    rows += [(len(rows) + i, f"e{i % 3} a a a a a a b") for i in range(9)]
    head = [f"t{x}" for x in range(40)]
    return rows + [(len(rows) + i, " ".join(head + [f"own{i}.{x}" for x in range(i % 14)])) for i in range(150)]


def expected_of(rows):
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    return {rows[i][0] for i in set(roots_of(len(rows), pairs))}


@pytest.mark.parametrize("block", [256, 3])
def test_copies_are_counted_exactly(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rows = mixed_copies()
    found = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in found) == sorted(expected_of(rows))


def test_pages_of_a_template_are_not_all_compared(spark, monkeypatch):
    compared, similar_pairs = [], simhash.similar_pairs

    def counted(pairs, *others):
        compared.append(pairs.count())
        return similar_pairs(pairs, *others)

    monkeypatch.setattr(simhash, "similar_pairs", counted)
    head = [f"t{x}" for x in range(200)]
    rows = [(i, " ".join([*head[: i % 200], f"own{i}", *head[i % 200 :]])) for i in range(400)]
    found = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in found] == [0]
    assert 0 < sum(compared) < 400 * 20


def test_copy_tree_finds_all_pairs():
    pick = np.random.default_rng(11)
    for spread in (2, 12, 24):
        hubs = pick.integers(0, 2, (5, 512), dtype=np.uint8)
        sets = hubs[pick.integers(0, 5, 700)] ^ (pick.random((700, 512)) < spread / 512)
        bits = np.packbits(sets.astype(np.uint8), axis=1, bitorder="little").view("<u8")
        label, size = pick.integers(0, 90, 700), pick.integers(60, 240, 700)
        tree = simhash.CopyTree(label, size, bits, 4, 5)
        tree.inside(np.arange(400))
        tree.across(np.arange(400), np.arange(400, 700))
        tree.inside(np.arange(400, 700))
        x, y = np.triu_indices(700, 1)
        apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1)
        size_x, size_y = size[x], size[y]
        keep = (label[x] != label[y]) & (np.minimum(size_x, size_y) * 5 >= np.maximum(size_x, size_y) * 4)
        keep &= apart * 9 <= size_x + size_y
        expected = set(zip(x[keep].tolist(), y[keep].tolist(), strict=True))
        found = [(min(a, b), max(a, b)) for found in tree.found for a, b in zip(found[0].tolist(), found[1].tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == expected and expected


def test_lattice_decoding():
    y = np.random.default_rng(4).standard_normal((200, 8)) * 2
    point = lattice.nearest_point(y)
    doubled = np.rint(2 * point).astype(int)
    assert ((doubled % 2).min(axis=1) == (doubled % 2).max(axis=1)).all() and (doubled.sum(axis=1) % 4 == 0).all()
    distance = ((y - point) ** 2).sum(axis=1)
    around = ((y[:, None] - point[:, None] - lattice.ROOTS[None]) ** 2).sum(axis=2).min(axis=1)
    assert (distance <= around + 1e-9).all() and distance.max() <= 1 + 1e-9


@pytest.mark.parametrize("block", [1024, 3])
def test_vector_groups(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    pick = np.random.default_rng(6)
    rows = []
    for c in pick.standard_normal((60, 32)):
        for _ in range(6):
            rows.append((len(rows), (c + pick.standard_normal(32) * pick.uniform(0, 0.2)).tolist(), int(pick.integers(0, 2))))
    rows += [(1000, rows[0][1], rows[0][2]), (1001, [2 * v for v in rows[0][1]], rows[0][2]), (1002, rows[0][1], None)]
    rows += [(1003, None, 0), (1004, [0.0] * 32, 0), (1005, [float("nan")] * 32, 0), (1006, [None] * 32, 0), (1007, [], 0)]
    rows += [(1008, [float("inf")] + [1.0] * 31, 0), (1009, [1.0, 2.0], 0), (1010, [2.0, 4.0], 0), (1010, [2.0, 4.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    good = [i for i, (_, x, l) in enumerate(rows) if x and l is not None and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    pairs = []
    for i in good:
        for j in good:
            a, b = rows[i], rows[j]
            if j < i and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    pairs.append((i, j))
    roots, links = roots_of(len(rows), pairs), np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    assert 100 < len(pairs)
    expected = sorted((r[0], int(n), rows[root][0], rows[root][0] == r[0]) for r, n, root in zip(rows, links, roots, strict=True))
    found = lattice.cosine_groups(frame)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()) == expected
    assert lattice.cosine_groups(frame.filter("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-{name}-{os.urandom(4).hex()}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and kept
        ids = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_near_copies_meet_by_their_simhash(spark):
    """The stage's candidates come from SimHash prints too, not from keys of least hashes alone."""
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words[::-1]), " ".join(f"x{w}" for w in words)]
    rows = [(i, simhash.copy_prints(t.encode())[3]) for i, t in enumerate(texts)]
    keys = {r.id: r.key for r in simhash.print_keys(spark.createDataFrame(rows, "id long, print long")).collect()}
    assert keys[0] == keys[1] and len({keys[0], keys[2], keys[3]}) == 3
