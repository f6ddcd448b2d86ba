"""SimHash, exact top-k and approximate neighbours against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lumaprof.llm import ann, components, near_copies, simhash, topk

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(prints, ids, bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                parent[find(a)] = find(b)
    least = {}
    for n in range(len(prints)):
        if ids[n] is not None:
            least[find(n)] = min(least.get(find(n), ids[n]), ids[n])
    return [least.get(find(n)) for n in range(len(prints))]


def test_near_duplicates_against_brute_force(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    near = " ".join(f"w{i}" for i in range(2000))
    rows = [(r.doc_id, r.text) for r in rows] + [(1000 + i, near.replace(f"w{50 * i} ", f"v{i} ", 1)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(docs).collect()
    prints = [fingerprint(t) for _, t in rows]
    wanted = sorted(zip([str(i) for i, _ in rows], [f"{p:016x}" for p in prints], map(str, least_reachable(prints, [i for i, _ in rows], 2))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == wanted


@pytest.mark.parametrize("limits", [{"goal": 40}, {"goal": 40, "member_block": 16, "visitor_block": 24}, {"goal": 10_000}])
def test_links_of_clustered_fingerprints(spark, limits):
    random.seed(29)
    centres = [random.getrandbits(64) for _ in range(60)]
    prints = set(centres) | {0}
    for centre in centres[:20]:
        for _ in range(random.randrange(30)):
            prints.add(centre ^ sum(1 << random.randrange(64) for _ in range(random.randrange(1, 4))) & (1 << 64) - 1)
    ball = random.getrandbits(64)  # dense: no vantage point splits it
    prints |= {ball ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(a)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    nodes = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    roots = {r.u: r.root for r in components.components(simhash.links(nodes, 2, **limits)).collect()}
    wanted = least_reachable([p & (1 << 64) - 1 for p in prints], prints, 2)
    assert [roots.get(p, p) for p in prints] == wanted


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7001, 7000), (7001, 7000)]
    random.shuffle(edges)
    found = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}, 7001: 7000}


def test_no_duplicates_of_nothing(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def groups_of_similar(texts):
    sets = []
    for text in texts:
        words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    return root


def edited_texts():
    random.seed(41)
    text = lambda n: [f"w{random.randrange(10**6)}" for _ in range(n)]

    def edited(words, edits):
        words = list(words)
        for at in random.sample(range(len(words)), edits):
            words[at] = f"e{random.randrange(10**6)}"
        return words

    hub, chain = text(200), [text(200)]
    for _ in range(6):
        chain.append(edited(chain[-1], 3))
    texts = [hub] + [edited(hub, n % 9) for n in range(50)] + chain  # 4 edits of 200 words are near 0.8
    for _ in range(20):
        base = text(random.randrange(30, 300))
        texts += [base, edited(base, max(1, len(base) // 60))]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("limits", [{}, {"few": 2, "block": 7}, {"few": 0, "block": 1000}])
def test_near_copies_against_brute_force(spark, odd_texts, limits):
    texts = odd_texts + edited_texts()
    root = groups_of_similar(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    wanted = sorted({min(i for i in range(len(texts)) if root[i] == r) for r in root})
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs, **limits).collect()) == wanted


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:100] + ["x"] + words[101:]), " ".join(words[:300] + ["y", "z"] + words[302:]), "another text of a few words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [0, 3]


def test_rows_with_repeated_and_null_ids_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (7, b), (9, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    rows_of = lambda found: sorted(map(str, (tuple(r) for r in found.collect())))
    assert rows_of(near_copies.one_of_each(docs)) == sorted(map(str, [(1, a), (5, b), (None, c), (9, None)]))


SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(31)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.3).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(1500 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [None] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] + [1.0] * 15),
             (2005, [1.0, 2.0]), (None, [1.0] * 16), (2050, [1e-30] * 16), rows[100]]
    return rows


def usable(rows, zero=True):
    return [(i, np.array(v, np.float64)) for i, v in rows
            if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and (zero or np.any(v))]


def test_topk_against_brute_force(spark, vectors):
    table = spark.createDataFrame([(i, v, 0, "s", "r") for i, v in vectors], SCHEMA).repartition(3)
    rows = [(i, np.floor(1024 * v).astype(np.int64)) for i, v in usable(vectors)]
    wanted = []
    for q, x in sorted({(i, tuple(v)) for i, v in rows if i % 100 == 0}):
        best = sorted((-int(np.dot(v, x)), i) for i, v in rows if i != q)[:10]
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for options in ({}, {"sample": 5, "pivots": 2, "query_block": 4}):
        found = topk.search(table, **options).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == sorted(wanted)


def test_topk_of_few_and_large(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (5, [-1.0, 0.5])], "vec_id bigint, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk.search(few).orderBy("rank").collect()] == [(1, 11 * 1024 ** 2), (5, 0)]
    assert topk.search(few.limit(0)).count() == 0 and topk.search(few.limit(1)).count() == 0
    large = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0])], "vec_id bigint, embedding array<float>")
    assert [r.vec_id for r in topk.search(large).orderBy("rank").collect()] == [1, 2]


def test_ann_recall_and_scores(spark, vectors):
    table = spark.createDataFrame([(i, v, 0, "s", "r") for i, v in vectors], SCHEMA).repartition(3)
    rows = usable(vectors, zero=False)
    for options in ({}, {"sample": 400, "row_block": 50, "query_block": 3}):
        found = {}
        for r in ann.search(table, **options).collect():
            found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        queries = dict((i, v) for i, v in rows if i % 50 == 0)
        assert set(found) == set(queries)
        hits = 0
        for q, x in queries.items():
            cosine = sorted((-float(np.dot(v, x) / np.sqrt(np.dot(v, v) * np.dot(x, x))), i) for i, v in rows if i != q)
            scores = {i: -s for s, i in cosine}
            got = sorted(found[q])
            assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
            assert all(abs(scores[i] - s) < 1e-9 for _, i, s in got)
            assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
            hits += sum(s >= -cosine[4][0] - 1e-9 for _, _, s in got)
        assert hits >= 0.9 * 5 * len(queries)


def test_ann_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0])], "vec_id bigint, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 3), (0, 3, 3), (50, 1, 0), (50, 2, 3), (50, 3, 3)]
    assert ann.search(few.limit(0)).count() == 0


def test_texts_are_described_in_bounded_memory():
    texts = [" ".join(f"w{(n * 7919 + i) % 5003}" for i in range(1500)) for n in range(900)]  # 8 MB in one batch
    batch = pa.RecordBatch.from_pydict({"one": list(range(900)), "two": list(range(900)), "doc_id": list(range(900)), "text": texts})
    tracemalloc.start()
    parts = list(near_copies.describe([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(p.num_rows for p in parts) == 900 and peak < 60 << 20
    whole = [near_copies.shingle_set(t.encode()).size for t in texts]
    assert [n for p in parts for n in p.column("shingles").to_pylist()] == whole
