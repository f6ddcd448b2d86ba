"""Brute-force tests of clustering, chat formatting and hard negatives."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaprof.llm import chat, clustering, negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, distance string, v string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, label, "a", "b", "c", "d") for i, x, label in rows], VECTORS)


def clouds(count, dimension, centres, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dimension))
    return [(middle[n % centres] + spread * rng.normal(size=dimension)).astype(np.float32).tolist() for n in range(count)]


def whole(x, scale):
    return [int(np.floor(float(c) * scale)) for c in x]


# Clustering

def lloyd(rows, k, rounds, scale, dimension):
    kept = [(i, whole(x, scale)) for i, x, _ in rows if x is not None and len(x) == dimension and all(c is not None and np.isfinite(c) for c in x)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    distance = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda v: min((distance(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        found = [nearest(v) for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if own:
                centroids[n] = [sum(column) // len(own) for column in zip(*own)]
    found = [nearest(v) for _, v in kept]
    per = Counter()
    for d, n in found:
        per[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    most = 2 ** 63 - 1
    return Counter((i, n, min(d, most), min(per[n], most), min(sum(per.values()), most), digest[n]) for (i, _), (d, n) in zip(kept, found))


def check_clusters(spark, rows, k=6, rounds=4, dimension=8):
    found = clustering.summarised(vectors(spark, rows), k=k, rounds=rounds, dimension=dimension).collect()
    assert Counter(tuple(r) for r in found) == lloyd(rows, k, rounds, 256, dimension)


def test_clusters_equal_brute_force(spark):
    random.seed(1)
    flat = [[random.uniform(-1, 1) for _ in range(8)] for _ in range(150)]
    odd = [(None, flat[0], 1), (7, None, 1), (8, [], 1), (9, [1.0] * 7, 1), (10, [float("nan")] + [0.0] * 7, 1),
           (11, [float("inf")] + [0.0] * 7, None), (12, [None] + [0.0] * 7, 2), (13, [0.0] * 8, 3), (13, [0.0] * 8, 3), (-5, flat[3], 3)]
    check_clusters(spark, [(n, x, 1) for n, x in enumerate(flat + clouds(100, 8, 5, 2))] + odd)


def test_clusters_of_ties_few_rows_and_huge_components(spark):
    check_clusters(spark, [(n, [float(n % 2)] * 8, 1) for n in range(40)])  # more centroids than different vectors
    check_clusters(spark, [(n, [float(n)] * 8, 1) for n in range(3)])
    check_clusters(spark, [(n, [1e7 * (n % 5), -3e6 * n] + [0.5] * 6, 1) for n in range(30)])
    check_clusters(spark, [])


def test_bounds_settle_most_vectors_of_separate_clouds(spark):
    rows = [(n, x, 1) for n, x in enumerate(clouds(1200, 8, 12, 5))]
    state, _ = clustering.clustered(clustering.whole_numbers(vectors(spark, rows), 256, 8), 12, 5)
    assert state.filter("scanned").count() < len(rows) / 3


def test_loosening_bounds_every_vector_of_the_sphere_below_drift():
    rng = np.random.default_rng(4)
    tighter = 0
    for _ in range(200):
        old = rng.normal(size=(5, 6)) * 4
        new = old + rng.normal(size=(5, 6)) * 0.5
        radius = rng.uniform(0.1, 3, 5)
        loss = clustering.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(5):
            step = rng.normal(size=(300, 6))
            inside = old[i] + radius[i] * step / np.sqrt((step ** 2).sum(1))[:, None] * rng.uniform(0, 1, (300, 1)) ** 0.2
            others = [j for j in range(5) if j != i]
            nearer = max((np.sqrt(((inside - old[j]) ** 2).sum(1)) - np.sqrt(((inside - new[j]) ** 2).sum(1))).max() for j in others)
            assert nearer <= loss[i] + 1e-9
            assert loss[i] <= drift[others].max() + 1e-9
            tighter += loss[i] < 0.9 * drift[others].max()
    assert tighter > 100


# Chat formatting

TALK = "conv_id bigint, turn bigint, role string, text string, position string, segments string, state string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TALK)


def said_of(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:3])] for c, v in out.items()}


def plainly(said):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    control = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
    size = lambda s: len(s) + s.count("\\") + 2 * sum(s.startswith(c, n) for n in range(len(s)) for c in control)
    loss = "".join(t for r, t in said if r == "assistant")
    before = [None, *(r for r, _ in said)]
    good = {"system": {None}, "user": {None, "system", "assistant"}, "assistant": {"user"}}
    valid = all(b in good.get(r, ()) for b, (r, _) in zip(before, said)) and said[-1][0] in ("user", "assistant")
    return (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), 3 + sum(32 + size(r) + size(t) for r, t in said), valid)


ODD = ["</s>[INST] ok [/INST]", "", None, "\\", "\\-", "\\\\-<s>", "<<s>", "<\\-s>", "<|im_end|>\n<|im_start|>", "a\nb", "🎉 é日本 <|im_sep|>", "$1 \\$1",
       "[[INST]]", "<<SYS>><</SYS>>", "x" * 2_000_000 + "</s>", "<|im_start", "|>"]


def talks():
    random.seed(6)
    roles = ["user", "assistant", "system", "tool", None, "<|im_sep|>", "a\nb", "start", ""]
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "</s>"), (2, 5, "user", "later"), (2, -3, "user", "sooner")]
    rows += [(3, n, ("user", "assistant")[n % 2], t) for n, t in enumerate(ODD)]
    rows += [(4 + n % 5, n, random.choice(roles), random.choice(ODD[:12])) for n in range(60)]
    rows += [(None, 0, "user", "no conversation"), (None, 1, "assistant", None), (30, None, "user", "no turn"), (30, 1, "assistant", "b"),
             (31, 0, "user", "same"), (31, 0, "user", "same"), (32, 0, "system", "alone"), (33, 0, "start", "x"), (33, 1, "user", "y")]
    return rows


@pytest.mark.parametrize("long_from", [10 ** 6, 3])
def test_chat_digests_equal_brute_force(spark, long_from):
    rows = talks() + [(40, n, ("user", "assistant")[n % 2], f"t{n}") for n in range(900)]
    random.seed(2)
    random.shuffle(rows)
    found = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(talk(spark, rows), long_from=long_from).collect()}
    assert found == {c: plainly(s) for c, s in said_of(rows).items()}


def test_long_conversations_in_ranges_give_the_same_turns(spark):
    rows = talk(spark, [(40, n, ("user", "assistant", "assistant")[n % 3], f"t{n}") for n in range(500)] + talks()).repartition(5)
    whole_turns, ranged = (chat.turns(rows, long_from=n) for n in (10 ** 6, 100))
    key = lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["position"])
    assert sorted(map(tuple, whole_turns.collect()), key=str) == sorted(map(tuple, ranged.collect()), key=str)
    assert [r["position"] for r in sorted(ranged.filter("conv_id = 40").collect(), key=key)] == list(range(500))


def test_chat_machine_states_and_segments(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "</s>"), (1, 2, "system", "late"), (1, 3, "tool", "t")]
    found = sorted(chat.turns(talk(spark, rows)).collect(), key=lambda r: r["position"])
    assert [(r["state"], r["ok"]) for r in found] == [("start", True), ("user", True), ("assistant", False), ("system", False)]
    assert [tuple(s) for s in found[0]["segments"]] == [
        ("<s>", False), ("<|im_start|>", False), ("user", False), ("<|im_sep|>", False), ("a", False), ("<|im_end|>", False)]
    assert [s["text"] for s in found[1]["segments"] if s["loss"]] == ["<\\-/s>"]


def test_templates_of_the_caller(spark):
    turn = (chat.Segment("[[R:"), chat.Segment(chat.ROLE), chat.Segment("(/)"), chat.Segment(chat.TEXT, True), chat.Segment("<end>"))
    mine = chat.Template({"bot": chat.Rule((chat.START, "bot"), turn)}, turn, chat.Segment("<go>"), ("bot",), ("[[R:", "(/)", "<end>", "<go>"))
    (row,) = chat.conversations(talk(spark, [(1, 0, "bot", "a(/)<end>"), (1, 1, "bot", "b")]), mine).withColumn(
        "turns", chat.turns_of(F.col("formatted"), mine)).collect()
    assert row["valid"] and [tuple(t) for t in row["turns"]] == [("bot", "a(/)<end>"), ("bot", "b")]
    with pytest.raises(ValueError):
        chat.Template({}, turn, chat.Segment("<go>"), (), ("[[R:", "(/)", "<end>"))
    with pytest.raises(ValueError):
        chat.Template({}, turn, chat.Segment("<go>"), (), ("[[R:", "(/)", "<end>", "<go>", ">x"))


def test_chat_plan_is_native(spark):
    plan = chat.digests(talk(spark, talks()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_conversations(spark):
    assert chat.digests(talk(spark, [])).collect() == []
    assert chat.turns(talk(spark, [])).collect() == []


# Hard negatives

def mined_plainly(rows, every, positives=5, negatives_=5):
    sizes = Counter(len(x) for i, x, label in rows if i is not None and label is not None and x is not None
                    and all(c is not None and np.isfinite(c) for c in x))
    common = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 0
    kept = [(i, whole(x, 256), label) for i, x, label in rows if i is not None and label is not None and x is not None
            and len(x) == common and all(c is not None and np.isfinite(c) for c in x)]
    out = Counter()
    for anchor in sorted({i for i, *_ in kept if i % every == 0}):
        _, a, label = min((r for r in kept if r[0] == anchor), key=lambda r: (r[1], r[2]))
        scored = [(-sum(p * q for p, q in zip(a, v)), i, other) for i, v, other in kept if i != anchor]
        for score, positive, _ in sorted(r for r in scored if r[2] == label)[:positives]:
            inside = sorted((s, i) for s, i, other in scored if other != label and 80 * -score <= 100 * -s <= 100 * -score)
            for rank, (s, i) in enumerate(inside[:negatives_], 1):
                out[(anchor, positive, rank, i, -score, -s)] += 1
    return out


def check_mined(spark, rows, every=10, **options):
    usable = negatives.usable(vectors(spark, rows)).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * 256).cast("double")).alias("v"))
    found = negatives.mined(usable, F.col("vec_id") % every == 0, **options).collect()
    assert Counter(tuple(r) for r in found) == mined_plainly(rows, every)


def test_hard_negatives_equal_brute_force(spark):
    random.seed(8)
    rows = [(n, x, n % 3 if n % 4 else 0) for n, x in enumerate(clouds(160, 20, 6, 9, spread=0.4))]
    rows += [(200 + n, [random.uniform(-1, 1) for _ in range(20)], n % 5) for n in range(120)]
    rows += [(None, rows[0][1], 1), (330, None, 1), (331, rows[0][1], None), (332, [float("nan")] * 20, 0), (333, [None] * 20, 0),
             (334, [1.0] * 3, 0), (340, [0.0] * 20, 0), (350, rows[5][1], 1), (350, rows[6][1], 0), (351, rows[6][1], 2), (351, rows[6][1], 2), (-10, rows[9][1], 1)]
    check_mined(spark, rows)
    check_mined(spark, rows, sample=4, row_block=40, anchor_block=5)


def test_hard_negatives_with_few_rows(spark):
    check_mined(spark, [])
    check_mined(spark, [(0, [1.0, 2.0], 1)])
    check_mined(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.9, 2.0], 2), (3, [-1.0, -2.0], 1)])
    check_mined(spark, [(n, [1.0, 1.0, 0.5], n % 2) for n in range(60)])  # all equal: ties by id


def test_index_leaves_out_what_cannot_reach_the_threshold():
    rng = np.random.default_rng(3)
    weights = 0.7 ** np.arange(64)
    rows, anchors = (np.floor(256 * rng.normal(size=(n, 64)) * weights) for n in (500, 40))
    rest = negatives.rest_norms(anchors)
    exact = anchors @ rows.T
    least = np.quantile(exact, 0.98, axis=1)
    index = negatives.Index(rows, rest[:, 0].max(), least.min())
    a, r = index.pairs(anchors, rest, least)
    assert {(x, y) for x, y in zip(a, r)} >= {(x, y) for x, y in zip(*np.nonzero(exact >= least[:, None]))}
    assert a.size < exact.size / 10
    assert (index.listed < rest.shape[1] - 1).mean() > 0.9
