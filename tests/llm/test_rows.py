"""Sharding, quality, personal data, the fixity audit and the pipeline on small tables."""

import hashlib
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumaprof.llm import near_copies, pii, quality, sharding, simhash, warc

SF = "/root/testdata/sf0.01"


def test_shards_sizes_and_slots(spark, odd_docs):
    rows = sharding.sharded(odd_docs).collect()
    wanted = Counter((r.doc_id, len((r.text or "").encode()) + 1, crc32((r.text or "").encode())) for r in odd_docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == wanted
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


def test_shards_take_rows_only_into_the_new_one(spark):
    ids = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    rows = sharding.sharded(ids).toPandas()
    moved = rows[rows["shard"] != rows["grown_shard"]]
    assert set(moved["grown_shard"]) == {8} and 0.08 < len(moved) / 20_000 < 0.14
    assert rows["shard"].value_counts().min() > 2250 and rows["shard"].value_counts().max() < 2750
    again = sharding.sharded(ids.withColumn("text", F.lit("other"))).toPandas()
    assert dict(zip(rows.doc_id, rows["shard"])) == dict(zip(again.doc_id, again["shard"]))


def test_weights_confine_movement_to_their_subtree(spark):
    tree = {"a": {"r": {0: 1.0, 1: 2.0}, "s": {2: 1.0}}, "b": {"r": {3: 1.0}, "s": {4: 1.0, 5: 0.0}}}
    heavier = {"a": {"r": {0: 1.0, 1: 2.0}, "s": {2: 3.0}}, "b": {"r": {3: 1.0}, "s": {4: 1.0, 5: 0.0}}}
    rows = spark.range(30_000).select(sharding.shard_of(F.col("id").cast("string"), tree).alias("x"),
                                      sharding.shard_of(F.col("id").cast("string"), heavier).alias("y")).toPandas()
    shares = rows["x"].value_counts(normalize=True)
    assert all(abs(shares[s] - w / 6) < 0.01 for s, w in {0: 1, 1: 2, 2: 1, 3: 1, 4: 1}.items()) and 5 not in shares
    moved = rows[rows["x"] != rows["y"]]
    # Out of b into a, and within a into the rack that grew; never out of that rack or into b.
    assert not (moved["x"] == 2).any() and not moved["y"].isin([3, 4]).any()
    assert set(moved[moved["x"].isin([0, 1])]["y"]) == {2}
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), {"a": {"r": {0: 0.0}}})


def test_numbering_in_ranges(spark, no_docs):
    rows = spark.range(3000).selectExpr("id % 2 as g", "id % 5 as k")
    found = sharding.numbered(rows, "g", ["k"], "n", range_rows=100).collect()
    for g in (0, 1):
        mine = sorted((r.n, r.k) for r in found if r.g == g)
        assert [n for n, _ in mine] == list(range(1500)) and [k for _, k in mine] == sorted(k for _, k in mine)
    assert sharding.sharded(no_docs).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model).join(labels, "doc_id").toPandas()
    assert all(h == (crc32(str(i).encode()) % 4 == 2) for i, h in zip(rows.doc_id, rows.held_out))
    held = rows[rows.held_out]
    assert ((held.score >= 0.7) == held.predicted.astype(bool)).all() and rows.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() >= 0.93 and (held[held.quality == 1].predicted == 1).mean() >= 0.97
    # Labels of held-out rows are not learned from.
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, flipped) == model


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.scored(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1
    assert quality.kept(odd_docs, model).columns == odd_docs.columns and quality.kept(no_docs, model).count() == 0
    nothing = quality.fit(no_docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r.score for r in quality.scored(odd_docs, nothing).collect()} == {0.5}
    few = quality.fit(odd_docs, spark.createDataFrame([(1, 1), (3, 0), (4, 0), (5, 1), (7, None), (None, 1)], "doc_id bigint, quality int"))
    assert quality.scored(odd_docs, few).count() == odd_docs.count()


def test_quality_does_not_thin_out_with_length(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = docs.join(labels, "doc_id").filter("quality = 1").filter(quality.held_out()).orderBy("doc_id").select("text").collect()
    whole = "\n".join(r.text or "" for r in rows).encode()
    long = whole * (1 + 1_500_000 // len(whole))
    compressors = model.compressors()
    short_score, long_score = quality.scores(model, compressors, [whole[:50_000], long])
    assert long_score >= 0.7 and abs(short_score - long_score) < 0.1
    # Every part counts in full, wherever it stands.
    for pair in compressors:
        one, many = quality.sizes(pair, whole[:quality.PIECE_BYTES]), quality.sizes(pair, whole[:quality.PIECE_BYTES] * 20)
        assert many == tuple(20 * n for n in one)


def test_quality_keeps_the_shares_of_capped_classes(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    learned = labels.filter(~quality.held_out()).join(docs, "doc_id", "left_semi").groupBy("quality").count().toPandas().set_index("quality")["count"]
    share, least = learned[1] / learned.sum(), int(learned.min())
    capped = quality.fit(docs, labels, per_class=least)
    assert capped.prior == pytest.approx(share) and share > 0.7
    # A calibration on weighed rows has the weighed mean of the labels; of unweighed ones it would be a half.
    rows = quality.scored(docs, capped).join(labels.filter(~quality.held_out()), "doc_id").toPandas()
    assert rows["score"].mean() == pytest.approx(share, abs=0.05)
    inputs, given = np.ones((4, 1)), np.array([1.0, 1.0, 0.0, 0.0])
    weight = quality.logistic(inputs, given, np.array([1.8, 1.8, 0.2, 0.2]), ridge=1e-9)
    assert 1 / (1 + np.exp(-weight[0])) == pytest.approx(0.9)


def test_quality_learns_from_the_ends_of_texts(spark):
    # All texts begin alike, for longer than a sample; good and bad differ behind that only.
    rng = np.random.default_rng(4)
    common = " ".join(f"w{n % 700}" for n in range(2600))
    assert len(common) > 10_000

    def text(words):
        return common + " " + " ".join(rng.choice(words, 400))

    kinds = [[f"{a}{b}ing" for a in "bcdfgh" for b in "aeiou"], [f"zz{a}{b}{a}q" for a in "klmnp" for b in "xyvw"]]
    docs = spark.createDataFrame([(i, text(kinds[i % 2])) for i in range(160)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    rows = quality.scored(docs, model, threshold=0.5).filter("held_out").collect()
    assert model.trained and len(rows) > 20 and all(r.predicted == 1 - r.doc_id % 2 for r in rows)


def test_quality_with_few_labels(spark):
    learned = [n for n in range(40) if crc32(str(n).encode()) % 4 != 2]
    texts = {n: (f"calm and clear prose about rivers {n} " if n % 2 else f"$$$ !!! 999 $$$ {n} ") * 30 for n in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    odd, even = [n for n in learned if n % 2], [n for n in learned if not n % 2]
    for marks, shared in (([(odd[0], 1), (even[0], 0)], True), ([(n, n % 2) for n in odd[:2] + even[:2]], False)):
        model = quality.fit(docs, spark.createDataFrame(marks, "doc_id bigint, quality int"))
        assert not model.trained and len(model.pairs) == 2 and (model.pairs[0] == model.pairs[1]) == shared
        scores = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
        assert min(scores[n] for n in texts if n % 2) > max(scores[n] for n in texts if not n % 2)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (1 + n % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    """The contract, word for word."""
    spans = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15)
            if good:
                spans.append((m.start(), n, m.end()))
    return sorted(spans)


PERSONAL = ["mail bob@x.org or a.b+c@d-e.co.uk, x@y@z.com, @a.b, q@nodot, é@ü.com a@b.c@d.e", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 1.2.3",
            "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 79927398713 4222222222222", "call +1 (555) 123-4567 or +44 20 7946 0958. +12 +1 2 3",
            "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, DE00 0000 0000 0000 0000 00", "ssn 123-45-6789; 123-45-6789", "account 12345678",
            "1" * 5000, "." * 3000 + "a@b", "a" * 5000 + "@", "+1" + " " * 3000, "🎉 a@b.de 🎉 1.1.1.1"]


def test_personal_data_against_the_plain_patterns(spark, odd_docs):
    import random

    random.seed(37)
    texts = PERSONAL + ["".join(random.choices("0123456789 .-+@ab()", k=random.randrange(5, 80))) for _ in range(800)]
    docs = odd_docs.select("doc_id", "text", "score").unionByName(
        spark.createDataFrame([(100 + i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, score string"))
    rows = {r.doc_id: r for r in pii.counted(docs).filter("doc_id is not null").collect()}
    kinds = list(BASE)
    for row in docs.filter("doc_id is not null").collect():
        spans, found = plain_spans(row.text or ""), rows[row.doc_id]
        written = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert found.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), row.text
        assert [found[f"n_{k}"] for k in kinds] == [sum(n == i for _, n, _ in spans) for i in range(4)]
        assert [s for s in found.spans.split(",") if s.split(":")[0] in kinds] == [s for s in written.split(",") if s] or not written
    assert pii.counted(docs).count() == docs.count()


def test_further_kinds_need_checks_or_context():
    kinds = lambda text: [(pii.KINDS[k], text[a:b]) for a, k, b, _ in pii.spans_of(text) if k > 3]
    assert kinds(PERSONAL[4]) == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")]
    assert kinds("ssn 123-45-6789") == [("national_id", "123-45-6789")] and kinds("no 123-45-6789") == []
    assert kinds("account 12345678") == [("account", "12345678")] and kinds("item 12345678") == []
    near, far = pii.spans_of("mail a@b.de"), pii.spans_of("a@b.de")
    assert near[0][3] > far[0][3]


def test_ibans_end_before_the_next_word():
    ibans = lambda text: [text[a:b] for a, k, b, _ in pii.spans_of(text) if pii.KINDS[k] == "iban"]
    for text in ("BE68 5390 0754 7034", "BE68539007547034", "DE89 3704 0044 0532 0130 00", "AT61 1904 3002 3457 3201"):
        for after in ("", ".", " is it", " OK", " BIC GEBABEBB", " 2024", " 2024 OK", " A1 B2", " EUR 100"):
            assert ibans(f"pay {text}{after}") == [text], text + after
    assert ibans("XX12 ABCD EFGH BE68 5390 0754 7034 OK") == ["BE68 5390 0754 7034"]
    assert ibans("BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00") == ["BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"]
    assert ibans("BE68 5390 0754 7035 OK") == []


def test_words_on_both_sides_announce():
    kinds = lambda text: [(pii.KINDS[k], text[a:b]) for a, k, b, _ in pii.spans_of(text)]
    assert kinds("123-45-6789 (SSN)") == [("national_id", "123-45-6789")]
    assert kinds("12345678 is the account") == [("account", "12345678")]
    assert kinds("12345678" + " " * 40 + "account") == [] and kinds("12345678" + " " * 33 + "accountant") == []


def test_redaction(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "mail bob@x.org now", "en", 18), (2, "clean", "en", 5), (3, None, None, None)], "doc_id bigint, text string, lang string, n_chars int")
    assert [tuple(r) for r in pii.redacted(docs).orderBy("doc_id").collect()] == [(1, "mail <email> now", "en", 16), (2, "clean", "en", 5), (3, None, None, None)]
    assert pii.redacted(odd_docs).columns == odd_docs.columns and pii.redacted(no_docs).count() == 0


def pages_of(spark, count):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(count)] + [(None, None, None), (3, "http://h/3", "x"), (3, "http://h/3", "x")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("archive", F.lit("clash"))


def test_audit_finds_damage_and_nothing_else(spark):
    pages = pages_of(spark, 700)
    damaged = F.when(F.col("page_id").isin(5, 301, 699), F.lit("bad")).otherwise(F.col("html"))
    primary = warc.catalogue(warc.records(pages))
    a, b = warc.leaves(primary), warc.leaves(warc.catalogue(warc.records(pages, damaged)))
    digits = warc.archive_digits(a.count())
    trees = warc.tree(a, digits), warc.tree(b, digits)
    assert digits == 1 and [t.count() for t in trees[0]][0] == 702 and [t.count() for t in trees[0]][2:] == [16, 1]
    found = warc.audit(*trees).toPandas()
    assert sorted(found.page_id) == [5, 301, 699] and (found.expected != found.found).all() and (found.copies == found.found_copies).all()
    assert warc.audit(trees[0], trees[0]).count() == 0


def test_audit_of_lost_extra_and_repeated_records(spark):
    pages = pages_of(spark, 700)
    primary = warc.catalogue(warc.records(pages))

    def differences(replica):
        return {(r.page_id, r.copies, r.found_copies) for r in warc.compared(primary, warc.catalogue(warc.records(replica))).collect()}

    assert differences(pages.filter("page_id <> 10 or page_id is null")) == {(10, 1, 0)}
    more = spark.createDataFrame([(900, None, "new"), (3, "http://h/3", "x")], "page_id bigint, url string, html string")
    assert differences(pages.drop("archive").unionByName(more)) == {(900, 0, 1), (3, 2, 3)}
    # A page under another url is one record less and one more.
    assert differences(pages.withColumn("url", F.when(F.col("page_id") == 8, "elsewhere").otherwise(F.col("url")))) == {(8, 1, 0), (8, 0, 1)}
    assert len(differences(pages.limit(0))) == 702


def test_archives_are_read_back(spark, tmp_path):
    long = "é\r\n\r\nWARC/1.0\r\n" + "x y" * 700_000
    pages = pages_of(spark, 600).drop("archive").unionByName(
        spark.createDataFrame([(-1, "a\r\nb", long)], "page_id bigint, url string, html string"))
    held, path = warc.records(pages), str(tmp_path / "archives")
    warc.write_archives(held, path)
    rows = warc.read_archives(spark, path)
    back = Counter((r.page_id, r.html) for r in rows.collect())
    assert back == Counter((r.page_id, r.html or "") for r in pages.collect())
    assert warc.compared(warc.catalogue(held), rows).count() == 0
    # Offsets of the audit are those of the files.
    at = {r.record_id: r.offset for r in rows.groupBy("record_id").agg(F.min("offset").alias("offset")).collect()}
    found = warc.compared(warc.catalogue(held), rows.filter("page_id not in (4, 77)")).collect()
    assert {(r.page_id, r.offset) for r in found if r.page_id is not None} == {(p, at[r.record_id]) for r in found for p in [r.page_id] if p is not None}
    assert {r.page_id for r in found} == {4, 77, None}


def test_broken_archive_is_read_on():
    one = b"WARC/1.0\r\nWARC-Record-ID: <urn:sha256:%s>\r\nX-Page-Id: 4\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    good, broken = one % (b"ab", 3, b"abc"), one % (b"cd", 999, b"abc")
    rows = list(warc.parsed(good + broken + good + b"rest"))
    assert [(r[0], r[2], r[6]) for r in rows] == [
        (0, "ab", None), (len(good), None, "not a whole record"), (len(good + broken), "ab", None), (len(good + broken + good), None, "not a whole record")]
    assert list(warc.parsed(b"")) == []


def test_audit_of_nothing(spark):
    assert warc.audited(pages_of(spark, 1).limit(0)).count() == 0


def test_pipeline_stages(spark, odd_docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "personal data", "packing"]
    plain = odd_docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int").alias("n_chars"))
    for docs in (plain, plain.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.dtypes == docs.dtypes and out.count() <= docs.count()
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (docs.count() > 0)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[n:n + 5]) for n in range(max(1, len(words) - 4))) if words else frozenset()


def firsts_of_similar(texts):
    """The least id of each group of texts with a five-word similarity of 0.8 or more, by comparing all that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root, holders = {i: i for i in texts}, {}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        near = Counter()
        for s in sets[i] or {()}:
            near.update(holders.setdefault(s, []))
            holders[s].append(i)
        for j, common in near.items():
            if not sets[i] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i for i in texts if top(i) == i}


def test_pipeline_against_its_parts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.scored(docs, quality.fit(docs, labels)).filter("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {i: len(tokenizer.encode(pii.masked(texts[i]), add_special_tokens=False).ids) + 1 for i in firsts_of_similar(texts)}
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert rows.groupby("doc_id")["length"].sum().to_dict() == wanted


def test_pipeline_takes_candidates_from_the_links_of_fingerprints(spark, monkeypatch):
    """A text with one word changed among many repeats is linked by its fingerprint alone: minima get no band here."""
    seen, links = [], simhash.links

    def recorded(prints, bits, **limits):
        seen.append((bits, {r.fp for r in prints.collect()}))
        return links(prints, bits, **limits)

    monkeypatch.setattr(simhash, "links", recorded)
    words = [f"w{n}" for n in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:200] + words[199:])), (3, "else"), (4, None)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [1, 3, 4]
    assert seen == [(2, {r.fp for r in simhash.fingerprints(docs).collect()})]
    nodes = near_copies._described(docs.selectExpr("doc_id AS one", "doc_id AS two", "doc_id", "text"))
    lone = nodes.selectExpr("one", "two", "doc_id AS node", "shingles", "cast(array() AS array<bigint>) AS bands", "array(fp) AS prints")
    scratch = near_copies.Scratch(spark, "lone")
    found = near_copies._links(docs.selectExpr("doc_id AS one", "doc_id AS two", "text"), scratch.written(lone, "nodes"), 32, 4096, scratch)
    assert [tuple(r) for r in found.collect()] == [(2, 1)]


def test_columns_of_any_name_come_back_as_they_are(spark):
    docs = spark.createDataFrame([(1, "a b", 70, "x"), (2, "a b", 71, "y"), (3, "c", 72, None)], "doc_id bigint, text string, _row bigint, `one two` string")
    found = near_copies.one_of_each(docs)
    assert found.columns == docs.columns and sorted(map(tuple, found.collect())) == [(1, "a b", 70, "x"), (3, "c", 72, None)]
