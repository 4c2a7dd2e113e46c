"""The training-data operators against brute-force versions, and their edge cases."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from glyphflow.llm import bpe, class_lm, decontaminate, licenses, quality, sharding, simhash, suffixes, url_rules
from glyphflow.llm.common import Scratch

from plain import repeated_runs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def words_of(rng, n):
    base = ["the", "of", "Éclair", "and", "straße", "日本", "x1", "licence", "don't", "###", "A,b"]
    return " ".join(rng.choice(base) + rng.choice(["", "a", "bc", str(rng.randrange(30))]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [None, "", " \t\n", "one", "one two", "<|endoftext|> end <|endoftext|>", "x" * 70_000, "a b " * 20_000]
    texts += [words_of(rng, rng.choice([1, 5, 60, 300])) for _ in range(60)]
    passage = words_of(rng, 70)
    texts += [words_of(rng, 40) + "\n" + passage + "\n" + words_of(rng, 40) for _ in range(8)]
    copy = words_of(rng, 120)
    texts += [copy] * 30
    near = copy.split()
    for k in range(12):
        w = list(near)
        w[k * 3] = "changed"
        texts.append(" ".join(w))
    texts += ["# notes\nReleased under the MIT License.", "gnu gnu general public license public license", "CC-BY 4.0 cc by", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"]
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out += [out[20], out[20]]  # repeated rows
    out.append((None, words_of(rng, 20), None, None, None))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def raw(t):
    return (t or "").encode()


def test_codec_and_counts_match_the_library(docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, vocabulary()).collect())
    counts = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.count_tokens(docs, vocabulary(), keep=["doc_id"]).collect())
    want, want_counts = Counter(), Counter()
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        want_counts[i, len(raw(t)), len(ids), len(ids) > 512] += 1
    assert got == want and counts == want_counts


def test_codec_round_trip(docs, rows):
    encoded = bpe.encode(docs, vocabulary(), keep=["doc_id", "text"], decoded_text=False)
    back = bpe.decode(encoded, vocabulary(), keep=["doc_id", "text"])
    assert back.where(F.coalesce("text", F.lit("")) != F.col("decoded_text")).count() == 0
    assert back.count() == len(rows)


def test_codec_on_random_pieces():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary()), bpe.encoder(open(vocabulary(), "rb").read())
    rng = random.Random(5)
    letters = "aaab  eéñß\n\t'strlvem1 2日　\x1c\x85😀\u0558<|endoftext|>thong#=-_"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(25))) + rng.choice(["", "<|endoftext|>"])
        ids = lib.encode(s, add_special_tokens=False).ids
        packed = own.encode(s)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids and own.count(s) == len(ids)
    for s, i in own.auto.whole.items():  # proved whole tokens
        assert own.bytes.walk(s) == [i]


def test_codec_in_small_arrays_and_parts(monkeypatch):
    """Words beyond the states are walked, long texts are cut, and full arrays start anew; nothing changes the ids."""
    from tokenizers import Tokenizer

    lib, raw_file = Tokenizer.from_file(vocabulary()), open(vocabulary(), "rb").read()
    rng = random.Random(6)
    texts = [words_of(rng, 200) + rng.choice(["\n\n x", "  ", "'s'll've", ""]) + "a" * rng.choice([0, 70, 200]) for _ in range(20)] + ["", " ", "\r\n", "'s", "don't'S 're"]
    for states, size in ((40, 1 << 20), (500, 300), (1 << 18, 16)):
        monkeypatch.setattr(bpe, "STATES", states)
        monkeypatch.setattr(bpe, "SLICE", size)
        own = bpe.Encoder(raw_file)
        want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in own.encode_all(texts)] == want and own.count_all(texts) == list(map(len, want))


def test_bytes_that_are_no_text(spark):
    """Spark strings may hold bytes that are no UTF-8: they count as U+FFFD, and n_bytes counts them as they are."""
    from tokenizers import Tokenizer

    df = spark.createDataFrame([(1, bytearray(b"a\xff\xfeb \xc3")), (2, bytearray(b"http://\xffx.org/es/"))], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    lib = Tokenizer.from_file(vocabulary())
    want = {1: lib.encode("a\ufffd\ufffdb \ufffd").ids, 2: lib.encode("http://\ufffdx.org/es/").ids}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in bpe.count_tokens(df, vocabulary(), keep=["doc_id"]).collect()} == {1: (6, len(want[1])), 2: (17, len(want[2]))}
    assert {r.doc_id: r.ids_sha256 for r in bpe.digests(df, vocabulary()).collect()} == {i: hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest() for i, x in want.items()}
    assert [r.rule for r in url_rules.judge(df, "text").orderBy("doc_id").collect()] == [None, "org/"]
    assert suffixes.drop_repeats(df, Scratch(spark)).count() == 2


def plain_hits(text, items):
    """n_words, n_hit, hash of the items and the verdict, by comparing all windows at all places."""
    split = lambda t: [w for w in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)) if w]
    words, hit, own = split(text), set(), set()
    for item, t in items:
        iw = split(t)
        size = min(13, len(iw))
        windows = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)} if iw else set()
        for j in range(len(words) - size + 1):
            if tuple(words[j : j + size]) in windows:
                hit |= set(range(j, j + size))
                if item is not None:
                    own.add(f"{item}")
    return len(words), len(hit), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


def test_decontamination(spark, docs, rows, monkeypatch):
    rng = random.Random(3)
    texts = [raw(t) for _, t, *_ in rows]
    items = [(k, " ".join(texts[60 + k].decode().split()[5:25])) for k in range(6)] + [(7, "one"), (8, ""), (9, None), (7, words_of(rng, 30)), (10, texts[75].decode()), (None, " ".join(texts[75].decode().split()[:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(i, raw(t)) for i, t in items]
    want = Counter((i, *plain_hits(raw(t), known)) for i, t, *_ in rows)
    for block in (1 << 20, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        found = decontaminate.report(decontaminate.find_spans(docs, bench, Scratch(spark), keep=["doc_id", "text"]), ["doc_id", "text"])
        got = Counter((r.doc_id, r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in found.collect())
        assert got == want
    left = decontaminate.drop_contaminated(docs.withColumn("spans", F.lit(1)), bench, Scratch(spark))
    assert left.columns == [*docs.columns, "spans"]
    assert {r.doc_id for r in left.collect()} >= {i for i, *_, bad in want if not bad}
    nothing = decontaminate.find_spans(docs, bench.limit(0), Scratch(spark), keep=["doc_id"])
    assert nothing.where(F.size("spans") > 0).count() == 0


def test_decontamination_in_pieces(monkeypatch):
    rng = random.Random(9)
    for _ in range(60):
        monkeypatch.setattr(decontaminate, "PIECE_WORDS", rng.choice([20, 1 << 17]))
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", rng.choice([50, 1 << 19]))
        letters = [b"a", b"b", b"c"][: rng.choice([2, 3])]
        mk = lambda n: b" ".join(rng.choice(letters) for _ in range(n))
        items = [(k % 4, mk(rng.choice([0, 1, 3, 13, 14, 20]))) for k in range(5)]
        texts = [mk(rng.randrange(90)) + b" zz " + items[0][1] + b" zz" for _ in range(6)] + [b""]
        for t, (n, spans, own) in zip(texts, decontaminate.match(texts, decontaminate.Phrases(items))):
            hit = sum(b - a for a, b in spans)
            assert (n, hit, hashlib.sha256(",".join(own).encode()).hexdigest()) == plain_hits(t, items)[:3]


def slow_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """Smallest id of each class, by comparing all distinct fingerprints."""
    distinct = sorted(set(prints.values()))
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    first = {}
    for i, x in prints.items():
        first[find(x)] = min(first.get(find(x), i), i)
    return {i: first[find(x)] for i, x in prints.items()}


def test_simhash_classes(spark, docs, rows):
    prints = {i: slow_fingerprint(raw(t)) for i, t, *_ in rows if i is not None}
    some = docs.where("doc_id is not null")
    found = simhash.near_duplicates(some, Scratch(spark)).collect()
    want = classes(prints)
    assert {r.doc_id: r.fp & (2**64 - 1) for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == want
    left = simhash.keep_leaders(docs.withColumn("fp", F.lit("mine")), Scratch(spark))
    assert left.columns == [*docs.columns, "fp"]
    ids = [r.doc_id for r in left.collect()]
    assert len(ids) == len(set(ids)) and set(want.values()) <= set(ids)
    assert simhash.keep_leaders(some, Scratch(spark)).count() == len(set(want.values()))


def test_each_class_keeps_one_row(spark):
    """Ids that several rows share, and rows without an id, lose no class and leave no second row of one."""
    rows = [(1, "one two three four"), (1, "quite other words here"), (2, "a third class of words"), (2, "one two three four"), (None, "one two three four")]
    rows += [(None, "only rows without an id")] * 3 + [(5, None), (None, ""), (4, " "), (4, " ")]
    left = simhash.keep_leaders(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), Scratch(spark)).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([rows[0], rows[1], rows[2], rows[5], (4, " ")])


@pytest.mark.parametrize("cell,fine", [(4096, 1 << 40), (8, 1 << 40), (4096, 1)])
def test_links_of_close_fingerprints(spark, monkeypatch, cell, fine):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "FINE_FROM", fine)
    rng = random.Random(1)
    prints, x = {}, rng.getrandbits(64)
    for i in range(400):
        if rng.random() < 0.2:
            x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 4])):
            x ^= 1 << rng.randrange(64)
        prints[i] = x
    distinct = spark.createDataFrame([(simhash.signed(v),) for v in set(prints.values())], "fp long")
    scratch = Scratch(spark)
    roots = {r.node: r.root for r in simhash.components(simhash.links(distinct, scratch), scratch).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for i, c in classes(prints).items():
        got[roots.get(simhash.signed(prints[i]), simhash.signed(prints[i]))].add(i)
        want[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_shards_are_even_and_gapless(spark, docs, rows):
    found = sharding.assign(docs, Scratch(spark)).collect()
    assert len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(24)) and max(map(len, by.values())) - min([len(by.get(s, ())) for s in range(24)]) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = Counter((i, len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.crc) for r in found) == want


def test_sharding_keeps_copies_together(spark):
    rows = [(i, f"t{i % 700}") for i in range(2000)] + [(5000 + i, "hot") for i in range(1000)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark))
    df = found.join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    # every row is linked and every shard full, so little room is left to move: the rounds must still join most groups
    start = F.pmod(F.xxhash64("doc_id", "size"), F.lit(24))
    split = df.where("text <> 'hot'").groupBy("text").agg(F.countDistinct("shard").alias("n"), F.countDistinct(start).alias("first"))
    assert 5 * split.where("n > 1").count() < split.where("first > 1").count()
    assert df.where("text = 'hot'").select("shard").distinct().count() <= 16  # 8 at least
    sizes = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert sizes == [125] * 24


def test_flows_are_capacities():
    # 0 and 1 are full and may swap as much as both give; 2 has room for 5 besides
    given = sharding.flows([[0, 10, 20], [4, 0, 0], [0, 0, 0]], [0, 0, 5])
    inflow, outflow = [sum(r[t] for r in given) for t in range(3)], [sum(r) for r in given]
    assert all(i <= f + o + 1e-3 for i, f, o in zip(inflow, [0, 0, 5], outflow))
    assert abs(given[1][0] - 4) < 1e-2 and abs(given[0][1] - 4) < 1e-2 and abs(given[0][2] - 5) < 1e-2


def test_sharding_reaches_known_cuts(spark):
    """Half of the rows are linked, so there is room for each group in one shard: no edge need be cut."""
    rows = [(i, f"t{i % 40}") for i in range(240)] + [(1000 + i, f"alone {i}") for i in range(240)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.assign(texts, Scratch(spark)).join(texts, "doc_id")
    split = found.where("doc_id < 1000").groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert split <= 2 and [r["count"] for r in found.groupBy("shard").count().collect()] == [20] * 24


def test_propagation_keeps_members_and_rooms(spark):
    """Each round's outcome: no member lost, parts only grow together, and no shard much above its room."""
    rows = [(i, f"t{i % 97}") for i in range(4000)]
    docs = sharding.documents_table(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id")
    scratch = Scratch(spark)
    before = sharding.linked_groups(docs, 24)
    squares = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["c"] * p["c"])
    was = {r.gid: (r.n, r.q) for r in before.select("gid", "n", squares.alias("q")).collect()}
    after = sharding.propagate(scratch.write(before), [167] * 24, scratch).select("gid", "n", "parts", squares.alias("q")).collect()
    assert {r.gid: r.n for r in after} == {g: n for g, (n, _) in was.items()} and all(sum(p.c for p in r.parts) == r.n and r.q >= was[r.gid][1] for r in after)
    load = Counter()
    for r in after:
        for p in r.parts:
            load[p.s] += p.c
    assert max(load.values()) <= 167 * 1.5 and sum(r.q for r in after) > 3 * sum(q for _, q in was.values())


def test_sharding_packs_a_group_larger_than_a_shard(spark):
    rows = [(i, f"t{i % 700}") for i in range(2000)] + [(5000 + i, "hot") for i in range(1000)]
    found = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark))
    df = found.join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    assert df.where("text = 'hot'").select("shard").distinct().count() == 8  # 8 at least
    assert sorted((r.shard, r.slot) for r in found.collect()) == [(s, k) for s in range(24) for k in range(125)]


def test_quality_statistics(docs, rows):
    def slow(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        win = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)

    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.rule_statistics(docs, keep=["doc_id"]).collect())
    assert got == Counter((i, *slow(t or "")) for i, t, *_ in rows)


def test_forest_rejects_bad_rows_and_keeps_good_ones(spark):
    rng = random.Random(2)
    good = [words_of(rng, 200).replace("#", "") for _ in range(300)]
    bad = [words_of(rng, 200).upper().replace(" ", "!!! ") for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)] + [(1, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    r = {x.doc_id: x for x in quality.judge(df, labels, Scratch(spark)).collect()}
    other = [i for i in range(1, 360, 2) if not r[i].base_failed]
    assert sum(r[i].kept for i in other if i < 300) >= 0.97 * sum(i < 300 for i in other)
    assert sum(not r[i].kept for i in other if i >= 300) >= 0.9 * sum(i >= 300 for i in other)
    none = quality.judge(df, labels.limit(0), Scratch(spark)).collect()
    assert all(x.kept != x.base_failed for x in none)
    left = quality.keep_good(df.withColumn("kept", F.lit(5)), labels, Scratch(spark))
    assert left.columns == ["doc_id", "text", "kept"] and {x.doc_id for x in left.collect()} == {i for i, x in r.items() if x.kept}


def test_paths_by_a_plain_walk_and_the_threshold():
    import numpy as np

    rng = np.random.default_rng(3)
    good = rng.normal(size=(300, 4))
    forest = quality.Forest(good, np.full(4, -6.0), np.full(4, 6.0))

    def walk(x):
        total = 0.0
        for k, cut, a, b, path in forest.trees:
            at = 0
            while k[at] >= 0:
                at = a[at] if x[k[at]] < cut[at] else b[at]
            total += path[at]
        return total / len(forest.trees)

    rows = np.vstack([good[:40], rng.normal(size=(40, 4)) * 4])
    assert np.allclose(forest.path_length(rows), [walk(x) for x in rows])
    # the threshold looks at both kinds: it catches most bad rows, loses as few good ones as that allows, and lies within the gap
    bad, fine = np.zeros(10), np.zeros(10)
    bad[[0, 2]], fine[[1, 5, 9]] = 3, [1, 1, 198]
    assert quality.calibrate(bad, fine, 0.01) == 4
    assert quality.calibrate(bad, fine, 0.0) == 1
    assert quality.calibrate(np.zeros(10), fine) == 0


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_forest_on_the_labels(spark, scale):
    import os

    where = f"/root/testdata/{scale}"
    if not os.path.isdir(where):
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{where}/labels.parquet")
    found = quality.judge(spark.read.parquet(f"{where}/documents.parquet"), labels, Scratch(spark)).join(labels, "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))
    assert n.get((1, False), 0) <= 0.01 * (n[1, True] + n.get((1, False), 0))


def test_licences(docs, rows):
    def slow(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(t)))
        places = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
        starts = [i for i, _ in places]
        return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))

    found = licenses.scan_licenses(docs, keep=["doc_id"]).collect()
    got = Counter((r.doc_id, r.n_words, len(r.places), min((p.start for p in r.places), default=None), max((p.start for p in r.places), default=None), r.base_labels) for r in found)
    assert got == Counter((i, *slow(t)) for i, t, *_ in rows)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found)
    assert any(r.labels == "mit" and not r.base_labels for r in found)  # by the template


def test_licence_votes_decide():
    """A key phrase alone is no licence: enough words with the highest inverse document frequency must agree on the place."""
    index = licenses.LicenseIndex({w: 1 for t in licenses.TEMPLATES for w in t[2].encode().split()} | {b"software": 90, b"the": 100}, 100)
    whole = {label: text for label, _, text in licenses.TEMPLATES}
    assert index.scan(whole["zlib"].encode())[2:] == ({"zlib"}, 1.0)
    words = whole["zlib"].split()
    assert index.scan(" ".join(words[: len(words) * 2 // 3] + ["odd"] * 50).encode())[2:] == (set(), 0.0)  # the key phrase is missing
    part = " ".join(["x"] * 60 + words[60:])
    labels, score = index.scan(part.encode())[2:]
    assert labels == {"zlib"} and 0.5 < score < 1
    # the file's rarest licence words vote; where they stand elsewhere, the key phrase in its place is not enough
    key = "must not be misrepresented as being the original software"
    common = licenses.LicenseIndex({w.encode(): 50 for w in key.split()}, 100)
    rare = sorted(set(words) - set(key.split()))[: licenses.VOTERS]
    astray = f"{key} and {' y y '.join(rare)}"
    assert common.scan(astray.encode())[2:] == (set(), 0.0)
    assert common.scan(part.encode())[2:] == (labels, score)
    assert index.scan(b"all rights reserved")[2:] == ({"proprietary"}, 0.75)


def test_class_model(spark, docs, rows):
    found = class_lm.score(docs, Scratch(spark)).collect()
    import math

    def tokens(t):
        return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", raw(t))] + [None]

    train = Counter(w for i, t, *_ in rows if not class_lm.is_held_out(i) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for i, t, *_ in rows:
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        want[i, class_lm.is_held_out(i), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == want
    assert class_lm.score(docs.where("doc_id is null and doc_id = 1"), Scratch(spark)).count() == 0


def test_class_model_sums_to_one_and_beats_the_base(spark):
    rng = random.Random(4)
    langs = [[f"{p}{k}" for k in range(40)] for p in ("a", "b", "c")]
    texts = [" ".join(rng.choice(langs[i % 3]) for _ in range(60)) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, counts = class_lm.train(df, Scratch(spark))
    for c in range(class_lm.CLASSES + 3):
        seen = sum((n + class_lm.ADD) * 10 ** model.factor[c, model.klass.get(w, model.open)] for w, n in model.counts.items())
        rest = (model.ends + class_lm.ADD) * 10 ** model.factor[c, model.end] + class_lm.ADD * 10 ** model.factor[c, model.open]
        assert abs(seen + rest - 1) < 1e-6
    held = class_lm.score(df, Scratch(spark)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b * 0.85


def test_class_model_by_plain_counts(spark, monkeypatch):
    """Scores from the words' classes by plain counting of classes, with most words outside the head."""
    import math

    monkeypatch.setattr(class_lm, "HEAD", 20)
    monkeypatch.setattr(class_lm, "CLUSTERED", 12)
    monkeypatch.setattr(class_lm, "CLASSES", 5)
    rng = random.Random(12)
    texts = [" ".join(rng.choice("aeiou") + str(min(rng.randrange(60), rng.randrange(60))) for _ in range(rng.randrange(40))) for _ in range(150)] + [None, "new words only", "x" * 100 + " a1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model, table = class_lm.train(df, Scratch(spark))
    known = {bytes(r["word"]): (r["c"], r["klass"]) for r in table.collect()}
    split = lambda t: raw(t).lower().split()
    train = [split(t) for i, t in enumerate(texts) if not class_lm.is_held_out(i)]
    assert {w: c for w, (c, _) in known.items()} == Counter(w for t in train for w in t)
    klass = lambda w: known[w][1] if w in known else "open"
    pairs, size, ends = Counter(), Counter({"end": len(train) + 0.1}), len(train)
    for t in train:
        path = ["start", *map(klass, t), "end"]
        pairs.update(zip(path, path[1:]))
    for c, k in known.values():
        size[k] += c + 0.1
    first, mass = Counter(), sum(size.values())
    for (a, _), n in pairs.items():
        first[a] += n
    unseen = 0.1 / (mass + 0.1)

    def log(t):
        total, before = 0.0, "start"
        for w in [*split(t), None]:
            k = "end" if w is None else klass(w)
            if k == "open":
                total += math.log10(unseen)
            else:
                total += math.log10((1 - unseen) * (pairs[before, k] + 2.0 * size[k] / mass) / (first[before] + 2.0) * ((ends if w is None else known[w][0]) + 0.1) / size[k])
            before = k
        return total

    found = {r.doc_id: r.score for r in class_lm.score(df, Scratch(spark)).collect()}
    assert all(abs(found[i] - log(t)) < 1e-6 for i, t in enumerate(texts)) and len(found) == len(texts)


def test_class_model_gives_rare_words_classes(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "CLUSTERED", 60)
    monkeypatch.setattr(class_lm, "HEAD", 70)
    rng = random.Random(8)
    texts = []
    for i in range(600):
        side = "ab"[i % 2]
        texts.append(" ".join(f"{side}{rng.randrange(30)}" if k % 3 else f"{side}{side}{rng.randrange(200)}" for k in range(60)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, table = class_lm.train(df, Scratch(spark))
    found = {bytes(r["word"]): (r["c"], r["klass"]) for r in table.collect()}
    assert {w: c for w, (c, _) in found.items()} == Counter(w.encode() for i, t in enumerate(texts) if not class_lm.is_held_out(i) for w in t.split())
    assert all(0 <= k < model.open for _, k in found.values())
    # words that are alone in a fixed rank's open class stand in the classes of their own side, and so texts that differ in them score apart
    a, b = ({k for w, (_, k) in found.items() if w.startswith(x)} for x in (b"aa", b"bb"))
    assert not a & b
    two = [(i, t) for i, t in [(10_000, "a1 a2 aa7 a3"), (10_001, "a1 a2 bb7 a3")]]
    r = {x.doc_id: x.score - x.base_score for x in class_lm.score(df.union(spark.createDataFrame(two, df.schema)), Scratch(spark)).where("doc_id >= 10000").collect()}
    assert r[10_000] > r[10_001] + 0.5


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/x?y#z", "https://a.example.org/en/12", "http://example.org/en", "http://xexample.org/es/", "http://x.com/fr/", "http://x.com/de/1", "http://org", "http://org/", "http://x.org?/", "http://m.ads-track.example.net/a", "http://a.net/login", "http://a.net/x#/login", "x://y://z.com/de/", "http://ORG.example.net/p", "http://com:80/de/"]
    names = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

    def slow(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in names if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fits, key=len, default=None)
        return host, path, best

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("mine"))
    found = {r.page_id: r for r in url_rules.judge(df).collect()}
    for i, u in enumerate(urls):
        assert (found[i].host, found[i].path, found[i].rule) == slow(u)
        assert found[i].verdict == (names[found[i].rule] if found[i].rule else "block" if found[i].pattern else "allow")
    assert found[12].verdict == found[13].verdict == "block" and found[14].verdict == "allow"


def test_rarest_tokens_fetch_few_rules():
    frequency = {"ads": 500, "img": 3, "click": 900, "net": 900, "x": 900}
    index = url_rules.RuleIndex(url_rules.PATTERN_RULES, frequency)
    assert len(url_rules.PATTERN_RULES) > 400 and not index.always
    rule = next(r for r in url_rules.PATTERN_RULES if r.name == "/ads/img/")
    assert set(rule.tokens) == {"ads", "img"}
    where = [t for t, rules in index.by_token.items() if any(r is rule for r, _ in rules)]
    assert where == ["img"]
    turned = url_rules.RuleIndex(url_rules.PATTERN_RULES, {"ads": 3, "img": 500})
    assert [t for t, rules in turned.by_token.items() if any(r is rule for r, _ in rules)] == ["ads"]
    for url, few in (("http://x.example.net/en/12", 0), ("http://ads.example.net/en/1", 40), ("http://x.net/ads/img/1", 60)):
        host, path = url_rules.split_url(url)
        tokens = url_rules.url_tokens(host, path)
        fetched = {r.name for r, _ in index.candidates(tokens)}
        fits = {r.name for r in url_rules.PATTERN_RULES if re.match(r.pattern, host + path, re.DOTALL)}
        assert fits <= fetched and len(fetched) <= few
    wild = url_rules.filter_rule("||a*b/c^")
    assert wild.tokens == ("c",) and url_rules.filter_rule("ads*").tokens == ()


def test_repeated_strings(spark, docs, rows):
    some = [(i, t) for i, t, *_ in rows if i is not None]
    want = repeated_runs([raw(t) for _, t in some])
    df = docs.where("doc_id is not null")
    found = suffixes.removed_runs(df, Scratch(spark)).collect()
    expected = Counter((i, len(raw(t)), tuple(r), suffixes.without(raw(t), r)) for (i, t), r in zip(some, want))
    assert Counter((r.doc_id, r.n_bytes, tuple((u.begin, u.end) for u in r.runs), bytes(r.kept_bytes)) for r in found) == expected
    assert any(r for r in want)
    left = suffixes.drop_repeats(docs.withColumn("spans", F.lit(1)), Scratch(spark), length_col="n_chars")
    assert left.columns == [*docs.columns, "spans"] and left.count() == len(rows)
    assert left.where("n_chars <> length(text)").count() == 0


def test_repeated_strings_of_low_entropy(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    monkeypatch.setattr(suffixes, "FLUSH", 50)
    base = ["".join(rng.choice("ab") for _ in range(rng.choice([100, 250, 600]))) for _ in range(6)]
    texts = ["".join(rng.choice([*base, "x" * rng.randrange(1, 500), "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(300)))]) for _ in range(rng.randrange(6)))[rng.randrange(30) :] for _ in range(60)] + ["é" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: [(u.begin, u.end) for u in r.runs] for r in suffixes.removed_runs(df, Scratch(spark)).collect()}
    assert found == dict(enumerate(repeated_runs([t.encode() for t in texts])))


def test_few_long_texts_fill_several_buckets(spark, monkeypatch):
    """Splitters come from suffixes, not rows; copies in long texts are found across pieces and buckets."""
    rng = random.Random(9)
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 1 << 10)
    body = [bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(130_000)).decode() for _ in range(3)]
    texts = [body[0], body[1] + body[0][40_000:41_000], body[2] + body[2][70_000:70_500], body[1][100:400]]
    made = []
    plan = suffixes.Splitters.__init__
    monkeypatch.setattr(suffixes.Splitters, "__init__", lambda self, sample, buckets: (plan(self, sample, buckets), made.append(len(self.keys)))[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(u.begin, u.end) for u in r.runs] for r in suffixes.removed_runs(df, Scratch(spark)).collect()}
    assert found == dict(enumerate(repeated_runs([t.encode() for t in texts]))) and all(found[i] for i in (0, 1, 2, 3))
    assert made[0] >= 4


def test_suffixes_sort_by_their_text():
    rng = random.Random(10)
    keys = suffixes.np.array([[rng.randrange(3) for _ in range(5)] for _ in range(400)], dtype=suffixes.np.uint64)
    order, depths = suffixes.multikey_sort([keys[:, k].copy() for k in range(5)])
    rows = [tuple(r) for r in keys.tolist()]
    assert [rows[i] for i in order] == sorted(rows)
    for d, begins in enumerate(depths):
        assert begins.tolist() == [i == 0 or rows[order[i]][: d + 1] != rows[order[i - 1]][: d + 1] for i in range(400)]


def test_empty_tables(spark, empty):
    scratch = Scratch(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string")
    results = [bpe.digests(empty, vocabulary()), bpe.count_tokens(empty, vocabulary()), decontaminate.find_spans(empty, bench, scratch), simhash.near_duplicates(empty, scratch), sharding.assign(empty, scratch), quality.judge(empty, labels, scratch), licenses.scan_licenses(empty), class_lm.score(empty, scratch), url_rules.judge(pages), suffixes.removal_digests(empty, scratch)]
    assert all(r.count() == 0 for r in results)
    for f in (lambda: quality.keep_good(empty, labels, scratch), lambda: simhash.keep_leaders(empty, scratch), lambda: suffixes.drop_repeats(empty, scratch, length_col="n_chars"), lambda: decontaminate.drop_contaminated(empty, bench, scratch)):
        out = f()
        assert out.columns == empty.columns and out.count() == 0


def test_clashing_columns(spark, docs):
    odd = docs.select("*", *[F.lit(1).alias(c) for c in ("_text", "n_words", "k0", "row", "id", "score", "gid")])
    assert bpe.count_tokens(odd, vocabulary()).count() == docs.count()
    assert licenses.scan_licenses(odd).columns.count("n_words") == 1
    assert sharding.assign(odd, Scratch(spark)).count() == docs.count()
    assert suffixes.drop_repeats(odd, Scratch(spark)).columns == odd.columns
