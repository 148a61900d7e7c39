"""The operators on documents against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import AZ

from ethogrid.llm import licenses, mixing, neardup, pieces, quality, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_sets(rows, n):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(AZ))
        out[i] = frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()
    return out


def linked(sets, percent=80):
    roots = {i: i for i in sets}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                roots[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(documents, texts, words):
    sets = shingle_sets(texts.items(), words)
    wanted = linked(sets)
    got = {r.doc_id: r for r in neardup.near_duplicates(documents, neardup.Params(words=words)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), wanted[i], wanted[i] == i) for i in texts}


def test_near_duplicates_of_a_hub_and_of_a_chain(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 9000, 120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):  # copies of one text, many of which aren't similar to each other
        w = list(base)
        for at in rng.choice(120, int(rng.integers(1, 12)), replace=False):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    chain = list(base[::-1])
    for i in range(90, 130):  # each similar to the one before
        chain = [*chain[6:], *(f"c{i}z{k}" for k in range(6))]
        rows.append((i, " ".join(chain)))
    wanted = linked(shingle_sets(rows, 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = neardup.Params(block=16, links=8)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, p).collect()} == wanted


def test_near_duplicates_of_repeated_rows(spark):
    rows, times = [], []
    for k in range(8):  # rows 0 and 1 are similar; 2 and 3 share rarer values with 0, but are not similar to it
        base = [f"f{k}w{i}" for i in range(61)]
        swap = lambda w, at, s: [f"{s}{k}y{i}" if i in at else x for i, x in enumerate(w)]
        third = swap(base, range(31, 55, 4), "c")
        for j, (w, m) in enumerate([(base, 40), (swap(base, (5, 15, 25), "b"), 40), (third, 1), (swap(third, (58,), "d"), 1)]):
            rows.append((10 * k + j, " ".join(w)))
            times += [rows[-1]] * m
    wanted = linked(shingle_sets(rows, 2))
    assert all(wanted[10 * k + 1] == 10 * k != wanted[10 * k + 2] for k in range(8))
    got = neardup.near_duplicates(spark.createDataFrame(times, "doc_id long, text string")).collect()
    assert len(got) == len(times) and {r.doc_id: r.component_id for r in got} == wanted


def test_near_duplicates_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd).collect()]
    assert len(rows) == odd.count()
    assert {(2, 3, 1, False), (1, 3, 1, True), (None, 3, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True)} <= set(rows)
    assert neardup.near_duplicates(none).count() == 0


def brute_spans(rows, length=50):
    first = {}
    for i, t in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_equal_brute_force(documents, texts):
    got = suffixes.substring_dedup(documents, suffixes.Params(least=5, batch=1 << 14)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_spans(list(texts.items()))


def test_substrings_of_odd_rows(odd, none, spark):
    got = suffixes.substring_dedup(odd, suffixes.Params(least=3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_spans([(r.doc_id, r.text) for r in odd.collect()])
    assert suffixes.substring_dedup(none).count() == 0
    rows = [(3, "a" * 300), (1, "a" * 100), (9, "é" * 80), (4, "xé" * 50 + "é" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffixes.substring_dedup(df).collect()), key=repr) == brute_spans(rows)


def test_substrings_take_room_for_little_text_at_a_time():
    import tracemalloc

    def peak(f):
        tracemalloc.start()
        got = f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, most

    rng, p, shards = np.random.default_rng(0), suffixes.Params(batch=1 << 19), 4
    some = [bytes(rng.integers(97, 123, 8192, np.uint8)).decode() for _ in range(512)]
    texts = pa.table({"doc_id": np.arange(1024), "text": some * 2, "bucket": np.arange(1024) % 16})  # 8 MB, and every anchor in two documents
    rows, most = peak(lambda: list(suffixes._seeds(shards, p)(texts.to_batches())))
    assert most < 50e6
    assert all(len(set(zip(r.column("shard").to_pylist(), r.column("bucket").to_pylist()))) == len(r) for r in rows)
    packed = pa.Table.from_batches(rows)
    assert len(packed) == 16 * shards
    known = pa.concat_tables(suffixes.shared_values._answer((pa.scalar(k),), packed.filter(pc.equal(packed["shard"], k))) for k in range(shards))
    sent, most = peak(lambda: suffixes._sender(shards, p)((pa.scalar(0),), texts, known))  # all texts as one bucket's
    assert most < 80e6
    answers = known.append_column("kind", pa.array([1] * len(known)))
    back = [suffixes._matcher(p)((pa.scalar(k),), sent.filter(pc.equal(sent["shard"], k))) for k in range(shards)]
    answers = pa.concat_tables([answers, pa.concat_tables(back).append_column("kind", pa.array([2] * sum(map(len, back)))).select(answers.column_names)])
    out, most = peak(lambda: suffixes._cutter(shards, p, (), True)((pa.scalar(0),), texts, answers))
    assert most < 60e6
    assert max(b.nbytes for b in out.to_batches()) < 1 << 20  # the result leaves in chunks
    assert out["n_removed"].to_pylist() == [0] * 512 + [8192] * 512


def test_suffix_order_is_that_of_the_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1500] = data[2000:2500]
    at = rng.permutation(len(data) - 50)
    order, new = suffixes.suffix_order(data, at, 50)
    got = [bytes(data[k : k + 50]) for k in at[order]]
    assert got == sorted(got) and new.tolist() == [True] + [x != y for x, y in zip(got, got[1:], strict=False)]


def test_levels_stay_logarithmic_and_find_what_they_hold():
    levels, rng, seen = suffixes.Levels(12), np.random.default_rng(0), set()
    for _ in range(100):
        data = rng.integers(97, 100, 60).astype(np.uint8)
        order, new = suffixes.suffix_order(data, np.arange(49), 12)
        at = np.arange(49)[order][new]
        words = [bytes(data[k : k + 12]) for k in at]
        known = levels.holds(data, at)
        assert known.tolist() == [w in seen for w in words]
        seen |= set(words)
        levels.add(data, at[~known])
    sizes = [len(at) for _, at in levels.arrays]
    assert sum(sizes) == len(seen) and len(sizes) <= 12 and all(x >= 2 * y for x, y in zip(sizes, sizes[1:], strict=False))


def base_quality(t):
    w = WORD.findall(t or "")
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k + d for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for d in range(3)}
    seen, twins = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            twins += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), twins, len(again)


def check_quality(rows, df_rows):
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in df_rows[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_base_equals_brute_force(spark, sf_dir, documents, texts):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.quality_rules(documents, labels).collect()
    assert len(rows) == len(texts)
    check_quality(rows, {i: [base_quality(t)] for i, t in texts.items()})
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    judged = [r.kept for r in rows if r.doc_id in good and not r.base_failed]
    assert sum(judged) >= 0.97 * len(judged)


def test_quality_separates_at_larger_scale(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.quality_rules(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    means = {r.quality: r.s for r in rows.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg({"score": "avg"}).withColumnRenamed("avg(score)", "s").collect()}
    assert means[1] > means[0] + 0.2


def test_quality_counts_every_trusted_row(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    # a batch of trusted rows beyond 20000, of which only those with the largest hashed ids hold a word of their own
    ids = spark.range(24_000).orderBy(F.xxhash64("id"), "id").toPandas()["id"]
    rows = pd.DataFrame({"doc_id": ids, "text": ["alpha beta gamma"] * 20_000 + ["delta epsilon zeta"] * 4_000})
    other = pd.DataFrame({"doc_id": range(100_000, 110_000), "text": ["alpha delta noise junk"] * 10_000})
    documents = spark.createDataFrame(pd.concat([rows, other]))
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": ids, "quality": 1, "toxic": 0}))
    p = quality.Params()
    ratio, _ = quality.fit(documents, labels, p)
    buf = np.frombuffer(b"epsilon", np.uint8)
    _, bucket = quality._grams(buf, np.array([0, len(buf)]), p.buckets)
    assert ratio[bucket[0]] > 0


def test_quality_of_odd_rows(odd, none, labels):
    rows = quality.quality_rules(odd, labels).collect()
    assert len(rows) == odd.count()
    wanted = defaultdict(list)
    for r in odd.collect():
        wanted[r.doc_id].append(base_quality(r.text))
    check_quality(rows, wanted)
    assert quality.quality_rules(none, labels).count() == 0
    assert quality.quality_rules(odd, labels.limit(0)).where("kept").count() == sum(not (len(WORD.findall(r.text or "")) < 50 or 2 * base_quality(r.text)[4] > len(WORD.findall(r.text or ""))) for r in odd.collect())


def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    starts, found = [], set()
    for phrase, label in licenses.BASE.items():
        q = phrase.split()
        for i in range(len(w) - len(q) + 1):
            if w[i : i + len(q)] == q:
                starts.append(i)
                found.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(found))


def test_licenses_equal_brute_force(documents, texts):
    rows = licenses.license_scan(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_notices_and_odd_rows(spark, odd, none):
    rows = [
        (1, "Intro. CC BY cc-by CC BY! MIT license"), (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"),
        (3, "free of charge"), (4, "Licensed under CC BY-NC 4.0."), (5, "xcc by ycc by"), (6, "Redistribution and use in source and binary forms, with or without changes are permitted provided that the following conditions are met:"),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == brute_license(t)
    assert got[2].labels == "mit" and got[2].n_base == 0 and got[2].score == 1.0
    assert got[3].labels == "" and got[3].score == 0.0 and got[4].labels == "cc-by,cc-by-nc" and "bsd" in got[6].labels and got[6].score < 1
    assert licenses.license_scan(odd).count() == odd.count() and licenses.license_scan(none).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        level = rest / max(sum(weight[s] for s in names if s not in full), 1)
        over = {s for s in names if s not in full and weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def check_mix(df, p=mixing.Params()):
    rows = mixing.mix(df, p).collect()
    source, taken, target = Counter(), Counter(), {}
    for r in rows:
        source[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    wanted = brute_targets(source)
    for s in source:
        assert abs(target[s] - wanted[s]) < 1e-6 * max(wanted[s], 1) and abs(taken[s] - wanted[s]) <= 1
    return rows


def test_mix_reaches_its_targets(documents):
    p = mixing.Params(block=7)
    rows = check_mix(documents, p)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(documents.repartition(7), p).collect()), key=repr)
    texts = mixing.mixed_documents(documents, p)
    given = Counter()
    for r in texts.collect():
        given[r.doc_id] += len(WORD.findall(r.text))
    assert given == Counter({r.doc_id: r.taken for r in rows if r.taken})
    assert texts.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_mix_of_full_sources_and_odd_rows(spark, odd, none):
    rows = [(i, "w " * (3000 if i == 0 else 5), s) for i, s in enumerate(["a", "b", None, "c", "b"])]
    got = check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.Params(block=4))
    assert {r.taken for r in got if r.source == "b"} == {15}
    assert len(check_mix(odd)) == odd.count() and mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    text = " lead  in\tword\n" + "tail " * 9
    out = mixing.mixed_documents(spark.createDataFrame([(1, text, "x", "a")], "doc_id long, text string, lang string, source string"), mixing.Params(block=2))
    assert out.first().text == text


def test_pieces_round_trip(documents, texts, odd, none):
    encoded = pieces.encode_pieces(documents)
    assert encoded.where("not exact").count() == 0
    assert {r.doc_id: r.decoded for r in pieces.decode_pieces(encoded).collect()} == texts
    strange = pieces.encode_pieces(odd)
    assert strange.where("exact is null").count() == 1 and strange.where("not exact").count() == 0 and strange.count() == odd.count()
    assert pieces.encode_pieces(none).count() == 0


def test_pieces_are_the_best_segmentation(texts):
    codec = pieces.Codec(pieces.Vocabulary.read(pieces.read_model()))
    own = {t.replace(pieces.META, " ").encode(): s for t, s, ok in zip(codec.v.texts, codec.v.scores, codec.v.normal, strict=True) if ok}
    some = [t.encode() for t in list(texts.values())[:12]]
    codec.encode(some)
    for chunk in {c for t in some for c in codec.chunks(b" " + t)}:
        text = chunk.decode()
        ends = np.cumsum([0] + [len(c.encode()) for c in text])
        best = [0.0] + [-1e18] * len(text)
        for e in range(1, len(text) + 1):
            best[e] = best[e - 1] + codec.v.unknown
            for k in range(e):
                piece = chunk[ends[k] : ends[e]]
                if piece in own:
                    best[e] = max(best[e], best[k] + own[piece])
        ids = np.frombuffer(codec[chunk], np.int32)
        got, raw = 0.0, 0
        for i in ids:
            if codec.v.normal[i]:
                got += codec.v.scores[i]
            else:
                raw += 1 if (i - codec.v.bytes_at) & 0xC0 != 0x80 else 0
        assert abs(got + raw * codec.v.unknown - best[-1]) < 1e-6


def test_long_runs_without_blanks_are_cut_where_no_piece_crosses():
    codec = pieces.Codec(pieces.Vocabulary.read(pieces.read_model()))
    rng = np.random.default_rng(6)
    for alphabet in ("日本語の文字列処理東京大学", "абвгдежз", "abcdefghijklmnop", "🎈é日aб▁"):
        chunk = (" " + "".join(rng.choice(list(alphabet), 700))).encode()
        parts = codec.pieced(chunk)
        assert b"".join(parts) == chunk
        assert b"".join(codec.viterbi([x])[0] for x in parts) == codec.viterbi([chunk])[0]
    assert len(codec.pieced((" " + "日本語の文字列処理" * 100).encode())) > 20


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)


def _value(text: str, beta, bias, p):
    buf = np.frombuffer(text.encode(), np.uint8)
    start, end, number, _ = toxicity.sentences(buf, np.array([0, len(buf)]), p)
    return toxicity.decisions(buf, start, end, number, beta, bias, p)


def test_toxicity_bears_gaps_and_stems():
    p = toxicity.Params()
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("aeinorstlh"), int(rng.integers(3, 9))))
    said = lambda *more: " ".join([word(), word(), *more, word()])
    plain = [said(word()).encode() for _ in range(400)]
    toxic = [said(w).encode() for w in ("worthless", "disgusting", "pathetic") for _ in range(20)]
    beta, bias = toxicity.train(toxic, plain, np.ones(1 << p.bits, np.float32), p)
    bad = [said(w) for w in ("wor*thless", "w.o.r.t.h.l.e.s.s", "w o r t h l e s s", "disgustingly")]
    good = [said(w) for w in ("threnore", "anion")]
    assert min(_value(s, beta, bias, p)[0] for s in bad) > max(_value(s, beta, bias, p)[0] for s in good)


def test_toxicity_sentences():
    p = toxicity.Params(width=3, long_word=8)
    text = "one two. three\nfour five six seven! a b c d\n\xa0 x " + "y" * 20
    buf = np.frombuffer(text.encode(), np.uint8)
    start, end, number, owner = toxicity.sentences(buf, np.array([0, len(buf)]), p)
    words = [bytes(buf[a:b]).decode() for a, b in zip(start, end, strict=True)]
    assert list(zip(words, number.tolist(), strict=True)) == [
        ("one", 0), ("two.", 0), ("three", 1), ("four", 2), ("five", 2), ("six", 2), ("seven!", 3), ("a b c d", 4), ("y" * 8, 5), ("y" * 8, 6), ("yyyy", 6),
    ] and set(owner.tolist()) == {0}


def test_toxicity_decisions_are_kernel_sums():
    """The folded weights against the kernel as it is defined, subsequence by subsequence."""
    p = toxicity.Params(bits=20)

    def features(sentence):
        words, out = [w for w in sentence.split() if len(w) >= 3], {}
        for w in words:
            mine = {}
            for i in range(len(w)):
                for b in range(2, p.span + 1):
                    for a in range(1, b):
                        if i + b < len(w):
                            mine.setdefault((w[i], w[i + a], w[i + b]), []).append(p.decay ** (b - 2))
                for n in p.runs:
                    if i + n <= len(w):
                        mine.setdefault(w[i : i + n], []).append(1.0)
            norm = sum(x * x for v in mine.values() for x in v) ** 0.5
            for k, v in mine.items():
                out[k] = out.get(k, 0) + sum(v) / norm / len(words) ** 0.5
        return out

    one, other = "stupid clown worthless", "the clown cloned a worth"
    wanted = sum(x * features(other).get(k, 0) for k, x in features(one).items())
    _, index, weight = toxicity._features([one.encode()], np.ones(1 << p.bits, np.float32), p)
    beta = np.bincount(index, weight, 1 << p.bits).astype(np.float32)
    assert abs(_value(other, beta, 0.0, p)[0] - wanted) < 1e-3


def test_toxicity_of_odd_rows(odd, none, labels):
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}


def test_shuffled_places_are_a_permutation_and_shards_are_drawn(spark):
    from pyspark.sql import functions as F

    p = mixing.Params()
    places = lambda n, key: mixing.permuted(spark.range(n), "to", F.col("id"), F.lit(n), F.lit(key), p)
    for n in (1, 2, 3, 5, 17, 1000, 20_001):
        assert sorted(r.to for r in places(n, 5).collect()) == list(range(n))
    n = 400_000  # shards of 1024 slots, 30 % of one source: the counts vary as draws without replacement do
    rows = places(n, -1).where("id < 120000").groupBy(F.expr("to div 1024").alias("shard")).count().where(f"shard < {n // 1024}")
    counts = np.array([r["count"] for r in rows.collect()])
    assert abs(counts.mean() - 1024 * 0.3) < 3 and 0.7 < counts.var() / (1024 * 0.21) < 1.3
    # two passes of one source are in different orders
    a, b = ([r.to for r in places(1000, key).orderBy("id").collect()] for key in (1, 2))
    assert sum(x == y for x, y in zip(a, b, strict=True)) < 20 and abs(np.corrcoef(a, b)[0, 1]) < 0.15


def test_license_labels_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    filler = [f"word{k}" for k in range(60)] + ["the", "license", "software", "free", "public"]
    rows = []
    for k in range(150):
        words = list(rng.choice(filler, int(rng.integers(0, 40))))
        for _ in range(int(rng.integers(0, 3))):
            notice = licenses.NOTICES[int(rng.integers(len(licenses.NOTICES)))][1].split()
            notice = [str(rng.choice(filler)) if rng.random() < 0.15 else w for w in notice[int(rng.integers(0, 4)) :]]
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = notice
        rows.append((k, " ".join(words)))
    vocabulary = {w for _, text, _ in licenses.NOTICES for w in text.split()}
    df = Counter(w for _, t in rows for w in set(t.split()))
    idf = {w: np.log(1 + len(rows) / (1 + df[w])) for w in vocabulary}
    share = licenses.Params().share
    wanted = {}
    for k, t in rows:
        w, found, best = t.split(), set(), 0.0
        for label, text, phrases in licenses.NOTICES:
            n = text.split()
            mass = sum(idf[x] for x in n)
            must = {i + d for ph in phrases for i in range(len(n)) if n[i : i + len(ph.split())] == ph.split() for d in range(len(ph.split()))}
            for offset in range(-len(n), len(w)):
                have = {i for i in range(len(n)) if 0 <= offset + i < len(w) and w[offset + i] == n[i]}
                weight = sum(idf[n[i]] for i in have)
                if weight >= share * mass - 1e-9 and must <= have:
                    found.add(label)
                    best = max(best, min(weight / mass, 1.0))
        base = {x for ph, x in licenses.BASE.items() if f" {ph} " in f" {t} "}
        wanted[k] = (",".join(sorted(base | found)), 1.0 if base else best)
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert all(abs(got[k][1] - wanted[k][1]) < 1e-9 for k in wanted) and len({v[0] for v in wanted.values()}) > 8


def test_quality_scores_equal_brute_force(spark, documents, texts, sf_dir):
    """The ratio, the threshold and the verdict with a counter of n-grams in place of arrays of sums."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    p = quality.Params()
    grams = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(AZ))
        raw = np.frombuffer((" ".join(w)).encode(), np.uint8)
        grams[i] = Counter(quality._grams(raw, np.array([0, len(raw)]), p.buckets)[1].tolist())
        assert sum(grams[i].values()) == max(2 * len(w) - 1, 0)
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1} & set(texts)
    half = {r.doc_id: r.half for r in documents.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2) as half").collect()}
    total = sum(grams.values(), Counter())
    size = sum(total.values())

    def model(ids):
        target = sum((grams[i] for i in ids), Counter())
        n = max(sum(target.values()), 1)
        raw = lambda g: (total[g] + 1) / (size + p.buckets)
        return lambda g: np.log((target[g] + p.prior * n * raw(g)) / (sum(target.values()) + p.prior * n)) - np.log(raw(g))

    score = lambda i, ratio: sum(n * ratio(g) for g, n in grams[i].items()) / max(sum(grams[i].values()), 1)
    halves = [model([i for i in trusted if half[i] == h]) for h in (0, 1)]
    own = sorted(score(i, halves[1 - half[i]]) for i in trusted)
    whole = model(trusted)
    _, threshold = quality.fit(documents, labels)
    assert abs(threshold - (own[max(int(np.ceil(p.tail * len(own))) - 1, 0)] - p.margin)) < 1e-9
    assert abs(quality.fit(documents, labels, quality.Params(small=0))[1] - threshold) < 1e-12
    for r in quality.quality_rules(documents, labels).collect():
        assert abs(r.score - score(r.doc_id, whole)) < 1e-9
        assert r.kept == (not r.base_failed and r.score >= threshold)
