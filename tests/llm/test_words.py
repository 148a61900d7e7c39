"""Word-table BPE, lexical search and conversation repair against the library and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import AZ, DOCS

from ethogrid.llm import lexical, repair, wordbpe

TERM = re.compile(lexical.TERM)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(wordbpe.read_tokenizer().decode())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_words_and_merges_equal_the_library(library):
    raw = wordbpe.read_tokenizer()
    split, merge = wordbpe.splitter(raw), wordbpe.merger(raw)
    rng = random.Random(1)
    alphabet = "aAbsStTrevVmMlLdD''' \n\t12é́️ÉİΣσς日本🎈́ǅ’　\u0085\x1cÅ½٣ẞ😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" + chr(c) + "B'" + chr(c) * 2 for c in range(0, 0x20100, 7) if not 0xD800 <= c < 0xE000]
    texts += ["'s's it's ''s 'll'll 'lll", "<|endoftext|>é<|startoftext|> x<|endoftext|", "'<|endoftext|>s", "e<|endoftext|>́", "a" * 5000, "ab" * 3000 + "'re", ""]
    for low in range(0, len(texts), 1000):
        part = texts[low : low + 1000]
        found, counts = split.words(part)
        words = iter(found.to_pylist())
        for text, n in zip(part, counts.tolist(), strict=True):
            assert [i for _ in range(n) for i in merge.encode(next(words))] == expected(library, text)[0], text
    for _ in range(500):
        word = "".join(rng.choice("abtheinrs") for _ in range(rng.randint(1, 60))).encode()
        ids = [merge.inner[b] for b in word[:-1]] + [merge.last[word[-1]]]
        assert merge._short(list(ids)) == merge._long(list(ids))


@pytest.mark.parametrize("p", [wordbpe.Params(), wordbpe.Params(chunk=3000, words=90, part=1000, bucket=50)])
def test_bpe_equals_the_library(spark, documents, texts, library, odd, p):
    got = {r.doc_id: r for r in wordbpe.encode_words(documents, p=p).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert (got[i].ids, got[i].decoded) == expected(library, text)
    rows = odd.select("doc_id", "text").collect()
    want = sorted(((r.doc_id is None, r.doc_id or 0), *expected(library, r.text)) for r in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.ids, r.decoded) for r in wordbpe.encode_words(odd, p=p).collect()) == want


def test_bpe_digests_and_decoding(spark, documents, library, none):
    encoded = wordbpe.encode_words(documents)
    rows = {r.doc_id: r for r in wordbpe.digests(encoded).collect()}
    decoded = {r.doc_id: r.decoded for r in wordbpe.decode_words(encoded).collect()}
    for r in encoded.collect():
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert decoded[r.doc_id] == r.decoded
        assert tuple(rows[r.doc_id])[1:] == (len(r.ids), sha(" ".join(map(str, r.ids))), sha(r.decoded))
    odd = spark.createDataFrame([(1, None), (2, []), (2, [0]), (None, [99_999]), (3, [49407, 256])], "doc_id long, ids array<int>")
    got = sorted(wordbpe.decode_words(odd).collect(), key=str)
    assert {(r.doc_id, r.decoded) for r in got} == {(1, None), (2, ""), (2, "!"), (None, None), (3, "<|endoftext|> !</w>")}
    assert wordbpe.encode_words(none).count() == 0 and wordbpe.decode_words(encoded.limit(0)).count() == 0


def test_a_tokenizer_of_another_make_is_refused():
    raw = wordbpe.read_tokenizer().replace(b'"Lowercase"', b'"NFKC"')
    with pytest.raises(ValueError):
        wordbpe.Splitter(raw)


def brute_search(items, docs, near):
    lists = [(i, TERM.findall((t or "").translate(AZ))) for i, t in docs]
    n_docs, n_terms = sum(bool(x) for _, x in lists), sum(len(x) for _, x in lists)
    counts = [(i, len(x), Counter(x)) for i, x in lists]
    df = Counter(t for _, _, c in counts for t in c)
    asked: dict[int, set] = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(AZ)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, n, c in counts:
            m = 50 + (50 * n * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scores)[:near], 1)]
    return sorted(out)


@pytest.mark.parametrize("p", [lexical.Params(near=3), lexical.Params(near=3, items=1, text=400), lexical.Params(near=3, items=2, text=400, known=0)])
def test_search_equals_brute_force(spark, documents, odd, p):
    rows = documents.select("doc_id", "text").limit(60).unionByName(odd.select("doc_id", "text"))
    docs = [tuple(r) for r in rows.collect()]
    words = TERM.findall(docs[3][1])
    items = [(1, docs[0][1]), (2, "alpha BETA beta w1x0"), (2, "naïve"), (3, None), (4, "日本 nowhere"), (None, docs[1][1]), (5, " ".join(words[:9])), (5, " ".join(words[:9])), (6, "")]
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, score string")
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, term string, rank int")
    assert sorted(map(tuple, lexical.search(asked, frame, p).select("item_id", "rank", "doc_id", "score").collect())) == brute_search(items, docs, 3)


def test_search_of_empty_tables(spark, documents, none):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(items, none).count() == 0 and lexical.search(items.limit(0), documents).count() == 0


def brute_repair(rows):
    """Cheapest cost, then least letters, over all edit sequences, by growing cost."""
    import heapq

    n, heap, seen = len(rows), [(0, "", 0, "")], set()
    done = re.compile(r"(s?(ua)+)?")
    partial = re.compile(r"(s?(ua)*u?)?")
    best = None
    while heap:
        cost, letters, k, said = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if k == n and done.fullmatch(said):
            return (cost, letters)
        key = (k, said, letters)
        if key in seen:
            continue
        seen.add(key)
        steps = [(5, "I", k, i) for i in "ua"]
        if k < n:
            own, fault = rows[k]
            steps.append((2, "D", k + 1, ""))
            if fault not in ("b", "d"):
                extra = 5 if fault == "t" else 0
                steps += [(extra, "K", k + 1, own)] + [(1 + extra, "R", k + 1, i) for i in "ua"]
        for c, letter, place, more in steps:
            if letter == "D" or more and partial.fullmatch(said + more):  # an empty role has none of the initials
                heapq.heappush(heap, (cost + c, letters + letter, place, said + more))
    return best


def test_edits_equal_brute_force():
    rng = random.Random(3)
    for _ in range(250):
        rows = [(rng.choice("suaax"), rng.choice(["", "", "", "b", "d", "t"])) for _ in range(rng.randint(0, 5))]
        graph = repair.Graph(rows)
        assert (graph.cost, graph.audit()) == brute_repair(rows), rows


def brute_conversations(rows):
    by: dict = {}
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        kept = by.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, kept in by.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, coded = set(), []
        for _, role, text in kept:
            ends = re.findall(r"[^\x20\x09-\x0D]", text)
            coded.append((role[:1], "b" if not ends else "d" if (role, text) in seen else "" if ends[-1] in ".!?" else "t"))
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit = brute_repair(coded)
        lines, said, rest = [], "", iter(kept)
        for letter in audit:
            row = next(rest) if letter != "I" else (None, "", "")
            if letter == "D":
                continue
            role = row[1] if letter == "K" else "assistant" if said.endswith("u") else "user"
            said += role[:1]
            lines.append(f"{role}:{row[2]}")
        faults = [f for _, f in coded]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repair_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "so", " \t", "", None, "Why?  \n", "a. b", "日本。", "x" * 200_000 + "."]
    rows = [(rng.choice([*range(40), None]), rng.choice([0, 1, 2, 3, 7, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts)) for _ in range(150)]
    rows += rows[:10]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, copies int")
    assert sorted(map(tuple, repair.repair(df).collect()), key=str) == brute_conversations(rows)
    assert repair.repair(df.limit(0)).count() == 0


def test_one_long_conversation(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(6000)]
    got = repair.repair(spark.createDataFrame(rows, DOCS.split(",")[0].replace("doc_id", "conv_id") + ", turn long, role string, text string")).collect()
    assert len(got) == 1 and len(got[0].audit) >= 5500 and got[0].illegal > 0
