"""Operators against plain versions of themselves on random and on given texts."""

import math
import os
import random
import re
import statistics
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests import oracle
from wireloom.llm import byte_bpe, jaccard_join, packing, quality, queries, token_counts

SF = "/root/testdata/sf0.01"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["'", "s", "t", "re", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "$", " ", "漢", "🙂", "ß", "'S", "́", "\r\n", "<|endoftext|>", "the ing", "<|", "tion"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def random_texts(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_pieces_without_regular_expressions():
    own = byte_bpe.Encoder(RANKS)
    ref = tiktoken.Encoding("ref", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    texts = random_texts(3000, 60, 1)
    for text, ids in zip(texts, own.encode_batch([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == ref.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_count_of_every_prefix():
    own, ref = token_counts.PrefixCounter(JSON), Tokenizer.from_file(JSON)
    for text in random_texts(250, 30, 2):
        want = [len(ref.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert token_counts.counts_at(own.table(text)).tolist() == want, text


def test_fast_encoder_gives_the_library_ids():
    own, ref = packing.TextEncoder(JSON), Tokenizer.from_file(JSON)
    assert own.fast is not None
    for text in random_texts(1500, 40, 3):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ref.encode(text, add_special_tokens=False).ids, text


def test_bm25_scores():
    rng = np.random.default_rng(4)
    docs = [Counter(rng.integers(0, 60, rng.integers(5, 40)).tolist()) for _ in range(40)]
    lengths = np.array([sum(d.values()) for d in docs], float)
    index = packing.Index([np.array(sorted(d), "<u4") for d in docs], [np.array([d[t] for t in sorted(d)], np.uint8) for d in docs], lengths)
    df = Counter(t for d in docs for t in d)

    def score(q, d):
        out = 0.0
        for t in docs[q]:
            idf = max(0, math.log((40 - df[t] + 0.5) / (df[t] + 0.5))) if df[t] > 1 else 0
            tf = docs[d].get(t, 0)
            out += round(256 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[d] / lengths.mean())))
        return out

    for q in range(0, 40, 7):
        assert np.allclose(index.scores(q), [score(q, d) for d in range(40)])
    gone = np.arange(40) % 3 == 0
    index.forget(gone)
    want = np.array([score(1, d) for d in range(40)])
    assert np.allclose(index.scores(1), np.where(gone, 0, want))


def test_windows_hold_every_token_once():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 1024, 300)
    found = packing.fill_windows(lengths, lambda i: rng.random(300))
    parts = defaultdict(list)
    for seq in found:
        n = sum(x[2] for x in seq)
        assert n == 1024 or n & (n - 1) == 0
        for i, at, size in seq:
            parts[i].append((at, size))
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(parts[i]):
            assert start == at
            at += size
        assert at == n


def brute_components(rows, percent=75):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(table))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def altered(seed, n):
    """Copies of a few texts with words changed, left out or moved, so that many links hold only just."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 30))
    bases = [[word() for _ in range(rng.randint(3, 60))] for _ in range(6)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [word()], [w[k], word()]])
            w = w or [word()]
        out.append((i, " ".join(w) if rng.random() > 0.02 else None))
    return out


@pytest.mark.parametrize(("seed", "list_part", "batch", "block", "mask"), [(1, 1 << 20, 1024, 2048, -1), (2, 2, 5, 3, -1), (3, 1 << 20, 7, 2, 31)])
def test_jaccard_components(spark, monkeypatch, seed, list_part, batch, block, mask):
    """Also with lists cut into parts and blocks, with lists that go over the borders of Arrow batches, and with names that agree."""
    monkeypatch.setattr("wireloom.llm.shared.BATCH_ROWS", batch)
    monkeypatch.setattr(jaccard_join, "WANTED", list_part)
    rows = altered(seed, 220)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(docs, list_part=list_part, block=block, mask=mask).collect()}
    assert got == brute_components(rows)


def test_keys_that_are_null_or_stand_twice(spark):
    words = [f"w{i}" for i in range(40)]
    one, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(f"v{i}" for i in range(40))
    rows = [(None, near), (3, one), (1, other), (1, one + " y"), (2, near + " z"), (7, other), (7, other), (8, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = jaccard_join.link_components(docs).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (7, 1), (7, 1), (8, 8), (8, 8), (None, 1)])
    kept = Counter((r.doc_id, r.text or "") for r in jaccard_join.keep_one(docs).collect())
    assert kept == Counter([(1, other), (1, one + " y"), (8, ""), (8, "")])


def test_keys_of_text(spark):
    docs = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), ("c", "four")], "k string, body string")
    got = {r.k: r.component_id for r in jaccard_join.link_components(docs, "k", "body").collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


def topical(n=600, topics=12, seed=12):
    """Texts that draw half of their words from one of some topics, with a few near copies."""
    rng = np.random.default_rng(seed)
    words = [[f"word{chr(97 + t)}{i}" for i in range(60)] for t in range(topics)]
    common = [f"plain{i}" for i in range(200)]
    texts = [" ".join(np.where(rng.random(k) < 0.5, rng.choice(words[i % topics], k), rng.choice(common, k))) for i, k in enumerate(rng.integers(20, 260, n))]
    for i in range(0, n, 20):
        texts[i + 1] = texts[i] + " again"
    return list(enumerate(texts))


def test_packing_shards_are_lexical(spark):
    """Recall of each document's five best neighbours of an index over all documents, in its own shard."""
    rows = topical()
    frame = packing.encoded(spark.createDataFrame(rows, "doc_id bigint, text string"), JSON)
    known = packing.table_statistics(frame)
    got = packing.routes(packing._named(frame), packing.table_router(frame, known, 600)).orderBy("key").collect()
    docs = [packing.terms_of(r.terms, r.counts, r.wide) for r in got]
    lengths = np.array([r.tokens for r in got], float)
    index = packing.Index([t for t, _ in docs], [c for _, c in docs], lengths)
    assert np.allclose(packing.statistics([t for t, _ in docs], lengths).idf, known.idf)
    order = sorted(range(len(got)), key=lambda i: got[i].route)
    shard = np.empty(len(got), int)
    shard[order] = np.arange(len(got)) // 50
    hits = had = best = 0
    for i in range(len(got)):
        score = index.scores(i)
        score[i] = -1
        hits += (shard[np.argsort(-score, kind="stable")[:5]] == shard[i]).sum()
        best += np.sort(score)[-5:].sum()
        had += np.sort(score[shard == shard[i]])[-5:].sum()
    assert hits / (5 * len(got)) >= 0.4 and had >= 0.9 * best  # 12 shards: by chance 0.08


def test_packing_takes_the_best_neighbours(spark):
    """One shard: the windows are those that a plain greedy search over all documents gives."""
    rows = topical(120, 4)
    frame = packing.encoded(spark.createDataFrame(rows, "doc_id bigint, text string"), JSON)
    known = packing.table_statistics(frame)
    routed = packing.routes(packing._named(frame), packing.table_router(frame, known, 120)).collect()
    docs = sorted(routed, key=lambda r: (r.route, r.h, r.key))
    own = [packing.terms_of(r.terms, r.counts, r.wide) for r in docs]
    left = {i: r.tokens for i, r in enumerate(docs)}
    mean = sum(left.values()) / len(left)

    def score(q, d):
        tf = dict(zip(own[d][0].tolist(), own[d][1].tolist(), strict=True))
        n = docs[d].tokens
        return sum(round(256 * known.idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * n / mean))) for t in own[q][0].tolist() if t in tf)

    want = []
    for seed in sorted(left, key=lambda i: (-left[i], i)):
        while left[seed]:
            space, seq = 1024, []
            for i in [seed, *sorted((i for i in left if i != seed), key=lambda i: (-score(seed, i), i))]:
                take = min(space, left[i])
                if take:
                    seq.append((docs[i].key, docs[i].tokens - left[i], take))
                    left[i] -= take
                    space -= take
            if not space:
                want.append(seq)
            else:
                left = dict.fromkeys(left, 0)
    got = defaultdict(list)
    for r in packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), JSON).collect():
        got[r.sequence_id].append((r.offset, r.doc_id, r.start, r.length))
    assert [[x[1:] for x in sorted(got[k])] for k in sorted(got)][: len(want)] == want and len(want) > 5


def test_filters_lose_no_link():
    rng = np.random.default_rng(6)
    for _ in range(3000):
        base = rng.choice(10_000, rng.integers(1, 60), replace=False)
        x = np.sort(base[rng.random(len(base)) > 0.12]).astype(np.uint64)
        y = np.sort(base[rng.random(len(base)) > 0.12]).astype(np.uint64)
        if len(x) and len(y):
            shared = len(np.intersect1d(x, y))
            assert jaccard_join.suffix_bound(x, y) >= shared
            assert jaccard_join.linked(x, y) == (100 * shared >= 75 * (len(x) + len(y) - shared))
    # outlines, of different sizes and with ranges that hold 255 n-grams and more
    for size, low in ((3, 0), (400, 0), (1100, 0), (200_000, 0), (1100, (1 << 64) - (1 << 50))):
        base = np.unique(rng.integers(low, 1 << 64, size, dtype=np.uint64))
        sets = [base, base[rng.random(len(base)) > 0.2], base[:2], base[:0], rng.integers(0, 1 << 64, size, dtype=np.uint64)]
        told = [jaccard_join.outline(s) for s in sets]
        assert [x is None for x in told] == [not len(s) for s in sets]
        for a, x in zip(told, sets, strict=True):
            for b, y in zip(told, sets, strict=True):
                assert a is None or b is None or jaccard_join.most_shared(a, b) >= len(np.intersect1d(x, y))


@needs_data
def test_jaccard_on_the_driver_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_ngram_jaccard_join(spark, SF).collect()}
    assert got == brute_components(rows)


@needs_data
def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = queries.op2_language_id(spark, SF).join(docs, "doc_id").where("held_out and n_chars >= 100").collect()
    assert len(got) > 150
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


@needs_data
def test_licence_lines_of_the_driver_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    named = {"apache": "Apache License", "gpl": "GNU General", "mit": "MIT License", "cc-by-nc": "CC BY-NC"}
    for r in queries.op4_license_scans(spark, SF).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert sorted(filter(None, r.families.split(","))) == sorted(f for f, mark in named.items() if mark in r.text)


@needs_data
def test_quality_verdicts(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op6_quality_rules(spark, SF).join(labels, "doc_id").where("not base_failed").collect()
    good, junk = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert all(r.kept for r in good) and sum(not r.kept for r in junk) >= 0.85 * len(junk)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert oracle.compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF) > 0


def plain_quality(rows):
    """doc_id -> (class distance, word distance, kept), from (doc_id, text, lang) rows, by the rules' definition."""
    rules = quality.Rules()
    word, classes = re.compile(r"[^\x20\x09-\x0D]+"), ["a-z", r"\x20\x09-\x0D", "A-Z", "#*$%&|<>", "0-9"]
    top = defaultdict(Counter)
    for _, text, lang in rows:
        if lang:
            top[lang].update(word.findall(text or ""))
    vocabulary = {w for lang in top for w, _ in sorted(top[lang].items(), key=lambda x: (-x[1], x[0]))[: rules.common_words]}
    either = vocabulary | {w[:1].upper() + w[1:] for w in vocabulary}
    facts = {}
    for i, text, lang in rows:
        text, words = text or "", word.findall(text or "")
        n = [len(re.findall(f"[{c}]", text)) for c in classes]
        left = re.sub("[" + "".join(classes) + "]", "", text)
        letters = sum(unicodedata.category(c)[0] == "L" for c in left)
        n += [letters, len(left) - letters]
        common = Counter(w.lower() for w in words if w in either)
        grams = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeated = len({p for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)})
        failed = len(words) < 20 or 100 * repeated > 30 * len(words)
        facts[i] = (len(words), [x / sum(n) if sum(n) else 0 for x in n], {w: k / sum(common.values()) for w, k in common.items()}, failed, lang)
    refs = {}
    for lang in {f[4] for f in facts.values() if f[4]}:
        own = [f for f in facts.values() if f[4] == lang and f[0] >= rules.word_judged_words and not f[3]]
        if own:
            median = [statistics.median(math.floor(f[1][k] * 10_000 + 0.5) for f in own) for k in range(7)]
            share = Counter()
            for f in own:
                share.update({w: math.floor(x * 1_000_000 + 0.5) for w, x in f[2].items()})
            refs[lang] = ([x / sum(median) for x in median], {w: x / sum(share.values()) for w, x in share.items()})

    def distance(p, q):
        kl = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x > 0)
        return math.sqrt(max(0, (kl(p, q) + kl(q, p)) / 2))

    out = {}
    for i, (n, shares, common, failed, _) in facts.items():
        if n < rules.judged_words:
            out[i] = (None, None, not failed)
            continue
        near = []
        for c, w in refs.values():
            bins = sorted({*common, *w})
            far = distance([common.get(b, 0) for b in bins], [w.get(b, 0) for b in bins]) if common else 1.0
            near.append((far, distance(shares, c)))
        word_far, class_far = min(near)
        over = class_far > rules.class_distance[0] + rules.class_distance[1] / math.sqrt(n)
        over |= n >= rules.word_judged_words and word_far > rules.word_distance[0] + rules.word_distance[1] / math.sqrt(n)
        out[i] = (class_far, word_far, not failed and not over)
    return out


@needs_data
def test_quality_distances_and_verdicts(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    want = plain_quality([tuple(r) for r in docs.collect()])
    got = {r.doc_id: r for r in queries.op6_quality_rules(spark, small).collect()}
    assert set(got) == set(want)
    for i, (class_far, word_far, kept) in want.items():
        r = got[i]
        assert r.kept == kept and (r.class_distance is None) == (class_far is None)
        assert class_far is None or (abs(r.class_distance - class_far) < 1e-6 and abs(r.word_distance - word_far) < 1e-6)
    other = {r.doc_id: (r.class_distance, r.word_distance) for r in quality.judge(docs.repartition(7), columns=["doc_id"]).select("row.doc_id", "quality.*").collect()}
    assert other == {i: (r.class_distance, r.word_distance) for i, r in got.items()}


def test_limits_keep_the_good():
    rows = [(100, 0.2, True), (400, 0.1, True), (100, 0.5, False), (25, 0.3, True), (25, 0.9, False)]
    a, b = quality.fit_limits(rows, [0.0, 0.05, 0.1], [0.5, 1.0, 2.0], 1.2)
    assert all(1.2 * d <= a + b / n**0.5 for n, d, good in rows if good) and all(d > a + b / n**0.5 for n, d, good in rows if not good)
