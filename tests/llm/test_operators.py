"""Operators against brute force on a small table with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagewise.llm import decontamination, embedding_dedup, licenses, ngram_jaccard, packing, secrets, sharding, substring_dedup, token_counts, tokens, toxicity
from stagewise.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = make(120), make(40)
    texts = {0: None, 1: "", 2: " \n\t ", 3: "one", 4: "One TWO", 5: base, 6: base, 7: base + " tail", 8: base.upper(), 9: make(30) + " " + passage + " " + make(30)}
    texts |= {10: make(25) + " " + passage, 11: make(9000), 12: "For " * 60, 13: "É ünïcode   K x", 14: base.replace(" ", "\n", 3), 15: passage + " " + passage}
    texts |= {20 + i: make(rng.randint(1, 80)) for i in range(40)}
    words = base.split()
    for i in range(12):
        copy = list(words)
        copy[10 * i % 110] = f"edit{i}"
        texts[70 + i] = " ".join(copy)
    return texts


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, i, "clash") for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, key string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_ngram_jaccard(docs, empty):
    sets = {}
    for i, t in TEXTS.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard(docs, 3, 90).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert ngram_jaccard.ngram_jaccard(empty, 3, 90).isEmpty()


def test_one_of_each_group_keeps_columns(docs):
    kept = ngram_jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns and 6 not in {r.doc_id for r in kept.select("doc_id").collect()}


def test_substring_dedup(docs, empty):
    seen, expected = set(), {}
    for i in sorted(TEXTS):
        w = (TEXTS[i] or "").encode().split()
        cut = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                cut[s : s + 20] = [True] * 20
            seen.add(key)
        expected[i] = (len(w), sum(cut), hashlib.sha256(b" ".join(x for x, c in zip(w, cut) if not c)).hexdigest())
    rows = substring_dedup.cut_duplicates(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == expected
    words = {i: (t or "").encode().split() for i, t in TEXTS.items()}
    for r in rows:
        ends = [0, *(f.start + f.length for f in r.factors)]
        # factors follow each other, and their words stand at an earlier source
        assert all(f.start >= e for f, e in zip(r.factors, ends)) and sum(f.length for f in r.factors) == r.n_removed
        for f in r.factors:
            assert words[r.doc_id][f.start : f.start + f.length] == words[f.source_doc][f.source_start : f.source_start + f.length]
            assert (f.source_doc, f.source_start) < (r.doc_id, f.start)
    whole = next(r for r in rows if r.doc_id == 6)
    assert [tuple(f) for f in whole.factors] == [(0, 120, 5, 0)]
    assert substring_dedup.cut_duplicates(empty).isEmpty()


def test_packing_and_token_counts(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in TEXTS.items()}
    rows = packing.pack_documents(docs).collect()
    pieces = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    expected = {}
    for i, x in ids.items():
        whole = np.array([*x, 1], dtype="<u4")
        for p in range(0, len(whole), 4096):
            expected[i, p // 4096] = (p, len(whole[p : p + 4096]), zlib.crc32(whole[p : p + 4096].tobytes()))
    assert pieces == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack_documents(empty).isEmpty()
    counted = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert counted == {i: len(x) for i, x in ids.items()}
    assert token_counts.count_tokens(empty).isEmpty()


def test_separators_across_blocks(spark, tmp_path):
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 30, 200)
    flat = np.concatenate([np.append(rng.integers(0, 9, n), 49407) for n in lengths] + [np.array([5, 5])]).astype("<u2")
    (tmp_path / "part.bin").write_bytes(flat.tobytes())
    found = token_counts.scan_separators(token_counts.read_token_files(spark, f"file://{tmp_path}", block=7)).orderBy("ordinal").collect()
    assert [r.n_tokens for r in found] == [*lengths.tolist(), 2] and [r.closed for r in found] == [True] * 200 + [False]


def test_separators_in_files_of_odd_length(spark, tmp_path):
    (tmp_path / "part.bin").write_bytes(np.array([1, 2, 49407, 3], dtype="<u2").tobytes() + b"x")
    (tmp_path / "empty.bin").write_bytes(b"")
    for block in (1, 2, 4, 9):
        found = token_counts.scan_separators(token_counts.read_token_files(spark, f"file://{tmp_path}", block=block)).orderBy("ordinal").collect()
        assert [(r.n_tokens, r.closed) for r in found] == [(2, True), (1, False)]


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 100, 60)
        bins, offset, free = packing.best_fit_decreasing(sizes, 100)
        used = np.bincount(bins, sizes)
        assert used.max() <= 100 and (100 - used == free).all()
        assert packing.bin_lower_bound(sizes, 100) <= len(free)
    assert packing.bin_lower_bound(np.array([60, 60, 60]), 100) == 3


def _fewest_bins(sizes, capacity):
    """An exact optimum by depth-first search."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= sizes[i]:
                place(i + 1, [*bins[: bins.index(room)], room - sizes[i], *bins[bins.index(room) + 1 :]])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best


def test_bounds_against_an_exact_optimum(spark):
    rng = np.random.default_rng(12)
    for most in (30, 60, 99):
        for _ in range(15):
            sizes = rng.integers(1, most, 9)
            fewest, bound = _fewest_bins(sizes.tolist(), 100), packing.bin_lower_bound(sizes, 100)
            lengths, counts = np.unique(sizes, return_counts=True)
            assert bound == packing.bin_lower_bound(lengths, 100, counts) and fewest - 1 <= bound <= fewest
            assert fewest <= len(packing.best_fit_decreasing(sizes, 100)[2]) <= fewest + 1
    pieces = spark.createDataFrame([(i, 0, 0, int(n)) for i, n in enumerate(sizes)], "doc_id bigint, row bigint, piece int, length bigint")
    assert packing.certified_bound(pieces, 100) == bound and packing.certified_bound(pieces.where("false"), 100) == 0


def test_packing_keeps_null_and_repeated_rows(spark):
    rows = [(None, "one two")] * 2 + [(7, "three")] * 2 + [(8, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == [-1, -1, 7, 7, 8]
    assert len({r.sequence_id for r in got}) == 1 and {r.bound for r in got} == {1}
    ends = np.cumsum([r.length for r in sorted(got, key=lambda r: r.offset)])
    assert sorted(r.offset for r in got) == [0, *ends[:-1]]


def test_other_tokenizers_are_refused(tmp_path):
    import json

    steps = json.load(open(tokens.default_path()))
    steps["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(steps))
    with pytest.raises(ValueError):
        tokens.ChunkTokenizer(str(tmp_path / "other.json"))


def test_packing_shares_part_filled_bins(spark):
    rng = np.random.default_rng(9)
    for lengths in (np.ones(1000, np.int64), rng.integers(1, 4, 1000)):
        rows = [(i, 0, 0, int(n)) for i, n in enumerate(lengths)]
        pieces = spark.createDataFrame(rows, "doc_id bigint, row bigint, piece int, length bigint")
        placed = packing.pack(pieces, capacity=100, group_pieces=64, exchange=16).collect()
        assert {r.doc_id for r in placed} == set(range(1000)) and len(placed) == 1000
        bins = defaultdict(list)
        for r in placed:
            bins[r.sequence_id].append((r.offset, int(lengths[r.doc_id])))
        for parts in bins.values():
            ends = np.cumsum([n for _, n in sorted(parts)])
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 100
        assert len(bins) == packing.bin_lower_bound(lengths, 100)


def test_secrets(spark):
    texts = ["token=token:abcdefgh é password: 'hunter22' x", "AKIA" + "A1" * 9 + " " + "ab12" * 7, None, "", "Secret = short api_key:abcdef api", "ghp_" + "a" * 36 + " AKIAAKIAX", "token: a token: secret123", "é" * 5 + " -----BEGIN RSA PRIVATE KEY-----"]
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint")
    expected = {}
    for i, t in enumerate(texts):
        spans = [(m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t or "", re.A | (re.I if r.any_case else 0)) if len(m.group(r.group)) >= r.least]
        expected[i] = sorted(spans)
    got = {r.doc_id: [(s.start, s.rule, s.end) for s in r.secrets] for r in secrets.scan_secrets(frame).collect()}
    assert got == expected and sum(map(len, expected.values())) >= 7
    clean = {r.doc_id: r.text for r in secrets.redact_secrets(frame).collect()}
    assert "hunter22" not in clean[0] and clean[2] is None and clean[3] == ""
    assert secrets.scan_secrets(frame.where("false")).isEmpty()


def test_trigram_queries():
    assert secrets.trigram_query("abcd|xbcde?") == [frozenset({"abc", "bcd"}), frozenset({"bcd", "xbc"})]
    assert secrets.trigram_query("[0-9a-f]+") is None


def test_licenses(spark):
    texts = ["Licensed under CC-BY 4.0. All rights reserved; all RIGHTS reserved", "GNU General Public License version 3 or later", None, "", "cc by cc by", "the MIT License Apache License, Version 2.0", "éCC BY x"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    expected = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = [(s, label) for p, label in licenses.BASE_PHRASES.items() for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        expected[i] = (len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame).collect()}
    assert {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in rows.items()} == expected
    assert rows[1].labels == "gpl,gpl-3-or-later" and "apache-2.0" in rows[5].labels and "mit" in rows[5].labels
    assert len(licenses.signature_rules()) > 200


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, shards=5).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == len(TEXTS) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert all(r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode()) for r in rows)
    assert len({r.shard for r in rows if r.doc_id in (5, 6)}) == 1
    assert sharding.shard_documents(empty).isEmpty()


def test_sharding_cuts_fewer_edges(spark):
    rows = [(i, f"text {i % 40}" if i < 400 else f"alone {i}") for i in range(600)] + [(None, "text 1"), (5, None), (6, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    start = sharding.shard_documents(frame, shards=6, rounds=0)
    moved = sharding.shard_documents(frame, shards=6)
    before, after = (sharding.cut_edges(x.select(F.col("text_crc32").alias("digest"), "shard")) for x in (start, moved))
    assert after < before / 2 and moved.count() == 603
    sizes = Counter(r.shard for r in moved.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_sharding_one_large_group(spark):
    same = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sizes = Counter(r.shard for r in sharding.shard_documents(same, shards=7).collect())
    assert sorted(sizes.values()) == [14] * 5 + [15] * 2


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 16))
    x[50:90] = x[0] + 0.05 * rng.standard_normal((40, 16))
    x[90:95] = x[1]
    rows = [(i, [float(v) for v in np.float32(v)], i % 2 if i < 50 else 0) for i, v in enumerate(x)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, rows[0][1], None), (304, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    links = defaultdict(set)
    for i, a, la in rows[:200]:
        for j, b, lb in rows[:200]:
            p, q = np.array(a, dtype=float), np.array(b, dtype=float)
            if i != j and la == lb and p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.98:
                links[i].add(j)
    least = {i: i for i, _, _ in rows}
    for _ in range(20):
        for i in links:
            least[i] = min([least[i], *(least[j] for j in links[i])])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(frame).collect()}
    assert got == {i: (len(links[i]), least[i]) for i, _, _ in rows}


def _brute_links(x, threshold=0.98):
    """Links and least reachable row of each row of x."""
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= threshold
    least, before = np.arange(len(x)), None
    while before is None or (least != before).any():
        before, least = least, np.where(linked, least[None, :], len(x)).min(axis=1)
    return {i: (int(linked[i].sum()) - 1, int(least[i])) for i in range(len(x))}


def test_embeddings_link_saturated_groups(spark):
    # two tight groups of 60 (cosine 0.9999 inside, just over 0.98 across), and 40 vectors that only link with one of them
    rng = np.random.default_rng(4)
    centre, aside = np.eye(24)[0], np.eye(24)[1]
    at = lambda angle, axis, n: np.cos(angle) * centre + np.sin(angle) * axis + 0.0005 * rng.standard_normal((n, 24))
    x = np.concatenate([at(0, aside, 60), at(0.19, aside, 60), *[at(0.19, -np.eye(24)[2 + k % 20], 1) for k in range(40)], rng.standard_normal((200, 24))]).astype(np.float32)
    expected = _brute_links(x)
    assert len({c for i, (_, c) in expected.items() if i < 160}) == 1
    frame = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(frame).collect()}
    assert got == expected


def test_embeddings_audit_counts_each_query_once(spark, monkeypatch):
    # one hot group with thousands of links, and 60 pairs that a search without orders can't find
    rng = np.random.default_rng(6)
    hot = np.eye(24)[0] + 0.001 * rng.standard_normal((120, 24))
    one = rng.standard_normal((60, 24))
    x = np.concatenate([hot, one, one + 0.01 * rng.standard_normal((60, 24))]).astype(np.float32)
    expected = _brute_links(x)
    search = embedding_dedup._sorted_edges
    monkeypatch.setattr(embedding_dedup, "_sorted_edges", lambda nodes, orders, seed: search(nodes.where("node < 121"), orders, seed))
    frame = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>, label int")
    rows = embedding_dedup.embedding_dedup(frame).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == expected
    assert {r.recall for r in rows} == {1.0}


def test_leaks(spark, empty):
    item = "A train of 24 wagons leaves Northtown at 9 hours and travels 350 km to reach Southville before the evening storm begins"
    other = item.replace("24", "31").replace("350", "720").replace("Northtown", "Easton")
    wrong = item.replace("9 hours", "24 hours")
    docs = spark.createDataFrame([(1, "intro words here. " + item.upper() + " and more"), (2, "so: " + other + " etc"), (3, "nothing of the kind is said in this text at all"), (4, None), (5, ""), (6, "x " + item + " y " + item)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "too short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontamination.leaks(docs, benchmark).collect()}
    assert {(2, 10), (6, 10)} <= set(got) and got[2, 10] is False and got[6, 10] is True
    assert {d for d, _ in got} <= {1, 2, 6} and wrong != item
    assert decontamination.leaks(empty, benchmark).isEmpty()


def test_leaks_verbatim_in_any_case(spark):
    item = "A train of 24 wagons leaves Northtown at 9 hours and travels 350 km to reach Southville before the evening storm begins"
    texts = {1: "intro words here. " + item.upper() + " and more", 2: "x " + item.lower() + " y", 3: "ask what is 2 + 2? then go", 4: "rates: 3 kg 4 km, Ann 5 miles 6 hours Bob 7 days 8 weeks end", 5: "what is it, 2 or 3"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(10, item), (11, "What is 2 + 2?"), (12, "3 kg 4 km, Ann 5 miles 6 hours Bob 7 days 8 weeks")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontamination.leaks(docs, benchmark).collect()}
    assert got == {(1, 10): True, (2, 10): True, (3, 11): True, (4, 12): True}


def test_leaks_each_occurrence_on_its_own(spark):
    item = "A train of 24 wagons leaves Northtown at 9 hours and travels 350 km to reach Southville before the evening storm begins"
    twin = "one says Tom has 3 red apples in a basket today and one says Ann has 5 red apples in a basket today and nothing more is said"
    other = [item.replace("24", a).replace("350", b).replace("Northtown", c) for a, b, c in (("31", "720", "Easton"), ("36", "810", "Weston"))]
    texts = {1: f"so: {other[0]} etc, and then: {other[1]} etc", 2: "so " + twin.replace("3", "8").replace("5", "8").replace("Tom", "Eve").replace("Ann", "Joe")}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(10, item), (11, twin)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.exact, r.found_windows <= r.n_windows) for r in decontamination.leaks(docs, benchmark).collect()}
    assert got.keys() == {(1, 10), (2, 11)} and got[1, 10] == (False, True)


def test_toxicity(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[7] = words[21] = "vilegrot"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    flags = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    scored = toxicity.score_documents(docs, toxicity.fit(docs, flags)).withColumn("held_out", toxicity.held_out()).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    wrong = [r.doc_id for r in scored if r.doc_id < 1000 and (r.score >= 0.7) != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 4 and all(0 <= r.score <= 1 for r in scored)
    one = next(r for r in scored if r.doc_id == 4)
    assert {rows[4][1][s.start : s.end] for s in one.spans} == {"vilegrot"}
    assert toxicity.toxicity_filter(docs, flags).columns == docs.columns
    none = toxicity.score_documents(docs, toxicity.fit(docs, flags.where("toxic = 0")))
    assert none.where("score > 0").isEmpty()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(40, 41), (50, 41), (41, 41)], "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 50: 40}
    assert connected_components(edges.where("false")).isEmpty()


def test_chunk_tokenizer_gives_the_library_ids():
    rng = random.Random(5)
    pieces = [chr(i) for i in range(0x131)] + list("aA'sSt1 \n\t") * 8 + ["<|endoftext|>", "\u0301", "\u03a3", "\u03c2", "\u2003", "\U0001f600", "'LL", "e\u0301"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(4000)] + ["", " ", "a" * 5000]
    encoder = tokens.ChunkTokenizer(tokens.default_path())
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        raw = [t.encode() for t in some]
        data, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))
        ids, bounds = encoder.encode(data, off, 1)
        for i, t in enumerate(some):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1]
