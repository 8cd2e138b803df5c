"""The ten operators against brute force, with nulls, empty and very long texts, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("chronoline.llm")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, ids string"
PASSAGE = " ".join(f"shared{i} passage{i * 7 % 13} of words" for i in range(30))


def corpus(n=90, seed=5):
    rng = random.Random(seed)
    vocabulary = {"en": "the of and a to in is with that it stone river".split(), "fr": "le la les une dans être où ça pierre rivière".split(), "de": "der die und über groß Straße nicht Fluss".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(list(vocabulary))
        words = [rng.choice(vocabulary[lang]) + rng.choice(["", "", str(rng.randrange(50))]) for _ in range(rng.choice([1, 3, 40, 120]))]
        text = " ".join(words)
        if i % 9 == 0:
            text += " " + PASSAGE + " " + " ".join(rng.sample(words, min(3, len(words))))
        if i % 10 == 1:
            text = text.replace(" ", "\n\t", 1) + " <|endoftext|>  'S 12345 ½ 漢字 \U0001f600 " + "=" * rng.randrange(80)
        rows.append((i * 3, text, lang if i % 7 else None, "src0", len(text), "k", "x"))
    rows += [(1000, None, None, None, None, None, None), (1001, "", "en", "s", 0, "", ""), (1002, " \n ", "en", "s", 3, "", ""), (1003, "a" * 3000, "en", "s", 3000, "", "")]
    rows += [(1004, rows[9][1], "fr", "s", 1, "", ""), (1005, rows[9][1] + " tail", "fr", "s", 1, "", ""), rows[20], rows[20]]
    rows += [(1010, "word " * 30_000, "en", "s", 1, "", "")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# -- 1 -------------------------------------------------------------------------------------
def test_bpe_equals_library_and_round_trips(docs, nothing, rows):
    from chronoline.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    got = sorted(((r.doc_id, list(r.ids), bytes(r.bytes)) for r in bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()), key=repr)
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows), key=repr)
    assert got == want
    assert bpe.encode(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_merges_of_long_words():
    from chronoline.llm.bpe import merge

    table = ranks()
    one = tiktoken.Encoding("one", pat_str="(?s:.+)", mergeable_ranks=table, special_tokens={})
    rng = random.Random(1)
    for n in (1, 2, 47, 48, 49, 200, 3000):
        for letters in ("ab", "the ", "=", "xyzé"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert merge(text.encode(), table) == one.encode_ordinary(text)


# -- 2 -------------------------------------------------------------------------------------
def test_url_rules_and_hosts(spark):
    from chronoline.llm import urls

    cases = {
        "http://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "https://x.com/fr/1": ("x.com", "/fr/1", "com/fr/", "allow"),
        "https://x.com/de/1": ("x.com", "/de/1", "com/de/", "block"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://ÄB.net?x=/y": ("Äb.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(pages).collect()}
    assert [got[i] for i in range(len(cases))] == [v[:3] for v in cases.values()]
    assert urls.judge(pages.limit(0)).count() == 0


def test_page_rank_equals_power_iteration(spark):
    from chronoline.llm import urls

    edges = [("a", "b", 2), ("a", "c", 1), ("b", "a", 1), ("c", "d", 5)]
    seeds = {"a": 0.75, "d": 0.25}
    total = {s: sum(n for x, _, n in edges if x == s) for s, _, _ in edges}
    want = {k: 0.15 * v for k, v in seeds.items()}
    for _ in range(200):
        new = {k: 0.15 * v for k, v in seeds.items()}
        for s, t, n in edges:
            new[t] = new.get(t, 0) + 0.85 * want.get(s, 0) * n / total[s]
        want = new
    got = urls.spread(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, seed double"), rounds=80, tolerance=1e-12)
    assert {r.host: r.rank for r in got.collect()} == pytest.approx(want)


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    from chronoline.llm import urls

    bad = '<a href="http://spam.com/de/1">x</a>'
    pages = [(1, "http://spam.com/de/1", ""), (2, "http://near.net/a", bad), (3, "http://far.net/a", ""), (4, "http://good.org/a", '<a href="http://friend.net/">')]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[2].verdict == "block" and got[2].rule is None and got[3].verdict == "allow" and got[3].distrust == 0
    assert urls.host_edges(spark.createDataFrame(pages, "page_id long, url string, html string")).count() == 2


# -- 3 -------------------------------------------------------------------------------------
def test_distrust_does_not_depend_on_the_number_of_seeds(spark):
    from chronoline.llm import urls

    link = lambda host: f'<a href="http://{host}/de/1">x</a>'
    pages = [(i, f"http://s{i}.com/de/1", "") for i in range(3000)]  # blocked seeds, of which one has a link to it
    chain = ["s0.com", *[f"h{k}.net" for k in range(1, 7)]]
    pages += [(3000 + k, f"http://{chain[k]}/a", link(chain[k - 1])) for k in range(1, 7)]
    pages += [(4000 + i, "http://h2.net/b", "") for i in range(300)]  # a large host in between has a small score of its own
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    n = len(pages)
    for k in range(1, 7):
        want = 0.15 * 0.85**k / 3000 * n / (301 if k == 2 else 1)
        assert got[3000 + k].distrust == pytest.approx(want, abs=urls.EXACT * urls.THRESHOLD)
        assert got[3000 + k].verdict == ("allow" if k == 2 else "block")


def test_rank_goes_past_thirty_hosts_or_raises(spark):
    from chronoline.llm import urls

    edges = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(36)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h0", 1.0)], "host string, seed double")
    assert {r.host: r.rank for r in urls.spread(edges, seeds).collect()} == pytest.approx({f"h{k}": 0.15 * 0.85**k for k in range(37)})
    with pytest.raises(RuntimeError):
        urls.spread(edges, seeds, rounds=2)


def test_toxicity_learns_and_never_reads_other_columns(spark):
    from chronoline.llm import toxicity

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(3000):
        words = [rng.choice("river stone cloud walk green paper light north".split()) for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["zumpfel" + rng.choice("abcdef"), "idiot"]))
        rows.append((i, " ".join(words), "en", "s", 0, "k", "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.7) == (i % 8 == 0) for i in held)
    assert right / len(held) > 0.98 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.7 for s in got.values())


def test_toxicity_without_labels_and_with_odd_texts(docs, nothing, spark):
    from chronoline.llm import toxicity

    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()} == {0.0}
    some = spark.createDataFrame([(i * 3, i % 2) for i in range(60)] + [(None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, some)
    assert toxicity.scored(docs, model).count() == docs.count() and toxicity.scored(nothing, model).count() == 0


def test_isotonic_never_falls():
    from chronoline.llm.toxicity import Isotonic

    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    out = Isotonic(x, y)(np.linspace(-4, 4, 200))
    assert (np.diff(out) >= 0).all() and 0 < out[0] < out[-1] < 1


# -- 4 -------------------------------------------------------------------------------------
@pytest.mark.parametrize("owners", [2, 23])
def test_katz_equals_dictionaries(spark, docs, nothing, rows, owners):
    from chronoline.llm import katz

    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", owners)
    try:
        got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.score(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    held = [zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    want = sorted((r[0], *b[:3], round(b[3], 6), round(b[4], 6)) for r, b in zip(rows, katz.brute([r[1] for r in rows], held)))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-7)
    assert katz.score(nothing).count() == 0


def test_katz_levels_sum_to_one():
    """P(w | first) over all words, the unknown one and the end."""
    from chronoline.llm import katz

    texts = ["a b a b c", "b c a", "a a a b", "c"]
    score = lambda t: katz.brute([*texts, t], [False] * len(texts) + [True])[-1][4]
    for first in ("a", "b", "c", "zz"):
        begin = score(first) - _end(texts, first)  # log10 P(first | begin)
        total = 10 ** _end(texts, first)
        for w in ("a", "b", "c", "yy"):
            total += 10 ** (score(f"{first} {w}") - begin - _end(texts, w))
        assert total == pytest.approx(1.0, rel=1e-9)


def _end(texts, word):
    """log10 P(end | word) by the definition, from counts."""
    import math
    from collections import Counter, defaultdict

    from chronoline.llm import katz

    uni, big = Counter(), defaultdict(Counter)
    for t in texts:
        row = [*t.split(), None]
        uni.update(row)
        for a, b in zip([0, *row], row):
            big[a][b] += 1
    norm = sum(uni.values()) + katz.ADD * (len(uni) + 1)
    times = np.zeros(katz.GT + 2)
    for c in big.values():
        for r in c.values():
            times[min(r, katz.GT + 1)] += r <= katz.GT + 1
    d = katz.Discounts(times)
    cut = lambda r: r - d.d[r if r <= katz.GT else 0]
    c, p1 = big.get(word), (uni[None] + katz.ADD) / norm
    if not c:
        return math.log10(p1)
    if None in c:
        return math.log10(cut(c[None]) / sum(c.values()))
    left = 1 - sum(map(cut, c.values())) / sum(c.values())
    return math.log10(left / (1 - sum((uni[x] + katz.ADD) / norm for x in c)) * p1)


# -- 5 -------------------------------------------------------------------------------------
def _brute_suffixes(strings, weights, depth):
    from collections import Counter

    c = Counter()
    for s, x in zip(strings, weights):
        for i in range(len(s) - depth + 1):
            c[s[i : i + depth]] += x
    return [[i for i in range(len(s) - depth + 1) if c[s[i : i + depth]] >= 2] for s in strings]


@pytest.mark.parametrize("limit", [1 << 26, 64])
def test_induced_sorting_order_and_common_prefixes(limit, monkeypatch):
    from chronoline.llm import induced

    monkeypatch.setattr(induced.BucketQueue.__init__, "__defaults__", (limit,))  # 64: the queues live on disk
    rng = random.Random(limit)
    for _ in range(600 if limit > 64 else 60):
        letters = rng.choice([b"ab", b"abc", b"a", b"\x00\xff", bytes(range(256))])
        strings = [bytes(rng.choices(letters, k=rng.randint(0, rng.choice([3, 12, 40])))) for _ in range(rng.randint(1, 6))]
        depth = rng.choice([1, 2, 3, 5, 8])
        weights = np.array([rng.choice([1, 1, 2]) for _ in strings])
        s = induced.Sorter(strings, depth)
        pos, val = s.sort()
        suffix = [tuple(s.text[p : s.ends[np.searchsorted(s.ends, p)]].tolist()) for p in pos.tolist()]
        assert len(pos) == sum(map(len, strings))
        for i in range(1, len(pos)):
            a, b = suffix[i - 1], suffix[i]
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert a >= b and val[i] == min(same, depth)
        assert [x.tolist() for x in induced.repeated_starts(strings, weights, depth)] == _brute_suffixes(strings, weights, depth)


def _joined_strings(rng):
    """Strings of up to 60 letters and some put together of them, so that long substrings begin one another."""
    letters = rng.choice([b"ab", b"abc", b"a", b"\x00\xff", b"abcdefghij", bytes(range(256))])
    base = [bytes(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(rng.randint(1, 4))]
    return list(dict.fromkeys(base + [a + b for a in base[:2] for b in base[:2]]))


def test_order_of_strings_that_begin_alike():
    from chronoline.llm import induced

    rng = random.Random(5)
    for _ in range(800):
        s = induced.Sorter(_joined_strings(rng), 200)
        pos, _ = s.sort()
        suffix = [s.text[p : s.ends[np.searchsorted(s.ends, p)]].tolist() for p in pos.tolist()]
        assert all(a >= b for a, b in zip(suffix, suffix[1:]))


def test_external_sorting_equals_that_in_memory(monkeypatch):
    """All levels of the recursion, ranges, pieces, steps and queues of any size."""
    from chronoline.llm import external, induced

    rng = random.Random(8)
    for _ in range(250):
        strings, depth = _joined_strings(rng), rng.choice([1, 2, 5, 200])
        for name, values in (("IN_MEMORY", [0, 1, 3, 20]), ("RANGE", [1, 3, 8, 50]), ("PIECE", [2, 5, 16, 1000]), ("STEP", [1, 2, 7, 64])):
            monkeypatch.setattr(external, name, rng.choice(values))
        pos, val = induced.Sorter(strings, depth).sort()
        sorter = external.ExternalSorter(iter(strings), np.array([len(x) for x in strings]), depth, rng.choice([0, 64, 1 << 20]))
        got = [np.array(x) for x in sorter.sort()]
        sorter.close()
        assert (pos == got[0]).all() and (val == got[1]).all()


def test_large_shard_is_sorted_in_bounded_memory():
    """More than the queues may hold, with the production limits: the same windows as by counting, in a fraction of the memory."""
    import subprocess
    import sys

    code = """
import os, re, resource, sys
sys.path.insert(0, sys.argv[1])
import numpy as np
from chronoline.llm import suffixdedup as s, external
rng = np.random.default_rng(4)
words = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) for n in rng.integers(2, 9, 3000)]
passages = [b" ".join(words[k] for k in rng.integers(0, 3000, 60)) for _ in range(400)]
held = s._Segments()
total = {}
for i in range(36000):
    own = b" ".join(words[k] for k in rng.integers(0, 3000, 45))
    body = own[: i % 200] + passages[i % 400] + own[i % 200 :]
    held.add(body, 1)
assert held.file is not None and held.size > s.EXTERNAL > external.IN_MEMORY
for i, body in enumerate(held._read()):
    if i % 40 == 0:
        for k in range(len(body) - 199):
            total[hash(body[k : k + 200])] = 0
for body in held._read():
    for k in range(len(body) - 199):
        h = hash(body[k : k + 200])
        if h in total:
            total[h] += 1
import threading, time
def now():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+([0-9]+)", open("/proc/self/smaps_rollup").read()))) // 1024
before, peak, stop = now(), [0], []
def watch():
    while not stop:
        peak[0] = max(peak[0], now())
        time.sleep(0.05)
t = threading.Thread(target=watch, daemon=True); t.start()
hits = [h if i % 40 == 0 else len(h) for i, h in enumerate(held.repeated(200))]
stop.append(1); t.join()
bodies = 0
rng = np.random.default_rng(4)
words = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) for n in rng.integers(2, 9, 3000)]
passages = [b" ".join(words[k] for k in rng.integers(0, 3000, 60)) for _ in range(400)]
for i in range(36000):
    own = b" ".join(words[k] for k in rng.integers(0, 3000, 45))
    body = own[: i % 200] + passages[i % 400] + own[i % 200 :]
    if i % 40 == 0:
        want = [k for k in range(len(body) - 199) if total[hash(body[k : k + 200])] > 1]
        assert hits[i].tolist() == want, i
        bodies += bool(want)
print(held.size >> 20, bodies, peak[0] - before)
"""
    import os

    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code, repo], capture_output=True, text=True, timeout=240)
    assert out.returncode == 0, out.stderr[-2000:]
    size, bodies, memory = map(int, out.stdout.split())
    assert size >= 20 and bodies > 800
    assert memory < 16 * size  # in memory it takes more than 50 bytes for each


def test_suffix_dedup_equals_counting(docs, nothing, rows):
    from chronoline.llm import suffixdedup

    got = sorted(tuple(r) for r in suffixdedup.digests(suffixdedup.without_repeats(docs)).collect())
    want = sorted((r[0], *b) for r, b in zip(rows, suffixdedup.brute([r[1] for r in rows])))
    assert got == want and any(w[2] for w in want)
    assert suffixdedup.without_repeats(nothing).count() == 0


@pytest.mark.parametrize("external", [1 << 30, 300])
def test_suffix_dedup_splits_hot_pieces(spark, monkeypatch, external):
    from chronoline.llm import suffixdedup

    monkeypatch.setattr(suffixdedup, "HOT", 3)
    monkeypatch.setattr(suffixdedup, "SHARD_BYTES", 500)
    monkeypatch.setattr(suffixdedup, "EXTERNAL", external)
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = [" ".join(word() for _ in range(60)) + PASSAGE[: rng.randint(150, 600)] + " ".join(word() for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(tuple(r) for r in suffixdedup.digests(suffixdedup.without_repeats(docs)).collect())
    assert got == [(i, *b) for i, b in enumerate(suffixdedup.brute(texts))]


def test_cut_repeats_keeps_rows_and_valid_text(docs, rows):
    from chronoline.llm import suffixdedup

    got = suffixdedup.cut_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    left = {r.doc_id: r.text for r in got.collect()}
    assert left[1000] is None and PASSAGE[:250] not in "".join(t or "" for t in left.values())


# -- 6 -------------------------------------------------------------------------------------
def _fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def _components(values, budget):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_equals_all_pairs(docs, nothing, rows):
    from chronoline.llm import simhash

    values = [_fingerprint(r[1]) for r in rows]
    roots = _components(values, 4)
    least = {k: min(rows[i][0] for i in range(len(rows)) if roots[i] == k) for k in set(roots)}
    want = sorted((rows[i][0], values[i], least[roots[i]]) for i in range(len(rows)))
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(nothing).count() == 0


def test_keep_one_equals_all_pairs_of_wide_fingerprints(docs, nothing, rows):
    from chronoline.llm import simhash

    wide = simhash.sketch(pa.array([r[1] for r in rows], pa.string()))
    limit = simhash.Plan.wide().limit
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(wide ^ wide[i]).sum(1) <= limit).tolist():
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    want = sorted({min(rows[i][0] for i in range(len(rows)) if root[i] == k) for k in set(root)})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert simhash.keep_one(nothing).count() == 0


def test_wide_fingerprints_estimate_the_similarity_of_shingles():
    import math

    from chronoline.llm import simhash

    rng = random.Random(3)
    errors = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for _ in range(rng.randrange(12)):
            other[rng.randrange(300)] = f"v{rng.randrange(5000)}"
        a, b = simhash.sketch(pa.array([" ".join(words), "  ".join(other).upper()]))
        share = int(np.bitwise_count(a ^ b).sum()) / 256
        cosine = math.cos(math.pi * share)
        errors.append(cosine / (2 - cosine) - simhash.jaccard(" ".join(words), " ".join(other)))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


@pytest.mark.parametrize("hot", [10**9, 40])
def test_wide_tries_find_near_copies_in_dense_groups(spark, monkeypatch, hot):
    from chronoline.llm import graphs, simhash

    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(5)
    plan = simhash.Plan.wide()
    centres = rng.integers(0, 1 << 63, (8, 4), dtype=np.uint64)
    fps = [c for c in centres]
    for c in centres:
        for _ in range(50):
            flips = np.packbits(rng.random(256) < 0.06).view(">u8").astype(np.uint64)
            fps.append(c ^ flips)
    fps = np.array(fps)
    found = simhash.spanning_links(spark.createDataFrame([(bytearray(f.astype("<u8").tobytes()),) for f in fps], "fp binary"), plan, len(fps)).collect()
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for r in found:
        a, b = find(bytes(r.a)), find(bytes(r.b))
        root[max(a, b)] = min(a, b)
    names = [find(f.astype("<u8").tobytes()) for f in fps]
    assert len(set(names)) == 8
    assert all(names[8 + i] == names[i // 50] for i in range(400))


def test_joins_deal_frequent_keys_over_tasks(spark):
    from chronoline.llm import graphs

    many = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(600)], "row long, k long")
    one = many.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    got = sorted(tuple(r) for r in graphs.dealt_join(many, one, "k", "row", 600).select("row", "k", "v").collect())
    assert got == [(i, 7 if i % 3 else i, 14 if i % 3 else 2 * i) for i in range(600)]


@pytest.mark.parametrize(("hot", "plan"), [(10**9, (5, 1)), (10**9, (6, 2)), (10, (5, 1)), (10, (7, 3))])
def test_trie_join_links_dense_groups(spark, monkeypatch, hot, plan):
    from chronoline.llm import graphs, simhash

    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    monkeypatch.setattr(simhash, "block_plan", lambda rows, budget: plan)
    rng = random.Random(7)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            v = centre
            for _ in range(rng.randrange(7)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    roots = _components(values, 4)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    got = {r.node % (1 << 64): r.root for r in graphs.star_components(links, "a", "b").collect()}
    mine = [got.get(v, v if v < 1 << 63 else v - (1 << 64)) for v in values]
    assert len(set(zip(mine, roots))) == len(set(mine)) == len(set(roots))


# -- 7 -------------------------------------------------------------------------------------
def test_order_minhash_edits(docs, nothing, rows):
    from chronoline.llm import ordermin

    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt, cut = order[(k + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = ordermin.signature(t), ordermin.signature(edited), ordermin.signature(nxt)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), ordermin.as_text(a), ordermin.as_text(b), ordermin.likeness(a, b), ordermin.likeness(a, c)))
    assert sorted(map(tuple, ordermin.edits(docs).collect())) == sorted(want)
    assert ordermin.edits(nothing).count() == 0
    one = ordermin.edits(docs.where("doc_id = 1003")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_order_minhash_by_definition_and_order():
    from chronoline.llm import ordermin

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(400)]
    text = " ".join(words)
    moved = " ".join(words[200:] + words[:200])
    near = " ".join(words[:390] + words[:10])
    a = ordermin.signature(text)
    assert ordermin.likeness(a, ordermin.signature(text)) == 1.0
    assert ordermin.likeness(a, ordermin.signature(near)) > 0.8
    assert ordermin.likeness(a, ordermin.signature(moved)) < ordermin.likeness(a, ordermin.signature(near))
    assert ordermin.likeness(ordermin.signature(""), ordermin.signature("")) == 1.0


# -- 8 -------------------------------------------------------------------------------------
def test_ppm_costs_and_predictions(docs, nothing, rows):
    from chronoline.llm import language

    model = language.train(docs.where(~language.held_out()))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and got[1000].score == 0
    judged = [(r[0], r[2]) for r in rows if r[2] and r[0] < 1000 and len(r[1]) > 200 and PASSAGE not in r[1]]
    assert sum(got[i].lang_pred == lang for i, lang in judged) >= 0.95 * len(judged)
    tree = language.ContextTree(["abab abba", "ba"])
    for context in (b"", b" ", b" a", b"xab", b"b"):  # every byte's share sums to one
        assert sum(np.exp(-tree.cost(context, b)) for b in range(256)) == pytest.approx(1.0)
    raw = np.frombuffer(b"abba", np.uint8)
    coded = b" abba "
    want = sum(model.trees[0].cost(coded[max(0, i - language.ORDER) : i], coded[i]) for i in range(1, len(coded)))
    assert model.words(raw, np.array([0]), np.array([4]))[0, 0] == pytest.approx(want)
    empty = language.train(nothing)
    assert {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


def test_ppm_learns_more_languages_than_the_frequent_ones(spark, nothing):
    from chronoline.llm import language

    rng, rows = random.Random(4), []
    for k in range(80):
        letters = [chr(0x4E00 + 20 * k + i) for i in range(20)]
        rows += [(len(rows) + i, " ".join("".join(rng.choices(letters, k=4)) for _ in range(30)), f"l{k:02}") for i in range(4 if k < 70 else 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.names == sorted({r[2] for r in rows}) and len(model.names) == 80
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()} == {r[0]: r[2] for r in rows}


# -- 9 -------------------------------------------------------------------------------------
def test_licence_places_equal_plain_comparison(spark, nothing):
    from chronoline.llm import licenses

    rng = random.Random(9)
    words = "under the mit license apache version 2 cc by nc xx Licensed 0".split()
    rows = [(i, rng.choice([" ", "-", ", "]).join(rng.choices(words, k=rng.randrange(120)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "Licensed under the Apache License, Version 2.0."), (503, "This work is licensed under the GNU General Public License, version 3."), (504, "All rights reserved.")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        base = licenses.brute_base(w)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None))
        assert r.base_labels == sorted({k for _, k in base}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert got[502].labels == ["apache-2"] and got[503].labels == ["gpl-3"] and got[504].labels == ["proprietary"] and got[500].score == 0
    assert licenses.scan_licenses(nothing).count() == 0


# -- 10 ------------------------------------------------------------------------------------
def _bench(rng):
    words = "alpha beta gamma delta eps zeta".split()
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 13, 14, 40])))) for i in range(12)]
    return items + [(90, None), (91, ""), (92, "..."), (10, items[0][1])], words


@pytest.mark.parametrize("block", [2_000_000, 20])
def test_wu_manber_equals_brute_force(spark, monkeypatch, block):
    from chronoline.llm import decontaminate

    monkeypatch.setattr(decontaminate, "PATTERN_WORDS", block)
    rng = random.Random(block)
    items, words = _bench(rng)
    texts = [" ".join(rng.choices([*words, "other"], k=rng.choice([0, 4, 300, 900]))) + (" " + items[rng.randrange(10)][1].upper() if i % 2 else "") for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "!"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.digests(decontaminate.contamination(docs, bench)).collect())
    want = []
    for i, t in rows:
        n, hit, found, sha = decontaminate.brute(t, items)
        want.append((i, n, hit, found, sha, hit > 0 and hit * 20 >= n))
    assert got == sorted(want)
    clean = decontaminate.keep_clean(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[-1])
    assert decontaminate.contamination(docs, bench.limit(0)).where(F.size("items") > 0).count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_hashes_and_word_spans():
    from chronoline.llm import common

    texts = ["Ab cd", None, "", "x" * 100 + " y", "é è"]
    raw, at = common.text_bytes(pa.array(texts))
    starts, stops, first = common.word_spans(common.LOWER[raw], at, common.NON_SPACE)
    low = common.LOWER[raw].tobytes()
    assert [low[a:b].decode() for a, b in zip(starts, stops)] == ["ab", "cd", "x" * 100, "y", "é", "è"] and first.tolist() == [0, 2, 2, 2, 4, 6]
    h = common.hash_spans(common.LOWER[raw], starts, stops).tolist()
    assert h == [common.hash_word(w) for w in (b"ab", b"cd", b"x" * 100, b"y", "é".encode(), "è".encode())] and len(set(h)) == 6
