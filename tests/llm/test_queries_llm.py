"""Every registered query on the smallest tables against a version by definition, and without the package on executors."""

import hashlib
import math
import os
import re
import subprocess
import sys
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

pytest.importorskip("chronoline.llm")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from chronoline.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def by_id(spark, name, key="doc_id"):
    rows = queries.QUERIES[name](spark, SF).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def rest(key, mod):
    return zlib.crc32(str(key).encode()) % mod


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1(spark, texts):
    import base64

    with open(public_tokenizers.path(queries.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(spark, "op1_byte_bpe")
    assert set(got) == set(texts)
    for k, r in got.items():
        ids = library.encode_ordinary(texts[k] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[k] or ""))


def test_op1_whatever_the_order_of_rows(spark, texts):
    """The input's rows come in another order each time that it is evaluated."""
    from pyspark.sql import functions as F

    from chronoline.llm import bpe, katz

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3).withColumn("r", F.rand()).sortWithinPartitions("r").drop("r")
    path = public_tokenizers.path(queries.RANKS)
    out = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()}
    assert out == {k: (t or "").encode() for k, t in texts.items()}
    want = {r.doc_id: round(r.score, 6) for r in queries.op4_katz(spark, SF).collect()}
    assert {r.doc_id: round(r.score, 6) for r in katz.score(docs).collect()} == want


def _links(pages):
    """(host, host) of links by a plain reading of the markup."""
    out = Counter()
    for url, html in pages:
        host = lambda u: re.split(r"[/?#]", u.split("://", 1)[1])[0].translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) if u and "://" in u else ""
        for m in re.findall(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", html or ""):
            to = host(m if "://" in m else "x:" + m if m.startswith("//") else "")
            if host(url) and to and to != host(url):
                out[host(url), to] += 1
    return out


def _ranks(links, seeds, damping=0.85):
    """Personalised PageRank by a dense linear system."""
    names = sorted({x for e in links for x in e} | set(seeds))
    at = {h: i for i, h in enumerate(names)}
    m, total = np.zeros((len(names), len(names))), Counter()
    for (a, _), n in links.items():
        total[a] += n
    for (a, b), n in links.items():
        m[at[b], at[a]] = n / total[a]
    s = np.zeros(len(names))
    for h, w in seeds.items():
        s[at[h]] = w / sum(seeds.values())
    return dict(zip(names, np.linalg.solve(np.eye(len(names)) - damping * m, (1 - damping) * s)))


def _judged(pages, rules, threshold):
    parts = []
    for page, url, html in pages:
        rest_ = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest_)[0].lower()
        path = re.split(r"[?#]", rest_[len(host) :])[0]
        fits = [(len(r), -i, v, r) for i, (v, r) in enumerate(rules) if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        parts.append((page, host, path, *(max(fits)[2:] if fits else (None, None))))
    links = _links([(u, h) for _, u, h in pages])
    n = Counter(p[1] for p in parts)
    trust = _ranks(links, Counter(p[1] for p in parts if p[3] == "allow"))
    back = Counter({(b, a): k for (a, b), k in links.items()})
    distrust = _ranks(back, Counter(p[1] for p in parts if p[3] == "block"))
    out = {}
    for page, host, path, verdict, rule in parts:
        t, d = (min(1.0, x.get(host, 0.0) * len(parts) / n[host]) for x in (trust, distrust))
        out[page] = (host, path, rule, verdict or ("block" if d >= threshold and d > t else "allow"), t, d)
    return out


def test_op2(spark):
    from chronoline.llm import urls

    pages = [tuple(r.values()) for r in pq.read_table(f"{SF}/pages.parquet", columns=["page_id", "url", "html"]).to_pylist()]
    want = _judged(pages, urls.RULES, urls.THRESHOLD)
    got = by_id(spark, "op2_link_trust", "page_id")
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {k: v[:4] for k, v in want.items()}


def test_op2_over_links_between_hosts(spark):
    from chronoline.llm import urls

    def page(i, host, path, *to):
        return (i, f"http://{host}{path}", "".join(f"<a href='{t if t.startswith(('/', '#')) else 'http://' + t}'>" for t in to))

    pages = [
        page(1, "a.org", "/x", "b.net/1", "//c.net/2"), page(2, "b.net", "/", "c.net/", "/own", "#here"), page(3, "c.net", "/", "spam.example.org/es/1"), page(4, "spam.example.org", "/es/1", "c.net/"),
        page(5, "d.net", "/", "spam.example.org/es/1", "bad.com/de/"), page(6, "e.net", "/", "d.net/"), page(7, "f.net", "/", "e.net/", "a.org/x"), page(8, "bad.com", "/de/1"), page(9, "g.net", "/"), (10, None, None), (11, "no-scheme", "<a href='http://d.net/'>"),
    ]
    want = _judged(pages, urls.RULES, urls.THRESHOLD)
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages) and {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    for r in got:
        host, path, rule, verdict, t, d = want[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
        assert r.trust == pytest.approx(t, abs=1e-4) and r.distrust == pytest.approx(d, abs=1e-4)


def test_op2_reads_the_base_of_relative_links(spark):
    from chronoline.llm import urls

    pages = spark.createDataFrame([("http://a.net/", "<BASE href='http://B.net/x/'><a href=y><a href='/z'><a href='#q'><a href='mailto:me'>")], "url string, html string")
    assert [tuple(r) for r in urls.host_edges(pages).collect()] == [("a.net", "b.net", 3)]  # the base itself and two links


def test_op3_trees_by_exhaustive_search():
    """Each split of a tree is the best of all splits, and each leaf the step that the loss asks for."""
    from chronoline.llm.toxicity import Boosted

    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (80, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (rng.random(80) < 0.1)).astype(float)
    b = Boosted(x, y)
    f = np.full(80, math.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1))))
    for feature, cut, value in b.trees[:5]:
        p = 1 / (1 + np.exp(-f))
        g, h, binned, at = y - p, p * (1 - p), b._binned(x), np.zeros(80, int)
        for node in range(7):
            here = np.flatnonzero(at == node)
            gains = {}
            for j in range(3):
                for c in range(int(binned.max()) + 1):
                    left, right = here[binned[here, j] <= c], here[binned[here, j] > c]
                    if min(len(left), len(right)) >= b.LEAST:
                        gains[j, c] = sum(g[s].sum() ** 2 / (h[s].sum() + b.RIDGE) for s in (left, right)) - g[here].sum() ** 2 / (h[here].sum() + b.RIDGE)
            best = max(gains.values(), default=0)
            if best > 1e-6:
                assert gains[feature[node], cut[node]] == pytest.approx(best)
            else:
                assert feature[node] == -1
            at[here] = 2 * node + 1 + (binned[here, feature[node]] > cut[node] if feature[node] >= 0 else 0)
        leaf = at - 7
        for k in set(leaf):
            assert value[k] == pytest.approx(g[leaf == k].sum() / (h[leaf == k].sum() + b.RIDGE) * b.RATE)
        f += value[leaf]
    b.trees = b.trees[:5]
    assert b.margin(x) == pytest.approx(f)


def test_op3(spark, texts):
    got = by_id(spark, "op3_toxicity")
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r.held_out == (rest(k, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_op3_lexicon_without_a_row_equals_one_learned_without_it(spark):
    """A row's own features never come from its own counts."""
    from chronoline.llm import toxicity

    rng = np.random.default_rng(2)
    rows = [("foul nasty " if y else "fine ") + " ".join(f"w{k}" for k in rng.integers(0, 30, 12)) for y in rng.integers(0, 2, 40)]
    labels = [int(t.startswith("foul")) for t in rows]

    def entries(skip):
        found = defaultdict(lambda: [0, 0])
        for i, (t, y) in enumerate(zip(rows, labels)):
            if i != skip:
                for stem in (0, *toxicity.STEMS):
                    import pyarrow as pa

                    for h in toxicity._entries(pa.array([t]), stem)[1].tolist():
                        found[stem, h][1 - y] += 1
        return [(s, h, *v) for (s, h), v in found.items()]

    toxic, clean = sum(labels), len(labels) - sum(labels)
    whole = entries(None)
    for i in (0, 1, 2, 3):
        y = labels[i]
        mine = toxicity.Lexicon(entries(i), toxic - y, clean - (1 - y))
        left = toxicity.Lexicon(whole, toxic, clean, without=y)
        import pyarrow as pa

        assert toxicity.features(pa.array([rows[i]]), mine).tolist() == toxicity.features(pa.array([rows[i]]), left).tolist()


def test_op4(spark, texts):
    from chronoline.llm import katz

    keys = sorted(texts)
    want = katz.brute([texts[k] for k in keys], [rest(k, 10) == 0 for k in keys])
    got = by_id(spark, "op4_katz")
    for k, (n, known, train, base, score) in zip(keys, want):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(k, 10) == 0, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_op4_counts_beyond_32_bits():
    from chronoline.llm.common import packed, unpacked
    from chronoline.llm.katz import _added

    names = np.array([7, 9, 7, 7], np.uint64)
    counts = np.array([1 << 32, 5, 1 << 33, 3], np.uint64)
    total, which = _added(names, unpacked(packed(counts)))
    assert total[which].tolist() == [3 * (1 << 32) + 3, 5, 3 * (1 << 32) + 3, 3 * (1 << 32) + 3]


def test_op5(spark, texts):
    from chronoline.llm import suffixdedup

    keys = sorted(texts)
    got = by_id(spark, "op5_suffix_dedup")
    assert [tuple(got[k]) for k in keys] == [(k, *b) for k, b in zip(keys, suffixdedup.brute([texts[k] for k in keys]))]


def test_op6(spark, texts):
    import xxhash

    keys = sorted(texts)
    fps = []
    for k in keys:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (texts[k] or "").encode().translate(LOW))
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    root = list(range(len(keys)))
    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if (a ^ b).bit_count() <= 4 and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    got = by_id(spark, "op6_simhash_trie")
    assert {k: (got[k].fingerprint, got[k].component_id) for k in keys} == {k: (f"{f:016x}", keys[r]) for k, f, r in zip(keys, fps, root)}


def _order_min(text):
    """The signature by definition: numbered k-mers dealt to bins, the smallest of a bin in text order."""
    from chronoline.llm import ordermin as o

    raw = text.encode()
    if not raw:
        return [0] * o.BINS
    n = max(1, len(raw) - o.K + 1)
    low = max(20, n.bit_length())
    mixed = lambda v: int(o.mix(np.array([v % (1 << 64)], np.uint64))[0])
    seen, bins = Counter(), defaultdict(list)
    for i in range(n):
        name = mixed(int.from_bytes(raw[i : i + o.K].ljust(o.K, b"\0"), "little") + int(o._C)) >> low
        number = mixed(name * int(o._C) + seen[name]) >> low
        seen[name] += 1
        bins[number >> (64 - low - 6)].append((number, i))
    out = []
    for b in range(o.BINS):
        total = 0
        least = sorted(bins.get(b, []))[: o.DEPTH]
        for number, _ in sorted(least, key=lambda x: x[1]):
            total = mixed(total * int(o._C) + number + 1)
        for _ in range(o.DEPTH - len(least)):
            total = mixed(total * int(o._C))
        out.append(total % 65535 % 65536 + 1 if least else 0)
    return out


def test_op7(spark, texts):
    from chronoline.llm import ordermin

    short = {k: t for k, t in texts.items() if len(t or "") < 3000}
    for t in [*list(short.values())[:25], "", "a", "aaaaaaaaaaaaaaaaaaaaaaaa", "abcdefgh"]:
        assert ordermin.signature(t or "").tolist() == _order_min(t or "")
    got = by_id(spark, "op7_order_minhash")
    keys = sorted(texts, reverse=True)
    for i, k in enumerate(keys):
        t, nxt = texts[k] or "", texts[keys[(i + 1) % len(keys)]] or ""
        cut = len(t) // 3
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), sha(t[: len(t) - cut] + nxt[:cut]))
        assert got[k].fingerprint == ordermin.as_text(ordermin.signature(t))


def test_op7_with_names_as_keys(spark):
    from chronoline.llm import ordermin

    rows = [(f"k{i:02d}", f"text number {i} " * 5) for i in range(30)] + [(None, "no key")]
    got = ordermin.edits(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    order = sorted([r for r in rows if r[0]], reverse=True) + [(None, "no key")]
    want = {}
    for i, (k, t) in enumerate(order):
        nxt, cut = order[(i + 1) % len(order)][1], len(t) // 3
        want[k] = sha(t[: len(t) - cut] + nxt[:cut])
    assert {r.doc_id: r.edited_sha256 for r in got} == want


def test_op8_predictions_by_the_definition(spark, texts):
    from chronoline.llm import language

    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    taught = defaultdict(list)
    for k, t in texts.items():
        if t is not None and langs[k] is not None and rest(k, 4) != 2:
            taught[langs[k]].append(t)
    assert all(len(v) <= language.TRAIN_ROWS for v in taught.values())  # nothing was left out
    trees = {lang: language.ContextTree(v) for lang, v in taught.items()}
    got = by_id(spark, "op8_ppm_language")
    assert all(r.held_out == (rest(k, 4) == 2) for k, r in got.items())
    for k in sorted(texts, key=lambda k: len(texts[k] or ""))[:60]:
        t = texts[k]
        if not t or not any(map(str.isalpha, t)):
            assert got[k].lang_pred == "und" and got[k].score == 0
            continue
        cost = {}
        for lang, tree in trees.items():
            cost[lang] = 0.0
            for word in re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(LOW)):
                coded = b" " + word + b" "
                cost[lang] += sum(tree.cost(coded[max(0, i - language.ORDER) : i], coded[i]) for i in range(1, len(coded)))
        best = min(sorted(cost), key=cost.get)
        assert got[k].lang_pred == best
        assert got[k].score == pytest.approx(1 / sum(math.exp(max(cost[best] - c, -700)) for c in cost.values()), rel=1e-6)


def _covered(words, template, versions):
    """Largest share of a template that matches in order can cover, by brute force over maximal matches; None below the rules."""
    from chronoline.llm import licenses as m

    least = min(m.MIN_MATCH, len(template))
    matches = [(i, j, n) for i in range(len(words)) for j in range(len(template)) if (i == 0 or j == 0 or words[i - 1] != template[j - 1]) for n in [next((k for k in range(min(len(words) - i, len(template) - j) + 1) if k == min(len(words) - i, len(template) - j) or words[i + k] != template[j + k]))] if n >= least]
    best = 0
    for i, j, n in matches:
        if n >= m.COVER * len(template) and all(j <= v < j + n for v in versions):
            best = max(best, n / len(template))
    return best


def test_op9(spark, texts):
    from chronoline.llm import licenses as m

    got = by_id(spark, "op9_license_automaton")
    for k, t in texts.items():
        words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOW))]
        base = sorted((i, name) for name, phrase in m.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        r = got[k]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(base), ",".join(sorted({b for _, b in base})))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        # One unbroken match that covers a template must be found; a label needs some match of its template.
        known = {w for v in m.TEMPLATES.values() for x in v for w in x.split()}
        if len(words) < 1500 and len(known & set(words)) >= m.MIN_MATCH:
            for label, templates in m.TEMPLATES.items():
                for x in (y.split() for y in templates):
                    versions = [i for i, w in enumerate(x) if w.isdigit()] if re.search(r"-\d+$", label) else []
                    if any(words[i : i + 3] == x[:3] for i in range(len(words))) and _covered(words, x, versions):
                        assert label in r.labels.split(",")


def test_op9_versions_and_matching_statistics(spark):
    from chronoline.llm import licenses as m

    cases = {
        "Licensed under the Apache License, Version 1.1": "", "Licensed under the Apache License, Version 2.0": "apache-2", "GNU General Public License version 1": "", "GNU General Public License version 4": "",
        "GNU General Public License, version 3": "gpl-3", "GNU Affero General Public License version 1": "", "GNU Affero General Public License version 3": "agpl-3", "Licensed under CC BY-NC 4.0": "cc-by-nc", m._MIT[0].upper(): "mit", m._MIT[0].replace("deal in the software without restriction", "deal in it freely"): "mit",
    }
    got = m.scan_licenses(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert {list(cases)[r.doc_id]: ",".join(r.labels) for r in got} == cases
    scanner = m.Scanner()
    rng = np.random.default_rng(3)
    sequences = [[int(scanner.numbered(np.array([m.hash_word(w.encode())], np.uint64))[0]) for w in t.split()] for t in [*m.BASE.values(), *(x for v in m.TEMPLATES.values() for x in v)]]
    grams = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, min(len(s), i + 14) + 1)}
    stream = []
    while len(stream) < 400:
        s = sequences[rng.integers(len(sequences))]
        a = rng.integers(len(s))
        stream += s[a : a + int(rng.integers(1, 13))]
    state = length = 0
    for i, token in enumerate(stream):
        state, length = scanner.automaton.step(state, length, token)
        want = max(n for n in range(min(i + 1, 14) + 1) if n == 0 or tuple(stream[i + 1 - n : i + 1]) in grams)
        assert min(length, 14) == want


def test_op10(spark, texts):
    from chronoline.llm import decontaminate

    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = by_id(spark, "op10_wu_manber")
    for k in sorted(texts)[::4]:
        n, hit, n_items, digest = decontaminate.brute(texts[k], items)
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, n_items, digest, hit > 0 and 20 * hit >= n)


def test_clean_rows_are_the_same_over_several_blocks_of_items(spark, monkeypatch):
    from chronoline.llm import decontaminate

    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    once = sorted(r.doc_id for r in decontaminate.keep_clean(docs, items).collect())
    monkeypatch.setattr(decontaminate, "PATTERN_WORDS", 100)
    assert len(list(decontaminate._item_blocks(items, "item_id", "text"))) > 2
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, items).collect()) == once


CLASHING = ["__n", "__key", "__hash", "n_bytes", "spans", "kept", "a.b", "key", "hash", "rest", "text2", "fp", "_0", "h1", "score", "part"]


def test_clashing_dotted_and_map_columns(spark):
    from pyspark.sql import functions as F

    from chronoline.llm import bpe, decontaminate, katz, language, licenses, ordermin, simhash, suffixdedup, toxicity

    passage = " ".join(f"w{i}" for i in range(80))
    rows = [(i, None if i == 5 else f"{passage if i < 3 else ''} own{i} text{i} of{i} words{i} here{i}") for i in range(8)] + [(7, "own7 text7"), (7, "own7 text7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASHING:
        docs = docs.withColumn(c, F.lit(c))
    docs = docs.withColumn("a map", F.create_map(F.lit("k"), F.col("doc_id")))
    items = spark.createDataFrame([(1, "own6 text6 of6")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    path = public_tokenizers.path(queries.RANKS)
    same = docs.columns
    for out in (simhash.keep_one(docs), suffixdedup.cut_repeats(docs), decontaminate.keep_clean(docs, items), toxicity.keep_clean(docs, model)):
        assert out.columns == same
        for r in out.collect():
            assert all(r[c] == c for c in CLASHING)
    stripped = suffixdedup.without_repeats(docs)
    assert len(set(stripped.columns)) == len(stripped.columns) and suffixdedup.digests(stripped).count() == len(rows)
    taught = language.train(docs.withColumn("lang", F.lit("xx")))
    for out in (bpe.encode(docs, path, public_tokenizers.PATTERN), katz.score(docs), language.identify(docs, taught), licenses.scan_licenses(docs), ordermin.edits(docs), simhash.near_duplicates(docs), toxicity.scored(docs, model), decontaminate.contamination(docs, items)):
        assert out.count() == len(rows)


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Started elsewhere, with the package on the driver's path only."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
    import os, sys
    from pyspark.sql import SparkSession
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    def missing(_):
        try:
            import chronoline
        except ModuleNotFoundError:
            return [1]
        return [0]
    assert spark.sparkContext.parallelize([0], 1).mapPartitions(missing).collect() == [1]
    sys.path.insert(0, {repo!r})
    import __spark_entry__
    for name in ("op3_toxicity", "op8_ppm_language", "op9_license_automaton", "op10_wu_manber", "pipeline"):
        assert __spark_entry__.queries()[name](spark, {SF!r}).count() > 100, name
    print("all ran")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in out.stdout, out.stderr[-3000:]
