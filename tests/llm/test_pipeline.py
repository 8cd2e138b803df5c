"""Each stage of the corpus pipeline against a brute-force version, on the smallest tables."""

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("chronoline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from chronoline.llm import decontaminate, simhash, suffixdedup, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, by name; 'documents' are the rows before the first."""
    from chronoline.llm.common import stage_table

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": (docs.columns, {r.doc_id: r.text for r in docs.collect()})}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, SF), "test")
        out[name] = (docs.columns, {r.doc_id: r for r in docs.collect()})
        if name != "byte_bpe":
            out[name] = (docs.columns, {k: r.text for k, r in out[name][1].items()})
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "byte_bpe"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][0] == stages["documents"][0]


def test_toxicity(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    before = stages["documents"][1]
    score = dict(zip(before, model.score(pa.array(list(before.values()), pa.string()))))
    assert stages["toxicity"][1] == {k: t for k, t in before.items() if score[k] < toxicity.THRESHOLD}


def test_near_copies(stages):
    """Exactly the components of near fingerprints, which hold all pairs of clear similarity and none of unlike texts."""
    before, after = stages["toxicity"][1], stages["simhash_near_dedup"][1]
    keys = sorted(before)
    wide = simhash.sketch(pa.array([before[k] for k in keys], pa.string()))
    limit = simhash.Plan.wide().limit
    root = list(range(len(keys)))
    for i in range(len(keys)):  # in order of keys, so that a root is the smallest key
        for j in np.flatnonzero(np.bitwise_count(wide ^ wide[i]).sum(1) <= limit).tolist():
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    assert set(after) == {keys[r] for r in root}
    assert all(before[k] == t for k, t in after.items())
    like = {(a, b): s for i, a in enumerate(keys) for b in keys[i + 1 :] if (s := simhash.jaccard(before[a], before[b])) >= 0.6}
    assert not any(s >= 0.8 and a in after and b in after for (a, b), s in like.items())
    near = {k for pair in like for k in pair}
    assert all(k in after or k in near for k in keys)


def test_repeats(stages):
    before, after = stages["simhash_near_dedup"][1], stages["suffix_array_dedup"][1]
    assert set(after) == set(before)
    keys = sorted(before)
    for k, want in zip(keys, suffixdedup.brute([before[k] for k in keys])):
        kept = len(after[k].encode())
        # Characters that a passage covers in part stay: three bytes more at most at each end of a run.
        assert want[0] - want[1] <= kept <= want[0] - want[1] + 6 * want[2]
        if not any(ord(c) > 127 for c in before[k]):
            assert hashlib.sha256(after[k].encode()).hexdigest() == want[3]


def test_contamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = stages["suffix_array_dedup"][1]
    clean = {}
    for k, t in before.items():
        n, hit, *_ = decontaminate.brute(t, items)
        if not (hit > 0 and hit * 20 >= n):
            clean[k] = t
    assert stages["benchmark_decontamination"][1] == clean


def test_tokens(stages):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = stages["benchmark_decontamination"][1], stages["byte_bpe"][1]
    assert set(after) == set(before)
    for k, r in after.items():
        ids = library.encode_ordinary(before[k] or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256((before[k] or "").encode()).hexdigest()
