"""Each stage of the pipeline against brute force on its predecessor's rows, and the whole against its stages."""

import hashlib
from collections import Counter

import public_tokenizers as vocab
import pytest

import corpus_pipeline
from tallyloom.llm import bpe, mixing
from tests.llm.test_row_operators import brute_lines, brute_targets
from tests.llm.test_text_operators import brute_simhash, groups


@pytest.fixture(scope="module")
def staged(spark, sf_dir, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(f"{top}/{name}")
        out.append(spark.read.parquet(f"{top}/{name}"))
    return out


def rows(df):
    return sorted([tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()])


def test_all_but_the_last_stage_return_the_columns_of_documents(staged):
    assert all(df.columns == staged[0].columns for df in staged[:-1])


def test_clean_documents_keep_their_language(staged):
    assert rows(staged[1]) == rows(staged[0])


def test_lines(staged):
    assert [r[:2] for r in rows(staged[2])] == [x[:2] for x in sorted(brute_lines(rows(staged[1]), 0.02, 5))]
    assert all(r["n_chars"] == len(r["text"]) for r in staged[2].collect())


def test_one_document_of_each_group_stays(staged):
    prints = {}
    for i, text, *_ in rows(staged[2]):
        prints.setdefault(brute_simhash(text), []).append(i)
    first = {min(min(prints[v]) for v in g) for g in groups(list(prints), 2)}
    assert [r[0] for r in rows(staged[3])] == sorted(first)


def test_sources_come_near_their_targets(staged):
    before, after = rows(staged[3]), rows(staged[4])
    size = lambda text: len(text.split())
    sizes, taken = Counter(), Counter()
    for _, text, _, source in before:
        sizes[source] += size(text)
    for _, text, _, source in after:
        taken[source] += size(text)
    largest = max(size(r[1]) for r in before)
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= 1.5 * largest
    times = Counter(r[0] for r in after)
    assert max(times.values()) <= 3 and set(times) <= {r[0] for r in before}
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(staged[3]).collect()}
    assert sum(plan.values()) == pytest.approx(len(after), abs=len(sizes))


def test_tokens_and_run(spark, sf_dir, staged):
    import tiktoken

    ranks = bpe.read_ranks(open(vocab.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text, *_ in rows(staged[4]):
        ids = library.encode_ordinary(text)
        want.append((i, len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted([tuple(r) for r in staged[5].collect()]) == sorted(want)
    assert sorted([tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()]) == sorted(want)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, row string, _n_lines string, fp string, key string, size int, copies string"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_with_nulls_repeats_and_clashing_columns(spark, sf_dir, empty):
    clean = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 200").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(60).collect()]
    junk = [(None, None, None, None, None), (9001, "", "en", None, 0), (9002, "12 34 ...", None, "a", 9), (9003, "xqzj vkwq zzxq qjxw wvkz qxqx jzkq " * 9, None, "a", 315), (9004, None, "en", "a", None)]
    clash = ("h", "r", "n", "f", "k", 7, "c")
    own = [] if empty else [(*r, *clash) for r in [*clean, clean[0], clean[0], *junk, (None, *clean[1][1:])]]
    docs = spark.createDataFrame(own, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), SCHEMA)
        if name == "language" and not empty:
            kept = {r["doc_id"] for r in after.collect()}
            assert not kept & {9001, 9002, 9003, 9004} and {r["doc_id"] for r in clean} <= kept
        docs = after
    got = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(got) == docs.count() and (bool(got) != empty)
