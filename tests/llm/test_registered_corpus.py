"""The registered corpus queries over whole tables against plain versions."""

import math

import pytest

import brute_force as plain
from loomframe.llm import licenses
from loomframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_op1(spark, rows):
    n = [len(plain.encode("byte_bpe_50k.json", t, [])) for _, t in rows]
    want = [(k, n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n)) for k in sorted(set(n))]
    got = QUERIES["op1_token_histogram"](spark, SF).select("n_tokens", "n_docs", "docs_ge", "tokens_ge", "truncated_tokens").collect()
    assert sorted(map(tuple, got)) == want


def test_op3(spark, rows):
    at, want = 0, []
    for i, t in rows:
        ids = plain.encode("word_bpe_49k.json", t, [1])
        want.append((i, at, len(ids), plain.crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, QUERIES["op3_token_wavelet"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_op4(spark, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op4_wu_manber"](spark, SF).collect())) == sorted(plain.contamination(rows, items))


def test_op7(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op7_exact_topk"](spark, SF).collect())) == plain.top(vectors)


def test_op8(spark, rows):
    got = {r["doc_id"]: r for r in QUERIES["op8_rare_word_index"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        labels, score = plain.notice_marks(t, licenses.PHRASES, licenses.NOTICES, licenses.ALIKE)
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain.base_marks(t)
        assert r["labels"] == labels and math.isclose(r["score"], score)


def test_op9(spark, rows):
    got = QUERIES["op9_simhash_trie"](spark, SF).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "fingerprint", "component_id")) for r in got), key=str) == plain.components([(i, plain.fingerprint(t)) for i, t in rows])


def test_op10(spark, rows):
    got = QUERIES["op10_pattern_packing"](spark, SF).collect()
    ids = {i: plain.encode("byte_bpe_50k.json", t, [2]) for i, t in rows}
    by, total = {}, 0
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert plain.crc(part) == r["ids_crc32"] and len(part) == r["length"] <= 1024
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(map(len, ids.values())) and sorted((r["doc_id"], r["piece"]) for r in got) == sorted((i, k) for i, x in ids.items() for k in range(-(-len(x) // 1024)))
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 1024
    assert len(by) <= 1.01 * total / 1024 + 1
