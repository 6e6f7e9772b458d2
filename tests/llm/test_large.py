"""Texts over a step's bytes against plain versions and against themselves in one step."""

import random

import numpy as np
import pytest

import brute_force as plain
from loomframe.llm import common, decontaminate, language, licenses, main_text, packing, quality, simhash, token_files, token_histogram
from loomframe.llm.common import Encoder, tokenizer_path

R = random.Random(4)
ITEM = "a passage of the benchmark that has thirteen words or a few more than that"
LARGE = " ".join(R.choice(("word", "other", "Ünder", "北京", "x1", "end.\n", "The", "all rights reserved")) + str(R.randrange(400)) * R.randrange(2) for _ in range(220_000))
LARGE = LARGE[:700_000] + " " + ITEM + ". " + LARGE[700_000:]
NO_SPACE = "aB3" * 500_000


@pytest.fixture(scope="module")
def large(spark):
    return spark.createDataFrame([(1, LARGE, "en"), (2, NO_SPACE, "en"), (3, "short", "en"), (4, None, None)], "doc_id long, text string, lang string")


def test_it_is_large():
    assert len(LARGE.encode()) > 1.2 * common.STEP_BYTES and len(NO_SPACE) > common.STEP_BYTES


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens(spark, large, tmp_path, name):
    texts = [LARGE, "short"]
    want = [plain.encode(name, t, []) for t in texts]
    ids, ends = Encoder.of(tokenizer_path(name)).encode([t.encode() for t in texts])
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    docs = large.where("doc_id <> 2")
    if name == "byte_bpe_50k.json":
        assert {r["n_tokens"] for r in token_histogram.length_histogram(docs).collect()} == {0, *map(len, want)}
        pieces = packing.pack(docs).where("doc_id = 1").orderBy("piece").collect()
        assert sum(r["length"] for r in pieces) == len(want[0]) + 1 and all(r["length"] == 1024 for r in pieces[1:])
    else:
        token_files.write_token_files(docs, f"{tmp_path}/t", tokenizer=name)
        got = {r["doc_id"]: r["ids_crc32"] for r in token_files.read_token_files(spark, f"{tmp_path}/t").collect()}
        assert got == {1: plain.crc([*want[0], 1]), 3: plain.crc([*want[1], 1]), 4: plain.crc([1])}


def test_contamination(spark, large):
    items = [(7, ITEM)]
    got = decontaminate.contamination(large, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(plain.contamination([(1, LARGE), (2, NO_SPACE), (3, "short"), (4, None)], items))
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(large, spark.createDataFrame(items, "item_id long, text string")).collect()) == [2, 3, 4]


def test_fingerprints():
    assert simhash.fingerprints([LARGE.encode(), b"short"]).tolist() == [plain.fingerprint(LARGE), plain.fingerprint("short")]
    assert simhash.fingerprints([NO_SPACE.encode()]).tolist() == [plain.fingerprint(NO_SPACE)]


def test_quality():
    model = quality.Model()
    for t in (LARGE, NO_SPACE):
        x, n = quality.by_steps([b"a", t.encode(), b""], lambda x: x)
        assert n.tolist() == [1, sum(-(-len(s) // 512) for s in quality.segments(t.encode())), 1] and len(x) == n.sum()
        assert np.allclose(model.scores([b"a", t.encode()])[1], model.scores([t.encode()]))


def test_language(spark, monkeypatch):
    trees = language.learned(spark.createDataFrame([(1, LARGE[:20_000], "en"), (2, "der die das und ist nicht", "de")], "doc_id long, text string, lang string"))
    texts = [LARGE.encode(), b"", NO_SPACE.encode(), b"short"]
    got = trees.coded(texts)
    monkeypatch.setattr(language, "STEP_BYTES", 1 << 24)
    want = trees.coded(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all() and got[0][0].min() > 0
    # the counts of a text in pieces are those of the whole
    monkeypatch.undo()
    of = lambda: np.unique(np.concatenate([language.strings_of(p) for _, p in language.windows(texts)]), return_counts=True)
    parts = of()
    monkeypatch.setattr(language, "STEP_BYTES", 1 << 24)
    assert all((a == b).all() for a, b in zip(parts, of()))


def test_licences(large):
    got = {r["doc_id"]: r for r in licenses.licence_marks(large).collect()}
    n_words, n_base, first, last, labels = plain.base_marks(LARGE)
    assert tuple(got[1][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == (n_words, n_base, first, last, labels) and n_base > 1000
    assert got[2]["n_words"] == 1 and got[4]["n_words"] == 0


def test_main_text():
    blocks = [" ".join(R.choice(LARGE[:500].split()) for _ in range(50)) for _ in range(6000)]
    page = "<nav>Menu</nav><article>" + "".join(f"<p>{b.replace('&', '&amp;')}</p>" for b in blocks) + "</article><footer>End</footer>"
    assert len(page) > 1 << 20 and main_text.extracted(page).split("\n") == blocks
