"""The corpus operators against plain versions, over texts with all that may go wrong."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute_force as plain
from loomframe.llm import common, components, decontaminate, exact_topk, language, licenses, main_text, packing, quality, simhash, token_files, token_histogram
from loomframe.llm.common import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
R = random.Random(9)
SYLLABLES = "the and ing er on re at en nd ti es or ed is ät ñe é 北 license cc by all rights reserved general public".split()


def sentence(n):
    return " ".join("".join(R.choices(SYLLABLES, k=R.randint(1, 3))).capitalize() if R.random() < 0.1 else "".join(R.choices(SYLLABLES, k=R.randint(1, 2))) for _ in range(n))


LONG = sentence(4000)
ITEMS = [(1, sentence(30)), (2, sentence(13)), (3, "Two words"), (4, ""), (5, None), (None, sentence(14)), (6, "single"), (1, sentence(15))]
TEXTS = [
    None, "", " \n\t ", "x", "One two", "<|endoftext|> a  b\n\nc", "CC BY-NC 4.0. All rights   reserved; cc by all rights reserved",
    "GNU General Public License, general public LICENSE", "Licensed under the Apache License, Version 2.0.", LONG, LONG + " more", LONG,
    ITEMS[0][1] + " tail", sentence(900) + " " + ITEMS[1][1] + " " + sentence(1100), sentence(60) + " " + ITEMS[1][1] + ". " + sentence(40), sentence(500) + " two WORDS", "İ Kelvin cc by", "###$$$ !!! |||", "12 34\x00 56",
    *[sentence(R.randint(1, 80)) for _ in range(25)],
]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "x"), (3, "x"), (None, "nobody's"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have the names that the operators use themselves."""
    rows = [(i, t, None if k % 5 == 0 else "en", "s", k, 1, 2, "z") for k, (i, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int, rank long, words string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def listed(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(name):
    odd = ["".join(R.choice(" \n\t,.!?ab1é 　'sΣ́\x1c$") for _ in range(R.randint(0, 60))) for _ in range(1500)]
    odd += [t or "" for t in TEXTS] + ["<|endoftext|> x<|startoftext|>y,<|endoftext|>.", "don't stop, I'll. 's", "a.b,c;d:e!f?g ?? !! .."]
    ids, ends = Encoder.of(tokenizer_path(name)).encode([t.encode() for t in odd])
    for k, t in enumerate(odd):
        assert ids[ends[k] : ends[k + 1]].tolist() == plain.encode(name, t, []), t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_compares_chunks(name, monkeypatch):
    """Chunks of one hash keep their own ids, and windows of any size give the same."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a  # equal under polynomial hashes modulo 2**64, whatever the base
    texts = [a, b, a + " " + b, "x" * 300, "y" * 300 + " " + "x" * 300, "", *(t or "" for t in TEXTS[:20]), a, ""]
    for window in (common.WINDOW, 50, 3):
        for same in (False, True):
            monkeypatch.setattr(common, "WINDOW", window)
            encoder = Encoder(tokenizer_path(name))
            if same:
                encoder.codes[:] = 0  # chunks of one length all have one hash
            for _ in range(2):
                ids, ends = encoder.encode([t.encode() for t in texts])
                for k, t in enumerate(texts):
                    assert ids[ends[k] : ends[k + 1]].tolist() == plain.encode(name, t, []), t


def test_length_histogram(docs, none):
    lengths = [len(plain.encode("byte_bpe_50k.json", t, [])) for _, t in DOCS]
    want = [(n, lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths)) for n in sorted(set(lengths))]
    suffix = token_histogram.length_histogram(docs)
    assert listed(suffix, "n_tokens", "n_docs", "docs_ge", "tokens_ge", "truncated_tokens") == sorted(want, key=str)
    got = token_histogram.answers(suffix, [0, 10, 10**6], [0.5, 1.0]).first()
    assert (got["n_docs"], got["n_tokens"], got["docs_over_10"], got["tokens_at_10"]) == (len(lengths), sum(lengths), sum(x > 10 for x in lengths), sum(min(x, 10) for x in lengths))
    assert got["tokens_at_0"] == 0 and got["tokens_at_1000000"] == sum(lengths) and got["length_q100"] == max(lengths) and got["length_q50"] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    assert token_histogram.length_histogram(none).count() == 0
    assert token_histogram.answers(token_histogram.length_histogram(none), [5]).first()["tokens_at_5"] == 0


def test_quality(spark, docs, none):
    real, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    even = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) != 0
    model = quality.learned(real, labels.where(even))
    known = {r["doc_id"]: r["quality"] for r in labels.where(~even).collect()}
    got = [(r["score"], known[r["doc_id"]]) for r in quality.scored(real, model).collect() if r["doc_id"] in known]
    good, bad = [s for s, y in got if y == 1], [s for s, y in got if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    rows = quality.scored(docs, model).collect()
    assert len(rows) == len(DOCS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    kept = quality.kept(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.scored(none, quality.learned(none, labels.limit(0))).count() == 0
    # one text's score does not depend on what it comes with
    texts = [t.encode() for _, t in DOCS if t]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])


def plain_features(text):
    """quality.encoded() of one text, byte by byte."""
    n = max(1, -(-len(text) // quality.PASSAGE_BYTES))
    edges = [k * len(text) // n for k in range(n + 1)]
    words, at = [], 0
    for w in __import__("re").finditer(rb"[^ \n\r\t\v\f]+", text):
        words.append((w.start(), w[0]))
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        part, row = text[a:b], np.zeros(quality.FEATURES)
        for x, y in zip(part[:-1], part[1:]):
            row[int(quality.KIND[x]) * quality.KINDS + int(quality.KIND[y])] += 1
        row = np.sqrt(row / max(1, row.sum()))
        own = [(k, w) for k, (at, w) in enumerate(words) if a <= at < b]
        inside = sum(quality.KIND[x] > 1 for x in part)
        row[-4] = len(own) / max(1, len(part)) * 5
        row[-3] = min(4, inside / max(1, len(own)) / 8)
        row[-2] = sum(k > 0 and words[k - 1][1] == w for k, w in own) / max(1, len(own))
        row[-1] = len(part) / quality.PASSAGE_BYTES
        out.append(row)
    return out


def plain_score(model, text):
    """The model's score of one text, passage by passage."""
    p, hs, es = model.p, [], []
    for x in plain_features(text):
        h = np.tanh((x - model.mean) / model.scale @ p["W"] + p["b"])
        es.append(p["w"] @ (np.tanh(h @ p["V"]) / (1 + np.exp(-h @ p["U"]))))
        hs.append(h)
    a = np.exp(np.array(es) - max(es))
    return 1 / (1 + np.exp(-(a / a.sum() @ np.array(hs) @ p["u"] + p["c"][0])))


def test_quality_model_by_hand(monkeypatch):
    texts = [(t or "").encode() for t in TEXTS] + [b"same same SAME same\nsame  same", b" "]
    x, number = quality.encoded(texts)
    assert np.allclose(x, [row for t in texts for row in plain_features(t)], atol=1e-5) and number.tolist() == [len(plain_features(t)) for t in texts]
    model = quality.Model(hidden=5, gate=3)
    label = np.array([k % 3 == 0 for k in range(len(texts))], float)
    model.fit(x, number, label, rounds=20)
    assert np.allclose(model.scores(texts), [plain_score(model, t) for t in texts], atol=1e-4)
    few = model.scaled(x[: int(number[:12].sum())]).astype(float)
    loss = lambda: -np.mean([np.log(y if k else 1 - y) for k, y in zip(label[:12], model.forward(model.hidden(few), number[:12])["y"])])
    for k, g in model.gradient(few, number[:12], label[:12]).items():
        for at in np.ndindex(g.shape) if g.size < 40 else [tuple(R.randrange(n) for n in g.shape) for _ in range(15)]:
            old, slope = model.p[k][at], []
            for d in (1e-2, -1e-2) if k == "W" else (1e-4, -1e-4):
                model.p[k][at] = old + d
                slope.append(loss() / (2 * d))
            model.p[k][at] = old
            assert abs(sum(slope) - g[at]) < 2e-4 + 0.02 * abs(g[at]), (k, at)
    # a text of several steps has all its passages, and one score whatever it comes with
    monkeypatch.setattr(quality, "STEP_BYTES", 3000)
    long = LONG.encode()
    one, n = quality.by_steps([long, b"x", b""], lambda x: x)
    assert n.tolist()[1:] == [1, 1] and n[0] == sum(len(plain_features(s)) for s in quality.segments(long)) and b"".join(quality.segments(long)) == long
    assert np.allclose(model.scores([b"a b", long, b"c"])[1], model.scores([long])[0])


def test_quality_trains_on_whole_documents(spark, monkeypatch):
    import pyarrow as pa

    assert quality.fits_not(pa.table({"k": [1, 2, 3, 4], "n": [512, 5120, 1024, 0]}), 4) == [2]
    rows = [(k, f"text {k} " * (5000 if k == 3 else 2)) for k in range(12)]
    seen = []
    monkeypatch.setattr(quality.Model, "fit", lambda self, x, number, label: seen.append((x, number, label)))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10)] + [(None, 1, 0), (11, None, 0)], "doc_id long, quality int, toxic int")
    quality.learned(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert len(seen[0][1]) == 10 and seen[0][1].max() == -(-len(rows[3][1]) // 512) and sorted(seen[0][2]) == [0.0] * 5 + [1.0] * 5
    quality.learned(spark.createDataFrame(rows, "doc_id long, text string"), labels, training_passages=20)
    assert seen[1][1].tolist() == [1] * 9


@pytest.mark.parametrize(("query", "modulus", "left", "module", "ids"), [("op2_attention_quality", 5, 0, quality, lambda docs, labels: labels), ("op6_ppm_language", 3, 1, language, lambda docs: docs)])
def test_held_out_rows_teach_nothing(spark, monkeypatch, query, modulus, left, module, ids):
    import zlib

    from loomframe.llm import queries

    taught, learned = [], module.learned
    monkeypatch.setattr(module, "learned", lambda *a: taught.extend(r["doc_id"] for r in ids(*a).collect()) or learned(*a))
    out = lambda i: zlib.crc32(str(i).encode()) % modulus == left
    got = queries.QUERIES[query](spark, SF).collect()
    assert len(got) == 200 and all(r["held_out"] == out(r["doc_id"]) for r in got) and any(r["held_out"] for r in got)
    assert taught and not any(map(out, taught))


def test_wavelet_matrix():
    ids = np.array([R.choice([3, 3, 7, 500, 49407]) for _ in range(3000)])
    m = token_files.WaveletMatrix.of(ids, 16)
    assert (m.decode() == ids).all() and [m.access(i) for i in range(0, 3000, 371)] == ids[::371].tolist()
    for s in (3, 500, 49407, 8, 1 << 20):
        at = np.flatnonzero(ids == s)
        assert m.count(s) == len(at) and m.rank(s, 1234) == (ids[:1234] == s).sum() and m.count(s, 100, 900) == (ids[100:900] == s).sum()
        assert [m.select(s, j) for j in range(0, len(at), 97)] == at[::97].tolist()
    assert token_files.WaveletMatrix.of(np.zeros(0, int), 16).decode().tolist() == []


def test_wavelet_matrix_opens_only_the_blocks_it_needs(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 256)
    ids = np.random.default_rng(4).integers(0, 50000, 20000)
    import pyarrow as pa

    row = token_files.packed(0, 0, 0, [1], [20000], ids, 16, pa.int64())
    m = token_files.opened(16, 20000, row[7], row[8], row[9])
    assert m.access(12345) == ids[12345]
    assert all(len(p.open) == 1 for p in m.planes) and len(m.planes[0].blocks) == 10
    s = int(ids[77])
    assert m.occurrences(s) == np.flatnonzero(ids == s).tolist() and m.count(s, 70, 1000) == (ids[70:1000] == s).sum() and (m.decode() == ids).all()


def test_token_files(spark, docs, none, tmp_path):
    token_files.write_token_files(docs, f"{tmp_path}/t", shard_tokens=500)
    got = token_files.read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    texts = {}
    for i, t in DOCS:  # documents of one id, in any order
        texts.setdefault((i, plain.crc(plain.encode("word_bpe_49k.json", t, [1]))), []).append(t)
    order, at = [(r["doc_id"], texts[r["doc_id"], r["ids_crc32"]].pop()) for r in got], 0
    assert [i for i, _ in order] == sorted((i for i, _ in DOCS), key=lambda i: (i is not None, i or 0)) and not any(texts.values())
    for r, (i, t) in zip(got, order, strict=True):
        ids = plain.encode("word_bpe_49k.json", t, [1])
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), plain.crc(ids))
        at += len(ids)
    assert spark.read.parquet(f"{tmp_path}/t").count() > 5
    # searched from the files
    whole = [x for i, t in order for x in plain.encode("word_bpe_49k.json", t, [1])]
    common_id, rare = max(set(whole), key=whole.count), whole[len(whole) // 2]
    assert {r["token"]: r["n"] for r in token_files.token_counts(spark, f"{tmp_path}/t", [common_id, rare, 1, 49151]).collect()} == {x: whole.count(x) for x in (common_id, rare, 1, 49151)}
    for x in (rare, 49151):
        want = [(i, k) for i, t in order for k, y in enumerate(plain.encode("word_bpe_49k.json", t, [1])) if y == x]
        assert listed(token_files.token_occurrences(spark, f"{tmp_path}/t", x), "doc_id", "at") == sorted(want, key=str)
    places = [0, 1, 777, len(whole) // 3, len(whole) - 1]
    assert token_files.tokens_at(spark, f"{tmp_path}/t", [*places, len(whole)]) == {p: whole[p] for p in places}
    with pytest.raises(Exception, match="bits"):
        token_files.write_token_files(docs, f"{tmp_path}/narrow", bits=8)
    assert token_files.token_digest(none).count() == 0


def test_token_files_are_all_that_is_written(spark, docs, tmp_path, monkeypatch):
    """Each file costs the JVM a few programs that it starts; a small table is one file, a larger one a file a range."""
    from pyspark.sql.readwriter import DataFrameWriter

    paths, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (paths.append(path), parquet(self, path, *a, **b))[1])
    token_files.write_token_files(docs, f"{tmp_path}/one")
    assert paths == [f"{tmp_path}/one"] and len(list((tmp_path / "one").glob("*.parquet"))) == 1
    monkeypatch.setattr(token_files, "STEP_BYTES", 100)
    monkeypatch.setattr(token_files, "PART_BYTES", 4000)
    token_files.write_token_files(docs, f"{tmp_path}/more")
    assert paths[1:] == [f"{tmp_path}/more"] and len(list((tmp_path / "more").glob("*.parquet"))) > 4
    assert spark.read.parquet(f"{tmp_path}/more").selectExpr("max(part)").first()[0] < 60
    got = [token_files.read_token_files(spark, f"{tmp_path}/{x}").orderBy("start").collect() for x in ("one", "more")]
    assert got[0] == got[1] and len(got[0]) == len(DOCS)


@pytest.mark.parametrize("kind", ["string", "double", "decimal(9,2)", "date", "timestamp", "binary", "struct<a:string,b:bigint>"])
def test_token_ranges_ascend(spark, kind, monkeypatch):
    """Ranges follow the order of ids of any kind, nulls first, and are of like bytes; copies of an id part by text."""
    monkeypatch.setattr(token_files, "STEP_BYTES", 200)
    monkeypatch.setattr(token_files, "PART_BYTES", 4000)
    made = {
        "string": "if(id < 150, 'many', concat(if(id % 2 = 0, 'é', 'Z'), id))", "double": "if(id % 50 = 0, double('nan'), id - 150.5)", "date": "date_add('2020-03-01', int(id * 7))", "timestamp": "timestamp_millis(id * 86400000 * 7)",
        "binary": "cast(unhex(hex(id * 7919)) as binary)", "struct<a:string,b:bigint>": "if(id % 40 = 0, null, struct(if(id % 3 = 0, null, string(id % 3)) as a, id as b))",
    }.get(kind, "id")
    rows = spark.range(300).selectExpr(f"if(id % 60 = 7, null, cast({made} as {kind})) as doc_id", "repeat(string(id), 10 + int(id) % 50) as text")
    got, n = token_files.ranged(rows, "doc_id", "text")
    assert n > 4 and got.count() == rows.count()
    at = [r["range"] for r in got.orderBy("doc_id", "tie").select("range").collect()]
    assert at == sorted(at) and at[0] == 0 and at[-1] == n - 1
    held = [r["b"] for r in got.groupBy("range").agg(F.sum(F.octet_length("text")).alias("b")).collect()]
    assert len(held) == n and max(held) < 5 * 4000


@pytest.mark.parametrize("table_words", [decontaminate.TABLE_WORDS, 20])
def test_contamination(spark, docs, none, table_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs, items, table_words=table_words)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = plain.contamination(DOCS, ITEMS)
    assert listed(got, *cols) == sorted(want, key=str)
    assert decontaminate.contamination(none, items).count() == 0
    assert sum(r["n_hit"] for r in decontaminate.contamination(docs, items.limit(0)).collect()) == 0
    kept = decontaminate.decontaminated(docs, items, table_words=table_words)
    assert kept.columns == docs.columns
    holds = [any(w[k : k + 13] == x[j : j + 13] for _, i in ITEMS if len(x := plain.words(i)) >= 13 for j in range(len(x) - 12) for k in range(len(w) - 12)) for w in (plain.words(t) for _, t in DOCS)]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(w[0]) for w, h in zip(want, holds) if not h and not w[-1])
    assert sum(h and not w[-1] for w, h in zip(want, holds)) > 0  # a passage in a text that is long enough not to be marked


@pytest.mark.parametrize("table_words", [decontaminate.TABLE_WORDS, 20])
def test_decontaminated_judges_each_row_by_its_text(spark, table_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = ITEMS[0][1] + " tail"
    rows = [(None, bad), (None, "clean and nameless"), (None, None), (7, bad), (7, "clean with the same id"), (7, "clean with the same id"), (8, bad), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [r for r in rows if r[1] != bad]
    assert listed(decontaminate.decontaminated(docs, items, table_words=table_words), "doc_id", "text") == sorted(want, key=str)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<header>Site</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>A &amp; B</h1><p>First   one,
with a <b>bold</b> <a href="/y">link</a>.</p><div class="ad">Buy</div><p>Short.</p><!-- <p>no</p> --><form>Name <input></form><p>Last&nbsp;one &lt;tag&gt; with more words in it.
</article></main><aside>Other stories</aside><div id="comments"><p>I liked this very very much, all of it, and write at length about it.</p></div><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    want = "A & B\nFirst one, with a bold link.\nShort.\nLast one <tag> with more words in it."
    plain_page = "<html><body><div class=menu><a href=1>Home</a></div><div id=content><p>Some text that is long enough.</p><p>Yes.</p></div><div class=footer>Bye</div>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>only"), (4, "u", plain_page), (5, "u", "<nav>Menu</nav><script>x"), (6, "u", "<p>" + "word " * 50000 + "</p>"), (7, "u", "no markup at all"), (8, "u", "<article><p>cut <b")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in main_text.main_text(pages).collect()))
    texts = {k: t for k, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert texts[1] == want and texts[2] == texts[3] == texts[5] == "" and texts[0] == "only" and texts[4] == "Some text that is long enough.\nYes." and len(texts[6]) == 249999 and texts[7] == "no markup at all" and texts[8] == "cut"
    assert main_text.main_text(pages.limit(0)).count() == 0


def test_main_text_keeps_links_of_the_article():
    items = "".join(f"<li><a href='/{k}'>linked item {k}</a></li>" for k in range(1, 9))
    names = [f"linked item {k}" for k in range(1, 9)]
    nav = "<nav><a href='/'>Home</a></nav>"
    assert main_text.extracted(f"{nav}<article><p>Before the list.</p><ul>{items}</ul><p>After the list.</p></article>").split("\n") == ["Before the list.", *names, "After the list."]
    assert main_text.extracted(f"{nav}<article><p>Some text.</p><ol>{items}</ol></article>").split("\n") == ["Some text.", *names]
    assert main_text.extracted(f"<body>{nav}<article>{items}</article><p>Imprint</p></body>").split("\n") == names
    # anchors without href are no links, and open ones end with their block
    plain_lines = [f"A plain line of text, number {k}." for k in range(6)]
    weighed = lambda page: sum(max(0, len(x.joined()) - x.linked) for x in main_text.lines_of(page)[0])
    full = sum(map(len, plain_lines))
    assert weighed("<div><a name='top'>" + "".join(f"<p>{x}</p>" for x in plain_lines) + "</div>") == full
    assert weighed("<div><p><a href='/x'>link" + "".join(f"<p>{x}" for x in plain_lines) + "</div>") == full
    assert weighed("<p><a href='/x'>one <a href='/y'>two</a> and more text</p>") == len("  and more text")  # a space on each side of the second link
    assert weighed("<a class='b' data-href='/x' title='a href=b'>text</a>") == 4 and weighed("<div><a class='c' href=/x><div>card</div></a></div>") == 0


def test_main_text_strips_whole_names_inside_the_article():
    parts = [
        "<section id='side-effects'><h2>Side effects</h2><p>Some may feel dizzy.</p></section>", "<section id='related-work'><h2>Related work</h2><p>Others did this.</p></section>",
        "<h2 id='notice-period'>Notice period</h2><p>It is a month.</p>", "<h3 id='notice'>Notice</h3>", "<div class='article-header'><h1>The title</h1></div>", "<div class='entry header'><h1>Another title</h1></div>",
    ]
    text = lambda x: [y for y in (" ".join(t.split()) for t in __import__("re").split("<[^>]*>", x)) if y]
    body = "<p>The article says this, and it says it at some length.</p>"
    for part in parts:
        for tag in ("article", "main"):
            assert main_text.extracted(f"<{tag}>{part}{body}</{tag}>").split("\n") == text(part + body), part
    for part in ("<div class='x ad'>Buy</div>", "<section id='comments'>I like it</section>", "<div role='navigation'>Next</div>", "<section class='related'>More</section>", "<nav id='x'>Up</nav>", "<div id='share'>Share</div>"):
        assert main_text.extracted(f"<article>{body}{part}</article>").split("\n") == text(body), part
    # most of an article is not stripped by an id
    assert main_text.extracted(f"<article><h1>T</h1><section id='notice'>{body}{body}</section><section id='share'>Share</section></article>").split("\n") == ["T", *text(body), *text(body)]
    # outside an article, too, headings' ids are words of their text
    assert main_text.extracted(f"<body><div><h2 id='notice-period'>Notice period</h2>{body}</div></body>").split("\n") == ["Notice period", *text(body)]


@pytest.mark.parametrize(
    ("part", "want"),
    [
        ("<p title=it's>Hello there, it's a long text.</p>", ["Hello there, it's a long text."]),
        ('<p class="a"">A stray quote ends nothing.</p>', ["A stray quote ends nothing."]),
        ("<p data-x=\"a > b\" title='c > d'>Quoted ends.</p>", ["Quoted ends."]),
        ("<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", ["Where x=2 holds."]),
        ("<p>An <svg><title>icon</title></svg>icon <span class=ad>Buy</span>and a <button>copy</button>button.</p>", ["An icon and a button."]),
        ("<p>One &amp;amp; two &am<b>p; three</b> &#8212; 4 &lt; 5 a<!-- -- > -->b<!-->c</p>", ["One &amp; two &amp; three \u2014 4 < 5 abc"]),
        ("<p>1 < 2, a <3 b</p>", ["1 < 2, a <3 b"]),
        ("<p>x</p><section class='notice-board'><p>The board said so.</p></section>", ["x", "The board said so."]),
        ("<p id=side-effects>None are known.</p>", ["None are known."]),
        ("<p><a href=/x/>linked</a> and not</p><div/><p>after</p></div>", ["linked and not", "after"]),
        ("<p>a</p><script>if (a</b) '</p>'</script ><p>b</p><textarea><p>c</textarea>", ["a", "b"]),
    ],
)
def test_main_text_reads_tags_as_browsers_do(part, want):
    body = "<p>The article says this, and it says it at some length.</p>"
    text = "The article says this, and it says it at some length."
    assert main_text.extracted(f"<nav><a href=/>Home</a></nav><article>{part}{body}</article><footer>End</footer>").split("\n") == [*want, text]


@pytest.mark.parametrize("unit", ["<a ", "<a href=", "<a x='", '<p class="', "<!--", "<!", "</", "<script>", "<div>", "<b>", "<a href=x>", "<a href=x><p>", "<div id=x><i>", "</i><b>", "&amp", "<", "<ul><li>"])
def test_main_text_takes_linear_time(unit):
    import time

    page = "<article><p>Text before.</p>" + unit * ((1 << 20) // len(unit))
    began = time.perf_counter()
    got = main_text.extracted(page)
    assert time.perf_counter() - began < 20 and got.startswith("Text before.")


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in main_text.main_text(pages).collect():
        article = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        import html as entities
        import re

        blocks = [" ".join(entities.unescape(x).split()) for x in re.split(r"(?:</?(?:h1|p|b|br)>)+", article)]
        assert r["text"] == "\n".join(x for x in blocks if x)


def slow_code_length(trees_of, text):
    """PPM code length of a text by plain counting of contexts, in bits."""
    import math

    data = b"\n" * language.ORDER + text
    counts = {}
    for t in trees_of:
        s = b"\n" * language.ORDER + t
        for i in range(language.ORDER, len(s)):
            for k in range(language.ORDER + 1):
                counts.setdefault(s[i - k : i], {}).setdefault(s[i], 0)
                counts[s[i - k : i]][s[i]] += 1
    total = 0.0
    for i in range(language.ORDER, len(data)):
        for k in range(language.ORDER, -1, -1):
            seen = counts.get(data[i - k : i])
            if seen is None:
                continue
            n, q = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


def test_language(spark, docs, none):
    texts = {"de": ["der die das und ist nicht", "ein Haus und die Straße"], "en": ["the and of is not", "a house and the street"]}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)] + [(9, "nobody", None), (10, None, "fr")]
    trees = language.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert trees.languages == ["de", "en"]
    asked = [b"die Strasse und das", b"the house", b"q", "ñ北".encode(), b"x" * 500]
    for text, row in zip(asked, trees.lengths(asked) / language.UNIT):
        for lang, bits in zip(trees.languages, row):
            assert abs(bits - slow_code_length([t.encode() for t in texts[lang]], text)) < 0.01 * len(text) + 0.01
    got = language.identified(docs, trees).collect()
    assert len(got) == len(DOCS) and all(0 <= r["score"] <= 1 for r in got)
    und = [r["doc_id"] for r in got if r["lang_pred"] == "und"]
    assert sorted(str(i) for i in und) == sorted(str(i) for i, t in DOCS if t is None or not any(map(str.isalpha, t)))
    assert language.identified(none, language.learned(none)).count() == 0
    assert {r["lang_pred"] for r in language.identified(docs, language.learned(none)).collect()} == {"und"}
    assert language.kept(docs, trees).columns == docs.columns


def test_language_sample_holds_each_language(spark, monkeypatch):
    assert language.quota([100, 3, 50], 63) == 30 and language.quota([5, 5], 100) == 5 and language.quota([], 9) == 1 and language.quota([9, 9, 9], 2) == 1
    hot, rare = "the same english words again", ["drei seltene deutsche Texte", "noch ein deutscher Text", "und der letzte"]
    rows = [(i, hot if i % 2 else f"english words number {i}", "en") for i in range(3000)] + [(9000 + i, t, "de") for i, t in enumerate(rare)]
    seen, grown = [], language.grown
    monkeypatch.setattr(language, "grown", lambda languages, which, keys, n: seen.append((languages, which, keys, n)) or grown(languages, which, keys, n))
    language.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), training_docs=203)
    languages, which, keys, n = seen[0]  # the first is of the whole sample
    assert languages == ["de", "en"]
    begin = keys >> 8 == int.from_bytes(language.BEFORE, "big")  # a string a document
    by = {x: int(n[begin & (which == i)].sum()) for i, x in enumerate(languages)}
    assert by["de"] == 3 and 120 < by["en"] < 290  # the rare language whole, copies of one text in and out by their ids


def test_language_of_held_out_documents(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    trees = language.learned(real.where(~held))
    known = {r["doc_id"]: r["lang"] for r in real.where(held).collect()}
    got = [r["lang_pred"] == known[r["doc_id"]] for r in language.identified(real.where(held), trees).collect()]
    assert np.mean(got) > 0.98


def test_language_keeps_only_what_is_taught(spark):
    import base64

    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    trees = language.learned(real.where(~held))
    foreign = [
        "Wczoraj wieczorem poszliśmy do kina, a potem długo rozmawialiśmy o filmie, który bardzo nam się podobał.",
        "Ieri sera siamo andati al cinema e poi abbiamo parlato a lungo del film che ci era piaciuto molto.",
        "Вчера вечером мы пошли в кино, а потом долго говорили о фильме.", "昨天晚上我们去看电影，然后谈了很久。", "xqzj kkvw zzqp wvxk jjqz pkzx qqvv",
        base64.b64encode(bytes(R.choices(range(256), k=300))).decode(), "".join(R.choices("abcdefghijklmnopqrstuvwxyz ", k=3000)),
    ]
    rows = [(-1 - k, x * n) for k, x in enumerate(foreign) for n in (1, 20)]
    both = real.where(held).select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("xx")))
    kept = {r["lang"]: r["n"] for r in language.kept(both, trees).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean = {r["lang"]: r["n"] for r in real.where(held).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept == clean and len(clean) == 4


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.4, 8).round(3).tolist()) for i in range(0, 330)]
    rows += [(50, rows[50][1]), (7, rows[7][1]), (8, None), (None, [0.1] * 8), (9, [float("nan")] * 8), (400, [float("inf")] * 8), (10, [0.1, None]), (450, [0.5, 0.5]), (11, [0.25, 0.5])]
    rows += [(1000 + i, rows[3][1]) for i in range(80)]  # ties beyond k
    df = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "vec_id long, embedding array<double>, label int, score double").repartition(4)
    cols = ("query_id", "rank", "vec_id", "score")
    got = listed(exact_topk.top_k(df), *cols)
    assert sorted(set(got)) == plain.top(rows)
    monkeypatch.setattr(exact_topk, "QUERY_BYTES", 150)  # blocks of two queries
    assert listed(exact_topk.top_k(df), *cols) == got
    assert exact_topk.top_k(df.limit(0)).count() == 0


def test_licence_marks(docs, none):
    got = licenses.licence_marks(docs)
    want = sorted(((i, *plain.base_marks(t)) for i, t in DOCS), key=str)
    assert listed(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    found = {r["doc_id"]: r for r in got.collect()}
    assert found[8]["labels"] == "apache-2.0" and found[8]["score"] >= 0.8 and "cc-by-nc" in found[6]["labels"] and found[0]["score"] == 0.0
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.collect())
    assert licenses.licence_marks(none).count() == 0


def test_licence_marks_of_several_notices(spark):
    """Each notice is found whatever rarer licence words the document holds."""
    notices = dict((label, t) for t, label, _ in licenses.NOTICES)
    granted = licenses.NOTICES[2][0]
    apache = "Licensed under the Apache License, Version 2.0"
    texts = [f"{granted}. {apache}", " -- ".join(t for t, *_ in licenses.NOTICES), f"{apache} and " + " ".join(w for w in granted.split() if len(w) > 3), f"words {notices['bsd']} more {notices['mpl-2.0']}"]
    docs = spark.createDataFrame([*enumerate(texts), *((10 + i, apache) for i in range(30))], "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in licenses.licence_marks(docs).collect()}
    assert got[0] == {"apache-2.0", "mit"} and got[1] >= {label for _, label, _ in licenses.NOTICES} and "apache-2.0" in got[2] and got[3] == {"bsd", "mpl-2.0"}
    # a notice without a mandatory phrase is found by any of its words
    free = (("you can use it and do with it as you please", "free", ()),)
    assert {r["labels"] for r in licenses.licence_marks(spark.createDataFrame([(1, "So you can use it and do with this as you like")], "doc_id long, text string"), notices=free).collect()} == {"free"}


def test_licence_marks_by_hand(spark):
    """labels and score of texts with notices that are whole, changed, cut at either end, repeated and mixed."""
    texts = [t for t, *_ in licenses.NOTICES] + [t or "" for t in TEXTS]
    texts += ["this wor\u212a is licensed under a creative commons attribution", "this work is licensed under a Creative\u2003Commons attribution", "THIS WORK IS LICENSED UNDER A CREATIVE COMMONS ATTRIBUTION \u212a"]
    for t, *_ in licenses.NOTICES:
        w = t.split()
        for _ in range(6):
            some = [x if R.random() < 0.85 else R.choice(w) for x in w]
            texts.append(" ".join(R.choices(w, k=R.randint(0, 5)) + some[R.randint(0, 3) : len(some) - R.randint(0, 3)] + R.choices(w, k=R.randint(0, 5))))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.licence_marks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        labels, score = plain.notice_marks(t, licenses.PHRASES, licenses.NOTICES, licenses.ALIKE)
        assert (got[k][0], round(got[k][1], 9)) == (labels, round(score, 9)), t


def test_near_duplicates(docs, none):
    got = simhash.near_duplicates(docs)
    want = plain.components([(i, plain.fingerprint(t)) for i, t in DOCS])
    assert listed(got, "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(c) for *_, c in want})


@pytest.mark.parametrize("hot", [2048, 8])
def test_links_of_all_near_fingerprints(spark, hot):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 60, np.uint64)
    crowd = (np.uint64(0xABCD) << np.uint64(48)) | r.integers(0, 1 << 20, 150, np.uint64)  # one full bucket
    near = [b ^ np.uint64(sum(1 << int(k) for k in r.choice(64, n, False))) for b in base for n in (1, 2, 3, 4)]
    prints = sorted({int(x) for x in [*base, *near, *crowd, 0, 7, (1 << 64) - 1]})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    old, simhash.HOT_BUCKET = simhash.HOT_BUCKET, hot
    try:
        got = sorted((x["u"], x["v"]) for x in simhash.linked(spark.createDataFrame([(signed(x),) for x in prints], "fp long")).collect())
    finally:
        simhash.HOT_BUCKET = old
    want = sorted((min(a, b), max(a, b)) for i, x in enumerate(prints) for y in prints[:i] if (x ^ y).bit_count() <= 3 for a, b in [(signed(x), signed(y))])
    assert got == want


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(docs, none, capacity):
    got = packing.pack(docs, capacity, keep_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        assert plain.crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len({i for i, _ in DOCS})
    want = sorted(plain.crc(plain.encode("byte_bpe_50k.json", t, [2])) for _, t in DOCS)
    for i, t in DOCS:
        if sum(j == i for j, _ in DOCS) > 1:
            continue
        ids, pieces = plain.encode("byte_bpe_50k.json", t, [2]), sorted(by_doc[i], key=lambda r: r["piece"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist() == ids and [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert all(r["length"] == capacity for r in pieces[1:]) and [r["start"] for r in pieces] == np.concatenate([[0], np.cumsum([r["length"] for r in pieces])[:-1]]).tolist()
    for rows in by_seq.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.concatenate([[0], np.cumsum([r["length"] for r in rows])[:-1]]).tolist() and sum(r["length"] for r in rows) <= capacity
    assert len(want) == len(DOCS) and packing.pack(none).count() == 0


def test_plan_is_nearly_full():
    r = np.random.default_rng(2)
    counts = np.bincount(r.integers(1, 1025, 20000), minlength=1025)
    made, number = packing.plan(counts, 1024)
    used = np.zeros(1025, int)
    for lens, times in made:
        assert sum(lens) <= 1024
        for n in lens:
            used[n] += times
    assert (used == counts).all() and number <= 1.005 * (counts * np.arange(1025)).sum() / 1024
    assert packing.plan(np.zeros(1025, int), 1024) == ([], 0)


def test_pipeline(spark):
    """run() against the stages' plain versions, given what the two trained stages keep."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = docs.collect()
    good = [r for r, s in zip(good, model.scores([(r["text"] or "").encode() for r in good])) if s >= 0.3]
    trees = language.learned(spark.createDataFrame(good, docs.schema))
    said, score = trees.predicted([r["text"].encode() for r in good])
    told = [(r["doc_id"], r["text"]) for r, a, s in zip(good, said, score) if a != "und" and s >= 0.5]
    own = {i: c for i, _, c in plain.components([(i, plain.fingerprint(t)) for i, t in told])}
    single = [(i, t) for i, t in told if own[i] == i]
    windows = {tuple(w[k : k + 13]) for w in (plain.words(t) for _, t in items) for k in range(len(w) - 12)}
    holds = {i: any(tuple(w[k : k + 13]) in windows for k in range(len(w) - 12)) for i, w in ((i, plain.words(t)) for i, t in single)}
    clean = {w[0] for w in plain.contamination(single, items) if not w[-1] and not holds[w[0]]}
    got = pipeline.run(spark, SF).collect()
    want = sorted((i, plain.crc(plain.encode("byte_bpe_50k.json", t, [2]))) for i, t in single if i in clean)
    assert sorted({r["doc_id"] for r in got}) == [i for i, _ in want]
    totals = {}
    for r in got:
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["length"]
    assert totals == {i: len(plain.encode("byte_bpe_50k.json", t, [2])) for i, t in single if i in clean}
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "language ID", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def crowd(n, seed=2):
    """n different fingerprints within three bits of one."""
    r = np.random.default_rng(seed)
    out = set()
    while len(out) < n:
        out.add(int(0x0123456789ABCDEF ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 4), False))))
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("hot", [2048, 8])
def test_spanning_links_keep_components(spark, hot, monkeypatch):
    """Fewer links than fingerprints a bucket, in bounded batches, and the components of all links."""
    r = np.random.default_rng(6)
    base = r.integers(0, 1 << 63, 80, np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in r.choice(64, n, False))) for b in base for n in (1, 2, 3, 4)]
    prints = sorted({int(x) for x in [*base, *near, *crowd(300), 0, 7, (1 << 64) - 1]})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    links = simhash.linked(df, spanning=True)
    assert all((x["u"] ^ x["v"]) & (1 << 64) - 1 and ((x["u"] ^ x["v"]) & (1 << 64) - 1).bit_count() <= 3 for x in links.collect())
    got = {x["node"]: x["root"] for x in components.components(links).collect()}
    want = {i: c for i, _, c in plain.components([(signed(x), x) for x in prints])}
    assert {i: c for i, c in got.items()} == {i: c for i, c in want.items() if i in got} and all(sum(c == d for d in want.values()) == 1 for i, c in want.items() if i not in got)


def test_a_crowd_of_near_fingerprints_takes_little_memory():
    import tracemalloc

    keys = crowd(20000)
    tracemalloc.start()
    links = sum(len(i) for i, _ in simhash.trie_pairs(keys, 16, 3, components.Forest(len(keys))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < links < len(keys) and peak < 150 << 20


def test_components_of_a_hub_and_a_chain(spark, monkeypatch):
    monkeypatch.setattr(components, "FEW_LINKS", 4)
    monkeypatch.setattr(components, "STEP_LINKS", 50)
    monkeypatch.setattr(components, "TASK_LINKS", 60)
    edges = [(1000, k) for k in range(1001, 1300)] + [(k, k + 1) for k in range(-50, 50)] + [(1100, 2000), (7, 7), (49, 50), (50, 49)]
    R.shuffle(edges)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {**dict.fromkeys([*range(1000, 1300), 2000], 1000), **dict.fromkeys(range(-50, 51), -50)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_deduplicated_keeps_one_row_of_each_component(spark):
    long_text = sentence(300)
    rows = [(1, long_text), (2, long_text), (2, "other words by far"), (2, "other words by far"), (3, None), (None, ""), (None, "nobody's own words here"), (None, "nobody's own words here"), (4, "nobody's words and others")]
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, kept_id int, fp string, nameless boolean").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.deduplicated(docs).collect()), key=str)
    assert got == sorted([(1, long_text), (2, "other words by far"), (3, None), (None, "nobody's own words here"), (4, "nobody's words and others")], key=str)
