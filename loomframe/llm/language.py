"""Language identification by prediction by partial matching: code lengths under frozen byte context trees."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, arrow_map, flat, local, sliced, stream, text_bytes, trim

#: Bytes of the longest context.
ORDER = 3
#: Labelled documents that the trees are grown from, about (chosen by a hash of id and text).
TRAINING_DOCS = 6000
#: Code lengths are in 1/UNIT bits, whole numbers, so sums are exact in any order.
UNIT = 1 << 12
#: Held-out documents that a language's range of code lengths is taken from, at least; with fewer it has none.
RANGE_DOCS = 5
#: Standard deviations that a text's code may be longer than its language's documents' are.
WIDE = 8
#: Variance of one byte's code, in bits, and the least deviation of long texts, as a share of their bits a byte.
BYTE_VARIANCE, LEAST_SPREAD = 9.0, 0.1
#: Bytes of a part that is coded in one language.
PART = 128
#: Bytes that a text is taken to follow.
BEFORE = b"\n" * ORDER
ASCII_LETTER = re.compile(rb"[A-Za-z]")


class Index:
    """Place of 32-bit keys in a sorted list, by a table of probes."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.at = np.full(1 << self.bits, -1, np.int32)
        rest, slot = np.arange(len(keys)), self.slot(keys)
        while len(rest):
            free = self.at[slot] < 0
            self.at[slot[free]] = rest[free]
            won = self.at[slot] == rest
            self.keys[slot[won]] = keys[rest[won]]
            rest, slot = rest[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        out = np.where(self.keys[slot] == keys, self.at[slot], -2)
        out[self.at[slot] < 0] = -1
        rest = np.flatnonzero(out == -2)
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            there, entry = self.keys[slot], self.at[slot]
            done = (entry < 0) | (there == keys[rest])
            out[rest[done]] = entry[done]
            rest, slot = rest[~done], slot[~done]
        return out


class Trees:
    """Frozen statistics of all languages. counts[k]: (keys, counts by language) of strings of k + 1 bytes.

    A symbol that a context of n symbols, q of them different, has seen c times costs -log2(c / (n + q)); one that it has
    not seen costs the escape -log2(q / (n + q)) and then what it costs in the context one byte shorter. A context that
    never occurred costs nothing extra. Below the empty context all 256 bytes are alike.
    """

    #: By language, bits a byte of its own documents, held out, and their variance; infinite where too few tell them.
    limits: np.ndarray | None = None

    def __init__(self, languages: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        n = len(languages)
        self.index, self.cost, self.escape_index, self.escape = {}, {}, {}, {}
        for k in range(ORDER + 1):
            keys, c = counts[k]
            heads, first = np.unique(keys >> np.uint32(8), return_index=True)
            total = np.add.reduceat(c, first, axis=0).astype(float) if len(keys) else np.zeros((0, n))
            kinds = np.add.reduceat((c > 0).astype(np.int64), first, axis=0).astype(float) if len(keys) else np.zeros((0, n))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                own = np.repeat(np.arange(len(heads)), np.diff(first, append=len(keys)))
                seen = -np.log2(c / (total + kinds)[own])
            self.escape[k] = np.rint(escape * UNIT).astype(np.int32)
            self.escape_index[k] = Index(heads.astype(np.uint32))
            self.index[k] = Index(keys)
            unseen = self.escape[k][own] + (self.shorter(k, keys) if len(keys) else np.zeros((0, n), np.int32))
            self.cost[k] = np.where(c > 0, np.rint(np.where(c > 0, seen, 0) * UNIT).astype(np.int32), unseen).astype(np.int32)
        # by language, for sums along texts
        self.columns = {k: [np.ascontiguousarray(self.cost[k][:, i]) for i in range(n)] for k in self.cost}

    def shorter(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Costs of the last byte of strings of k + 1 bytes in the context one byte shorter."""
        if k == 0:
            return np.full((len(keys), len(self.languages)), 8 * UNIT, np.int32)
        return self.costs(k - 1, keys & np.uint32((1 << 8 * k) - 1))

    def costs(self, k: int, keys: np.ndarray) -> np.ndarray:
        at = self.index[k].find(keys)
        out = np.zeros((len(keys), len(self.languages)), np.int32)
        have = at >= 0
        out[have] = self.cost[k][at[have]]
        if not have.all():
            rest = keys[~have]
            head = self.escape_index[k].find(rest >> np.uint32(8))
            escape = np.zeros((len(rest), len(self.languages)), np.int32)
            escape[head >= 0] = self.escape[k][head[head >= 0]]
            out[~have] = escape + self.shorter(k, rest)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text under each language, in 1/UNIT bits."""
        return self.coded(texts)[0]

    def coded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """lengths(), and the length of each whole text with each part of PART bytes under the language that suits it."""
        out, mixed = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        for own, pieces in windows(texts) if self.languages else ():
            bits, least = self.pieces(pieces)
            np.add.at(out, own, bits)
            np.add.at(mixed, own, least)
        return out, mixed

    def pieces(self, pieces: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """coded() of pieces of texts, each with the ORDER bytes before it."""
        keys = strings_of(pieces)
        out, mixed = np.zeros((len(pieces), len(self.languages)), np.int64), np.zeros(len(pieces), np.int64)
        sizes = np.array([len(x) for _, x in pieces])
        parts = -(-sizes // PART)
        first = np.cumsum(parts) - parts
        starts = np.repeat(np.cumsum(sizes) - sizes, parts) + PART * (np.arange(parts.sum()) - np.repeat(first, parts))
        least = None
        at = self.index[ORDER].find(keys)
        rest = np.flatnonzero(at < 0)
        found = self.costs(ORDER, keys[rest])
        at[rest] = 0
        for i, column in enumerate(self.columns[ORDER]):
            each = column[at] if len(column) else np.zeros(len(at), np.int32)
            each[rest] = found[:, i]
            bits = np.add.reduceat(each, starts, dtype=np.int64)
            out[:, i] = np.add.reduceat(bits, first)
            least = bits if least is None else np.minimum(least, bits)
        mixed[:] = np.add.reduceat(least, first)
        return out, mixed

    def predicted(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Language of the shortest code and its posterior under equal priors; und and 0 without letters or languages."""
        return self.judged(texts)[:2]

    def judged(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """predicted(), and whether the text is coded about as well as that language's own documents: the posterior says
        only which language is nearest, and nears 1 with a text's length whatever it is written in. Parts in another
        learned language count as coded by that one."""
        got, mixed = (x / UNIT for x in self.coded([x or b"" for x in texts]))
        said, score, own = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if self.languages:
            best = got.argmin(axis=1)
            p = 1 / np.exp2(np.minimum(0, got.min(axis=1)[:, None] - got)).sum(axis=1)
            usual = np.ones(len(texts), bool)
            if self.limits is not None:
                middle, variance = self.limits[best].T
                n = np.maximum(1, [len(x or b"") for x in texts])
                usual = mixed / n <= middle + WIDE * np.sqrt(BYTE_VARIANCE / n + variance)
            for i, x in enumerate(texts):
                if x and has_letter(x):
                    said[i], score[i], own[i] = self.languages[best[i]], p[i], usual[i]
        return said, score, own


def has_letter(x: bytes) -> bool:
    return bool(ASCII_LETTER.search(x)) or (not x.isascii() and any(map(str.isalpha, x.decode("utf-8", "replace"))))


def windows(texts: list[bytes]) -> Iterator[tuple[list[int], list[tuple[bytes, bytes]]]]:
    """The texts in pieces of at most STEP_BYTES, a multiple of PART, each with the ORDER bytes before it, and what text each
    is of; about STEP_BYTES of them at a time."""
    own, pieces, size = [], [], 0
    for i, x in enumerate(texts):
        for at in range(0, len(x), STEP_BYTES):
            if pieces and size + min(len(x) - at, STEP_BYTES) > STEP_BYTES:
                yield own, pieces
                own, pieces, size = [], [], 0
            own.append(i)
            pieces.append((x[at - ORDER : at] if at else BEFORE, x[at : at + STEP_BYTES]))
            size += len(pieces[-1][1])
    if pieces:
        yield own, pieces


def strings_of(pieces: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The string that ends in each byte of the pieces."""
    data, bounds = flat([x for p in pieces for x in p])
    keys = strings(data)
    mine = np.ones(len(keys), bool)
    mine[(bounds[2:-1:2, None] - 1 - np.arange(ORDER)).ravel()] = False  # strings that span two pieces
    return keys[mine]


def strings(data: np.ndarray) -> np.ndarray:
    """Every string of ORDER + 1 bytes as a number."""
    out = data[: len(data) - ORDER].astype(np.uint32)
    for k in range(1, ORDER + 1):
        out = out << np.uint32(8) | data[k : len(data) - ORDER + k]
    return out


def learned(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", training_docs: int = TRAINING_DOCS, id_col: str = "doc_id") -> Trees:
    """Trees of the rows given that have text and language: about training_docs of them, by a hash of id and
    text. Each language gives all its rows or an equal number, so that none is left out because others have more.

    Strings are counted on the executors, over whole texts; the driver gets the distinct ones of the sample. The ranges
    of code lengths come from the sample too: each document is coded with the trees of the half that it is not in. All
    copies of a text are in one half.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id"))
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    most = quota(list(rows.values()), training_docs)
    sample = known
    if crowded := {x: n for x, n in rows.items() if n > most}:
        least = F.create_map(*(F.lit(v) for x, n in sorted(crowded.items()) for v in (x, int(most / n * (1 << 30)))))
        sample = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.coalesce(least[F.col("lang")], F.lit(1 << 30)))
    halved = [F.col("lang"), F.col("text"), F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2)).alias("half")]

    def step(cols, state):
        texts, langs, halves = text_bytes(cols[1]), np.array(cols[0].to_pylist(), object), cols[2].to_numpy()
        out_lang, out_half, out_key, out_n = [], [], [], []
        for lang, half in sorted(set(zip(langs.tolist(), halves.tolist()))):
            for _, pieces in windows([texts[i] for i in np.flatnonzero((langs == lang) & (halves == half))]):
                keys, n = np.unique(strings_of(pieces), return_counts=True)
                out_lang += [lang] * len(keys)
                out_half.append(np.full(len(keys), half, np.int64))
                out_key.append(keys.astype(np.int64))
                out_n.append(n)
        none = [np.zeros(0, np.int64)]
        return [pa.array(out_lang, pa.string()), *(np.concatenate(none + x) for x in (out_half, out_key, out_n))]

    counted = stream(sample, step, halved, "lang string, half long, s long, n long").groupBy("lang", "half", "s").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(counted["lang"].unique().tolist())
    which = counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    half, keys, n = counted["half"].to_numpy(np.int64), counted["s"].to_numpy(np.int64).astype(np.uint32), counted["n"].to_numpy(np.int64)
    trees = grown(languages, which, keys, n)
    if not languages:
        return trees
    others = sample.sparkSession.sparkContext.broadcast([grown(languages, *(x[half != h] for x in (which, keys, n))) for h in (0, 1)])
    place = {x: i for i, x in enumerate(languages)}

    def coded(cols, state):
        texts, langs, halves = text_bytes(cols[1]), np.array([place[x] for x in cols[0].to_pylist()], np.int64), cols[2].to_numpy()
        bits = np.zeros(len(texts))
        for h in (0, 1):
            of = np.flatnonzero(halves == h)
            bits[of] = local(others)[h].lengths([texts[i] for i in of])[np.arange(len(of)), langs[of]] / UNIT
        return [langs, halves, np.array([len(x) for x in texts], np.int64), bits]

    got = stream(sample, coded, halved, "lang long, half long, n long, bits double").toArrow()  # a row a document of the sample
    lang, own, size, bits = (got[c].to_numpy() for c in ("lang", "half", "n", "bits"))
    taught = np.array([[((which == i) & (half != h)).any() for h in (0, 1)] for i in range(len(languages))])
    fit = (size > 0) & taught[lang, own]
    trees.limits = ranges(len(languages), lang[fit], size[fit], bits[fit])
    others.destroy()
    del counted, which, half, keys, n, got
    trim()
    return trees


def quota(rows: list[int], total: int) -> float:
    """The largest number that each of the groups may give at most, for total rows in all; one at least."""
    rows, rest = sorted(rows), total
    for i, n in enumerate(rows):
        if n * (len(rows) - i) > rest:
            return max(1.0, rest / (len(rows) - i))
        rest -= n
    return float(max(rows, default=1))


def grown(languages: list[str], which: np.ndarray, keys: np.ndarray, n: np.ndarray) -> Trees:
    """Trees of n strings each of ORDER + 1 bytes, by place of their language."""
    counts = {}
    for k in range(ORDER, -1, -1):
        tail = keys & np.uint32((1 << 8 * (k + 1)) - 1)
        distinct, place = np.unique(tail, return_inverse=True)
        c = np.zeros((len(distinct), len(languages)), np.int64)
        np.add.at(c, (place, which), n)
        counts[k] = (distinct, c)
    return Trees(languages, counts)


def ranges(languages: int, lang: np.ndarray, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Trees.limits, from held-out documents' language, bytes and bits: the median, and the spread by the quartiles of
    the longer half, which do not heed a few documents that are labelled wrongly."""
    out = np.full((languages, 2), np.inf)
    for i in range(languages):
        of = lang == i
        if of.sum() >= RANGE_DOCS:
            n, rate = size[of], bits[of] / size[of]
            low, middle, high = np.percentile(rate[n >= np.median(n)], [25, 50, 75])
            out[i] = middle, max((high - low) / 1.349, LEAST_SPREAD * middle) ** 2
    return out


def identified(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row, from its whole text alone; und with score 0 for null texts and texts
    without a letter. Repeated rows get a row each."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the training sample's distinct strings

    def step(cols, state):
        said, score = local(shared).predicted(text_bytes(cols[1]))
        return [cols[0], pa.array(said, pa.string()), score]

    return stream(docs, step, [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")], f"doc_id {kind}, lang_pred string, score double")


def kept(docs: DataFrame, trees: Trees, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, whose language is told with a score of at least least and that
    are coded about as well as that language's own documents. Each row is judged by its whole text alone, so ids may be
    null or repeat, and rows of one text stay or go alike; null and empty texts and those without a letter go. An empty
    table gives no rows, and trees without a language keep none."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for few in sliced(batch):
                said, score, own = local(shared).judged(text_bytes(few.column(at).cast(pa.string())))
                yield few.filter(pa.array((np.array(said) != "und") & (score >= least) & own))

    return arrow_map(docs, run, docs.schema)
