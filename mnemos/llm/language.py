"""Languages of documents and of the segments of mixed documents.

Method: sparse multinomial logistic regression on TF-IDF character n-grams,
trained with follow-the-regularised-leader and elastic-net penalties, then
calibrated with one temperature. The labels it learns from are those the
documents carry, wrong ones among them, from a bounded seeded sample; how rare an
n-gram is, is counted over all documents.

A text's score is the mean over its words, so each word has scores of its own;
segments are the best path through them when a change of language costs
something, less where a sentence begins.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mnemos.sources.tables import table

LANGUAGES = ("de", "en", "es", "fr", "nl", "pt", "ru")
SAMPLE = 400  # labelled documents of each language that the classifier learns from
BITS = 16  # n-grams are hashed to 2^BITS columns
GRAMS = (1, 2, 3, 4)
CHUNK = 8  # words of a training example
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.3, 0.5
CHANGE, CHANGE_WITHIN = 5.0, 10.0  # cost of a change of language where a sentence begins, and elsewhere
WORD_GAIN = 1.5
LEAST_WORDS = 12

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
# What is no running text, each with a sign without which it can't occur: most texts hold few of them.
_NOT_TEXT = (
    ("`", r"`[^`]*`"), ('"', r'"[^"\n]*(?:\n[^"\n]*)?"'), ("“", r"“[^”]*”"), ("„", r"„[^“”]*[“”]"), ("«", r"«[^»]*»"),  # code and quotes
    ("@", r"<[^>\s]*@[^>\s]*>|\S+@\S+"), ("://", r"\w+://\S+"), ("#", r"\(?\#\d+\)?"),  # addresses, numbers of issues
    ("/", r"\S*[\w)]/[\w(]\S*"), (".", r"\b[\w-]+\.\w+:\d+|\b[\w-]+\.[a-z]{1,4}\b(?=[\s,;:)]|$)"),  # paths and files
)
_IDENTIFIER, _SIGN = r"\b\w*[_\d]\w*\b", re.compile(r"[_\d]")
_ENDS = re.compile(r"[.!?;:]|\n\n")
_NOT_LINE = re.compile(r"\s*(?:[#>|]|[\w-]+-by:|[a-z][\w-]*: *\S+ *$|[\w-]+: .*<\S+@\S+>)", re.I)


def message(text: Column) -> Column:
    """The message of a printed commit: from the first blank line to the diff."""
    head = F.substring_index(text, "\ndiff --git ", 1)
    return F.when(F.instr(head, "\n\n") > 0, F.substr(head, F.instr(head, "\n\n") + 2)).otherwise(F.lit(""))


def label(lang: Column) -> Column:
    """The language a label names: its two letters, with or without a region, in any case; else null."""
    found = F.regexp_extract(lang, r"^\s*([A-Za-z]{2})(?:[-_][A-Za-z0-9]{2,3})?\s*$", 1)
    return F.when(found != "", F.lower(found))


@lru_cache(None)
def _no_text(signs: tuple[bool, ...]) -> re.Pattern | None:
    parts = [p for (_, p), there in zip(_NOT_TEXT, signs) if there] + [_IDENTIFIER] * signs[-1]
    return re.compile("|".join(parts)) if parts else None


def running_words(text: str) -> tuple[list[str], list[int], list[bool]]:
    """The words of the running text, where each starts in the text, and whether a sentence may begin there."""
    kept = "\n".join([" " * len(x) if _NOT_LINE.match(x) else x for x in text.split("\n")])
    pattern = _no_text((*[sign in kept for sign, _ in _NOT_TEXT], _SIGN.search(kept) is not None))
    if pattern:
        kept = pattern.sub(lambda m: " " * (m.end() - m.start()), kept)  # places stay as they are
    out, at, begins, end = [], [], [], 0
    for m in _WORD.finditer(kept):
        start, after = m.span()
        word, between = m.group(), kept[end:start]
        out.append(word.lower())
        at.append(start)
        begins.append(word[0].isupper() or between != " " and _ENDS.search(between) is not None)
        end = after
    return out, at, begins


@lru_cache(20_000)
def _grams(word: str) -> tuple[int, ...]:
    w = f"^{word}$"
    return tuple(zlib.crc32(w[i : i + n].encode()) & ((1 << BITS) - 1) for n in GRAMS for i in range(len(w) - n + 1))


def _chunks(words: list[str]) -> list[list[str]]:
    return [words[i : i + CHUNK] for i in range(0, len(words) - CHUNK // 2, CHUNK)]


def _count(df: np.ndarray, chunks: list[list[str]]) -> None:
    """Adds the chunks to ``df``: in how many each n-gram occurs, and at the end how many there are."""
    for lo in range(0, len(chunks), 10_000):
        some, known = chunks[lo : lo + 10_000], {}
        word = np.array([known.setdefault(w, len(known)) for c in some for w in c])
        grams = [_grams(w) for w in known]
        size = np.array([len(g) for g in grams])
        column = np.array([i for g in grams for i in g])
        many, start = size[word], (np.cumsum(size) - size)[word]
        at = np.arange(many.sum()) + np.repeat(start - (np.cumsum(many) - many), many)
        owner = np.repeat(np.repeat(np.arange(len(some)), [len(c) for c in some]), many)
        key = np.sort((owner << BITS) | column[at])  # np.unique hashes, which is slower here
        df[:-1] += np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] & ((1 << BITS) - 1), minlength=1 << BITS)
        df[-1] += len(some)


def gram_counts(documents: DataFrame, text: str) -> np.ndarray:
    """In how many chunks of all documents each hashed n-gram occurs, and at the end the
    number of chunks; the driver gathers 2^BITS + 1 numbers at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << BITS) + 1, np.int64)
        for b in batches:
            _count(df, [c for t in b.column(0).to_pylist() for c in _chunks(running_words(t)[0])])
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["gram", "n"])

    picked = documents.select(F.col(text).alias("t")).where("t is not null")
    found = picked.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


class Model:
    """Weights per hashed n-gram and language, the n-grams' rarity and the temperature."""

    def __init__(self, languages: Sequence[str]) -> None:
        self.languages = tuple(languages)
        self.weights = np.zeros((1 << BITS, len(self.languages)), np.float32)
        self.bias = np.zeros(len(self.languages), np.float32)
        self.idf = np.ones(1 << BITS, np.float32)
        self.temperature = 1.0
        self._seen: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def vector(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values: the mean over the words of each word's n-grams, weighted by rarity."""
        total: Counter = Counter()
        for w in words:
            g = _grams(w)
            for i in g:
                total[i] += 1 / len(g) ** 0.5
        idx = np.fromiter(total, np.int64, len(total))
        return idx, np.fromiter(total.values(), np.float64, len(total)) * self.idf[idx] / max(1, len(words))

    def word_scores(self, word: str) -> np.ndarray:
        found = self._seen.get(word)
        if found is None:
            if len(self._seen) > 200_000:
                self._seen.clear()
            idx, val = self.vector([word])
            found = self._seen[word] = (val @ self.weights[idx]).astype(np.float32)
        return found

    def fit(self, texts: Sequence[str], labels: Sequence[str], seed: int = 5, counts: np.ndarray | None = None) -> Model:
        """``counts`` are those of ``gram_counts``; without them the texts' own are taken."""
        rng = np.random.default_rng(seed)
        chunks, ys = [], []
        for text, lang in zip(texts, labels):
            more = _chunks(running_words(text)[0])
            chunks += more
            ys += [self.languages.index(lang)] * len(more)
        if not chunks:
            return self
        if counts is None:
            counts = np.zeros((1 << BITS) + 1, np.int64)
            _count(counts, chunks)
        self.idf = np.log((1 + counts[-1]) / (1 + counts[:-1])).astype(np.float32)
        data = [self.vector(c) for c in chunks]
        order = rng.permutation(len(data))
        held, train = order[: len(data) // 10], order[len(data) // 10 :]
        k = len(self.languages)
        z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
        zb, nb = np.zeros(k), np.zeros(k)
        y = np.eye(k)[ys]

        def weights(z, n):
            return np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

        for _ in range(EPOCHS):
            for i in rng.permutation(train):
                idx, val = data[i]
                zi, ni = z[idx], n[idx]
                w, wb = weights(zi, ni), -zb * ALPHA / (BETA + np.sqrt(nb))
                s = val @ w + wb
                p = np.exp(s - s.max())
                p = p / p.sum() - y[i]
                g = val[:, None] * p
                z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                n[idx] = ni + g * g
                zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * wb
                nb += p * p
        self.weights = weights(z, n).astype(np.float32)
        self.bias = (-zb * ALPHA / (BETA + np.sqrt(nb))).astype(np.float32)
        if len(held):
            scores = np.array([data[i][1] @ self.weights[data[i][0]] + self.bias for i in held])
            right = np.array([ys[i] for i in held])
            self.temperature = min(np.geomspace(0.05, 5, 60), key=lambda t: _loss(scores / t, right))
        self._seen = {}
        return self

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        x = (scores + self.bias) / self.temperature
        x = np.exp(x - x.max(axis=-1, keepdims=True))
        return x / x.sum(axis=-1, keepdims=True)


def _loss(x: np.ndarray, right: np.ndarray) -> float:
    m = x.max(axis=1)
    return float((np.log(np.exp(x - m[:, None]).sum(axis=1)) + m - x[np.arange(len(x)), right]).mean())


def _paths(scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray, gain: float) -> np.ndarray:
    """The language of each word: the best path of every text, all texts a word further at a time."""
    e = scores.astype(np.float64) * gain
    e -= np.log(np.exp(e - e.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + e.max(axis=1, keepdims=True)
    cost = np.where(begins, CHANGE, CHANGE_WITHIN)
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    best = np.zeros((len(sizes), e.shape[1]))
    came = np.zeros(e.shape, np.int8)
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")  # texts longer than t
    for t in range(steps):
        m = active[t]
        at = start[:m] + t
        if t:
            top = best[:m].argmax(axis=1)
            leap = best[np.arange(m), top] - cost[at]
            stay = best[:m] >= leap[:, None]
            came[at] = np.where(stay, np.arange(e.shape[1]), top[:, None])
            best[:m] = np.where(stay, best[:m], leap[:, None]) + e[at]
        else:
            best[:m] = e[at]
    out = np.zeros(len(e), np.int8)
    now = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        out[at] = now[:m]
        now[:m] = came[at, now[:m]]
    return out


def train(documents: DataFrame, doc_id: str, text: str, lang: str, languages: Sequence[str] = LANGUAGES, sample: int = SAMPLE) -> Model:
    """Fits a model on at most ``sample`` documents of each language, those with the lowest
    hash of their id, with the n-grams' rarity in all documents; the driver gathers no more. Documents without words or a label that names
    one of the languages are passed over; without any, the model knows nothing and gives all languages alike."""
    known = documents.select(F.xxhash64(F.lit(3), doc_id).alias("h"), label(F.col(lang)).alias("lang"), F.col(text).alias("text"))
    known = known.where(F.col("lang").isin(*languages) & (F.length("text") > 40))
    # each task passes on its first of a language to one of 64 places, so that no one gathers those of all tasks
    for keys in (["lang", "place"], ["lang"]):
        w = Window.partitionBy(*keys).orderBy("h", "text")
        known = known.withColumn("place", F.pmod(F.spark_partition_id(), F.lit(64))) if "place" in keys else known
        known = known.withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample).drop("n")
    rows = known.select("lang", "text", "h").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], r["text"]))
    return Model(languages).fit([r["text"] for r in rows], [r["lang"] for r in rows], counts=gram_counts(documents, text))


def segments(documents: DataFrame, doc_id: str, text: str, model: Model, *keep: str) -> DataFrame:
    """(``doc_id``, segment, lang, words, start_char, end_char, confidence, and the columns ``keep`` of the document): the parts of
    each text's running words in one language, in order; ``confidence`` is the calibrated
    probability of the language over the part.

    Defined cases: null, empty and wordless texts have no rows; repeated rows give
    repeated rows; texts of any length are taken whole; other columns are ignored.
    """
    picked = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).where("d is not null and t is not null")
    kinds = [picked.schema["d"].dataType, T.IntegerType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.IntegerType(), T.DoubleType()]
    names = [doc_id, "segment", "lang", "words", "start_char", "end_char", "confidence", *keep]
    kinds += [f.dataType for f in picked.schema.fields[2:]]
    schema = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)])
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            words, at, ends, begins, sizes = [], [], [], [], []
            for t in b.column(1).to_pylist():
                w, places, first = running_words(t)
                words += w
                at += places
                ends += [p + len(x) for p, x in zip(places, w)]
                begins += first
                sizes.append(len(w))
            if not words:
                continue
            scores = np.array([m.word_scores(w) for w in words])
            size = np.array(sizes)
            path = _paths(scores, np.array(begins), size, WORD_GAIN / m.temperature * 0.5)
            row = np.repeat(np.arange(len(size)), size)
            cut = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (row[1:] != row[:-1])]))
            last = np.concatenate([cut[1:], [len(path)]])
            many = last - cut
            means = np.add.reduceat(scores.astype(np.float64), cut, axis=0) / many[:, None]
            sure = m.probabilities(means)[np.arange(len(cut)), path[cut]]
            owner = row[cut]
            first = np.searchsorted(owner, owner, "left")
            columns = [
                b.column(0).take(pa.array(owner)), np.arange(len(cut)) - first, [m.languages[k] for k in path[cut]],
                many, np.array(at)[cut], np.array(ends)[last - 1], sure, *(c.take(pa.array(owner)) for c in b.columns[2:]),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, to_arrow_type(k)) for c, k in zip(columns, kinds)], schema.names)

    return picked.mapInArrow(run, schema).toDF(*names)


def per_language(parts: DataFrame, doc_id: str, *keep: str) -> DataFrame:
    """(``doc_id``, ``keep``, lang, words, confidence): the segments of a document added up by language; repeated segments count once."""
    once = parts.repartition(doc_id).distinct()  # one shuffle for both
    return once.groupBy(doc_id, *keep, "lang").agg(F.sum("words").alias("words"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("confidence"))


def main_language(parts: DataFrame, doc_id: str) -> DataFrame:
    """(``doc_id``, lang, words, confidence, share): the language with most of a document's words; ties to the earlier code."""
    by = per_language(parts, doc_id)
    best = by.groupBy(doc_id).agg(F.sum("words").alias("all"), F.min(F.struct((-F.col("words")).alias("n"), "lang", "words", "confidence")).alias("b"))
    return best.select(doc_id, "b.lang", "b.words", "b.confidence", (F.col("b.words") / F.col("all")).alias("share"))


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "lang", "text").select("doc_id", "lang", message(F.col("text")).alias("text"), label(F.col("lang")).alias("named"))
    return segments(docs, "doc_id", "text", train(docs, "doc_id", "text", "lang"), "named")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    long = per_language(_parts(spark, folder), "doc_id", "named").where(F.col("words") >= LEAST_WORDS)
    return long.where(~F.col("lang").eqNullSafe(F.col("named"))).select("doc_id", "lang").distinct()


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    return main_language(_parts(spark, folder), "doc_id")


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder).drop("named")


QUERIES = {"p9_found": p9_found, "p9_documents": p9_documents, "p9_segments": p9_segments}
ORACLE: dict[str, str] = {}
