"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed into a fixed table of vectors;
a passage of ``PASSAGE`` consecutive words is the mean of its words' vectors, and a linear
softmax over that mean gives its class. A text scores as its most toxic passage, so a long
text is not diluted; training lets each text learn through that passage. Passages stand side
by side in training and overlap in scoring, so that none is cut in half. Misspelt words
share most n-grams, hence vectors, with the words they hide.

Fitting uses a bounded sample: at most ``most_labels`` labelled rows, those with the
smallest hash of their id, gathered in one task; the weights have a fixed size. Scoring
covers whole texts of all rows, in Arrow batches, without a shuffle.

Cases: null and empty texts have one empty passage, scored by the bias alone; rows whose
label or id is null are not learned from; without labels of both classes every score is the
share of toxic labels seen (0 if none); repeated rows score alike; other columns pass
through untouched, but those with the added names, if there, are replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import returning_memory, table
from inkwell.llm.shingles import TO_WORDS

BUCKETS, DIM, GRAMS, PASSAGE, STRIDE = 1 << 16, 4, (3, 4, 5, 6), 40, 10
MOST_LABELS, EPOCHS, SEED, CACHE = 8000, 40, 5, 200_000
#: A vector is learned only if that many pairs of word and labelled text share its bucket; DECAY shrinks it each step.
LEAST_PAIRS, DECAY, RATE, FLOOR = 25, 0.03, 3.0, 0.9998


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all words' n-grams, word after word, and how many each word has."""
    marked = b"".join(b"<" + w + b">" for w in words)
    b = np.frombuffer(marked, np.uint8).astype(np.uint64) + np.uint64(1)
    size = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    owner = np.repeat(np.arange(len(words)), size)
    room = ends[owner] - np.arange(len(b))  # bytes from here to the end of the word
    power, all_ids, all_owners = np.uint64(1099511628211), [], []
    h = np.zeros(len(b), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = max(len(b) - n + 1, 0)
        h[:m] = h[:m] * power + b[n - 1 : n - 1 + m]
        if n in GRAMS:
            at = np.flatnonzero(room >= n)
            all_ids.append(_bucket(h[at] + np.uint64(n)))
            all_owners.append(owner[at])
    weights = np.cumprod(np.full(int(size.max()), power, np.uint64)) if len(words) else np.zeros(0, np.uint64)
    whole = np.add.reduceat(b * weights[np.arange(len(b)) - starts[owner]], starts) if len(words) else np.zeros(0, np.uint64)
    all_ids.append(_bucket(whole))
    all_owners.append(np.arange(len(words)))
    ids, owners = np.concatenate(all_ids), np.concatenate(all_owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.bincount(owners, minlength=len(words))


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``, all of at least one row."""
    return np.add.reduceat(values, np.cumsum(counts) - counts, axis=0)


def _run_sums(values: np.ndarray, index: np.ndarray, counts: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Sums of values[index] over consecutive runs of ``index``, all of at least one, in blocks of bounded size."""
    ends = np.cumsum(counts)
    out, i = np.empty((len(counts), values.shape[1]), np.float32), 0
    while i < len(counts):
        a = int(ends[i] - counts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + step, "right")))
        out[i:j] = np.add.reduceat(values[index[a : int(ends[j - 1])]], ends[i:j] - counts[i:j] - a, axis=0)
        i = j
    return out


def _common_subwords(words: list[bytes], texts_of: np.ndarray, step: int = 50_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word its n-grams in buckets that LEAST_PAIRS pairs of word and text share, how many those are and how many it has in all; and those buckets.

    Goes through the words in steps, so that n-grams in rare buckets never gather.
    """
    seen = np.zeros(BUCKETS)
    for i in range(0, len(words), step):
        ids, n = subwords(words[i : i + step])
        seen += np.bincount(ids, np.repeat(texts_of[i : i + step], n), BUCKETS)
    common = seen >= LEAST_PAIRS
    grams, kept, every = [], [], []
    for i in range(0, len(words), step):
        ids, n = subwords(words[i : i + step])
        keep = common[ids]
        kept.append(np.bincount(np.repeat(np.arange(len(n)), n)[keep], minlength=len(n)))
        grams.append(ids[keep].astype(np.int32))
        every.append(n)
    return np.concatenate(grams), np.concatenate(kept), np.concatenate(every), common


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Vectors, softmax weights and bias, by full-batch Adam on the texts' most toxic passages.

    In the first quarter of the epochs every passage carries its text's label.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return {"vectors": np.zeros((BUCKETS, 1), np.float32), "weights": np.zeros((1, 2), np.float32), "bias": np.array([0.0, 20.0 if len(y) and y[0] else -20.0], np.float32)}
    ids: dict[bytes, int] = {}
    words, passages, owner = array("i"), [], []
    for k, text in enumerate(texts):
        w = [ids.setdefault(x, len(ids)) for x in words_of(text)] or [ids.setdefault(b"", len(ids))]
        for i in range(0, len(w), PASSAGE):
            passages.append(len(w[i : i + PASSAGE]))
            owner.append(k)
        words.extend(w)
    words, passages, owner = np.frombuffer(words, np.int32), np.array(passages), np.array(owner)
    vocabulary = list(ids)
    del ids
    by_text = np.bincount(owner, minlength=len(y))
    pairs = np.unique(words.astype(np.int64) * len(y) + np.repeat(owner, passages)) // len(y)
    grams, per_word, whole, kept = _common_subwords(vocabulary, np.bincount(pairs, minlength=len(vocabulary)))
    n_words = len(vocabulary)
    del pairs, vocabulary
    whole = whole.astype(np.float32)[:, None]  # a word is the mean over all its n-grams; those too rare stay zero
    learned = np.flatnonzero(per_word)
    # The two scatter-adds of the gradient, as sums over runs: words of each bucket, passages of each word.
    order = np.argsort(grams, kind="stable").astype(np.int32)
    used, c1 = np.unique(grams, return_counts=True)
    word_of = np.repeat(np.arange(n_words, dtype=np.int32), per_word)[order]
    order = np.argsort(words, kind="stable").astype(np.int32)
    c2 = np.bincount(words, minlength=n_words)
    passage_of = np.repeat(np.arange(len(passages), dtype=np.int32), passages)[order]
    del order
    rng = np.random.default_rng(seed)
    p = {"vectors": (rng.normal(0, 0.1, (BUCKETS, DIM)) * kept[:, None]).astype(np.float32), "weights": rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), "bias": np.zeros(2, np.float32)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    first = np.cumsum(by_text) - by_text
    p["bias"][1] = np.log(y.mean() / (1 - y.mean()))
    floor = 0.0
    for epoch in range(1, epochs + 1):
        w = np.zeros((n_words, DIM), np.float32)
        w[learned] = _run_sums(p["vectors"], grams, per_word[learned])
        w /= whole
        v = _run_sums(w, words, passages) / passages[:, None]
        z = v @ p["weights"] + p["bias"]
        gap = z[:, 1] - z[:, 0]
        if epoch * 4 <= epochs:
            weight = 1 / by_text[owner]
        else:
            best = np.maximum.reduceat(gap, first)
            weight = (gap == best[owner]).astype(np.float64)
            weight /= np.add.reduceat(weight, first)[owner]
        e = np.exp(z - z.max(1, keepdims=True))
        e /= e.sum(1, keepdims=True)
        e[np.arange(len(e)), y[owner]] -= 1
        e = (e * (weight / len(y))[:, None]).astype(np.float32)
        gv = (e @ p["weights"].T) / passages[:, None].astype(np.float32)
        gw = _run_sums(gv, passage_of, c2) / whole
        grad = {"weights": v.T @ e + 1e-5 * p["weights"], "bias": e.sum(0), "vectors": np.zeros_like(p["vectors"])}
        grad["vectors"][used] = _run_sums(gw, word_of, c1)
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            step = (m[k] / (1 - 0.9**epoch)) / (np.sqrt(s[k] / (1 - 0.99**epoch)) + 1e-8)
            if k == "vectors":
                # The floor lets what few texts hold, with its small gradient, move little.
                floor = floor or float(np.quantile(np.abs(g[used]), FLOOR))
                step = (m[k] / (1 - 0.9**epoch)) / (np.sqrt(s[k] / (1 - 0.99**epoch)) + floor)
                p[k] = (p[k] * (1 - DECAY) - RATE * step).astype(np.float32)
            else:
                p[k] = (p[k] - 0.05 * step).astype(np.float32)
    return p


def gram_scores(p: dict[str, np.ndarray]) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log-odds: the model is linear after its averages."""
    w = p["weights"][:, 1] - p["weights"][:, 0]
    return (p["vectors"] @ w).astype(np.float64), float(p["bias"][1] - p["bias"][0])


class Scorer:
    """Log-odds of texts, with a bounded cache of words."""

    def __init__(self, grams: np.ndarray, bias: float):
        self.grams, self.bias, self.known = grams, bias, {}

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        new = list({w for w in words if w not in known})
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set(words))
            ids, n = subwords(new)
            known.update(zip(new, (_sums(self.grams[ids], n) / n).tolist(), strict=True))
        return np.array([known[w] for w in words], np.float64)

    def __call__(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.log_odds(text), -60, 60))))

    def log_odds(self, text: str | None) -> float:
        """Of the most toxic of all passages that begin STRIDE words apart, and of the last one."""
        words, best = words_of(text) or [b""], -np.inf
        last = max(len(words) - PASSAGE, 0)
        for i in range(0, last + 1, STRIDE * 10_000):
            s = np.concatenate([[0.0], np.cumsum(self.word_scores(words[i : i + STRIDE * 10_000 + PASSAGE]))])
            most = max(len(s) - 1 - PASSAGE, 0)
            begin = np.minimum(np.arange(0, most + STRIDE, STRIDE), most)
            end = np.minimum(begin + PASSAGE, len(s) - 1)
            best = max(best, float(((s[end] - s[begin]) / (end - begin)).max()))
        return best + self.bias


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> tuple[np.ndarray, float]:
    """Learn from labelled rows (doc_id, toxic), in one task over a bounded sample."""
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id", "toxic").limit(most_labels)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id", "text", "toxic").limit(most_labels)

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []  # at most ``most_labels``
        for b in batches:
            texts += b["text"].to_pylist()
            y += b["toxic"].to_pylist()
        grams, bias = gram_scores(train(texts, y))
        yield pa.RecordBatch.from_pydict({"grams": pa.array([grams.astype("<f8").tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    got = rows.coalesce(1).mapInArrow(run, "grams binary, bias double").first()
    if got is None:
        return np.zeros(BUCKETS), -20.0
    return np.frombuffer(got["grams"], "<f8"), got["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", added: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All rows and columns of ``docs`` with its score and prediction, under the names in ``added``."""
    grams, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(grams)  # BUCKETS numbers, whatever the input
    docs = docs.drop(*added)
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.IntegerType())])
    at = docs.columns.index(text)

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, bias)
        for b in batches:
            s = np.array([scorer(x.as_py()) for x in b.column(at)], np.float64)
            columns = [*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, *added])

    return docs.mapInArrow(run, schema)


def held_out(share: int = 5):
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % share == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
