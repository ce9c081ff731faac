"""Toxicity by a classifier chain: linear models that each see the probabilities of the categories before them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, drop, materialize, null_id, require, with_id
from .wordhash import hash_words

#: Labelled documents that the chain is fitted on at most: the bound of the driver's part.
MOST_LABELLED = 12_000
#: Words fall into so many buckets.
BITS = 18
FOLDS = 5
#: A word enters a model if its share among positive documents differs by so many standard errors.
LEAST_Z = 4.0
#: How much more recall weighs than precision where a threshold is chosen (the beta of the F measure).
RECALL = 1.5
#: Documents of the sample that a word must be in.
LEAST_DOCS = 4
#: Words that a model has at most, those that tell most.
MOST_WORDS = 4096
#: Bytes of text handled at once.
PARSED = 1_500_000

_APART = np.ones(256, dtype=bool)
_APART[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)]] = False


@dataclass(frozen=True)
class Category:
    """A category and the label that marks it: ``column`` equals ``positive``."""

    name: str
    column: str
    positive: int = 1


@dataclass
class Linear:
    """Weights of word buckets and of the probabilities of earlier categories."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float = 0.5

    def logit(self, sums: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return sums + (earlier @ self.earlier if len(self.earlier) else 0.0) + self.bias


@dataclass
class Chain:
    categories: tuple[Category, ...]
    models: list[Linear] = field(default_factory=list)
    #: Out-of-fold precision and recall of each category at its threshold.
    held_out: list[tuple[float, float]] = field(default_factory=list)


def word_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text's words, end to end, and where each text's begin.

    Words are runs of letters, digits and bytes beyond ASCII, with A-Z in lower case.
    """
    words, at = hash_words(texts, _APART)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(at))
    keys = np.unique((owner << BITS) | (words >> np.uint64(64 - BITS)).astype(np.int64))
    counts = np.bincount(keys >> BITS, minlength=len(texts))
    return keys & ((1 << BITS) - 1), np.append(0, np.cumsum(counts))


def _sums(weights: np.ndarray, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(weights[buckets]))
    return total[at[1:]] - total[at[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def telling(n: int, p: int, df: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The buckets, ascending, whose words tell the ``p`` positive ones of ``n`` documents by a two-proportion z test.

    ``df`` and ``pos`` count the documents and the positive ones that hold each bucket. At most ``MOST_WORDS``, the greatest |z| first.
    """
    if not 0 < p < n:
        return np.empty(0, np.int64)
    share = df / n
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs((pos / p - (df - pos) / (n - p)) / np.sqrt(share * (1 - share) * (1 / p + 1 / (n - p))))
    chosen = np.flatnonzero((df >= LEAST_DOCS) & (df < n) & (z >= LEAST_Z))
    return np.sort(chosen[np.argsort(-z[chosen], kind="stable")][:MOST_WORDS])


def fit_linear(buckets: np.ndarray, at: np.ndarray, earlier: np.ndarray, y: np.ndarray, rounds: int = 200, decay: float = 1e-3) -> Linear:
    """Logistic regression on the presence of telling words and on earlier probabilities, by gradient steps with momentum.

    Which words tell is decided on the same rows.
    """
    n, p = len(y), int(y.sum())
    width, size = earlier.shape[1], 1 << BITS
    words = np.zeros(size)
    rate = (p + 1.0) / (n + 2.0)
    if not 0 < p < n:
        return Linear(words, np.zeros(width), float(np.log(rate / (1 - rate))))
    row = np.repeat(np.arange(n), np.diff(at))
    chosen = telling(n, p, np.bincount(buckets, minlength=size), np.bincount(buckets, weights=y[row], minlength=size))
    column = np.full(size, -1)
    column[chosen] = np.arange(len(chosen))
    use = column[buckets] >= 0
    row, col = row[use], column[buckets[use]]
    w, v, b = np.zeros(len(chosen)), np.zeros(width), float(np.log(rate / (1 - rate)))
    mw, mv, mb, sw, sv, sb = np.zeros_like(w), np.zeros_like(v), 0.0, np.zeros_like(w), np.zeros_like(v), 0.0
    for t in range(1, rounds + 1):
        margin = np.bincount(row, weights=w[col], minlength=n) + earlier @ v + b
        error = (_sigmoid(margin) - y) / n
        gw, gv, gb = np.bincount(col, weights=error[row], minlength=len(w)) + decay / n * w, earlier.T @ error + decay / n * v, error.sum()
        mw, mv, mb = 0.9 * mw + 0.1 * gw, 0.9 * mv + 0.1 * gv, 0.9 * mb + 0.1 * gb
        sw, sv, sb = 0.99 * sw + 0.01 * gw**2, 0.99 * sv + 0.01 * gv**2, 0.99 * sb + 0.01 * gb**2
        up, down = 1 - 0.9**t, 1 - 0.99**t
        step = 0.1
        w = w - step * (mw / up) / (np.sqrt(sw / down) + 1e-8)
        v = v - step * (mv / up) / (np.sqrt(sv / down) + 1e-8)
        b = b - step * (mb / up) / (np.sqrt(sb / down) + 1e-8)
    words[chosen] = w
    return Linear(words, v, float(b))


def _rows_of(keep: np.ndarray, buckets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [buckets[at[i] : at[i + 1]] for i in np.flatnonzero(keep)]
    return (np.concatenate(parts) if parts else buckets[:0]), np.append(0, np.cumsum([len(x) for x in parts], dtype=np.int64)).astype(np.int64)


def fit_chain(buckets: np.ndarray, at: np.ndarray, labels: np.ndarray, folds: np.ndarray, categories: tuple[Category, ...]) -> Chain:
    """Fits the models in order. What a later model learns from are out-of-fold probabilities of the earlier ones,
    so that it sees them as unsure as they will be on new texts. Each threshold is the out-of-fold one of
    the best F measure, in which recall weighs ``RECALL`` times as much as precision; the highest of equals."""
    chain = Chain(categories)
    earlier = np.zeros((len(labels), 0))
    for k in range(len(categories)):
        y = labels[:, k].astype(float)
        logit = np.zeros(len(y))
        for f in range(FOLDS):
            train, test = folds != f, folds == f
            if not train.any() or not test.any():
                continue
            model = fit_linear(*_rows_of(train, buckets, at), earlier[train], y[train])
            b, a = _rows_of(test, buckets, at)
            logit[test] = model.logit(_sums(model.words, b, a), earlier[test])
        model = fit_linear(buckets, at, earlier, y)
        order = np.argsort(-logit, kind="stable")
        hits = np.cumsum(y[order])
        f = (1 + RECALL**2) * hits / (np.arange(1, len(y) + 1) + RECALL**2 * max(y.sum(), 1))
        at_best = int(np.argmax(f)) if len(y) and y.any() else -1
        if at_best >= 0:
            lower = logit[order[at_best + 1]] if at_best + 1 < len(y) else logit[order[at_best]] - 1
            model.threshold = float(_sigmoid(np.array([(logit[order[at_best]] + lower) / 2]))[0])
            chain.held_out.append((float(hits[at_best] / (at_best + 1)), float(hits[at_best] / y.sum())))
        else:
            model.threshold = 1.1
            chain.held_out.append((1.0, 1.0))
        chain.models.append(model)
        earlier = np.column_stack([earlier, _sigmoid(logit)])
    return chain


def predict(chain: Chain, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probabilities, a column a category."""
    known = np.zeros((len(at) - 1, 0))
    for model in chain.models:
        known = np.column_stack([known, _sigmoid(model.logit(_sums(model.words, buckets, at), known))])
    return known


def _encoded(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]


def train(docs: DataFrame, labels: DataFrame, categories: tuple[Category, ...], most: int = MOST_LABELLED) -> Chain:
    """A chain fitted on at most ``most`` labelled documents, taken in the order of a hash of their id.

    Rows with a null id, label or text are left out; of several labels of one id the greatest counts, and of several
    texts of one id the least. What reaches the driver is bounded: counts of ``2 ** BITS`` buckets by fold, then at most
    ``most`` rows of those buckets only that some model may use. Whole texts are read by the executors.
    """
    columns = list(dict.fromkeys(c.column for c in categories))
    require(labels, ["doc_id", *columns])
    usable = labels.where(" and ".join(f"{c} is not null" for c in ["doc_id", *columns]))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(c).alias(c) for c in columns])
    some = F.broadcast(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    marks = F.array(*[(F.col(c.column) == c.positive).cast("int") for c in categories]).alias("marks")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the fold follows from the id alone
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    rows = texts.join(some, "doc_id").groupBy("doc_id", marks).agg(F.min("text").alias("text")).select("doc_id", "text", fold, "marks")
    rows = materialize(rows, "labelled-texts")
    size, k = 1 << BITS, len(categories)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat, at = word_buckets(_encoded(batch["text"]))
            owner = np.repeat(np.arange(len(batch)), np.diff(at))
            key = batch["fold"].to_numpy(dtype=np.int64)[owner] * size + flat
            held, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            own = np.array([list(m) for m in batch["marks"]], dtype=np.int64).reshape(len(batch), k)
            counts = {f"n{i}": np.bincount(inverse, weights=own[owner, i], minlength=len(held)).astype(np.int64) for i in range(k)}
            yield pd.DataFrame({"key": held, "n": n} | counts)

    names = ["n", *(f"n{i}" for i in range(k))]
    counted = rows.select("text", "fold", "marks").mapInPandas(count, "key long, " + ", ".join(f"{n} long" for n in names))
    found = materialize(counted.groupBy("key").agg(*[F.sum(n).alias(n) for n in names]), "bucket-counts").toPandas()
    table = np.zeros((len(names), FOLDS * size), dtype=np.int64)
    table[:, found["key"].to_numpy(dtype=np.int64)] = found[names].to_numpy(dtype=np.int64).T
    table = table.reshape(len(names), FOLDS, size)
    each = {r[0]: (r[1], list(r[2])) for r in rows.groupBy("fold").agg(F.count("*"), F.array(*[F.sum(F.col("marks")[i]) for i in range(k)])).collect()}  # a row a fold
    useful = np.empty(0, np.int64)
    for left_out in (None, *range(FOLDS)):
        used = [f for f in range(FOLDS) if f != left_out and f in each]
        n, df = sum(each[f][0] for f in used), table[0, used].sum(axis=0)
        for i in range(k):
            useful = np.union1d(useful, telling(n, sum(each[f][1][i] for f in used), df, table[1 + i, used].sum(axis=0)))
    keep = np.zeros(size, dtype=bool)
    keep[useful] = True
    held = docs.sparkSession.sparkContext.broadcast(keep)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat, at = word_buckets(_encoded(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fold": batch["fold"], "marks": batch["marks"], "buckets": [(x := flat[a:b])[held.value[x]] for a, b in zip(at[:-1], at[1:], strict=True)]})

    kept = materialize(rows.mapInPandas(gather, "doc_id long, fold int, marks array<int>, buckets array<int>"), "labelled-buckets")
    found = kept.toPandas().sort_values("doc_id", kind="stable")
    drop(rows)
    flat = [np.asarray(b, dtype=np.int64) for b in found["buckets"]]
    at = np.append(0, np.cumsum([len(b) for b in flat], dtype=np.int64)).astype(np.int64)
    marks_of = np.array([list(m) for m in found["marks"]], dtype=np.int64).reshape(len(flat), k)
    return fit_chain(np.concatenate(flat) if flat else np.empty(0, np.int64), at, marks_of, found["fold"].to_numpy(dtype=np.int64), categories)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id`` and for each category its probability ``p_<name>`` and decision ``<name>``, for every row.

    Null and empty texts hold no words and get what the chain says of none; rows without an id are
    scored, and repeated rows get equal scores each; other columns are ignored and an empty table gives no rows. Whole texts
    are read, a few megabytes at a time. A document whose probability equals a threshold is decided positive.
    """
    require(docs, ["doc_id", "text"])
    models = docs.sparkSession.sparkContext.broadcast(chain)  # 2 ** BITS weights a category, whatever the corpus
    names = [c.name for c in chain.categories]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = models.value
        for batch in batches:
            texts, ids, no_id = _encoded(batch["text"]), batch["doc_id"].to_numpy(), batch[NO_ID].to_numpy()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= PARSED):
                    size += len(texts[end])
                    end += 1
                p = predict(chain, *word_buckets(texts[begin:end]))
                out = {"doc_id": ids[begin:end], NO_ID: no_id[begin:end]}
                for k, name in enumerate(names):
                    out |= {f"p_{name}": p[:, k], name: p[:, k] >= chain.models[k].threshold}
                yield pd.DataFrame(out)
                begin = end

    schema = f"doc_id long, {NO_ID} boolean, " + ", ".join(f"p_{n} double, {n} boolean" for n in names)
    return null_id(with_id(docs, "text").mapInPandas(run, schema))
