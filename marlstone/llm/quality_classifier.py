"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

Both start from labelled documents. In each round tasks score all unlabelled documents, and a view labels those that
it is surest of for the other. Each is then calibrated on labelled documents kept apart, and the calibrated views are combined there.
Fitting takes bounded samples (parameters below) and happens once; every document is scored, by tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, keep, leaving_nothing, text_of
from marlstone.llm.ngram_join import word_hashes
from marlstone.session import ship

BUCKETS = 1 << 16
#: Characters of texts whose words are hashed at once.
CHUNK = 1 << 20


@dataclass(frozen=True)
class CoTraining:
    """labelled: rows at most that fitting takes, the first by a hash of their id; least: labelled documents of each kind
    without which nothing is fitted; rounds; sure: least calibrated probability of a pseudo-label; given: documents that one
    view gives one label per round at most, the surest of all unlabelled ones; threshold: of kept."""

    labelled: int = 9000
    least: int = 10
    given: int = 500
    rounds: int = 3
    sure: float = 0.95
    threshold: float = 0.5


def style(t: str, n_words: int, n_distinct: int) -> list[float]:
    """Measures of a text's form."""
    n = max(len(t), 1)
    raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    symbols = np.isin(raw, np.frombuffer(b"#*$%&|<>!", dtype=np.uint8)).sum() / n
    upper = ((raw >= 65) & (raw <= 90)).sum() / n
    digits = ((raw >= 48) & (raw <= 57)).sum() / n
    lines = [x for x in t.split("\n") if x.strip()]
    dup = 1 - len(set(lines)) / max(len(lines), 1)
    return [symbols, upper, digits, dup, n_distinct / max(n_words, 1), min(n / max(n_words, 1), 50.0), float(np.log1p(n_words))]


def meta(f: pd.DataFrame, columns: tuple[str, ...]) -> np.ndarray:
    """Metadata as hashed indicator and number columns."""
    out = np.zeros((len(f), 64 * len(columns)))
    for i, c in enumerate(columns):
        if pd.api.types.is_numeric_dtype(f[c]):
            v = f[c].to_numpy(dtype=np.float64, na_value=np.nan)
            out[:, 64 * i] = np.isnan(v)
            out[:, 64 * i + 1] = np.log1p(np.clip(np.nan_to_num(v), 0, None)) / 10
        else:
            h = pd.util.hash_array(f[c].fillna("").astype(str).to_numpy(dtype=object), categorize=True) % 64
            out[np.arange(len(f)), 64 * i + h.astype(np.int64)] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> np.ndarray:
    """Weights (the last one a constant) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) / 100 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * len(x) / 100 * b)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b


def _logit(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x @ b[:-1] + b[-1]


def _prob(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class TextView:
    """Word evidence (log odds of a word's bucket in good and bad texts) and measures of form, in a logistic model."""

    def fit(self, words: list[np.ndarray], form: np.ndarray, y: np.ndarray, w: np.ndarray) -> TextView:
        # Evidence comes from one half and the model from the other: on its own texts, evidence looks too good.
        half = np.arange(len(y)) % 2 == 0
        good, bad = np.ones(BUCKETS), np.ones(BUCKETS)
        for i in np.flatnonzero(half):
            (good if y[i] else bad)[words[i]] += w[i]
        n1, n0 = w[half & (y == 1)].sum() + 2, w[half & (y == 0)].sum() + 2
        self.odds = (np.log(good / n1) - np.log(bad / n0)).astype(np.float32)
        rest = ~half
        x = self.rows([words[i] for i in np.flatnonzero(rest)], form[rest])
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.b = logistic((x - self.mean) / self.dev, y[rest], w[rest])
        return self

    def rows(self, words: list[np.ndarray], form: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), 5))
        for i, x in enumerate(words):
            o = np.sort(self.odds[x]) if len(x) else np.zeros(1)
            out[i] = o[0], o[min(1, len(o) - 1)], o[: max(1, min(5, len(o)))].mean(), o.mean(), o[-1]
        return np.hstack([out, form])

    def logit(self, words: list[np.ndarray], form: np.ndarray) -> np.ndarray:
        return _logit((self.rows(words, form) - self.mean) / self.dev, self.b)


def content(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct word buckets, sorted, and measures of form of each text."""
    words, form, i = [], [], 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK):
            n += len(texts[j])
            j += 1
        for t, h in zip(texts[i:j], word_hashes(texts[i:j]), strict=True):
            b = (h % np.uint64(BUCKETS)).astype(np.int32)
            distinct = np.unique(b)
            words.append(distinct)
            form.append(style(t, len(b), len(distinct)))
        i = j
    return words, np.array(form).reshape(len(texts), -1)


@dataclass
class Model:
    text: TextView
    meta: np.ndarray
    scale: tuple[np.ndarray, np.ndarray]
    mix: np.ndarray

    def views(self, words, form, m) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of the two views."""
        return _logit(self.text.logit(words, form)[:, None], self.scale[0]), _logit(_logit(m, self.meta)[:, None], self.scale[1])

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _prob(_logit(np.stack([a, b], axis=1), self.mix))


def co_train(words: list[np.ndarray], form: np.ndarray, m: np.ndarray, y: np.ndarray, c: CoTraining, surest) -> Model:
    """y: 1 good, 0 bad. A third of the rows is kept for calibration.

    surest(model): for each view its pseudo-labels of unlabelled documents, a dict from id to label, and a dict from
    id to words, form and metadata of every id in them.
    """
    held, train = np.arange(len(y))[::3], np.array([i for i in range(len(y)) if i % 3])
    pick = lambda ix: [words[i] for i in ix]
    given: list[dict[int, int]] = [{}, {}]  # pseudo-labels for the text view, for the metadata view
    known: dict[int, tuple] = {}
    ones = np.ones(len(held))
    for r in range(c.rounds + 1):
        sets = [(list(g), np.concatenate([y[train], np.fromiter(g.values(), np.int64, len(g))]), np.concatenate([np.ones(len(train)), np.full(len(g), 0.5)])) for g in given]
        ids, lab, w = sets[0]
        text = TextView().fit(pick(train) + [known[i][0] for i in ids], np.vstack([form[train], *[known[i][1] for i in ids]]), lab, w)
        ids, lab, w = sets[1]
        mb = logistic(np.vstack([m[train], *[known[i][2] for i in ids]]), lab, w, ridge=1.0)
        za, zb = text.logit(pick(held), form[held]), _logit(m[held], mb)
        scale = (logistic(za[:, None], y[held], ones), logistic(zb[:, None], y[held], ones))
        model = Model(text, mb, scale, np.zeros(3))
        if r == c.rounds:
            break
        told, features = surest(model)
        known |= features
        for teacher, labels in enumerate(told):
            given[1 - teacher].update(labels)
    a, b = model.views(pick(held), form[held], m[held])
    model.mix = logistic(np.stack([a, b], axis=1), y[held], ones)
    return model


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", metadata: tuple[str, ...] = ("lang", "source", "n_chars"), co: CoTraining | None = None) -> DataFrame:
    """id, p_text, p_meta (calibrated views), score, kept of every document.

    A document is good if all its labels say quality 1 and none says toxic; label rows without id or quality are
    left out. Null text: empty. Null metadata is a value of its own. Repeated rows are scored alike. With fewer than
    co.least good or bad labelled documents nothing can be fitted: scores are null and every document is kept, whatever
    the table's size. Extra columns are not read. An empty table gives no rows.
    """
    c = co or CoTraining()
    spark = docs.sparkSession
    ship(spark)
    told = labels.filter(f"{id_col} is not null and quality is not null").groupBy(F.col(id_col).cast("long").alias("id")).agg((F.min(F.col("quality")) * (1 - F.max(F.coalesce("toxic", F.lit(0))))).cast("int").alias("y"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_of(F.col(text)).alias("t"), *[F.col(x).alias(f"m{i}") for i, x in enumerate(metadata)])
    names = tuple(f"m{i}" for i in range(len(metadata)))
    key = F.xxhash64("t", *names).alias("key")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words, form = content(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w in words], pa.binary()), pa.array([x.tobytes() for x in form], pa.binary()), *b.columns[1:]], names=["words", "form", *b.schema.names[1:]])

    # Texts are read once: their words' buckets and measures are kept, and every round works on these.
    kinds = dict(src.dtypes)
    schema = "words binary, form binary, id long, key long" + "".join(f", {n} {kinds[n]}" for n in names)
    src = keep(src.select("t", "id", key, *names).mapInArrow(leaving_nothing(measured), schema), "features")
    first = lambda d, n: d.orderBy(F.xxhash64("id"), "id").limit(n)
    # The sample is bounded by a parameter, so its ids may be broadcast and its rows, one for each id, may come to the driver.
    some = first(told.join(src.select("id").distinct(), "id", "left_semi"), c.labelled).select("id", "y")

    def held(f: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
        return [np.frombuffer(w, np.int32) for w in f["words"]], np.frombuffer(b"".join(f["form"]), np.float64).reshape(len(f), -1)

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                words, form = held(f)
                yield pd.DataFrame({"id": f["id"], "y": f["y"], "words": words, "form": list(form), "meta": list(meta(f, names))})

    def collected(chosen: DataFrame) -> pd.DataFrame:
        """Features of the chosen (id, y), of one row for each id."""
        rows = src.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by(F.struct("words", "form", *names), "key").alias("x")).select("id", "y", "x.*")
        return rows.mapInPandas(features, "id long, y int, words array<int>, form array<double>, meta array<double>").toPandas().sort_values("id", kind="stable")

    def surest(model: Model) -> tuple[list[dict], dict]:
        """What each view is surest of among all unlabelled documents."""
        sent = spark.sparkContext.broadcast(model)

        def views(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    words, form = held(f)
                    a, b = sent.value.views(words, form, meta(f, names))
                    yield pd.DataFrame({"id": f["id"], "key": f["key"], "p0": _prob(a), "p1": _prob(b)})

        every = src.filter("id is not null").mapInPandas(views, "id long, key long, p0 double, p1 double")
        scored = cut(every.groupBy("id").agg(F.min_by(F.struct("p0", "p1"), "key").alias("p")).select("id", "p.*").join(told.select("id"), "id", "left_anti"))
        out: list[dict] = [{}, {}]
        for teacher in (0, 1):
            for label in (1, 0):
                sure = F.col(f"p{teacher}") if label else 1 - F.col(f"p{teacher}")
                best = scored.select("id", sure.alias("sure")).filter(F.col("sure") >= c.sure).orderBy(F.desc("sure"), F.xxhash64("id"), "id").limit(c.given)
                out[teacher].update({x.id: label for x in best.collect()})  # at most c.given
        ids = sorted(out[0].keys() | out[1].keys())
        got = collected(spark.createDataFrame([(i, -1) for i in ids], "id long, y int")) if ids else pd.DataFrame(columns=["id", "words", "form", "meta"])
        sent.unpersist()
        return out, {int(i): (np.asarray(w, np.int64), np.asarray(f), np.asarray(v)) for i, w, f, v in zip(got["id"], got["words"], got["form"], got["meta"], strict=True)}

    got = collected(some)
    y = got["y"].to_numpy()
    out = "id long, p_text double, p_meta double, score double, kept boolean"
    if not len(got) or min((y == 1).sum(), (y == 0).sum()) < max(c.least, 1):
        null = F.lit(None).cast("double")
        return src.select(F.col("id").alias(id_col), null.alias("p_text"), null.alias("p_meta"), null.alias("score"), F.lit(True).alias("kept"))
    model = co_train([np.asarray(w, np.int64) for w in got["words"]], np.stack(got["form"].to_numpy()), np.stack(got["meta"].to_numpy()), y, c, surest)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats and a few hundred weights

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        md = shared.value
        for f in frames:
            if len(f):
                words, form = held(f)
                a, b = md.views(words, form, meta(f, names))
                s = md.score(a, b)
                yield pd.DataFrame({"id": f["id"], "p_text": _prob(a), "p_meta": _prob(b), "score": s, "kept": s >= c.threshold})

    return src.mapInPandas(score, out).withColumnRenamed("id", id_col)
