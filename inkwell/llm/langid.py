"""Language identification: the family first, then one-versus-one linear SVMs inside it.

A text is its letter trigrams, as bytes, hashed to a fixed number of features and taken as shares of
all of them; so a linear score is the mean of the weights of its trigrams, one pass over the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import _LOWER, bound_batches, column_of, fold_of, text_blocks

FEATURES = 1 << 13
#: Training rows of a language at most (about; chosen by hash over all rows that may train).
ROWS_PER_LANGUAGE = 700
#: Training rows in all, and languages, at most: the driver holds a row of features for each.
TRAIN_ROWS, LANGUAGES = 4000, 400
#: Longer texts train nothing (they are scored like all others).
TRAIN_BYTES = 1 << 16

#: Families of closely related languages, by ISO 639-1 code. A code that is not
#: listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "pl", "cs", "sk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only {lang}")


_LETTERS = _LOWER.copy()
_LETTERS[0x30:0x3A] = 0


def trigram_features(buf: np.ndarray, offs: np.ndarray, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The feature at each letter byte of a block, and each row's first one. Neighbours that are no
    letters, or beyond the row, read as 0."""
    low = _LETTERS[buf]
    wide = np.zeros(len(buf) + 2, np.uint32)
    wide[1:-1] = low
    before, after = wide[:-2].copy(), wide[2:].copy()
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    before[cuts] = 0
    after[cuts - 1] = 0
    at = np.flatnonzero(low)
    code = before[at] << np.uint32(16) | low[at].astype(np.uint32) << np.uint32(8) | after[at]
    code = (code * np.uint32(0x9E3779B1)) ^ (code >> np.uint32(7))
    code = (code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - (features.bit_length() - 1))
    return code.astype(np.int64), np.searchsorted(at, offs)


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights of a linear SVM with squared hinge loss, classes weighing alike; y is +1 or -1.

    Accelerated gradient steps of the size that the loss's curvature allows; deterministic.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1.0 / (2.2 * top + penalty)
    w = np.zeros(x.shape[1], np.float32)
    last = w
    for t in range(rounds):
        ahead = w + (t / (t + 3.0)) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        last, w = w, (ahead - step * (penalty * ahead - 2 * (x.T @ (weight * y * slack)))).astype(np.float32)
    return w


def _train_rows(features: int):
    def run(batches):
        for batch in batches:
            index, count = [], []
            for _, _, buf, offs in text_blocks(column_of(batch, "_text")):
                code, first = trigram_features(buf, offs, features)
                for a, b in zip(first[:-1], first[1:], strict=True):
                    k, n = np.unique(code[a:b], return_counts=True)
                    index.append(k.astype(np.int32))
                    count.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([column_of(batch, "_lang"), pa.array(index, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))], names=["_lang", "index", "count"])

    return run


class LanguageModel:
    """Weights of all machines side by side: families one against the rest, then pairs of a family."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        self.langs = langs
        self.families = sorted({family_of(v) for v in langs})
        self.members = [[i for i, v in enumerate(langs) if family_of(v) == f] for f in self.families]
        scale = 1 / np.sqrt((x.mean(axis=0) if len(x) else np.zeros(x.shape[1])) + 1e-7)
        norm = float(np.sqrt(((x * scale) ** 2).sum(axis=1).mean())) if len(x) else 1.0
        scale = (scale / max(norm, 1e-9)).astype(np.float32)
        z = np.hstack([x * scale, np.ones((len(x), 1), np.float32)])
        columns = []
        kin = np.array([self.families.index(family_of(langs[i])) for i in y]) if len(y) else np.zeros(0, int)
        for f in range(len(self.families)) if len(self.families) > 1 else ():
            columns.append(linear_svm(z, np.where(kin == f, 1, -1).astype(np.float32)))
        self.pairs = [(a, b) for own in self.members for k, a in enumerate(own) for b in own[k + 1 :]]
        for a, b in self.pairs:
            use = (y == a) | (y == b)
            columns.append(linear_svm(z[use], np.where(y[use] == a, 1, -1).astype(np.float32)))
        w = np.array(columns, np.float32).reshape(len(columns), x.shape[1] + 1).T
        self.weights = np.ascontiguousarray(w[:-1] * scale[:, None], np.float32)
        self.bias = w[-1]

    def margins(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first) - 1, self.weights.shape[1]), np.float64)
        full = np.flatnonzero(first[1:] > first[:-1])
        if len(full) and self.weights.shape[1]:
            sums = np.add.reduceat(self.weights[code], first[full], axis=0, dtype=np.float64)
            out[full] = sums / (first[full + 1] - first[full])[:, None]
        return out + self.bias

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Family of the largest margin; in it, the language that wins most pairs, then by margin."""
        squash = lambda m: 1 / (1 + np.exp(np.clip(-3 * m, -50, 50)))
        n = len(margins)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        many = len(self.families) > 1
        ranked = np.sort(margins[:, : len(self.families)], axis=1) if many else None
        family = margins[:, : len(self.families)].argmax(axis=1) if many else np.zeros(n, int)
        score = squash((ranked[:, -1] - ranked[:, -2]) / 2) if many else np.ones(n)
        lang = np.array([own[0] for own in self.members])[family]
        base = len(self.families) if many else 0
        for f, own in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            if len(own) < 2 or not len(rows):
                continue
            wins, total, worst = (np.zeros((len(rows), len(own))) for _ in range(3))
            worst += np.inf
            for k, (a, b) in enumerate(self.pairs):
                if a in own:
                    m = margins[rows, base + k]
                    for who, sign in ((own.index(a), 1), (own.index(b), -1)):
                        wins[:, who] += sign * m > 0
                        total[:, who] += sign * m
                        worst[:, who] = np.minimum(worst[:, who], sign * m)
            best = (wins + 1e-3 * np.tanh(total)).argmax(axis=1)
            lang[rows] = np.array(own)[best]
            score[rows] *= squash(worst[np.arange(len(rows)), best])
        return [self.langs[i] for i in lang], score


def train_languages(docs: DataFrame, may_train, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, features: int = FEATURES, train_rows: int = TRAIN_ROWS, languages: int = LANGUAGES) -> LanguageModel:
    """Fit on a bounded sample: by hash, about ``rows_per_language`` rows of each language, ``train_rows``
    in all, of texts with a letter and up to ``TRAIN_BYTES`` bytes. Counts of the languages cover all
    rows; the ``languages`` most frequent ones are learned. Rows of one language and equal features count
    once; a quarter more than that number of rows is the most that is taken, however often rows repeat."""
    rows = docs.where(may_train & F.col(lang_col).isNotNull() & (F.octet_length(text_col) <= TRAIN_BYTES) & F.col(text_col).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(languages).collect()}
    langs = sorted(sizes)
    rows_per_language = min(rows_per_language, train_rows // max(1, len(langs)))
    if not langs:
        return LanguageModel([], np.zeros((0, features), np.float32), np.zeros(0, int))
    rows = rows.where(F.col(lang_col).isin(langs))
    share = F.create_map(*[F.lit(x) for v in langs for x in (v, min(1.0, rows_per_language / sizes[v]))])[F.col(lang_col)]
    sample = rows.where(F.pmod(F.xxhash64(F.lit(9), id_col, text_col), F.lit(1_000_000)) < share * 1_000_000)
    got = sample.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).mapInArrow(_train_rows(features), "_lang string, index array<int>, count array<int>").dropDuplicates()
    most = len(langs) * rows_per_language * 5 // 4
    got = got.orderBy(F.xxhash64("index", "count"), "_lang", "index", "count").limit(most).toArrow()
    x = np.zeros((got.num_rows, features), np.float32)
    for r, (i, c) in enumerate(zip(got["index"].to_pylist(), got["count"].to_pylist(), strict=True)):
        x[r, i] = np.array(c, np.float32) / max(1, sum(c))
    y = np.array([langs.index(v) for v in got["_lang"].to_pylist()], int)
    order = np.lexsort((x @ np.arange(features, dtype=np.float32), y))  # rows come in any order
    return LanguageModel(langs, x[order], y[order])


def _predict(shared, features: int, id_type: str):
    def run(batches):
        model = LanguageModel.__new__(LanguageModel)
        model.__dict__ = shared.value
        for batch in batches:
            langs, scores = [], []
            for _, _, buf, offs in text_blocks(column_of(batch, "_text")):
                names, score = model.predict(model.margins(*trigram_features(buf, offs, features)))
                langs += names
                scores.append(score)
            has = column_of(batch, "_has").to_numpy(zero_copy_only=False).astype(bool)
            out = np.where(has, np.concatenate([*scores, np.zeros(0)]), 0.0)
            yield pa.RecordBatch.from_arrays([column_of(batch, "_id"), column_of(batch, "_held"), pa.array([v if h else "und" for v, h in zip(langs, has, strict=True)], pa.string()), pa.array(out, pa.float64())], names=["_id", "_held", "lang_pred", "score"])

    return run, f"_id {id_type}, _held boolean, lang_pred string, score double"


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_fold: int = 1, features: int = FEATURES, **options) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Rows of the held-out fold (crc32 of the id) train nothing; null languages neither. Null texts and
    texts without a letter get ``und`` with score 0, and so do all rows if nothing can train. Ids may
    be null or repeat; empty tables give no rows. No row is shuffled; the model has a fixed size.
    """
    bound_batches(docs.sparkSession)
    model = train_languages(docs, fold_of(id_col, folds) != held_fold, id_col, text_col, lang_col, features=features, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model.__dict__)
    rows = docs.select(F.col(id_col).alias("_id"), (fold_of(id_col, folds) == held_fold).alias("_held"), F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_has"))
    run, schema = _predict(shared, features, docs.schema[id_col].dataType.simpleString())
    return rows.mapInArrow(run, schema).select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "lang_pred", "score")
