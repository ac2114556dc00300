"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features come from the text alone: densities of a lexicon, how near its words stand to
second-person words, capitals, punctuation, and rates of obfuscated spellings. The
lexicon is mined from training labels: words, and starts of words, which many toxic
and hardly any clean documents have. At most ``most_rows`` labelled rows, taken by a hash of
their id, are learnt from (the documented bound of the fit): half of them of each kind, more
where the other kind has fewer, weighted to stand for all labels of their kind. A part of them is kept from
the trees and calibrates their scores, unless the trees would be left with one kind. All documents are scored where they are read: no
text is shuffled.

Defined results: a null text counts as empty and gets the score of a text without words.
Of several labels of one id the highest counts; null labels and ids are left out. Without
labels of both kinds the score is the share of label 1 among the labels, 0 without any.
Equal rows get equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.common import cut

# Second-person words of the languages at hand.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes ti tuyo vosotros".split()
#: Letters that are often written as another sign.
LOOKALIKE = str.maketrans("013457@$!|+", "oieastasiit")
STARTS = (4, 5, 6)
FEATURES = [
    "words", "hits", "density", "kinds", "near", "near_density", "most_in_window", "capitals", "capital_words", "exclamations", "questions", "marks",
    "digits", "obfuscated", "obfuscated_hits", "word_length",
]
HIT, SECOND, CAPITAL, OBFUSCATED, HIDDEN = 1, 2, 4, 8, 16
_INNER = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|([^\W\d_])\1\1")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_REPEATED = re.compile(r"(.)\1+")


def terms(word: str) -> list[str]:
    """A word in lower case without marks around it, and its starts, marked as such."""
    w = word.lower().strip(string.punctuation)
    return [w, *[w[:k] + "*" for k in STARTS if len(w) > k]] if len(w) > 2 else []


class Flags(dict):
    """Flags of words by lexicon; computed once for each word and kept, bounded."""

    def __init__(self, lexicon: frozenset[str], most: int = 300_000):
        super().__init__()
        self.lexicon, self.second, self.most = lexicon, frozenset(SECOND_PERSON), most

    def __missing__(self, word: str) -> int:
        plain = terms(word)
        flag = HIT if any(t in self.lexicon for t in plain) else 0
        if plain and plain[0] in self.second or word.lower() in self.second:
            flag |= SECOND
        if len(word) > 2 and word.isupper():
            flag |= CAPITAL
        if _INNER.search(word):
            flag |= OBFUSCATED
            if not flag & HIT:
                read = _NOT_LETTERS.sub("", word.lower().translate(LOOKALIKE))
                if any(t in self.lexicon for w in (read, _REPEATED.sub(r"\1", read)) for t in terms(w)):
                    flag |= HIDDEN
        if len(self) >= self.most:
            self.clear()
        self[word] = flag
        return flag


def features(text: str, flags: Flags) -> list[float]:
    """The values of FEATURES."""
    import numpy as np

    words = text.split()
    n = max(1, len(words))
    own = np.frombuffer(bytes(map(flags.__getitem__, words)), dtype=np.uint8)
    chars = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    hit = np.flatnonzero(own & (HIT | HIDDEN))
    second = np.flatnonzero(own & SECOND)
    near = 0
    if len(hit) and len(second):
        at = np.searchsorted(second, hit)
        before = np.abs(hit - second[np.maximum(at - 1, 0)])
        after = np.abs(hit - second[np.minimum(at, len(second) - 1)])
        near = int((np.minimum(before, after) <= 5).sum())
    window = int((np.searchsorted(hit, hit + 50) - np.arange(len(hit))).max()) if len(hit) else 0
    kinds = len({words[i].lower() for i in hit.tolist()})
    letters = max(1, int(chars[65:91].sum() + chars[97:123].sum() + chars[128:].sum()))
    size = max(1, len(text))
    marks = sum(int(chars[ord(c)]) for c in string.punctuation)
    count = lambda bit: int(np.count_nonzero(own & bit))
    return [
        float(np.log1p(len(words))), float(len(hit)), len(hit) / n, float(kinds), float(near), near / n, float(window), int(chars[65:91].sum()) / letters,
        count(CAPITAL) / n, int(chars[33]) / size, int(chars[63]) / size, marks / size, int(chars[48:58].sum()) / size, count(OBFUSCATED) / n,
        float(count(HIDDEN)), size / n,
    ]


def _counted(rows: DataFrame, among: frozenset[str] | None) -> DataFrame:
    """term, n: in how many of the texts each term occurs."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        total = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = {t for w in set((text or "").split()) for t in terms(w)}
                total.update(found if among is None else found & among)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def mine_lexicon(sample: DataFrame, least: int = 5, ratio: float = 12.0) -> frozenset[str]:
    """Terms of at least ``least`` toxic texts (half of them where there are few) that toxic texts have ``ratio`` times as often as clean ones."""
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    least = max(min(least, max(2, toxic // 2)), toxic // 1000)
    often = {r.term: r.n for r in _counted(sample.where("label = 1"), None).where(F.col("n") >= least).collect()}  # bounded by the sample
    other = {r.term: r.n for r in _counted(sample.where("label = 0"), frozenset(often)).collect()}
    return frozenset(t for t, n in often.items() if (n / (toxic + 1)) / ((other.get(t, 0) + 0.5) / (clean + 1)) >= ratio)


def featured(rows: DataFrame, lexicon: frozenset[str], text_col: str) -> DataFrame:
    """The columns of ``rows`` but the text, and ``features`` as an array."""
    others = [c for c in rows.columns if c != text_col]

    def run(batches):
        import pyarrow as pa

        flags = Flags(lexicon)
        for batch in batches:
            values = [features(t or "", flags) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(values, pa.list_(pa.float64()))], names=[*others, "features"])

    schema = T.StructType([*(rows.schema[c] for c in others), T.StructField("features", T.ArrayType(T.DoubleType()))])
    return rows.select(text_col, *others).mapInArrow(run, schema)


@dataclass
class Model:
    """A fitted scorer; ``constant`` is set if there was nothing to learn from."""

    lexicon: frozenset[str]
    trees: object = None
    calibration: object = None
    constant: float | None = None

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The columns of ``docs`` but the text, and ``score``."""
        if self.constant is not None:
            return docs.drop(text_col).withColumn("score", F.lit(self.constant))
        return self._scored(featured(docs, self.lexicon, text_col)).drop("features")

    def _scored(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        rows = rows.withColumn("_v", array_to_vector("features"))
        rows = self.trees.transform(rows).withColumn("_margin", vector_to_array("_p")[1])
        if self.calibration is None:
            return rows.withColumnRenamed("_margin", "score").drop("_v", "_p")
        score = F.least(F.greatest(F.col("_score"), F.lit(0.0)), F.lit(1.0))
        return self.calibration.transform(rows).withColumn("score", score).drop("_v", "_p", "_margin", "_score")


def fit(
    docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 40_000, seed: int = 7
) -> Model:
    """Learn from the labelled rows that ``use`` (over the id) admits."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(use)
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    place = F.xxhash64("_id", F.lit(seed))
    found = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    parts = []
    for kind, other in ((0, 1), (1, 0)):
        most = max(most_rows // 2, most_rows - found.get(other, 0))
        weight = max(1.0, found.get(kind, 0) / most)
        parts.append(known.where(F.col("label") == kind).orderBy(place).limit(most).withColumn("weight", F.lit(weight)))
    known = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = cut(texts.join(F.broadcast(known), "_id"), "labelled")  # at most most_rows ids
    sides = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sides.get(0) or not sides.get(1):
        total = sum(sides.values())
        return Model(frozenset(), constant=sides.get(1, 0) / total if total else 0.0)

    fold = F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(4))
    if sample.where(fold != 0).select("label").distinct().count() < 2:
        fold = F.lit(1)
    model = Model(mine_lexicon(sample.where(fold != 0)))
    rows = cut(featured(sample, model.lexicon, "text").withColumn("fold", fold).withColumn("_label", F.col("label").cast("double")), "features")
    learn = rows.where("fold <> 0").withColumn("_v", array_to_vector("features")).orderBy("_id").coalesce(4)
    trees = GBTClassifier(featuresCol="_v", labelCol="_label", weightCol="weight", predictionCol="_label_out", maxIter=25, maxDepth=4, stepSize=0.2, subsamplingRate=0.8, seed=seed, minInstancesPerNode=4)
    model.trees = trees.fit(learn).setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_p")
    held = rows.where("fold = 0")
    sides = held.groupBy("_label").count().count()
    if sides == 2:
        calibrate = IsotonicRegression(featuresCol="_margin", labelCol="_label", weightCol="weight", predictionCol="_score")
        model.calibration = calibrate.fit(model._scored(held).withColumnRenamed("score", "_margin"))
    return model
