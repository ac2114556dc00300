"""Tuning trials: one (draw, fold) a task, on bounded samples.

A search fits hundreds of small models, each only to be compared with the others. As
distributed fits these would be a million tiny jobs; so a trial is a task here. It learns on about ``rows``
rows of its fold's training side, chosen by a hash of ticker and date, and is judged on about
``test_rows`` of the test side. Both bounds are parameters; what is sent to the tasks is
(rows + test_rows) x features bytes a fold. The members that a search is for are fitted on all rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.operators import trees

c = F.col

ROWS, TEST_ROWS = 2_000, 100_000


def _sample(table: DataFrame, span: tuple, most: int):
    """About ``most`` rows between two dates as (features, targets)."""
    side = table.where(c("date").between(*[F.lit(x) for x in span]))
    share = min(1.0, most / max(1, side.count()))
    chosen = side.where(F.pmod(F.xxhash64("ticker", "date"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return trees.matrix(chosen.orderBy("date", "ticker"), "target")


def accuracies(table: DataFrame, spans: dict, folds: list[int], draws: list[dict], rows: int = ROWS, test_rows: int = TEST_ROWS) -> DataFrame:
    """(draw, fold, accuracy) for each of ``draws`` on each of ``folds``; ``table``: ticker, date, target, features."""
    spark, sides = table.sparkSession, {}
    for fold in folds:
        (train, y), (test, z) = _sample(table, spans[fold, "train"], rows), _sample(table, spans[fold, "test"], test_rows)
        if len(set(y.tolist())) == 2 and len(z):
            cuts = trees.cuts_of(train)
            sides[fold] = (trees.binned(train, cuts), trees.binned(test, cuts), y, z)
    shared = spark.sparkContext.broadcast(sides)
    fit, predict = trees.boosted, trees.leaves

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for draw, fold, params in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                train, test, y, z = shared.value[fold]
                found = predict(test, fit(train, y, json.loads(params)))
                out.append((draw, fold, float(((found > 0) == (z > 0.5)).mean())))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["draw", "fold", "accuracy"])

    # long trials first, one a task
    trials = [(i, f, json.dumps(d)) for i, d in sorted(enumerate(draws), key=lambda x: -x[1]["maxIter"]) for f in sides]
    listed = spark.createDataFrame(trials, "draw int, fold int, params string")
    return listed.repartition(max(1, len(trials))).mapInArrow(run, "draw int, fold int, accuracy double")
