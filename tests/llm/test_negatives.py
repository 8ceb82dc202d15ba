"""Hard negatives against all inner products."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import catalog, negatives, oracles
from lurewatch.llm.common import table
from tests.compare import difference, duck
from tests.llm import odd


def plainly(rows, anchor=lambda i: i % 100 == 0, positives=5, count=10):
    """rows(id, vector, label), labels as they are."""
    own = [(i, l, [int(x) for x in np.floor(256 * np.array(v, float))]) for i, v, l in rows
           if l is not None and v is not None and None not in v and np.isfinite(256 * np.array(v, float)).all()]
    last = lambda i: (i is None, i)
    out = []
    for k, (i, label, v) in enumerate(own):
        if i is None or not anchor(i):
            continue
        score = [sum(a * b for a, b in zip(v, w)) for _, _, w in own]
        order = sorted((j for j in range(len(own)) if j != k and len(own[j][2]) == len(v)), key=lambda j: (-score[j], last(own[j][0])))
        for p in [j for j in order if own[j][1] == label][:positives]:
            meets = [j for j in order if own[j][1] != label and 30 * score[p] <= 100 * score[j] <= 90 * score[p]]
            out += [(i, own[p][0], r + 1, own[j][0], score[p], score[j]) for r, j in enumerate(meets[:count])]
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "embeddings").select("vec_id", "embedding", "label").collect()]
    changed = [(i, v, l if i % 7 or l is None else (l + 1) % 10) for i, v, l in rows]
    got = catalog.queries()["op13_zone_maps"](spark, folder)
    assert plain(got) == plainly(changed) and plain(got)
    assert difference(got, duck(folder), oracles.HARD_NEGATIVES) is None


def test_small_blocks_and_a_hot_vector(spark, monkeypatch):
    """A third of all rows are one vector; many blocks and cells, several labels."""
    monkeypatch.setattr(negatives, "CELL_BLOCKS", 2)
    draw = np.random.default_rng(3)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else draw.normal(size=3).round(3).tolist(), int(i * i % 4)) for i in range(1500)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, positives=3, negatives=4)
    assert plain(got) == plainly(rows, lambda i: i % 50 == 0, 3, 4)


def test_odd_table(spark):
    vectors = odd.vectors(spark).withColumn("label", F.pmod(F.coalesce("vec_id", F.lit(3)), F.lit(3)).cast("int"))
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    clipped = [tuple(max(-negatives.LONGEST, min(negatives.LONGEST, x)) if k > 3 else x for k, x in enumerate(r)) for r in plainly(rows, lambda i: i < 8)]
    got = negatives.hard_negatives(vectors, F.col("vec_id") < 8)
    small = lambda rows: [r for r in rows if abs(r[4]) < negatives.LONGEST and abs(r[5]) < negatives.LONGEST]
    assert small(plain(got)) == small(clipped)
    assert negatives.digest(vectors.limit(0)).collect() == [] and negatives.digest(odd.vectors(spark)).count() >= 0


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2)])
def test_curve(dims, bits):
    """The curve visits every cell once, each a neighbour of the one before."""
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = negatives.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds():
    draw = np.random.default_rng(5)
    a, block = draw.integers(-300, 300, (6, 9)).astype(float), draw.integers(-300, 300, (40, 9)).astype(float)
    least, most = negatives.bounds(a, block.min(axis=0)[None], block.max(axis=0)[None])
    exact = negatives.products(a, block)
    assert (least[:, 0] <= exact.min(axis=1)).all() and (most[:, 0] >= exact.max(axis=1)).all()
