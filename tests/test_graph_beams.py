"""Graph searches of queries that are not in the graph, and of vectors with many copies."""

import numpy as np

from tallyweave.operators import search
from tallyweave.operators.graph import Graphs
from tests.test_vectors import frame, hits


def test_beams_are_as_wide_as_the_vectors_ask(spark):
    """Vectors without clusters, half of the nearest in the other shard: a beam of 15 alone does not find 0.9 of them."""
    points = np.random.default_rng(3).normal(size=(3000, 128))
    vectors = frame(spark, points)
    asked = vectors.where("vec_id % 50 = 0")
    assert hits(Graphs.build(vectors, shard=1500).neighbours(asked, 15, beam=15), search.exact_neighbours(vectors, asked, 15)) >= 0.9


def test_copies_are_answered_by_id(spark):
    points = np.random.default_rng(4).normal(size=(1500, 8))
    points[::3] = points[0]
    vectors = frame(spark, points)
    asked = vectors.where("vec_id % 100 = 0")
    found = Graphs.build(vectors, shard=700).neighbours(asked, 15)
    assert hits(found, search.exact_neighbours(vectors, asked, 15)) >= 0.97
