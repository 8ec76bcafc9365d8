"""Components of links against a plain union-find."""

import random

from helixweave.llm.components import components


def test_long_chain_of_random_ids(spark):
    rng = random.Random(5)
    ids = [rng.getrandbits(63) - (1 << 62) for _ in range(5000)]
    other = [(10, 11), (11, 12), (12, 10), (11, 10)]
    links = [*zip(ids, ids[1:], strict=False), *other, (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, min(ids)) | {10: 10, 11: 10, 12: 10}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
