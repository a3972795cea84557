"""Components of large link sets: ranges of near ids join their own links first."""

import random

import pytest

from lacegraph.operators import components as C


def brute(links):
    label = {x: x for link in links for x in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def found(spark, links, **sizes):
    df = C.components(spark.createDataFrame(links, "a long, b long"), **sizes)
    rows = [(r.id, r.component) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return dict(rows)


def test_links_of_near_ids_take_no_star_steps(spark, monkeypatch):
    monkeypatch.setattr(C, "_large", lambda e: pytest.fail("star step"))
    links = [(i, i + d) for i in range(400) if i % 20 < 18 for d in (1, 2)] + [(i, i + 1000) for i in range(0, 400, 7)]
    random.Random(1).shuffle(links)
    assert found(spark, links, one_task_links=200, range_links=150) == brute(links)


@pytest.mark.parametrize("seed", [0, 1])
def test_random_links_hubs_and_repeats(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(7, 400 + i) for i in range(60)]
    links = [(a, b) for a, b in links + links[:20] if a != b]
    for one_task, size in ((0, 40), (30, 25)):
        assert found(spark, links, one_task_links=one_task, range_links=size) == brute(links)
