"""Root-to-leaf paths of random forests, cycles and long chains against plain recursion."""

from __future__ import annotations

import random

from weftline.llm.chat_format import format_trees, leaf_paths


def test_paths_of_random_forests(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(12):
        n = rng.choice((1, 2, 3, 7, 8, 9, 40))
        for i in range(n):  # some parents are missing, later, or the message itself: cycles and roots
            parent = rng.choice((None, i, rng.randrange(n), i - 1, i - 1, i // 2 if i else None, 99))
            rows.append((conv, i, parent, rng.choice((0.0, 0.5, 1.0, None))))
    rows += [(50, i, i - 1 if i else None, 0.25) for i in range(700)] + [(51, None, None, 9.0), (51, 1, None, 1.0)]
    expected = {}
    for conv in {r[0] for r in rows}:
        own = {i: (p, s) for c, i, p, s in rows if c == conv and i is not None}
        for leaf in own:
            if any(p == leaf for p, _ in own.values()):
                continue
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][0]
            if at in path:
                continue
            expected[conv, leaf] = (path[::-1], sum(own[i][1] or 0.0 for i in path) / len(path))
    messages = spark.createDataFrame(rows, "conv long, id long, parent long, score double")
    found = leaf_paths(messages).collect()
    assert len(found) == len({(r.conv, r.leaf) for r in found})
    got = {(r.conv, r.leaf): (r.path, r.score) for r in found}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(abs(got[k][1] - expected[k][1]) < 1e-9 for k in expected)
    assert len(got[50, 699][0]) == 700


def test_a_message_without_an_id_takes_no_rank(spark):
    rows = [(1, None, None, "user", "lost", 9.0), (1, 1, None, "user", "kept", 1.0)]
    got = format_trees(spark.createDataFrame(rows, "conv long, id long, parent long, role string, text string, score double")).collect()
    assert [(r.branch, r.n_turns) for r in got] == [(1, 1)]
