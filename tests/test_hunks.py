"""Ordered diffs: the alignment against brute force, and what hunks must hold."""

import random
from itertools import combinations

import pytest

from capledger.operators import hunks, text


def longest(places):
    """Length of the longest increasing subsequence, by all subsets."""
    return max((n for n in range(len(places) + 1) for c in combinations(places, n) if all(a < b for a, b in zip(c, c[1:]))), default=0)


def test_longest_chain():
    rng = random.Random(1)
    for _ in range(300):
        places = rng.sample(range(50), rng.randrange(9))
        chain = hunks.longest_chain(places)
        kept = [places[i] for i in chain]
        assert chain == sorted(chain) and kept == sorted(kept) and len(kept) == longest(places)
    assert hunks.longest_chain(list(range(100_000, 0, -1))) == [99_999]


def brute_rows(old, new, context):
    """Rows of a diff: matches by the longest chain (quadratic), then what lies within ``context`` rows of a change."""
    nth = lambda ls: [(x, ls[:i].count(x)) for i, x in enumerate(ls)]
    a, b = nth(old), nth(new)
    places = [(i, b.index(x)) for i, x in enumerate(a) if x in b]
    level, back = [], []
    for i, (_, p) in enumerate(places):
        below = [j for j in range(i) if places[j][1] < p]
        level.append(1 + max((level[j] for j in below), default=0))
        back.append(max((j for j in range(i) if level[j] == level[i] - 1), default=None))
    chain, i = [], min((i for i in range(len(places)) if level[i] == max(level)), key=lambda i: places[i][1], default=None)
    while i is not None:
        chain.insert(0, places[i])
        i = back[i]
    rows, i, j = [], 0, 0
    for x, y in [*chain, (len(old), len(new))]:
        rows += [("removed", k + 1, None, old[k]) for k in range(i, x)] + [("added", None, k + 1, new[k]) for k in range(j, y)]
        if x < len(old) or y < len(new):
            rows.append(("context", x + 1, y + 1, old[x]))
        i, j = x + 1, y + 1
    changed = [p for p, r in enumerate(rows) if r[0] != "context"]
    near = [p for p in range(len(rows)) if any(abs(p - c) <= context for c in changed)]
    out, hunk = [], 0
    for n, p in enumerate(near):
        hunk += n == 0 or near[n - 1] != p - 1
        out.append((hunk, n + 1, *rows[p]))
    return out


@pytest.mark.parametrize("context", [0, 1, 3])
def test_hunks_against_brute_force(spark, context):
    rng = random.Random(context)
    versions, policies = [], {}
    for n in range(80):
        policy = rng.choice(["hot", "hot", "p1", None])
        body = list(policies.get(policy, []))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(body) + 1)
            body[at : at + rng.randrange(3)] = rng.choices(["", "a", "b", "-- [C1] x", "++y", *(f"line {i}" for i in range(30))], k=rng.randrange(8))
        policies[policy] = body
        versions.append((policy, n, None if n % 17 == 5 else "\n".join(body) + "\n" * bool(body)))
    got, want = {}, {}
    df = spark.createDataFrame(versions, "policy_id string, version_no long, text string")
    for r in hunks.diff_hunks(df, context).collect():
        got.setdefault((r.policy_id, r.version_a, r.version_b), []).append((r.hunk, r.row, r.kind, r.line_a, r.line_b, r.line))
    for policy in policies:
        own = [v for v in versions if v[0] == policy]
        for a, b in zip(own, own[1:]):
            rows = brute_rows((a[2] or "").splitlines(), (b[2] or "").splitlines(), context)
            if rows:
                want[policy, a[1], b[1]] = rows
    assert {k: sorted(v, key=lambda r: r[1]) for k, v in got.items()} == want
    counted = {r.version_b: r.net for r in text.line_diff(df).collect()}
    for (_, _, b), rows in got.items():
        assert counted[b] == sum((r[2] == "added") - (r[2] == "removed") for r in rows)


def test_moved_and_equal_texts(spark):
    df = spark.createDataFrame([("p", 1, "a\nb\nc\nd"), ("p", 2, "a\nb\nc\nd"), ("p", 3, "d\na\nb\nc"), ("q", 4, "x")], "policy_id string, version_no long, text string")
    rows = sorted(tuple(r)[3:] for r in hunks.diff_hunks(df).collect())
    assert rows == [
        (1, 1, "added", None, 1, "d"), (1, 2, "context", 1, 2, "a"), (1, 3, "context", 2, 3, "b"), (1, 4, "context", 3, 4, "c"), (1, 5, "removed", 4, None, "d"),
    ]
    assert hunks.diff_hunks(df.limit(0)).count() == 0
