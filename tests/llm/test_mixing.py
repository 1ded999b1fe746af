"""Mixing: targets, flow and selection against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pyspark.sql.functions as F
import pytest

from screenforge.llm import mixing
from screenforge.llm.mixing import mix, mixed_sources, route, water_level


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string, pattern int, place int")


def _rows(n=400, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choices(["a", "b", "é", "日", None, "B"], [50, 10, 5, 3, 8, 2])[0], 1, "x", 2, 3) for i in range(n)]
    return rows + [(None, None, "a", 1, "x", 2, 3), (7, "\n\x0b same words here\t", "a", 1, "x", 2, 3), (7, "\n\x0b same words here\t", "a", 1, "x", 2, 3), (8, "", "empty", 1, "x", 2, 3)]


def _size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def _targets(sizes):
    """The rule as it is said: share, stop, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, free = Fraction(3, 2) * sum(sizes.values()), dict.fromkeys(names, Fraction(0)), set(names)
    while free and total > 0:
        all_, given = sum(weight[s] for s in free), total
        for s in list(free):
            target[s] += given * weight[s] / all_
            total -= given * weight[s] / all_
        for s in list(free):
            if target[s] >= 2 * sizes[s]:
                total += target[s] - 2 * sizes[s]
                target[s] = Fraction(2 * sizes[s])
                free.remove(s)
    return target


def test_water_level():
    rng = random.Random(5)
    for _ in range(200):
        sizes = {f"{i:02}": rng.choice([0, 1, 5, 100, rng.randint(0, 1000)]) for i in range(rng.randint(1, 12))}
        want = _targets(sizes)
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        assert water_level(list(sizes.values()), weights, Fraction(3, 2) * sum(sizes.values()), 2) == list(want.values())


def _best_flow(capacity, members, quotas, repeats):
    """Most tokens and least cost, by trying all amounts per pattern."""
    best = None
    for amounts in itertools.product(*(range(c * repeats + 1) for c in capacity)):
        # Can these amounts be dealt to the sources? By Hall's condition over all sets of sources.
        for chosen in itertools.product((0, 1), repeat=len(quotas)):
            if sum(x for x, m in zip(amounts, members) if all(chosen[s] for s in m)) > sum(q for q, c in zip(quotas, chosen) if c):
                break
        else:
            cost = sum(r for x, c in zip(amounts, capacity) for r in range(repeats) for _ in range(max(0, min(c, x - r * c))))
            best = max(best or (-1, 0), (sum(amounts), -cost))
    return best


def test_flow_is_the_best_one():
    rng = random.Random(3)
    for _ in range(150):
        sources, patterns = rng.randint(1, 3), rng.randint(1, 4)
        members = [sorted(rng.sample(range(sources), rng.randint(0, sources))) for _ in range(patterns)]
        capacity, quotas = [rng.randint(0, 3) for _ in members], [rng.randint(0, 6) for _ in range(sources)]
        taken, routed = route(capacity, members, quotas, 2)
        assert all(0 <= x <= 2 * c for x, c in zip(taken, capacity)) and all(r <= q for r, q in zip(routed, quotas))
        assert sum(taken) == sum(routed)
        cost = sum(max(0, x - c) for x, c in zip(taken, capacity))
        assert (sum(taken), -cost) == _best_flow(capacity, members, quotas, 2)


@pytest.mark.parametrize("most, digits", [(100_000, 3), (0, 1)])
def test_query_equals_brute_force(spark, monkeypatch, most, digits):
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", most)
    monkeypatch.setattr(mixing, "DIGITS", digits)
    rows = _rows()
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += _size(text)
    target = _targets(sizes)
    expected = []
    for source, size in sizes.items():
        mine = defaultdict(list)
        for doc_id, text, s, *_ in rows:
            if s == source:
                inner = hashlib.md5((text or "").encode()).hexdigest()
                mine[hashlib.md5(f"0:{'' if doc_id is None else doc_id}:{inner}".encode()).hexdigest()].append((doc_id, _size(text)))
        whole, rest = divmod(int(target[source]), size) if size else (0, 0)
        for place in sorted(mine):
            group = mine[place]
            give = min(max(rest, 0), sum(s for _, s in group))
            rest -= give
            expected += [(doc_id, s, size, float(target[source]), whole * s + give // len(group)) for doc_id, s in group]
    got = list(map(tuple, mixed_sources(_docs(spark, rows)).collect()))
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)


def test_overlapping_sources(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 20), rng.choice(["a", "a,b", "b,c", "c", "", "b,b,d"]), 1, "x", 2, 3) for i in range(300)]
    members = F.filter(F.split("source", ","), lambda s: s != "")
    documents, sources = mix(_docs(spark, rows), members, weights=(1, 5, 1, 1), seed=4)
    documents, sources = documents.collect(), sources.collect()
    assert len(documents) == len(rows) and [s.source for s in sources] == ["a", "b", "c", "d"]
    assert sum(d.taken for d in documents) == sum(s.routed for s in sources)
    assert all(d.taken <= 2 * d.size for d in documents)
    assert all(s.routed <= s.target < s.routed + 1 or s.target > s.routed for s in sources)
    assert all(d.taken == 0 for d in documents if rows[d.doc_id][2] == "")
    again = mix(_docs(spark, rows[::-1]).repartition(3), members, weights=(1, 5, 1, 1), seed=4).documents.collect()
    assert sorted(again) == sorted(documents)
    other = mix(_docs(spark, rows), members, weights=(1, 5, 1, 1), seed=5).documents.collect()
    assert sorted(other) != sorted(documents)


def test_too_many_patterns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_EDGES", 3)
    with pytest.raises(ValueError):
        mixed_sources(_docs(spark, _rows()))


def test_empty_tables(spark):
    assert mixed_sources(_docs(spark, [])).count() == 0
    assert [r.taken for r in mixed_sources(_docs(spark, [(1, None, None, 1, "x", 2, 3)])).collect()] == [0]
