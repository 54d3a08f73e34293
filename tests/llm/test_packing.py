import random
from collections import Counter

from siltstone.llm import packing as P


def check(counts, capacity):
    fill = P.fillings(counts, capacity)
    used = Counter()
    for f, times in fill:
        assert times > 0 and sum(s * k for s, k in f) <= capacity
        for s, k in f:
            used[s] += k * times
    assert used == Counter({s: n for s, n in counts.items() if n})
    return sum(t for _, t in fill)


def test_fillings():
    rnd = random.Random(1)
    assert check({}, 10) == 0 and check({10: 7}, 10) == 7 and check({6: 2, 4: 2}, 10) == 2
    for _ in range(30):
        counts = {rnd.randint(1, 200): rnd.randint(1, 12) for _ in range(60)}
        bins = []
        for s in sorted((s for s, c in counts.items() for _ in range(c)), reverse=True):
            i = next((i for i, b in enumerate(bins) if b + s <= 200), None)
            if i is None:
                bins.append(s)
            else:
                bins[i] += s
        assert check(counts, 200) <= 1.03 * len(bins) + 1  # first fit decreasing
    # The number of fillings doesn't follow the number of items.
    assert len(P.fillings({s: 10**9 + s for s in range(1, 100)}, 100)) < 1000


def test_every_item_has_one_place(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, 7, 30, 64, 100, 101, 250, 1000]), "c", "p") for i in range(900)] + [(2000 + i, 40, "c", "p") for i in range(500)] + [(5000, None, "c", "p")]
    d = spark.createDataFrame(rows, "doc_id long, n_tokens long, container_id string, part string").drop("part")
    got = P.packed(d, capacity=100, bucket_rows=50).collect()
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.part, r.start, r.n))
    assert set(parts) == {r[0] for r in rows}
    for k, n, *_ in rows:
        own = sorted(parts[k])
        assert sum(x[2] for x in own) == (n or 0) and [x[0] for x in own] == list(range(len(own)))
        assert (n or 0) > 100 or len(own) == 1
    fill = Counter()
    for r in got:
        assert (r.container_id is None) == (r.n == 0)
        fill[r.container_id] += r.n
    del fill[None]
    assert max(fill.values()) <= 100 and set(fill) == set(range(len(fill)))


def test_empty(spark):
    assert P.packed(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []


def test_slots_as_a_plain_search():
    rnd = random.Random(4)
    slots, base = [], 0
    for size in (3, 7, 50):
        first = 0
        for _ in range(rnd.randint(1, 9)):
            k, times = rnd.randint(1, 4), rnd.randint(1, 5)
            slots.append((size, first, first + k * times, k, base))
            first, base = first + k * times, base + times
    asked = [(s, r) for s, a, b, _, _ in slots for r in range(a, b)]
    want = [next(c + (r - a) // k for z, a, b, k, c in slots if z == s and a <= r < b) for s, r in asked]
    got = P.Slots(rnd.sample(slots, len(slots))).containers(P.np.array([s for s, _ in asked]), P.np.array([r for _, r in asked]))
    assert got.tolist() == want
