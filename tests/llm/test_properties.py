"""Properties of the parts that need no Spark."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm_operators import brute_quality

from quartzloom.llm import chat, licenses, linededup, packing, quality, sharding, simhash

fast = settings(max_examples=150, deadline=None)


@fast
@given(st.text(alphabet=st.sampled_from(list("\\<>/s[]INTROLEYx é")), max_size=40))
def test_escaping(t):
    assert chat.unescape(chat.escape(t)) == t


@fast
@given(st.lists(st.sampled_from("abcd"), max_size=60), st.sampled_from([" ", "\n", "\t\x0b"]))
def test_measurements(words, gap):
    t = gap.join(words)
    m = quality.measure(t)
    assert tuple(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_quality(t)


@fast
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_packing_holds_the_histogram(histogram):
    plan, used = packing.solve(histogram, 64, steps=20).plan, Counter()
    for config, n in plan:
        assert n > 0 and sum(k * s for s, k in config.items()) <= 64
        for s, k in config.items():
            used[s] += k * n
    assert used == Counter(histogram)
    table = packing.places(plan)
    assert len({(r[0], r[1]) for r in table.tolist()}) == len(table)


@fast
@given(st.lists(st.integers(0, 40), min_size=12, max_size=12), st.randoms())
def test_overflow_fills_exact_capacities(counts, r):
    owner = np.array([0, 1, 2, 3] * 3)
    r.shuffle(owner)
    owner = np.r_[owner[:8], [0, 1, 2, 3]]
    total = sum(counts)
    capacity = total // 4 + (np.arange(4) < total % 4)
    runs = sharding.overflow(np.array(counts), owner, capacity)
    by_arc, by_shard = Counter(), Counter()
    for arc, shard, n in runs:
        by_arc[arc] += n
        by_shard[shard] += n
    assert all(by_arc[a] == n for a, n in enumerate(counts))
    assert all(by_shard[s] == c for s, c in enumerate(capacity.tolist()))


@fast
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.integers(0, 63))
def test_forest_has_the_components_of_all_links(prints, b):
    prints = sorted({*prints, *(p ^ (1 << b) for p in prints[:10])})
    x = np.array(prints, np.uint64)
    left, right = simhash.forest(x, x)
    parent = {p: p for p in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for p, q in zip(left.tolist(), right.tolist(), strict=True):
        assert root(p) != root(q)
        parent[root(p)] = root(q)
    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                assert root(p) == root(q)


@fast
@given(st.text(alphabet=st.sampled_from(list("aA \t\n\r\x0bé")), max_size=30))
def test_line_keys(t):
    lines, digests = linededup.hashes(t.encode(), 1)
    keys = [x.strip("\x20\t\n\x0b\x0c\r").replace("A", "a") for x in t.split("\n")]
    assert b"\n".join(lines).decode() == t
    assert [bool(d) for d in digests] == [bool(k) for k in keys]
    assert all((digests[i] == digests[j]) == (keys[i] == keys[j]) for i in range(len(keys)) for j in range(i))


@fast
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=30))
def test_winnowing_keeps_one_gram_in_every_five_words(words):
    kept = licenses.winnow(words)
    assert kept and all(any(i <= p <= i + 2 for p in kept) for i in range(len(words) - 4))
