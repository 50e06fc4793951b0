import os
import random

import pytest

from textquarry.llm import mixing, tokens

HAVE = os.path.exists(tokens.VOCABULARY)


def naive(vocabulary, piece):
    """Byte pairs merged by rank, as defined."""
    rank = {t: i for i, t in enumerate(vocabulary.tokens)}
    parts = [bytes([b]) for b in piece.encode()]
    while True:
        best = min(((rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 30, 0))
        if best[0] == 1 << 30:
            return len(parts)
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def small():
    letters = [bytes([b]) for b in range(256)]
    return tokens.Vocabulary([*letters, b"ab", b"bc", b"abc", b"aa", b"aab", b"ca", b"cab", b"bb", b"abab", b" a", b" ab"])


def test_counters_are_known_by_their_vocabulary():
    class Shared:
        def __init__(self, *parts):
            self.value = tokens.Vocabulary([bytes([i]) for i in range(256)] + list(parts))

    assert [tokens._counter(Shared(*parts)).count("ab") for parts in ((), (b"ab",), (), (b"ab",))] == [2, 1, 2, 1]


def test_small_vocabulary_against_merging():
    v = small()
    c = tokens.Counter(v)
    rng = random.Random(3)
    for _ in range(2000):
        piece = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        assert c.count_piece(piece) == naive(v, piece), piece


@pytest.mark.skipif(not HAVE, reason="no vocabulary files here")
def test_public_vocabulary_against_a_library():
    import public_tokenizers
    import tiktoken

    v = tokens.Vocabulary.load()
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(v.tokens)}, special_tokens={})
    c = tokens.Counter(v)
    rng = random.Random(7)
    texts = ["", "Hello world's  end\n\n", "Größe – naïve € русский текст", "   ", "a" * 500, "\n \t x" * 30]
    texts += ["".join(rng.choice("aeinrst éßж19 .,\n'") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    assert [c.count(t) for t in texts] == [len(e.encode_ordinary(t)) for t in texts]
    assert c.count(None) is None


@pytest.mark.skipif(not HAVE, reason="no vocabulary files here")
def test_cube(spark):
    rows = [(1, "one two", "EN", " A ", "reviews", ".txt"), (2, "three", "en-US", "a", "review", "TXT"), (3, None, "xx", None, "News ", "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, format string")
    got = {(r.level, r.source, r.lang, r.topic, r.format): (r.docs, r.tokens) for r in tokens.budget(df).collect()}
    assert got["", None, None, None, None] == (3, 3)
    assert got["source,lang,topic,format", "a", "en", "review", "txt"] == (2, 3)
    assert got["lang", None, None, None, None] == (1, 0)


def test_fit_is_within_and_full():
    rng = random.Random(1)
    for _ in range(60):
        h = {rng.randint(1, 900): rng.randint(1, 6) for _ in range(rng.randint(1, 40))}
        total = sum(n * c for n, c in h.items())
        budget = rng.randint(0, total + 10)
        taken = mixing.fit(h, budget)
        assert all(0 < k <= h[n] for n, k in taken.items())
        assert sum(n * k for n, k in taken.items()) <= budget
    assert mixing.fit({3: 4, 5: 4}, 14) in ({3: 3, 5: 1}, {3: 3, 5: 1})
    assert sum(n * k for n, k in mixing.fit({n: 3 for n in range(2, 200)}, 12_345).items()) == 12_345


def test_fit_is_exact_beyond_any_length():
    rng = random.Random(11)
    for _ in range(150):  # against all sums
        h = {rng.choice((2, 3, 5, 7, 10, 30, 44, 90, 300)): rng.randint(1, 5) for _ in range(rng.randint(1, 5))}
        sums = {0}
        for n, c in h.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = rng.randint(0, sum(n * c for n, c in h.items()) + 5)
        taken = mixing.fit(h, budget)
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= budget) and all(0 < k <= h[n] for n, k in taken.items())
    long = {n: 2 for n in range(30_000, 90_000, 997)} | {7: 40, 11: 40}  # a remainder of over 60,000 tokens
    budget = sum(n * c for n, c in long.items()) // 3
    assert sum(n * k for n, k in mixing.fit(long, budget).items()) == budget
    assert mixing.fit({1_000_000: 9, 3: 1}, 5_000_009) == {1_000_000: 5, 3: 1}  # no choice meets it: the nearest below
    assert mixing.fit({6: 50, 9: 50}, 500) in [{6: a, 9: b} for a in range(1, 51) for b in range(1, 51) if 6 * a + 9 * b == 498] + [{6: 8, 9: 50}]


def test_plan_keeps_repeats_and_shares():
    p = mixing.plan({"a": {10: 10}, "b": {10: 100}, "x": {5: 5}}, {"a": (0.5, 3), "b": (0.25, 1), "gone": (0.25, 9)})
    assert set(p) == {"a", "b"} and p["a"] == (3, {})
    rounds, extra = p["b"]
    assert rounds == 0 and sum(n * k for n, k in extra.items()) == 150


@pytest.mark.skipif(not HAVE, reason="no vocabulary files here")
def test_mix(spark):
    rows = [(i, "word " * (1 + i % 7), "A " if i % 2 else "a") for i in range(40)] + [(100 + i, "other words here " * (1 + i % 5), "b") for i in range(60)] + [(999, None, "a"), (998, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goals = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("gone", 0.2, 5)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, goals)
    shares = {r.source: r for r in mixing.reached_shares(m, goals).collect()}
    assert abs(shares["a"].share - 0.625) < 0.01 and abs(shares["b"].share - 0.375) < 0.01 and shares["gone"].share == 0
    assert shares["a"].most_copies <= 2 and shares["b"].most_copies == 1
    assert m.exceptAll(mixing.mix(df.repartition(3), goals)).count() == 0
