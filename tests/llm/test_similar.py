"""Near copies by shingles, against all pairs."""

import numpy as np
import pytest

from lodestone.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(texts):
    """The smallest id that each text reaches over links of 0.8."""
    sets = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def components(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}


def edited(rng, words, share):
    """Each word changed with such a chance that shingles are alike by ``share`` on average."""
    chance = 1 - (2 * share / (1 + share)) ** 0.2
    return [f"e{rng.integers(10**9)}" if rng.random() < chance else w for w in words]


@pytest.mark.parametrize("fill", [0, 3000])
def test_pairs_at_the_bound_are_found_whatever_the_number_of_texts(spark, fill):
    rng = np.random.default_rng(11)
    texts = {}
    for base in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(6, 400)))]
        for share in (1, 0.86, 0.82, 0.8, 0.78):
            texts[len(texts)] = " ".join(edited(rng, words, share))
    want = brute(texts)
    more = {10**6 + i: " ".join(f"v{x}" for x in rng.integers(0, 10**6, 20)) for i in range(fill)}
    found = components(spark, texts | more)
    assert {i: found[i] for i in texts} == want and all(found[i] == i for i in more)


def test_crowded_keys_lose_no_pair(spark):
    rng = np.random.default_rng(12)
    shared = [f"s{i}" for i in range(150)]
    ids = rng.permutation(300).tolist()
    texts = {}
    for _ in range(150):  # a hot source: alike by 0.75, and among them pairs alike by 0.81, their ids far apart
        words = shared + [f"u{x}" for x in rng.integers(0, 10**6, 25)]
        texts[ids.pop()] = " ".join(words)
        texts[ids.pop()] = " ".join([*words[:-18], *(f"x{x}" for x in rng.integers(0, 10**6, 18))])
    want = brute(texts)
    assert len(set(want.values())) == 150
    assert components(spark, texts) == want


def test_long_texts_below_the_bound_stay_apart(spark):
    rng = np.random.default_rng(13)
    texts = {}
    for _ in range(30):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 900)]
        texts[len(texts)] = " ".join(words)
        texts[len(texts)] = " ".join([*words[:-115], *(f"x{x}" for x in rng.integers(0, 10**6, 115))])  # 0.77
    assert components(spark, texts) == brute(texts) == {i: i for i in texts}


def test_short_texts_and_boundaries():
    nine = "a b c d e f g h i"
    assert simhash.alike(simhash.shingles(nine[:-2]), simhash.shingles(nine))
    assert not simhash.alike(simhash.shingles("a b c d e f g"), simhash.shingles("a b c d e f g h"))
    for n in range(1, 3000):
        largest = n * 5 // 4
        assert simhash.size_class(largest) - simhash.size_class(n) <= 1


def test_alike_sets_share_more_keys_than_they_do_without():
    rng = np.random.default_rng(14)
    least = []
    for n in [*range(1, 60), 97, 400, 1500]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype("u8"))
            x, y = (np.delete(a, rng.permutation(n)[: int(rng.integers(0, n // 9 + 1))]) for _ in "ab")
            y = np.unique(np.concatenate([y, rng.integers(0, 2**63, int(rng.integers(0, n // 9 + 1))).astype("u8")]))
            if len(x) and len(y) and simhash.alike(x, y):
                of = max(simhash.size_class(len(x)), simhash.size_class(len(y)))
                level = max(simhash.level_of(x), simhash.level_of(y))
                keys = [simhash.part_keys(z, of, level) for z in (x, y)]
                spare = max(simhash.spare_keys(len(k), len(z), of) for k, z in zip(keys, (x, y), strict=True))
                least.append(len(np.intersect1d(*keys)) - spare)
    assert len(least) > 500 and min(least) >= 1


def test_fingerprints_are_compared_by_the_general_pigeonhole_principle(spark, monkeypatch):
    rng, met, links = np.random.default_rng(15), [], simhash.links
    words = [f"w{x}" for x in rng.integers(0, 10**6, 1500)]
    texts = {i: " ".join([*words[: 700 * i], f"x{i}", *words[700 * i + 1 :]]) for i in range(3)} | {9: " ".join(words[::-1])}
    monkeypatch.setattr(simhash, "links", lambda *a, **k: met.append(links(*a, **k)) or met[-1])
    assert components(spark, texts) == brute(texts)
    prints = {simhash.fingerprint(t) for t in texts.values()}
    near = sum((a ^ b).bit_count() <= 2 for a in prints for b in prints if a < b)
    assert len(met) == 1 and met[0].count() == near
