"""Near copies by five-word shingles: every pair of similarity 0.8 or more is linked."""

import random

import numpy as np
import pytest

from litweave.llm import near_copies

from .test_dedup import AWKWARD, brute_components, documents


def brute_set(text):
    found = [w.lower() for w in (text or "").encode().split()]
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edited(rng, text, n):
    found = text.split()
    for at in rng.sample(range(len(found)), n):
        found[at] = f"new{rng.randrange(10**6)}"
    return " ".join(found)


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 400))) for _ in range(30)]
    line = " ".join(f"line{i}" for i in range(60))
    texts = base + [edited(rng, t, k) for t in base for k in (1, 1, 2, 4)]
    texts += [f"{line} {t[: 20 * (k % 9)]}" for k, t in enumerate(base)] + [edited(rng, base[0], 1) for _ in range(40)] + AWKWARD
    sets = [brute_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(len(texts), pairs)


def test_one_word_of_sixty_replaced_is_a_near_copy(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(9000)}" for _ in range(60)) for _ in range(25)]
    texts = base + [edited(rng, t, 1) for t in base]
    kept = near_copies.drop_near_copies(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(25))
    assert near_copies.drop_near_copies(documents(spark, [])).count() == 0


@pytest.mark.parametrize("common", [3, 256])
def test_a_large_group_just_around_the_bound(spark, monkeypatch, common):
    """Most pairs of a large family are just below the bound, some above; sets meet in many blocks."""
    monkeypatch.setattr(near_copies, "BLOCK_NODES", 24)
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(near_copies, "COMMON", common)
    rng = random.Random(6)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(120))
    other = " ".join(f"v{rng.randrange(3000)}" for _ in range(100))
    texts = [edited(rng, base, rng.choice([1, 2, 3])) for _ in range(300)] + [edited(rng, other, k % 5) for k in range(60)]
    chain = [other]
    for _ in range(25):
        chain.append(edited(rng, chain[-1], 2))
    line = " ".join(f"line{i}" for i in range(30))
    texts += chain + [f"{line} {' '.join(f'u{rng.randrange(9000)}' for _ in range(rng.randrange(9)))}" for _ in range(60)]
    rng.shuffle(texts)
    sets = [brute_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(len(texts), pairs)


def test_parities_never_rule_out_a_similar_pair():
    rng = random.Random(7)
    for n in (1, 5, 40, 900, 5000):
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
        for k in (0, 1, n // 50, n // 40, n // 20):
            x, y = (near_copies.shingle_set(t) for t in (text, edited(rng, text, min(k, n))))
            assert near_copies._unpacked(near_copies._packed(x)).tolist() == x.tolist()
            a, b = near_copies._parities(x), near_copies._parities(y)
            slots = 8 * min(len(a), len(b))
            differ = int((np.bitwise_count(near_copies._folds(a, slots) ^ near_copies._folds(b, slots))).sum())
            assert differ <= len(set(x.tolist()) ^ set(y.tolist()))
