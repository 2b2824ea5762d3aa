import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge import docs, none

from reelsift.llm.ngram_join import Bands, jaccard_classes, overlaps, shingle_set


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    """Component (smallest id) and set size by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in rows}
    found, root = defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j, k in Counter(j for s in sets[i] for j in found[s]).items():
            if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            found[s].append(i)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def near_copies(seed, families=12, size=9, spread=0.06):
    """Families of a text and copies with some words replaced, chained and starred, plus loners."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([3, 8, 30, 120]))]
        for _ in range(size):
            copy = [word() if rng.random() < spread * rng.random() else w for w in base]
            rows.append(" ".join(copy))
            if rng.random() < 0.5:
                base = copy
    rows += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(20)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "n", "num", "den"), [(1, 3, 90, 100), (2, 5, 4, 5)])
def test_matches_brute_force_on_families_of_near_copies(spark, seed, n, num, den):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(df, n=n, num=num, den=den).collect())
    want = brute(rows, n, num, den)
    assert got == want
    assert len({c for *_, c in want}) < len(rows) - 20  # the test has links


def test_edges(spark):
    got = jaccard_classes(docs(spark, extra=("component_id", "k", "sig"))).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == 10
    assert all(r.n_shingles == 0 and r.component_id == i and r.class_id is None for i in (2, 3, 4) for r in by[i])
    assert [r.component_id for r in by[1]] == [1, 1] and len({r.class_id for r in by[1] + [x for x in by[None] if x.n_shingles]}) == 1
    assert [r.n_shingles for r in by[5]] == [1] and [r.n_shingles for r in by[6]] == [1]
    assert jaccard_classes(none(spark)).count() == 0


def test_short_sequences_are_whole_and_case_folds_ascii_only():
    assert len(shingle_set(b"a b", 3)) == 1 and (shingle_set(b"a b", 3) != shingle_set(b"a", 3)).all()
    assert (shingle_set("A B C D".encode(), 3) == shingle_set(b"a b c d", 3)).all()
    assert (shingle_set("É b c".encode(), 3) != shingle_set("é b c".encode(), 3)).all()
    assert len(shingle_set("a b c".encode(), 3)) == 1  # a no-break space is part of a word


@pytest.mark.parametrize("k2", [0, 1])
def test_similar_sets_always_share_a_signature(k2):
    rng = np.random.default_rng(k2)
    bands = Bands(9, 10, k2)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[int(rng.integers(0, max(1, len(a) // 18))):], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 18))), dtype=np.uint64)])
        common = len(np.intersect1d(a, b))
        if 10 * common >= 9 * (len(a) + len(b) - common):
            assert np.intersect1d(bands.signatures(a), bands.signatures(b)).size


def test_overlaps_counts_rare_and_frequent_elements():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60 if i % 2 else 4000, rng.integers(1, 80)).astype(np.uint64)) for i in range(60)]
    got = overlaps(sets, np.arange(60), np.arange(20, 60))
    assert (got == np.array([[len(np.intersect1d(a, b)) for b in sets[20:]] for a in sets])).all()


def test_choices_of_second_level_parts_give_the_same_links(spark):
    from reelsift.llm import ngram_join

    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:i] + ["x"] + words[i + 1:]) for i in (0, 3, 60, 119)] + [" ".join(words[::-1]), " ".join(words[:40]), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = [sorted((r.doc_id, r.component_id) for r in ngram_join.jaccard_classes(df, n=2, num=9, den=10, k2=k).collect()) for k in (0, 1)]
    assert links[0] == links[1] and [c for _, c in links[0]] == [0, 0, 0, 0, 4, 5, 6]


def test_overlaps_take_memory_for_the_elements_not_for_all_pairs_of_sets():
    """Before, all sets of both blocks were compared with each other, 67 MB at the most; 26 now."""
    import tracemalloc

    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(3000) < 0.1][:400], rng.integers(0, 60_000, 200).astype(np.uint64)])) for _ in range(1700)]
    left, right = np.arange(850), np.arange(850, 1700)
    tracemalloc.start()
    got = overlaps(sets, left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    for i, j in ((0, 0), (3, 849), (849, 5)):
        assert got[i, j] == len(np.intersect1d(sets[left[i]], sets[right[j]]))
    some = np.array([4, 1, 30])
    whole = overlaps(sets[:40], some, some)
    assert all(whole[i, j] == len(np.intersect1d(sets[a], sets[b])) for i, a in enumerate(some) for j, b in enumerate(some))


def test_crowds_are_cut_and_compared_by_one_worker(spark, monkeypatch):
    """Before, tasks that compared a large group's sets with their centre kept two Python workers each."""
    from reelsift.llm import ngram_join

    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(words[:i] + [f"x{i}"] + words[i + 1:]) for i in range(90)] + [" ".join(words[::-1]), None]
    df = spark.createDataFrame([(i % 91, t) for i, t in enumerate(texts)], "doc_id long, text string")  # an id of two texts
    plans, cut = {}, ngram_join.cut_lineage

    def noted(table, name):
        plans[name] = table._jdf.queryExecution().executedPlan().toString()
        return cut(table, name)

    monkeypatch.setattr(ngram_join, "cut_lineage", noted)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(df, n=2, num=9, den=10).collect())
    assert "links" in plans and all(p.count("MapInArrow") <= 1 for p in plans.values())
    assert got == sorted([(i, 149, 0) for i in range(90)] + [(90, 149, 90), (0, 0, 0)])


def passages(seed, texts=120, kinds=25):
    """Texts of some of few passages each, so that many share one and few are similar; some have a near copy."""
    rng = random.Random(seed)
    said = [" ".join(f"p{p}w{i}" for i in range(12)) for p in range(kinds)]
    rows = []
    for t in range(texts):
        words = " ".join([*rng.sample(said, 4), *(f"t{t}w{i}" for i in range(rng.choice([0, 12, 12, 12])))]).split()
        rows.append(" ".join(words))
        if t % 6 == 0:
            words[rng.randrange(len(words))] = "x"
            rows.append(" ".join(words))
    return list(enumerate(rows))


@pytest.mark.parametrize(("group", "frequent"), [(8192, (64, 512)), (7, (2, 5, 11))])
def test_texts_that_only_share_passages_never_form_one_family(spark, monkeypatch, group, frequent):
    """Before, whatever shared signatures was one family, and its blocks were all compared with each other."""
    from reelsift.llm import ngram_join

    rows, wanted, cut = passages(3), [], ngram_join.cut_lineage

    def noted(table, name):
        made = cut(table, name)
        if name == "wanted":
            wanted.extend(r["count"] for r in made.groupBy("family").count().collect())
        return made

    monkeypatch.setattr(ngram_join, "cut_lineage", noted)
    monkeypatch.setattr(ngram_join, "SCREEN_GROUP", group)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = brute(rows, 5, 4, 5)
    assert got == want and len({c for *_, c in want}) <= len(rows) - 15
    assert wanted and max(wanted) <= 12


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    from reelsift.llm.ngram_join import screened

    rng, bands = np.random.default_rng(7), Bands(4, 5)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, int(rng.integers(170, 230)), dtype=np.uint64)
        sets += [np.unique(np.r_[base[cut:], rng.integers(0, 2**63, cut, dtype=np.uint64)]) for cut in (0, 9, 25, 60)]
    k = np.arange(len(sets))
    n = np.array([len(x) for x in sets])
    bits = np.frombuffer(b"".join(bands.sketch(x, 19) for x in sets), np.uint64).reshape(len(sets), -1)
    a, b = screened(np.zeros(len(k), np.int64), k, k, n, bits, 4, 5)
    root = np.arange(len(k))
    for x, y in zip(a, b, strict=True):
        root[root == root[y]] = root[x]
    links = 0
    for i in k:
        for j in k[:i]:
            common = len(np.intersect1d(sets[i], sets[j]))
            if 5 * common >= 4 * (n[i] + n[j] - common):
                links += 1
                assert root[i] == root[j]
            differ = int(np.bitwise_count(bits[i] ^ bits[j]).sum())
            assert differ <= n[i] + n[j] - 2 * common
    assert links >= 40 and len(set(root.tolist())) >= 40  # similar sets meet, the others stay apart
    none, _ = screened(np.zeros(len(k), np.int64), k, np.zeros(len(k), np.int64), n, bits, 4, 5)
    assert not len(none)  # one component already
    alone, _ = screened(k, k, k, n, bits, 4, 5)
    assert not len(alone)
