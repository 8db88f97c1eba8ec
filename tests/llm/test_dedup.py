import random

import pytest

from tests.llm import brute
from xylem.llm import exact_dedup, near_dedup, repeats


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_near_dedup_against_all_pairs(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 8)):
            text = list(base)
            for _ in range(rng.randrange(0, 8)):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text).title() if rng.random() < 0.3 else "  ".join(text))
    data = [(i, t) for i, t in enumerate(texts)] + [(d, t) for d, t, *_ in brute.ODD if d != 8]
    data = [(i if d is not None else None, t) for i, (d, t) in enumerate(data)]
    got = near_dedup.verdicts(spark.createDataFrame(data, "doc_id long, text string"))
    assert rows(got.select("doc_id", "n_shingles", "component_id")) == sorted(brute.near(data), key=str)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_UNITS", 4)
    rng = random.Random(2)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    data = []
    for i in range(40):
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(999)}"
        data.append((i, " ".join(text)))
    got = near_dedup.verdicts(spark.createDataFrame(data, "doc_id long, text string"))
    assert rows(got.select("doc_id", "n_shingles", "component_id")) == sorted(brute.near(data), key=str)


def test_near_stage_keeps_one_of_each(spark):
    kept = near_dedup.kept_documents(brute.odd(spark))
    assert kept.columns == brute.odd(spark).columns
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 9, 10, 11, 12, None}
    assert near_dedup.verdicts(brute.empty(spark)).count() == 0


def test_near_stage_keeps_one_of_rows_that_repeat_an_id(spark):
    words = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(50)]
    data = [(1, " ".join(words)), (1, " ".join([*words[:-1], "x"])), (1, " ".join([*words, "y"])), (2, " ".join(["z", *words])), (1, " ".join(other))]
    kept = rows(near_dedup.kept_documents(spark.createDataFrame(data, "doc_id long, text string")))
    assert len(kept) == 2 and data[4] in kept and set(kept) <= {data[i] for i in (0, 1, 2, 4)}


@pytest.mark.parametrize("digit", [1, 48])
def test_exact_dedup(spark, digit):
    data = [(d, t) for d, t, *_ in brute.ODD] + [(20, "same " * 2000), (21, "same\n" * 2000), (22, "same " * 2000 + "x")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, "doc_id long, text string"), first_digit=digit)
    groups: dict = {}
    for d, t in data:
        groups.setdefault(brute.re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(d)
    want = []
    for ids in groups.values():
        real = [i for i in ids if i is not None]
        keep, left = min(real, default=None), True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            want.append((i, keep, len(ids), i == keep and left))
            left = left and i != keep
    assert rows(got.select("doc_id", "_dedup.keep_id", "_dedup.group_size", "_dedup.kept")) == sorted(want, key=str)


def test_exact_stage(spark):
    kept = exact_dedup.kept_documents(brute.odd(spark))
    assert kept.columns == brute.odd(spark).columns
    # 8 differs from 1 in white space alone, and null text is equal to empty text
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 5, 6, 7, 9, 10, 11, 12]
    assert kept.where("doc_id IS NULL").count() == 1
    assert exact_dedup.exact_dedup(brute.empty(spark)).count() == 0


@pytest.mark.parametrize("most", [8192, 2])
def test_repeats(spark, most):
    rng = random.Random(3)
    bases = ["".join(rng.choice(["ab", "ba", "aab", "c"]) for _ in range(60)) for _ in range(5)]
    data = [(i, "".join(rng.choice(bases)[rng.randrange(30) :] for _ in range(rng.randrange(4)))) for i in range(50)]
    data += [(100, None), (101, ""), (102, "x" * 300), (103, "y" * 19), (103, "y" * 19), (104, "ab" * 100), (None, "zq" * 7 + bases[0]), (105, "é" * 30)]
    got = repeats.cut_repeats(spark.createDataFrame(data, "doc_id long, text string"), 20, 8, False, most)
    assert rows(got.drop("text")) == sorted(brute.repeats(data, 20), key=str)


def test_repeats_odd(spark):
    got = repeats.verdicts(brute.odd(spark))
    assert rows(got) == sorted(brute.repeats([(d, t) for d, t, *_ in brute.ODD], 400), key=str)
    assert repeats.verdicts(brute.empty(spark)).count() == 0


def test_links_hidden_between_components_of_a_large_cluster(spark, monkeypatch):
    """Chains, strays and several groups in one cluster of many small blocks: every link is found, few pairs are compared."""
    monkeypatch.setattr(near_dedup, "BLOCK_UNITS", 4)
    how = near_dedup.Settings(numerator=85, bands=48, rows=4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    data = []
    for group in range(4):  # four groups of near copies, each too far from the others, but in their buckets
        mine = list(base)
        for _ in range(9):
            mine[rng.randrange(200)] = f"g{group}x{rng.randrange(999)}"
        for _ in range((40, 20, 5, 1)[group]):
            text = list(mine)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(200)] = f"x{rng.randrange(9999)}"
            data.append((len(data), " ".join(text)))
    for step in range(30):  # a chain: each differs from the one before by a little, its ends share little
        text = [*base[step * 3 :], *[f"c{i}" for i in range(step * 3)]]
        data.append((len(data), " ".join(text)))
    rng.shuffle(data)
    got = near_dedup.grouped(spark.createDataFrame(data, "doc_id long, text string"), how)
    assert rows(got.select("doc_id", "n_shingles", "component_id")) == sorted(brute.near(data), key=str)


def test_a_near_copy_cluster_compares_about_as_many_blocks_as_it_has(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_UNITS", 4)
    sizes = []

    def counted(whole):
        def make(how):
            seen = spark.sparkContext.accumulator(0)
            sizes.append(seen)
            run = whole(how)

            def count(f):
                seen.add(len(f))
                return run(f)

            return count

        return make

    for name in ("_standing", "_crossing"):
        monkeypatch.setattr(near_dedup, name, counted(getattr(near_dedup, name)))
    base = [f"w{i}" for i in range(150)]
    data = [(i, " ".join([*base, f"x{i}"])) for i in range(120)]
    got = near_dedup.verdicts(spark.createDataFrame(data, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}
    assert sum(s.value for s in sizes) <= 3 * 120
