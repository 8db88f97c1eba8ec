import random
from collections import Counter

import corpus_pipeline
from tests.llm import brute
from xylem.llm import tokens


def test_stages_over_odd_rows(spark, tmp_path):
    docs = brute.odd(spark)
    columns = docs.columns
    docs.write.parquet(str(tmp_path / "0"))
    docs = spark.read.parquet(str(tmp_path / "0"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k + 1)))
        docs = spark.read.parquet(str(tmp_path / str(k + 1)))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert "sequence_id" in docs.columns


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and (out.groupby("sequence_id").length.sum() <= 4096).all()


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Words to take from each source, by resharing what full sources leave until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_stages_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(500)]
    data, sources = [], ["a", "b", "c", None]
    for i in range(40):
        text = [rng.choice(words) for _ in range(rng.randrange(60, 140))]
        data.append((len(data), " ".join(text), "en", rng.choice(sources)))
        if i % 4 == 0:  # an exact copy but for white space, and a near one
            near = list(text)
            near[rng.randrange(len(near))] = "changed"
            data += [(len(data), "\n ".join(text), "en", rng.choice(sources)), (len(data) + 1, " ".join(near).upper(), "en", rng.choice(sources))]
    data += [(900, "too short", "en", "a"), (901, None, None, None), (902, "again and again " * 40, "en", "b"), (903, " ".join(w + " ###$$$|||" for w in words[:100]), "en", "c")]
    docs, rows = spark.createDataFrame(data, brute.SCHEMA), data
    stages = dict(corpus_pipeline.STAGES)

    def step(name, frame):
        out = stages[name](spark, frame, "")
        got = [tuple(r) for r in out.collect()]
        return spark.createDataFrame(got, brute.SCHEMA) if name != "packing" else out, got

    docs, got = step("quality rules", docs)
    assert sorted(got) == sorted(r for r in rows if r[0] < 900)
    groups = {}
    for r in got:
        groups.setdefault(brute.re.sub(r"[\x20\x09-\x0d]+", " ", r[1]), []).append(r)
    want = sorted(min(g) for g in groups.values())
    docs, got = step("exact dedup", docs)
    assert sorted(got) == want and len(want) < 60
    want = sorted(r[0] for r, (_, _, c) in zip(got, brute.near([r[:2] for r in got], 5, 80, 100)) if r[0] == c)
    docs, got = step("near-dedup", docs)
    assert sorted(r[0] for r in got) == want and len(want) < 50
    before = {r[0]: r for r in got}
    size = {d: len(brute.WORD.findall(r[1])) for d, r in before.items()}
    source_size = Counter()
    for d, r in before.items():
        source_size[r[3]] += size[d]
    docs, got = step("mixing", docs)
    taken, copies = Counter(), Counter(r[0] for r in got)
    for r in got:
        assert r == before[r[0]]
        taken[r[3]] += size[r[0]]
    for s, target in targets(dict(source_size)).items():
        assert abs(taken[s] - target) <= max(size.values()) / 2 + 1
    assert max(copies.values()) <= 2
    packed, _ = step("packing", docs)
    packed = packed.toPandas()
    library = tokens.Encoder.of(tokens.tokenizer_path()).tokenizer
    ids = {d: len(library.encode(r[1], add_special_tokens=False).ids) + 1 for d, r in before.items()}
    assert sorted(zip(packed.doc_id, packed.length)) == sorted((r[0], ids[r[0]]) for r in got)
    for _, x in packed.sort_values("offset").groupby("sequence_id"):
        assert x.offset.tolist() == [0, *x.length.cumsum()[:-1]] and x.length.sum() <= 4096
    assert packed.sequence_id.nunique() <= -(-packed.length.sum() // 4096) + 1
