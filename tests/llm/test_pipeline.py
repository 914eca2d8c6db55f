"""The pipeline's stages on a small corpus, and its contract."""

import random

import numpy as np

import corpus_pipeline
from stratocast.llm import jaccard, pipeline, pii, simhash, word_bpe
from stratocast.llm.queries import vocabulary

from .cases import SF, edge_rows


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "bpe"]


def test_each_stage_works_on_what_its_predecessor_kept(spark, corpus, tmp_path):
    docs = corpus[0]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert out.columns == docs.columns
        seen.append((docs, out))
        docs = out
    (raw, good), (_, once), (_, clean), (_, mix), (mix_in, ids) = seen
    assert good.count() < raw.count() and good.exceptAll(raw).count() == 0
    assert once.exceptAll(good).count() == 0 and once.select("text").distinct().count() == once.count()
    # Every document that went has a kept one in its group; exact copies are never lost wholly.
    assert good.select("text").distinct().join(once.select("text"), "text", "left_anti").count() < 0.1 * once.count()
    assert clean.count() == once.count() and not any(pii.base_spans(r.text) for r in clean.collect())
    assert mix.select("doc_id").distinct().count() <= clean.count() and mix.exceptAll(clean).select("doc_id").join(clean, "doc_id", "left_anti").count() == 0
    got = sorted((r.doc_id, tuple(r.ids)) for r in ids.collect())
    trie = word_bpe.WordTrie(vocabulary())
    assert got == sorted((r.doc_id, tuple(int.from_bytes(e[i:i + 4], "little") for i in range(0, len(e), 4)))
                         for r in mix_in.collect() for e, _ in trie.encode([r.text]))


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "ids"]


def test_near_duplicates_keep_one(spark, documents):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(10, base), (11, base), (12, base.replace("w200", "other")), (13, " ".join(f"v{i}" for i in range(300))), (None, base), (10, base), (14, ""), (15, None)]
    got = sorted((r.doc_id for r in pipeline.one_of_each(spark, documents(rows), SF).collect()), key=str)
    assert got == sorted([10, 13, 14, None], key=str)


def test_stages_take_edge_cases(spark, documents):
    docs = documents(edge_rows(), extra=True)
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            assert out.count() <= rows.count() * 40
            assert name == "bpe" or out.columns == rows.columns


def test_similar_texts_share_a_component(spark, documents):
    words = [f"w{i}" for i in range(500)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:250] + ["new"] + words[250:])), (3, " ".join(reversed(words)))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(rows), shingle=5, radius=7, blocks=9, tables=4, total=42).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_links_are_those_of_brute_force(spark, documents):
    """Pairs of Jaccard 0.6 to 0.95: every one of 0.8 or more links, and no other."""
    draw = random.Random(7)
    texts = []
    for g in range(150):
        words = [f"g{g}w{i}" for i in range(draw.randint(60, 400))]
        other = list(words)
        for at in draw.sample(range(len(words)), max(1, round(len(words) * draw.uniform(0.005, 0.05)))):
            other[at] = f"x{at}"
        texts += [" ".join(words), " ".join(other)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    alike = {i for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    near = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.8 <= s < 0.9 for s in near) > 20 and sum(0.6 <= s < 0.8 for s in near) > 20
    found = {r.doc_id: r.component for r in jaccard.near_duplicates(documents(list(enumerate(texts))), pipeline.identity()).collect()}
    assert {i for i in range(0, len(texts), 2) if found[i] == found[i + 1]} == alike
    assert len(set(found.values())) == len(texts) - len(alike)
    assert {r.doc_id for r in pipeline.one_of_each(spark, documents(list(enumerate(texts))), SF).collect()} == set(range(len(texts))) - {i + 1 for i in alike}


def test_members_of_a_bucket_meet_beyond_the_chosen_one(spark):
    """Chains: neighbours are alike, ends are not; and a large bucket gives no square of pairs."""
    nodes = spark.createDataFrame([(i, [1] * 5) for i in range(12)], "node long, bands array<long>")
    assert {(r.a, r.b) for r in jaccard.pairs(nodes).collect()} == {(i, j) for i in range(12) for j in range(i)}
    nodes = spark.createDataFrame([(i, list(range(32))) for i in range(300)], "node long, bands array<long>")
    assert jaccard.pairs(nodes).count() <= 300 * jaccard.CHOICES


def test_unlike_texts_of_one_id_stay(spark, documents):
    one, two, three = (" ".join(f"{c}{i}" for i in range(300)) for c in "abc")
    near = one.replace("a150", "other")
    rows = [(5, one), (5, two), (3, near), (None, three), (None, three), (None, three.replace("c150", "other")), (7, two), (7, two), (9, three)]
    got = sorted(((r.doc_id, r.text) for r in pipeline.one_of_each(spark, documents(rows, extra=True), SF).collect()), key=str)
    assert (3, near) in got and (5, two) in got and (9, three) in got and len(got) == 4
    assert [i for i, _ in got].count(None) == 1


def test_simhash_index_proposes_and_the_full_sets_decide(spark, documents, monkeypatch):
    """Without MinHash: texts within two bits still meet, and those of one fingerprint but unlike sets stay apart."""
    monkeypatch.setattr(jaccard, "pairs", lambda nodes: spark.createDataFrame([], "a long, b long"))
    base = [f"w{i}" for i in range(2000)]
    one, two = " ".join(base), " ".join(base[:900] + ["other"] + base[901:])
    line = "a b c " * 3000
    three, four = line + " ".join(f"x{i}" for i in range(60)), line + " ".join(f"y{i}" for i in range(60))
    far = lambda a, b: (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count()
    assert 0 < far(one, two) <= 2 and far(three, four) == 0
    found = {r.doc_id: r.component for r in jaccard.near_duplicates(documents(list(enumerate([one, two, three, four]))), pipeline.identity()).collect()}
    assert found[0] == found[1] and len(set(found.values())) == 3


def sets_of(texts):
    return [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]


def classes(texts, tenths=8):
    """For each text the least index that is reachable by alike pairs, by brute force."""
    sets, at = sets_of(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= tenths * (len(sets[i]) + len(sets[j]) - both) and at[i] != at[j]:
                old, new = max(at[i], at[j]), min(at[i], at[j])
                at = [new if x == old else x for x in at]
    return at


def same_classes(found, expected):
    pairs = set(zip(found, expected))
    return len(pairs) == len(set(found)) == len(set(expected))


def test_members_of_a_star_meet_beyond_its_centre(spark, documents, monkeypatch):
    """Without MinHash: one fingerprint for all texts, whose pairs are alike, but unlike those of other pairs."""
    monkeypatch.setattr(jaccard, "pairs", lambda nodes: spark.createDataFrame([], "a long, b long"))
    line = "a b c " * 3000
    texts = [line + " ".join(f"{c}{i}" for i in range(60)) + end for c in "uvwxyz" for end in ("", " end")]
    assert len({simhash.fingerprint(t.encode()) for t in texts}) == 1
    found = {r.doc_id: r.component for r in jaccard.near_duplicates(documents(list(enumerate(texts))), pipeline.identity()).collect()}
    assert len(set(found.values())) == 6 and all(found[i] == found[i + 1] for i in range(0, 12, 2))


def test_templated_texts_without_sketches(spark, documents, monkeypatch):
    """What no sketch proposes is found too: chains, sizes at the limit, texts of one template at 0.6 to 0.95."""
    none = "a long, b long"
    monkeypatch.setattr(jaccard, "pairs", lambda nodes: spark.createDataFrame([], none))
    monkeypatch.setattr(jaccard, "close", lambda found, nodes: spark.createDataFrame([], none))
    draw = random.Random(11)
    template = [f"t{i}" for i in range(200)]
    texts = []
    for g in range(120):
        words = list(template)
        for at in draw.sample(range(200), draw.randint(1, 9)):
            words[at] = f"g{g}x{at}"
        texts.append(" ".join(words))
    chain = [f"c{i}" for i in range(100)]
    texts += [" ".join(chain[:k]) for k in range(20, 101, 4)] + ["one two", "one two three", "one two three four five", "one two three four five six"]
    found = {r.doc_id: r.component for r in jaccard.near_duplicates(documents(list(enumerate(texts))), pipeline.identity()).collect()}
    expected = classes(texts)
    assert 5 < len(set(expected)) < len(texts) - 20
    assert same_classes([found[i] for i in range(len(texts))], expected)


def test_first_shingles_and_parts_keep_alike_pairs():
    """Sets at the limit share a first shingle in any order; the bound by a part is never below the truth."""
    draw = np.random.default_rng(3)
    for n in [*range(1, 30), 200, 1000]:
        for _ in range(20):
            union = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            both = -(-8 * n // 10)
            cut = draw.integers(both, n + 1)
            a, b = np.unique(union[:cut]), np.unique(np.concatenate([union[:both], union[cut:]]))
            often = np.sort(draw.choice(union, n // 2, replace=False))
            known = often, draw.integers(2, 5, len(often))
            assert jaccard.alike(a, b, 8)
            assert np.intersect1d(jaccard.firsts(a, 8, known), jaccard.firsts(b, 8, known)).size
            part = lambda h: (h[h < jaccard.QUARTER] >> np.uint64(32)).astype(np.uint32)
            assert jaccard.may_be_alike(part(a), part(b), len(a), len(b), 8)
