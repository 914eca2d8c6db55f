"""Matching, encoding, media and mixing operators against brute force, libraries and oracles."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratocast.llm import matroska, maxscore, mixing, pii, runlength, simhash, word_bpe
from stratocast.llm.components import components
from stratocast.llm.queries import ORACLE, QUERIES, vocabulary

from .cases import SF, edge_rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


# ---------------------------------------------------------------- personal data

def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_by_plain_patterns():
    rng = random.Random(1)
    for _ in range(15000):
        text = "".join(rng.choice("@@a.b-0123456789..+ ()%é_1") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_patterns_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@b." * 50_000):
        pii.base_spans(text)


def test_pii_query_by_brute_force(spark, corpus):
    got = {r.doc_id: r for r in QUERIES["op2_pii_bilstm_crf"](spark, SF).collect()}
    for r in corpus[0].collect():
        want = plain_spans(r.text)
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(filter(None, said.split(","))) <= set(g.spans.split(","))


def test_pii_edge_cases(documents):
    docs = documents(edge_rows() + [(30, "mail a.b@c.de now"), (31, None)], extra=True)
    for net in (None, pii.fit(docs, steps=3), pii.fit(docs.limit(0))):
        got = pii.digest(pii.spans(docs, net)).collect()
        assert len(got) == 13
        by_id = {r.doc_id: r for r in got}
        assert by_id[30].n_email == 1 and "email:5:13" in by_id[30].spans
        assert by_id[31].base_sha256 == hashlib.sha256(b"").hexdigest()
    rows = {r.doc_id: r for r in pii.redact(docs, None).collect()}
    assert rows[30].text == "mail <EMAIL> now" and rows[30].n_chars == 16 and rows[30].score == "x" and rows[31].text is None


def test_viterbi_by_enumeration():
    import itertools
    rng = np.random.default_rng(4)
    e, trans = rng.normal(size=(5, 3, 2)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    path = pii.viterbi(e, trans)
    for b in range(2):
        best = max(itertools.product(range(3), repeat=5), key=lambda p: sum(e[t, p[t], b] for t in range(5)) + sum(trans[x, y] for x, y in zip(p, p[1:])))
        assert tuple(path[:, b]) == best


def test_windows_decode_like_one_another(spark, corpus):
    net = pii.fit(corpus[0], steps=60)
    if net is not None:
        text = "word " * 200 + "mail 12@mail3.example.com or +1 (652) 555-4544 " + "word " * 200
        found = pii.find([text, "x", text], net)
        assert found[0] == found[2] and found[1] == []


# ---------------------------------------------------------------- top-k

@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_maxscore_oracle(spark, db):
    got = sorted(map(tuple, QUERIES["op3_maxscore_topk"](spark, SF).collect()))
    assert got == sorted(db.execute(ORACLE["op3_maxscore_topk"]).fetchall()) and got


def test_maxscore_ties_blocks_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(60)] + [(20, rows[20][1]), (None, rows[1][1]), (1000, None), (1001, []), (1002, [1.0, None]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (1005, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank", "3 as v")
    good = {i: np.floor(64 * np.array(v + [0.0] * (6 - len(v)))).astype(int) for i, v in rows[:360] + rows[-1:]}
    want = []
    for q in sorted(i for i in good if i % 20 == 0):
        best = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:20]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    for sizes in ((64, 4), (4096, 512)):
        got = sorted(map(tuple, maxscore.top_k(maxscore.integers(df), shard_rows=sizes[0], query_rows=sizes[1]).collect()))
        assert got == want
    assert maxscore.top_k(maxscore.integers(df.limit(0))).count() == 0


# ---------------------------------------------------------------- media

@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 768, 769, 6144, 6145, 98304, 200_001])
def test_matroska_round_trip(size):
    payload = matroska.padded(random.Random(size).randbytes(size))
    assert len(payload) % 192 == 0 and payload
    data = matroska.mux(payload)
    found = matroska.parse(data)
    assert found["ok"] and b"".join(data[p[2]:p[3]] for p in found["packets"]) == payload
    assert all(data[c[2]:c[2] + 4] == matroska.CLUSTER.to_bytes(4, "big") for c in found["cues"])
    stamps = [p[1] for p in found["packets"]]
    assert stamps == sorted(stamps) and found["tracks"][0]["codec"] == "A_PCM/INT/LIT"


def test_matroska_unknown_sizes_groups_and_faults():
    m = matroska
    block = b"\x82" + (5).to_bytes(2, "big") + b"\x02" + bytes([1]) + bytes([3]) + b"abcdefg"  # Xiph: 3 and 4 bytes
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block) + m.uint(m.BLOCK_DURATION, 10) + m.element(m.REFERENCE, b"\xff"))
    unknown = b"\x01" + b"\xff" * 7
    data = (m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + unknown + m.element(m.INFO, m.uint(m.TIMESTAMP_SCALE, 1000))
            + m.CLUSTER.to_bytes(4, "big") + unknown + m.uint(m.TIMESTAMP, 100) + group + m.CLUSTER.to_bytes(4, "big") + unknown + m.uint(m.TIMESTAMP, 200) + m.element(m.SIMPLE_BLOCK, b"\x81\x00\x01\x80zz"))
    got = m.parse(data)
    assert got["ok"] and [(p[0], p[1], data[p[2]:p[3]], p[4], p[6]) for p in got["packets"]] == [
        (2, 105_000, b"abc", False, 0), (2, 110_000, b"defg", False, 0), (1, 201_000, b"zz", True, 1)]
    whole = m.mux(b" " * 5000)
    for n in range(0, len(whole), 37):
        m.parse(whole[:n])
    assert not m.parse(whole[:-1])["ok"] and not m.parse(b"\x00abc")["ok"]


def test_media_edge_cases(documents):
    docs = documents(edge_rows(), extra=True)
    got = {(r.doc_id, r.n_bytes): r for r in matroska.features(matroska.media(docs)).collect()}
    for i, text in edge_rows():
        raw = (text or "").encode()
        want = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        r = got[i, len(raw)]
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:]) and r.payload_bytes == len(want)
    assert got[6, 43].media_sha256 == got[7, 43].media_sha256
    files = matroska.media(docs)
    assert matroska.packets(files).count() >= 11 and matroska.packets(files.selectExpr("doc_id", "cast(null as binary) as media")).count() == 0


# ---------------------------------------------------------------- tokens

def test_bpe_like_the_library():
    library, own = Tokenizer.from_file(vocabulary()), word_bpe.WordTrie(vocabulary())
    rng = random.Random(3)
    letters = "abcdeABC éÉßΣσςİıſÅ'’ÀÀ  \t\n  ​0123½²٣,.!?ñ́漢字😀🏽\x00\x07\x85퟿"
    texts = ["", "<|endoftext|>a<|startoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|", "don't I'LL we'd'S", "ΑΣ ΑΣ. ΣΑΣΑ", "internationalization " * 40, "a" * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    for text, (ids, decoded) in zip(texts, own.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(want)


def test_bpe_query_by_the_library(spark, corpus):
    library = Tokenizer.from_file(vocabulary())
    got = {r.doc_id: r for r in QUERIES["op7_trie_bpe"](spark, SF).collect()}
    for r in corpus[0].collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_edge_cases(documents):
    docs = documents(edge_rows(), extra=True)
    got = word_bpe.encode(docs, vocabulary())
    rows = got.collect()
    assert len(rows) == 11 and [r.ids for r in rows if r.doc_id in (1, 2, 3)] == [[], [], []]
    back = {r.doc_id: r.text for r in word_bpe.decode(got, vocabulary()).collect()}
    assert back[6] == back[7] and back[1] == ""
    assert word_bpe.digest(docs.limit(0), vocabulary()).count() == 0


# ---------------------------------------------------------------- near duplicates

def plain_components(codes, ids, radius):
    parent = list(range(len(codes)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(codes)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= radius:
                parent[root(a)] = root(b)
    low = {}
    for a, i in enumerate(ids):
        low[root(a)] = min(low.get(root(a), i), i)
    return [low[root(a)] for a in range(len(codes))]


def plain_fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query_by_brute_force(spark, corpus):
    rows = [(r.doc_id, r.text) for r in corpus[0].collect()]
    codes = [plain_fingerprint(t) for _, t in rows]
    want = plain_components(codes, [i for i, _ in rows], 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash_gray_index"](spark, SF).collect()}
    assert got == {i: (f"{c:016x}", w) for (i, _), c, w in zip(rows, codes, want)}


@pytest.mark.parametrize("radius,blocks,limit", [(2, 4, 65536), (2, 4, 5), (4, 6, 20)])
def test_links_lose_nothing_when_routes_are_split(spark, radius, blocks, limit):
    rng = random.Random(radius + limit)
    base = [rng.getrandbits(64) for _ in range(6)]
    codes = list({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(50)})
    nodes = spark.createDataFrame([(simhash.signed(c), i) for i, c in enumerate(codes)], "fp0 long, rep long")
    found = components(simhash.edges(nodes, 1, radius, blocks, limit), "t")
    got = {r.node: r.component for r in found.collect()}
    assert [got.get(i, i) for i in range(len(codes))] == plain_components(codes, range(len(codes)), radius)


def test_index_prunes_exactly():
    rng = np.random.default_rng(7)
    near = np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300).astype(np.uint64), near]))
    group = np.sort(rng.integers(0, 3, len(codes)))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    got = {(int(a), int(b)) for x in simhash.links(codes, group, 2, budget=500) for a, b in zip(*x)}
    far = np.bitwise_count(codes[:, None] ^ codes[None])
    assert got == {(a, b) for a, b in zip(*np.nonzero((far <= 2) & (group[:, None] == group[None]))) if a < b}


def test_near_duplicate_edge_cases(documents):
    docs = documents(edge_rows(), extra=True)
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest(simhash.near_duplicates(docs)).collect()]
    assert len(got) == 11
    zero = {i: c for i, f, c in got if f == "0" * 16}
    assert zero == {1: 1, 2: 1, 3: 1, None: 1}
    assert {c for i, _, c in got if i in (6, 7)} == {6} and [c for i, _, c in got if i == 4] == [4, 4]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}}


# ---------------------------------------------------------------- mixing

def test_mixing_oracle(spark, db):
    got = sorted(tuple(map(str, r)) for r in QUERIES["op9_poisson_mixing"](spark, SF).select("doc_id", "text", "copy", "shuffle_key").collect())
    cols = [c[0] for c in db.execute(ORACLE["op9_poisson_mixing"]).description]
    want = db.execute(ORACLE["op9_poisson_mixing"]).fetchall()
    assert got == sorted(tuple(str(r[cols.index(c)]) for c in ("doc_id", "text", "copy", "shuffle_key")) for r in want)


def test_mixing_rates(spark, documents):
    docs = documents([(i, "t") for i in range(6000)], source="a").unionByName(documents([(i, "t") for i in range(6000, 6200)], source="b"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 5.0), ("d", -1.0)], "source string, weight double")
    got = mixing.poisson_mix(docs, weights, size=8000)
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["a"] - 2000) < 150 and abs(n["b"] - 6000) < 260  # a rate of 30 is drawn in two parts
    keys = [r.shuffle_key for r in got.coalesce(1).collect()]
    assert len(set(keys)) == len(keys)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.poisson_mix(docs.repartition(7), weights, size=8000).collect()))


def test_mixing_edge_cases(spark, documents):
    docs = documents(edge_rows(), source=None, extra=True)
    got = mixing.poisson_mix(docs, size=220)
    rows = got.collect()
    assert set(docs.columns) < set(got.columns) and {"copy_", "rate_", "shuffle_key_"} < set(got.columns)
    assert 120 < len(rows) < 330 and {r.doc_id for r in rows} >= {1, 2, 5}
    assert mixing.poisson_mix(docs.limit(0)).count() == 0
    assert mixing.poisson_mix(docs, spark.createDataFrame([], "source string, weight double")).count() == 0


def test_rows_without_id_are_drawn_one_by_one(documents):
    docs = documents([(None, f"text {i}") for i in range(400)])
    n = [r["count"] for r in mixing.poisson_mix(docs).groupBy("text").count().collect()]
    assert 200 < len(n) < 300 and max(n) > 2  # neither all nor none of them
    plan = mixing.poisson_mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


# ---------------------------------------------------------------- repeats

def plain_removal(rows):
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            w = t[p:p + 50]
            first[w] = min(first.get(w, 1 << 64), runlength.LAST if i is None else i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < (runlength.LAST if i is None else i):
                gone[p:p + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 30_000, "index_bytes": 5_000, "common": 2}, {"index_bytes": 5_000, "crowd": 3}])
def test_repeats_by_brute_force(spark, documents, corpus, settings):
    rng = random.Random(5)
    words = ["alpha", "beta", "gam", "de", "x", " " * 60, "a line that many documents have, and it is long enough to count\n", "é", "\0"]
    rows = [(r.doc_id, r.text) for r in corpus[0].where("length(text) < 6000").limit(60).collect()]
    rows += [(2000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(i, t if i != 5 else "x" * 3000) for i, t in edge_rows()] + [(None, "a" * 300), (None, "a" * 300), (5002, "a" * 200), (3000, "b" * 80), (3000, "b" * 80)]
    got = runlength.digest(runlength.remove_repeats(documents(rows, extra=True), digest=True, **settings))
    assert sorted(map(tuple, got.collect()), key=str) == plain_removal([(i, (t or "").encode()) for i, t in rows])


def test_a_line_with_very_many_surroundings(spark):
    """One line of 60 bytes inside 200,000 short documents, nothing else in common, at default settings."""
    line = "this one line stands in every document of the whole table.\n"
    docs = spark.range(200_000).selectExpr("id as doc_id", f"concat(md5(cast(id as string)), '{line}', md5(cast(-id - 1 as string))) as text")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in runlength.remove_repeats(docs, digest=True).collect()}
    # The line goes with what its neighbours have in common with those of any smaller document.
    md5 = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    seen_left, seen_right = set(), set()

    def shared(text, seen):
        n = 0
        while text[:n + 1] in seen:
            n += 1
        seen.update(text[:k] for k in range(1, 16))
        return n

    for i in range(200_000):
        left, right = shared(md5(i)[::-1], seen_left), shared(md5(-i - 1), seen_right)
        assert got[i] == ((len(line) + left + right, 1) if i else (0, 0))


def test_copies_do_not_send_their_stretches(documents, monkeypatch):
    """Ten copies of each text, in chunks of their own: what goes to the routes is no multiple of the texts."""
    rng, sent, by_route = random.Random(4), [], runlength.by_route
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=3000)) for _ in range(40)]
    texts = [t if c % 2 else t[:1500] + str(c) + t[1500:] for c in range(10) for t in texts]

    def measured(messages, n_routes, solve):
        sent.append(messages.agg(F.sum(F.length("body"))).first()[0] or 0)
        return by_route(messages, n_routes, solve)

    monkeypatch.setattr(runlength, "by_route", measured)
    rows = list(enumerate(texts))
    got = runlength.digest(runlength.remove_repeats(documents(rows), chunk_bytes=120_000, digest=True)).collect()
    assert sorted(map(tuple, got), key=str) == plain_removal([(i, t.encode()) for i, t in rows])
    assert sum(sent) < 2 * sum(map(len, texts))


def test_repeats_of_an_empty_table(documents):
    assert runlength.remove_repeats(documents([])).count() == 0


def test_run_length_index():
    rng = random.Random(0)
    strings = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 30))) for _ in range(80)})
    docs = np.array([rng.randint(0, 9) for _ in strings])
    index = runlength.RunLengthIndex(strings, docs, 5)
    found = index.statistics(np.array([len(s) for s in strings]), 5)
    for j, s in enumerate(strings):
        for p in range(len(s) - 4):
            assert found[j, p] == min(d for t, d in zip(strings, docs) if s[p:p + 5] in t)
    assert len(index.start) < index.n
    # Rows in order hold the suffixes in order: locate them all through the samples.
    text = [c + len(strings) if c is not None else None for s in strings for c in [*s, None]]
    seps = iter(range(len(strings)))
    text = [next(seps) if c is None else c for c in text]
    suffixes = [text[index.locate(r):] for r in range(index.n)]
    assert suffixes == sorted(suffixes)


@pytest.mark.parametrize("size", [0, 127, 1000, 3_000_001])
def test_matroska_level_is_of_the_whole_payload(documents, size):
    text = "".join(random.Random(size).choices("abc xyz", k=size))
    changed = text[:-2] + "zz" if size else text
    rows = [(1, text), (2, changed)]
    got = {r.doc_id: int(dict(x.split("=") for x in r.feature.split(";"))["level"]) for r in matroska.features(matroska.media(documents(rows))).collect()}
    assert got == {i: sum(abs(x - 128) for x in matroska.padded(t.encode())) for i, t in rows}


def test_network_spans_need_a_digit_only_if_they_are_of_digits(monkeypatch):
    text = "write to jane at example dot org or call soon about it"
    a, b = text.index("jane"), text.index(" or call")

    def labels(values, lengths, net, kind=None):
        out = np.zeros(len(values), dtype=np.uint8)
        out[a:b] = kind + 1
        return out

    for kind, name in enumerate(pii.KINDS):
        monkeypatch.setattr(pii, "network_labels", lambda *x, kind=kind: labels(*x, kind=kind))
        assert pii.find([text], {}) == [[(a, kind, b, False)] if name == "email" else []]


def test_copies_of_one_table_are_one_code_of_its_routes(spark, monkeypatch):
    """Nodes that share fp0 and nothing else: no route is split for them, and all link."""
    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(77, simhash.signed(int(x)), i) for i, x in enumerate(rng.integers(0, 1 << 63, 60))], "fp0 long, fp1 long, rep long")
    labels, keep = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, label: labels.append(label) or keep(df, label))
    found = components(simhash.edges(nodes, 2, 2, 4, limit=50), "t").collect()
    assert {(r.node, r.component) for r in found} == {(i, 0) for i in range(60)} and "simhash-finer" not in labels


def test_pairs_of_a_dense_group_are_not_held():
    import tracemalloc
    codes = np.arange(8192, dtype=np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    tracemalloc.start()
    a, b = simhash.stars(codes, codes.astype(np.int64), np.ones(8192, np.int64), 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(a) == 8191 and not b.any() and peak < 500e6
