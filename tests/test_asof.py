"""As-of joins against brute force: ties, NULL keys, tolerance, both directions."""

import random


from stratocast.operators.asof import Source, asof, asof_many, asof_nearest, interpolate_at


def data(seed, n=60):
    r = random.Random(seed)
    left = [(r.choice(["a", "b", "z", None]), r.randrange(0, 200), i) for i in range(n)]
    right = [(r.choice(["a", "a", "b", None]), r.randrange(0, 200), i, r.choice([None, i])) for i in range(n)]
    return left, right


def frames(spark, left, right):
    return (spark.createDataFrame(left, "k string, t long, id long"),
            spark.createDataFrame(right, "k string, u long, tie long, v long"))


def pick(right, k, ok, key):
    c = [r for r in right if k is not None and r[0] == k and ok(r[1])]
    return max(c, key=key) if c else None


def test_backward_and_forward(spark):
    for seed in (1, 2):
        left, right = data(seed)
        l, r = frames(spark, left, right)
        for incl in (True, False):
            got = {x.id: x for x in asof(l, r, ["k"], "t", "u", {"tie2": "tie"}, tie="tie", inclusive=incl, tolerance=30, width=17).collect()}
            fwd = {x.id: x for x in asof(l, r, ["k"], "t", "u", {"u2": "u"}, tie="tie", inclusive=incl, direction="forward", width=17).collect()}
            assert len(got) == len(left) == len(fwd)
            for k, t, i in left:
                b = pick(right, k, lambda u: u <= t if incl else u < t, lambda x: (x[1], x[2]))
                b = b if b and t - b[1] <= 30 else None
                assert got[i].tie2 == (b[2] if b else None)
                f = pick(right, k, lambda u: u >= t if incl else u > t, lambda x: -x[1])
                assert fwd[i].match_us == (f[1] if f else None)


def test_nearest_prefers_the_earlier(spark):
    l = spark.createDataFrame([("a", 10, 1), ("a", 50, 2), ("a", 100, 3)], "k string, t long, id long")
    r = spark.createDataFrame([("a", 5), ("a", 15), ("a", 53), ("a", 200)], "k string, u long")
    got = {x.id: x.match_us for x in asof_nearest(l, r, ["k"], "t", "u", {"u2": "u"}, 20, width=7).collect()}
    assert got == {1: 5, 2: 53, 3: None}


def test_many_sources_in_one_pass(spark):
    l = spark.createDataFrame([("a", 10, 1), ("b", 10, 2)], "k string, t long, id long")
    x = spark.createDataFrame([("a", 10, 7), ("a", 3, 6)], "k string, u long, v long")
    got = {r.id: (r.p, r.q) for r in asof_many(l, [Source(x, "u", {"p": "v"}), Source(x, "u", {"q": "v"}, inclusive=False)], ["k"], "t", width=4).collect()}
    assert got == {1: (7, 6), 2: (None, None)}


def test_interpolation_holds_the_ends(spark):
    l = spark.createDataFrame([("a", t) for t in (0, 10, 15, 20, 99)], "k string, t long")
    c = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 3.0), ("a", 18, None)], "k string, u long, v double")
    got = {r.t: r.y for r in interpolate_at(l, c, ["k"], "t", "u", "v", "y", width=6).collect()}
    assert got == {0: 1.0, 10: 1.0, 15: 2.0, 20: 3.0, 99: 3.0}
