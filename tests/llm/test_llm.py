import math
import random
import re
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slabworks.llm import bytepair as B
from slabworks.llm import mixture as M
from slabworks.llm import repetition as R
from slabworks.llm import trees

DOC = "doc_id bigint, text string, source string, extra string"


@pytest.fixture(scope="module")
def enc():
    return B.encoder(B.vocabulary())


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(B.vocabulary())
    t.encode_special_tokens = True
    return lambda texts: [r.ids for r in t.encode_batch(texts, add_special_tokens=False)]


def ids(enc, text):
    return np.frombuffer(enc.encode(text), dtype=np.int32).tolist()


def test_every_token_is_its_own_encoding(enc):
    odd = [t for t, i in enc.ids.items() if enc.encode_piece(t.encode("latin-1").decode("utf-8", "replace")) != [i] and t.encode("latin-1").decode("utf-8", "replace").isascii()]
    assert odd == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aAtheinsT  \n\t01'.,-_é中🙂\x1c\x85\xa0²ⅷ", max_size=120)), min_size=1, max_size=8))
def test_as_the_public_library(enc, reference, texts):
    assert [ids(enc, t) for t in texts] == reference(texts)


def test_hard_texts(enc, reference):
    r = random.Random(3)
    texts = ["<|endoftext|> x", "a" * 30000, "ab" * 9000, " " * 5000, "\n" * 3000 + "x", "é" * 5000, "ing" * 7000 + "th" * 5000, "\n\nfoo\n  bar \n\n", "I'll we've 's  's\t's", "   x", "x\n" * 20000]
    texts += ["".join(r.choice("eaintrsolc") for _ in range(4000)), "".join(r.choice("ABCdef123+/=") for _ in range(20000))]
    assert [ids(enc, t) for t in texts] == reference(texts)


def test_corpus(spark, reference):
    rows = [(1, "hello world", "a", ""), (2, "", "a", ""), (3, None, None, ""), (3, "  ", "a", ""), (4, "x" * 300000, "b", "")]
    df = spark.createDataFrame(rows, DOC)
    got = sorted((r.doc_id, r.ids) for r in B.encode_corpus(df).collect())
    assert got == sorted((i, reference([t or ""])[0]) for i, t, _, _ in rows)
    counts = sorted((r.doc_id, r.n_tokens) for r in B.count_tokens(df, ["doc_id"]).collect())
    assert counts == [(i, len(x)) for i, x in got]
    assert B.encode_corpus(df.limit(0)).count() == 0


# --- mixing ---


def corpus(spark, sizes):
    rows = [(i, "word " * n, s, "") for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows + [(-1, None, "a", ""), (-2, "", "a", ""), (-3, "no source", None, "")], DOC)


def targets(spark, rows):
    return spark.createDataFrame(rows, "mix_name string, source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    r = random.Random(1)
    docs = corpus(spark, [(s, r.randint(1, 60)) for s, n in (("a", 400), ("b", 60), ("c", 7)) for _ in range(n)])
    want = targets(spark, [("m", "a", 0.6, 1), ("m", "b", 0.3, 3), ("m", "c", 0.1, 4), ("n", "a", 0.5, 2), ("n", "zz", 0.5, 2), ("o", "b", None, 1), ("o", "c", 1.0, 0)])
    drawn, plan = M.draw(docs, want)
    rows = drawn.collect()
    cap = {("m", "a"): 1, ("m", "b"): 3, ("m", "c"): 4, ("n", "a"): 2}
    assert all(0 < x.copies <= cap[x.mix_name, x.source] for x in rows) and min(x.doc_id for x in rows) >= 0
    assert len({(x.mix_name, x.doc_id) for x in rows}) == len(rows)
    got = {(x.mix_name, x.source): x for x in M.shares(drawn, want).collect()}
    for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        assert got["m", s].actual_share == pytest.approx(share, abs=0.02)
    assert got["n", "a"].actual_share == 1.0 and got["n", "zz"].tokens == 0 and got["o", "c"].tokens == 0
    again = {(x.mix_name, x.doc_id): x.copies for x in M.draw(docs, want)[0].collect()}
    assert again == {(x.mix_name, x.doc_id): x.copies for x in rows}
    # the source that limits the mix is used up to its cap
    p = {(x.mix_name, x.source): x for x in plan.collect()}
    assert any(math.isclose(x.due, x.available * x.max_repeats, rel_tol=1e-6) for x in p.values() if x.mix_name == "m")


def test_inclusion_follows_the_odds(spark):
    from pyspark.sql import functions as F

    docs = corpus(spark, [("a", 10)] * 300 + [("b", 10)] * 100)
    want = targets(spark, [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)])
    weight = F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)
    even = odd = 0
    for seed in range(6):
        for x in M.draw(docs, want, weight=weight, seed=seed)[0].where("source = 'a'").collect():
            even, odd = even + (x.doc_id % 2 == 0), odd + (x.doc_id % 2)
    assert 2.0 < even / odd < 4.5  # three times the probability


def broadcast_sides(df):
    """The expressions below each broadcast exchange of the executed plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            deep = len(line) - len(line.lstrip(" :+-"))
            below = []
            for other in lines[i + 1 :]:
                if len(other) - len(other.lstrip(" :+-")) <= deep:
                    break
                below.append(other)
            out.append("\n".join(below))
    return out


def test_the_plan_is_broadcast_and_not_the_documents(spark):
    docs = corpus(spark, [("a", 5)] * 40 + [("b", 9)] * 30)
    drawn, _ = M.draw(docs, targets(spark, [("m", "a", 0.5, 2), ("m", "b", 0.5, 3)]))
    sides = broadcast_sides(drawn)
    assert sides and all("doc_id" not in side for side in sides), sides
    assert "SortMergeJoin" not in drawn._jdf.queryExecution().executedPlan().toString()


def test_certified(spark):
    r = random.Random(5)
    docs = corpus(spark, [(s, r.randint(1, 60)) for s, n in (("a", 200), ("b", 50), ("c", 7)) for _ in range(n)])
    want = targets(spark, [("m", "a", 0.6, 1), ("m", "b", 0.4, 3), ("n", "c", 0.5, 2), ("n", "zz", 0.5, 2), ("o", "zz", 1.0, 2)])
    drawn, plan = M.draw(docs, want)
    told = {(x.mix_name, x.source): x for x in M.certify(drawn, want, plan).collect()}
    assert len(told) == 5 and all(x.share_met and x.repeats_kept and x.mix_exhausted for x in told.values()) and told["m", "a"].n_available == 200 and told["n", "zz"].n_available == 0
    fewer = {(x.mix_name, x.source): x for x in M.certify(drawn.where("source <> 'b' or doc_id % 2 = 0"), want, plan).collect()}
    assert not fewer["m", "b"].share_met


def test_no_documents(spark):
    drawn, _ = M.draw(corpus(spark, [("a", 3)]).limit(0), targets(spark, [("m", "a", 1.0, 1)]))
    assert drawn.count() == 0 and M.shares(drawn, targets(spark, [("m", "a", 1.0, 1)])).first().actual_share == 0.0


# --- repetition ---


def brute(text, n=8):
    w = re.findall(r"\w+", (text or "").lower())
    seen, mark = set(), [0] * len(w)
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            mark[i : i + n] = [1] * n
        seen.add(g)
    return sum(mark) / len(w) if w else 0.0


def texts(n, seed=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", "  \n", "a b c", "a " * 500, "one two three four five six seven eight " * 2]
    for _ in range(n):
        base = [r.choice(words) for _ in range(r.randint(5, 120))]
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(base))
            base += base[i : i + r.randint(1, 60)]
        out.append(" ".join(base).upper() if r.random() < 0.2 else "\n".join(base))
    return out


def test_shares_as_brute_force(spark):
    ts = texts(400)
    df = spark.createDataFrame([(i, t, "s", "") for i, t in enumerate(ts)], DOC)
    got = {r.doc_id: r for r in R.repeated_shares(df).collect()}
    assert all(got[i].repeated_share == pytest.approx(brute(t)) for i, t in enumerate(ts))
    assert all(got[i].repeated_share <= got[i].four_share + 1e-12 <= got[i].word_share + 2e-12 for i in got)


@pytest.mark.parametrize("sample", [5, 300])
def test_trees_lose_nothing(spark, sample):
    ts = texts(600, 9)
    df = spark.createDataFrame([(i, t, "s", "") for i, t in enumerate(ts)], DOC)
    got = {r.doc_id for r in R.repetitive(df, sample=sample).collect()}
    assert got == {i for i, t in enumerate(ts) if brute(t) >= R.SHARE}
    assert R.repetitive(df.limit(0)).count() == 0


def test_forest_is_monotonic_and_bounded():
    r = np.random.default_rng(0)
    x = r.random((1500, 3))
    y = ((x[:, 0] + 0.3 * x[:, 1] + 0.2 * r.random(1500)) > 0.7).astype(float)
    f = trees.fit(x, y, np.array([1, 1, 0]))
    p = f.score(x)
    assert ((p > 0) == (y > 0.5)).mean() > 0.9
    for j in (0, 1):
        z = x.copy()
        z[:, j] += 0.2
        assert (f.score(z) >= p - 1e-9).all()
    low = np.array([0.5, 0.4, 0.0])
    assert f.score(np.maximum(x, low)).min() >= f.lowest(low, np.ones(3) * 2) - 1e-9
    # held-out accuracy on rows of the same rule
    h = r.random((800, 3))
    assert (((f.score(h) > 0) == ((h[:, 0] + 0.3 * h[:, 1] + 0.1) > 0.7)).mean()) > 0.88
    empty = trees.fit(np.zeros((0, 3)), np.zeros(0), np.array([1, 1, 0]))
    assert empty.score(x).shape == (1500,)


def test_repeats_in_a_hash_table():
    r = np.random.default_rng(1)
    for n, most in ((0, 1), (1, 1), (5000, 700), (5000, 3), (3000, 1 << 62)):
        keys = r.integers(0, most, n).astype(np.uint64)
        seen, want = set(), []
        for k in keys.tolist():
            want.append(k in seen)
            seen.add(k)
        assert R._again(keys).tolist() == want


def test_sql(spark, sf):
    from slabworks.llm import queries
    from tests.oracle import connect, differences

    for name, sql in queries.ORACLES.items():
        assert differences(spark, connect(sf), name, queries.QUERIES[name], sql, sf) == "", name


def test_encoder_is_kept_per_process():
    assert B.encoder(B.vocabulary()) is B.encoder(B.vocabulary()) and "_slabworks_kept" in sys.modules
