"""Tokens against other libraries, mixtures against brute force, canonical forms against definition."""

import base64
import itertools
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm.bpe import PATTERN, ByteBpe, load
from graphloom.llm.canonical import canonical
from graphloom.llm.lookalike import canonical_texts, same_look_classes, same_look_pairs
from graphloom.llm.mixture import mix, sainte_lague, shard_quotas
from graphloom.llm.tokens import VOCABULARY, count_tokens, decode_corpus, encode_corpus

DOC = "doc_id bigint, text string, source string, ids string, form string, f1 bigint, shard int, times int"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, (sources or {}).get(i, "s"), "clash", "clash", 1, 1, 1) for i, t in texts], DOC)


@pytest.fixture(scope="module")
def bpe():
    return load(open(VOCABULARY, "rb").read())


@pytest.fixture(scope="module")
def other():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.text("ab <|endoftext|>'s\n1", max_size=200))
def test_same_ids_and_round_trip(bpe, other, text):
    ids = bpe.encode(text)
    assert ids == other.encode_ordinary(text)
    assert "".join(bpe.decode(ids)) == text


@pytest.mark.parametrize("unit,n", [("a", 20000), ("ab", 3000), (" ", 3000), ("=-", 2000), ("é", 2000), ("の", 2000), ("banana", 500), ("0123456789", 300)])
def test_long_pieces_stream(bpe, other, unit, n):
    assert bpe.encode(unit * n) == other.encode_ordinary(unit * n)


@settings(max_examples=60, deadline=None)
@given(st.text("abcdefgh", min_size=1, max_size=1500))
def test_transducer_is_the_merge_procedure(bpe, text):
    assert list(bpe.encode_stream(text.encode())) == list(bpe.merged(text.encode()))


def test_tiny_vocabulary_in_constant_memory():
    b = ByteBpe({b"a": 0, b"b": 1, b"ab": 2, b"aba": 3, b"bb": 4})
    seen = []
    it = b.encode_stream(iter(b"ab" * 5000 + b"a"))
    assert b.lookahead == 3 and b.merged(b"abab") == [2, 2]
    seen = list(it)
    assert b"".join(b.words[i] for i in seen) == b"ab" * 5000 + b"a"


def test_corpus_ids(spark, other):
    texts = [(1, None), (2, ""), (3, " "), (4, "<|endoftext|>"), (5, "x" * 5000), (6, "Zwei 👩‍💻"), (6, "again"), (None, "n")]
    got = {(r["doc_id"], tuple(r["ids"])) for r in encode_corpus(docs(spark, texts)).collect()}
    assert got == {(i, tuple(other.encode_ordinary(t or ""))) for i, t in texts}
    assert encode_corpus(docs(spark, texts).limit(0)).count() == 0


def naive(weights, seats, caps):
    out = [0] * len(weights)
    for _ in range(seats):
        free = [i for i, w in enumerate(weights) if w > 0 and out[i] < caps[i]]
        if not free:
            break
        out[min(free, key=lambda i: (-weights[i] / (2 * out[i] + 1), i))] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 60)), min_size=1, max_size=7), st.integers(0, 150))
def test_sainte_lague_is_highest_quotients(parties, seats):
    w, caps = [float(a) for a, _ in parties], [c for _, c in parties]
    assert sainte_lague(w, seats, caps) == naive(w, seats, caps)


def test_mixture(spark):
    n = {"big": 3000, "small": 40, "other": 400, "untargeted": 100}
    data = [(f"{s}{i}", s, 10 + i % 7) for s, k in n.items() for i in range(k)] + [("null", None, 5), ("zero", "big", 0)]
    ids = {k: i for i, (k, *_) in enumerate(data)}
    d = spark.createDataFrame([(ids[k], s, t, "clash") for k, s, t in data] * 2, "doc_id bigint, source string, n_tokens bigint, shard string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 4), ("other", 0.3, 2), ("absent", 0.1, 3), ("off", 0.0, 1), (None, 0.5, 1)], "source string, target_weight double, max_repeats int")
    chosen, report = mix(d, targets, block_tokens=16, shard_docs=500)
    rows, rep = chosen.collect(), {r["source"]: r for r in report.collect()}
    caps = {"big": 1, "small": 4, "other": 2}
    assert all(1 <= r["times"] <= caps[r["source"]] for r in rows) and len({r["doc_id"] for r in rows}) == len(rows)
    total = sum(r["times"] * r["n_tokens"] for r in rows)
    for s, w in (("big", 0.5), ("small", 0.2), ("other", 0.3)):
        got = sum(r["times"] * r["n_tokens"] for r in rows if r["source"] == s)
        assert abs(got / total - w) < 0.02 and rep[s]["tokens_used"] == got
    assert rep["small"]["most_repeats"] == 4 and rep["absent"]["tokens"] == 0 and rep["untargeted"]["tokens_used"] == 0 and rep[None]["n_docs"] == 1
    again = {(r["doc_id"], r["times"]) for r in mix(d, targets, block_tokens=16, shard_docs=500)[0].collect()}
    assert again == {(r["doc_id"], r["times"]) for r in rows}
    assert {(r["doc_id"]) for r in mix(d, targets, seed=7, block_tokens=16)[0].collect()} != {r["doc_id"] for r in rows}
    capped, _ = mix(d, targets, total_tokens=10**6, block_tokens=1)
    assert {r["times"] for r in capped.where("source = 'small'").collect()} == {4}
    assert mix(d.limit(0), targets)[0].count() == 0 and mix(d, targets.limit(0))[0].count() == 0


SAME = ["Test é", "Te\u0301st é".replace("e\u0301", "e"), "Т\u0435st é", "Test e\u0301", "Te\u200bst\u00a0é", "\uff34est\u3000é", "\ufeffTest\u2009é\u00ad", "Test é \n"]
DIFFERENT = ["test é", "Test e", "Tést é", "Test  é", "Test é!", "①", "1", "²", "2", "½", "1/2", "👩\u200d💻", "👩💻", "क्\u200dष", "क्ष", "ﬁ", "fi", "𝔘", "U", "a\nb", "a b", "—", "-", "’", "'"]


def test_look():
    assert len({canonical(t) for t in SAME}) == 1
    assert len({canonical(t) for t in DIFFERENT}) == len(DIFFERENT)
    assert canonical(None) is None and canonical("") == "" and canonical("\u200b") == ""
    assert canonical("각") == canonical("각") and canonical("ｶﾞ") == "ガ" and canonical("Å") == "Å" and canonical("µ") == "μ"
    assert canonical("a\r\nb\u2028c\x0bd") == "a\nb\nc\nd"


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=30) | st.text("aеé\u0301\u0323 \u200b\u200d👩💻가ᄀ\u1161\u11a8ｶﾞ\n\t", max_size=20))
def test_canonical_is_idempotent_and_composed(text):
    c = canonical(text)
    assert canonical(c) == c
    assert unicodedata.is_normalized("NFC", c)
    assert canonical(unicodedata.normalize("NFD", text)) == canonical(unicodedata.normalize("NFC", text))


def test_pairs_against_brute_force(spark):
    texts = list(enumerate([*SAME, *DIFFERENT, *SAME[:3], None, "", " ", "\u200b", "\u3000", "same", "same"])) + [(None, "Test é")]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations([t for t in texts if t[0] is not None], 2) if x is not None and y is not None and x != y and canonical(x) == canonical(y) and canonical(x).strip()}
    d = docs(spark, texts)
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in same_look_pairs(d.union(d.limit(5))).collect()} == want
    classes = {r["doc_id"]: (r["class_id"], r["text_id"]) for r in same_look_classes(d).collect()}
    assert {(a, b) for a, b in itertools.combinations(sorted(classes), 2) if classes[a][0] == classes[b][0] and classes[a][1] != classes[b][1]} == want
    assert same_look_pairs(d.limit(0)).count() == 0
    assert canonical_texts(d).where(F.col("text").isNull() & F.col("form").isNotNull()).count() == 0


def test_counts(spark):
    assert {(r["doc_id"], r["n_tokens"]) for r in count_tokens(docs(spark, [(1, None), (2, "Hello world")])).collect()} == {(1, 0), (2, 2)}


def test_copies_never_meet(spark):
    d = spark.range(20_000).selectExpr("id as doc_id", "case when id = 7 then 'T\u0435st' else 'Test' end as text")
    rows = same_look_pairs(d)
    assert rows.count() == 19_999 and rows.where("doc_id_a = 7 or doc_id_b = 7").count() == 19_999


def test_quotas_of_shards_are_highest_quotients(spark):
    import random

    r = random.Random(5)
    shards = [("s", i, r.randint(50, 400)) for i in range(40)] + [("t", i, 300) for i in range(7)]
    for blocks in (3, 57, 333):
        goals = spark.createDataFrame([("s", blocks, 9), ("t", blocks // 3, 9)], "source string, blocks bigint, repeats bigint")
        got = {(q["source"], q["shard"]): q["rounds"] * t + q["rest"] for q in shard_quotas(spark.createDataFrame(shards, "source string, shard int, t bigint"), goals, 8).collect() for s, i, t in shards if (s, i) == (q["source"], q["shard"])}
        for s, b in (("s", blocks), ("t", blocks // 3)):
            mine = [(i, t) for x, i, t in shards if x == s]
            assert [got[s, i] for i, _ in mine] == [8 * k for k in sainte_lague([float(t) for _, t in mine], b, [t * 9 // 8 for _, t in mine])]


def test_decoding_is_the_inverse(spark):
    texts = [(1, "Zwei \U0001f469\u200d\U0001f4bb"), (2, None), (3, ""), (4, "a" * 3000)]
    assert {tuple(r) for r in decode_corpus(encode_corpus(docs(spark, texts))).collect()} == {(i, t or "") for i, t in texts}
