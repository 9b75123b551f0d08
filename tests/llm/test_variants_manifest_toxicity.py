"""Spelling variants, the Merkle manifest and toxicity against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from geoloom.llm import merkle, spelling, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, n long, word string, tree string, pos long, digest string, score double"
VOCAB = [f"{a}{b}{c}" for a in ("the", "tho", "ér", "con") for b in ("in", "on", "st") for c in ("ger", "gér", "en", "entia")]
INSULTS = ["blorgface", "wuzzbrain", "grimblenose"]


def typo(r, w):
    i, k = r.randrange(len(w)), r.randrange(3)
    return w[:i] + w[i + 1 :] if k == 0 else w[:i] + r.choice("abcé") + w[i:] if k == 1 else w[:i] + r.choice("xyzé") + w[i + 1 :]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = []
    for i in range(150):
        words = [r.choice(VOCAB) if r.random() < 0.8 else typo(r, r.choice(VOCAB)) for _ in range(r.randint(1, 60))]
        text = " ".join(w.upper() if r.random() < 0.1 else w for w in words)
        out.append((i, text, r.choice(["en", "fr", None, ""]), f"s{i % 3}" if i % 7 else None, len(text)))
    out += [(150, None, "en", "s0", None), (151, "", None, None, 0), (152, " \n", "xx", "s1", 2), (153, "12 ?? ×÷", "one", "s2", 8)]
    out.append((None, "lone null id thingers " * 4, "en", "s1", 1))
    out.append((None, "lone null id thingers " * 4, "en", "s1", 2))
    out.append((154, " ".join(r.choice(VOCAB) for _ in range(20_000)), "en", "s2", 9))
    out += [out[5], out[5]]  # repeated rows
    return [(*x, 7, "w", "t", 3, "d", 0.5) for x in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(5).cache()


# --- 11 ------------------------------------------------------------------------------------------------------


def brute_vocab(rows):
    count = Counter()
    for x in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", x[1] or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if x[0] is None else x[0]}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def brute_variants(vocab):
    near = {w: [v for v in vocab if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in vocab}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best and vocab[best] >= 2 * vocab[w] else None
    root = {}
    for w in vocab:
        end = w
        while form[end]:
            end = form[end]
        root[w] = end
    return {(w, form[w], root[w], n, len(near[w]), vocab.get(form[w])) for w, n in vocab.items()}


@pytest.mark.parametrize("halves", [25_000, 6])
def test_variants(docs, rows, halves):
    got = [tuple(r) for r in spelling.variants(docs, halves_per_shard=halves).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_variants(brute_vocab(rows))
    assert len(got) == len(set(got)) == len(want) > 100
    assert set(got) == want
    assert any(form and form != root for _, form, root, *_ in want)  # a chain of two steps


def test_variants_empty(docs):
    assert spelling.variants(docs.limit(0)).isEmpty()
    assert spelling.variants(docs.where("text is null or text = ''")).isEmpty()


def test_one_edit():
    r = random.Random(4)
    words = ["".join(r.choice("ab") for _ in range(r.randint(0, 6))) for _ in range(60)]
    for a in words:
        for b in words:
            assert spelling.one_edit(a, b) == (distance(a, b) == 1)


def test_shared_half_is_not_all_pairs():
    """Thousands of words of one half: each is compared with few of them."""
    rests = spelling.Rests()
    r = random.Random(5)
    words = {"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(20_000)}
    for w in words:
        rests.add(w, "th" + w)
    assert max(map(len, rests.by.values())) < 50


# --- 12 ------------------------------------------------------------------------------------------------------


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows):
    def leaf(r, text):
        values = (r[0], r[3], r[2], r[4], text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            a = i // 8 * 8
            out.append((level[a:i], level[i + 1 : a + 8]))
            i //= 8
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {k: tree([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in names}
    top = tree([trees[k][-1][0] for k in names])
    out = []
    for p, k in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            steps = path(trees[k], i) + path(top, p)
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None else None
            h = leaf(r, low) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            for left, right in steps:
                h = sha("".join(left) + h + "".join(right))
            out.append((r[0], own, trees[k][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in steps)), h, h == top[-1][0]))
    return out


def ordered(found):
    return sorted(map(repr, found))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(docs, rows, levels):
    got = [tuple(r) for r in merkle.manifest(docs, levels=levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    want = brute_manifest([r[:5] for r in rows])
    assert ordered(got) == ordered(want)
    assert {v[-1] for v in want} == {True, False}


def test_manifest_small(spark, docs, rows):
    assert merkle.manifest(docs.limit(0)).isEmpty()
    one = merkle.manifest(docs.where("doc_id = 150")).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("")
    for n in (8, 9, 65):  # full blocks, one over, and a last run of one
        some = [(i, f"Text {i}", "en", "s", 6) for i in range(n)]
        got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long"), levels=1).collect()]
        assert ordered(got) == ordered(brute_manifest(some))


# --- 13 ------------------------------------------------------------------------------------------------------


def made(seed, n, first=0):
    r = random.Random(seed)
    texts, labels = [], []
    for i in range(first, first + n):
        words = [r.choice(VOCAB) for _ in range(r.randint(3, 200))]
        toxic = r.random() < 0.3
        for _ in range(r.randint(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(INSULTS))
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic), "x"))
    return texts, labels


@pytest.fixture(scope="module")
def trained(spark):
    texts, labels = made(1, 800)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string"))


def test_toxicity(spark, trained, docs, rows):
    texts, labels = made(2, 400, 5000)
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(texts, "doc_id long, text string"), trained).collect()}
    assert sum(got[i].predicted == t for i, t, _ in labels) >= 390
    out = toxicity.score(docs, trained).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    empty = trained.score(None)
    assert trained.score("") == trained.score(" ?! ") == empty
    assert [r.score for r in out if r.doc_id in (150, 151, 152)] == [empty] * 3
    assert len({r.score for r in out if r.doc_id == 5}) == 1
    assert toxicity.score(docs.limit(0), trained).isEmpty()


def test_toxicity_misspelt_and_long(trained):
    r = random.Random(3)
    clean = [" ".join(r.choice(VOCAB) for _ in range(60)) for _ in range(100)]
    assert sum(trained.score(t) < 0.3 for t in clean) >= 98
    caught = 0
    for t in clean:
        words = t.split()
        for w in INSULTS:
            words.insert(r.randrange(len(words)), typo(r, w))
        caught += trained.score(" ".join(words)) >= 0.3
    assert caught >= 80  # none of these spellings was seen
    long = " ".join(r.choice(VOCAB) for _ in range(20_000))
    assert trained.score(long) < 0.3 <= trained.score(f"{long} {INSULTS[0]} {INSULTS[1]} {INSULTS[2]}")


def test_toxicity_parts(monkeypatch, trained):
    text = " ".join(made(4, 1)[0][0][1].split() * 20) + " 𝒳𝒴 ok"
    whole = trained.word_odds(text)
    monkeypatch.setattr(toxicity, "PART_CHARS", 50)
    assert np.allclose(trained.word_odds(text), whole) and len(whole) == len(re.findall(r"\w+", text))


def test_toxicity_plain_recount(trained):
    """Scores by loops over words, n-grams and passages."""
    text = made(5, 1)[0][0][1] + " Ab, c! " + INSULTS[0]
    odds = []
    for w in re.findall(r"[^\W_]+", text.lower()):
        bucket, owner = toxicity.grams(np.array([ord(c) for c in f" {w} "], np.uint64))
        assert len(bucket) == sum(max(len(w) + 2 - n + 1, 0) for n in toxicity.NGRAMS) and not owner.any()
        odds.append(trained.weight[bucket].mean())
    best = max(np.mean(odds[i : i + toxicity.PASSAGE]) for i in range(0, max(len(odds) - toxicity.PASSAGE // 2, 1), toxicity.PASSAGE // 2))
    assert trained.score(text) == pytest.approx(1 / (1 + np.exp(-best - trained.bias)))


def test_toxicity_labels(spark):
    docs = spark.createDataFrame([(1, "a word"), (3, "b word"), (3, "c"), (None, "d")], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    assert toxicity.train(docs, labels([])).score("x") == 0.0
    assert toxicity.train(docs, labels([(3, 1), (None, 0), (1, None)])).score("x") == 1.0
    assert toxicity.train(docs, labels([(1, 0), (3, 0)])).score("x") == 0.0
    both = toxicity.train(docs, labels([(1, 0), (3, 0), (3, 1)]))  # two labels: the larger
    assert 0 < both.score("x") < 1
    kept = [r.doc_id for r in toxicity.score(docs.selectExpr("cast(doc_id as string) doc_id", "text", "1 as score"), both).collect()]
    assert sorted(map(str, kept)) == ["1", "3", "3", "None"]
