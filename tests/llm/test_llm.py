"""Operators for training data against brute force, on small tables with nulls, ties, repeats and empty texts."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skyloom.llm import decontaminate, embeddings, licenses, lines, lm, mixing, repeats, simhash, tokens, toxicity
from skyloom.llm.components import components

WORDS = "the of and ré naïve alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
DOCS = "doc_id long, text string, source string, text_2 int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    out = [(i, t, f"s{i % 3}", i) for i, t in enumerate(base)]
    near = base[3].split()
    near[1:1] = ["extra"]
    out += [(50, base[3], None, 1), (51, " ".join(near), "s1", 1), (52, None, "s1", 1), (53, "", "s2", 1), (None, base[7], "s0", None), (8, base[8], "s2", 8), (54, "same line of text\nshort\nsame line of text", "s0", 2), (55, "  SAME line of text\nother\n", "s0", 2)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_token_counts_equal_the_library():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    rng = random.Random(1)
    parts = [*"abstrevl' '\n\t !9é漢½<|>", "'s", "'ll", "'re", "  ", "<|endoftext|>"]
    texts = ["", "don't'stop 's", " \n a  b\n\n", "<|endoftext|> a", *("".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(500)), "x" * 3000]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.TokenCounter(path).count_batch(texts) == want


def test_token_state_maps_compose():
    rng = np.random.default_rng(2)
    classes = rng.integers(0, tokens.N_CLASSES - 1, 5000).astype(np.uint8)
    state, want = tokens.S_START, []
    for i, c in enumerate(classes):
        if tokens.MARK[state, c]:
            want.append(i)
        state = tokens.STEP[state, c]
    assert tokens.piece_marks(classes, 64).tolist() == want


def test_token_counts_of_rows(docs, empty):
    P = pytest.importorskip("public_tokenizers")
    out = tokens.count_tokens(docs.withColumn("n_tokens", F.lit(-1)), P.path("byte_bpe_50k.json"))
    assert out.count() == docs.count() and out.where("doc_id = 52").first()["n_tokens"] == 0
    assert tokens.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_licenses(spark, empty):
    finder = licenses.NoticeFinder(licenses.BASE, licenses.FUZZY)
    r = finder.scan("MIT License. Under the Apache-License; mit license GNU General Public License".encode())
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (4, 0, 9, "apache,gpl,mit", 1.0)
    assert finder.scan(b"submit license")["n_base"] == 0
    r = finder.scan(b"x y Permission is herby granted, free of charge, to any persn obtaining a copy of this software z")
    assert r["labels"] == "mit-notice" and r["n_base"] == 0 and 0 < r["score"] < 1 and r["spans"][0]["first_word"] == 2
    assert finder.scan(b"")["score"] == 0.0
    df = spark.createDataFrame([(1, None), (None, "mit license")], "doc_id long, text string")
    assert {x["n_base"] for x in licenses.scan_licenses(df).collect()} == {0, 1}
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(("length", "errors"), [(12, 2), (15, 3), (20, 4)])
def test_masks_survive_substitutions(length, errors):
    import itertools

    spots = [[sum(1 << (s + i) for i, c in enumerate(m) if c == "1") for s in range(length - len(m) + 1)] for m in decontaminate.MASKS]
    flat = [x for s in spots for x in s]
    assert all(any(not x & bad for x in flat) for bad in (sum(1 << i for i in c) for c in itertools.combinations(range(length), errors)))


def test_longest_overlap_is_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        e = rng.random(30) < 0.75
        best = max((j - i for i in range(30) for j in range(i + 1, 31) if e[i] and e[j - 1] and e[i:j].sum() >= 0.8 * (j - i) - 1e-9), default=0)
        assert decontaminate.longest_overlap(e, 0.8)[1] == best


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    item = prose(rng, 30)
    changed = item.split()
    for i in (4, 11, 19, 26):
        changed[i] = "changed"
    bench = spark.createDataFrame([(7, item), (8, None), (None, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b c " + " ".join(changed) + " d"), (2, prose(rng, 50)), (3, None), (4, re.sub('[a-z]', lambda m: m[0].upper(), item))], "doc_id long, text string")
    for block in (1_000_000, 5):
        got = {r["doc_id"]: [(h["item_id"], h["words"], h["equal"]) for h in r["overlaps"]] for r in decontaminate.add_overlaps(df, bench, block_words=block).collect()}
        assert got == {1: [(7, 30, 26)], 2: [], 3: [], 4: [(7, 30, 30)]}
    assert decontaminate.add_overlaps(empty, bench).count() == 0


@pytest.mark.parametrize("chunk", [2048, 4])
def test_embeddings(spark, chunk):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((3, 16))
    data = [(i, (centre[i % 3] + rng.standard_normal(16) * 0.09).tolist(), i % 2) for i in range(60)]
    data += [(100, data[0][1], 0), (101, None, 0), (102, [0.0] * 16, 0), (103, [float("nan")] * 16, 0), (104, data[0][1], None), (105, [1.0, 2.0], 0), (None, data[2][1], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    ids = [r[0] if r[0] is not None else (1 << 63) - 1 for r in data]
    links = {i: set() for i in ids}
    for a, (_, x, l1) in zip(ids, data, strict=True):
        for b, (_, y, l2) in zip(ids, data, strict=True):
            if a != b and l1 is not None and l1 == l2 and x and y and len(x) == len(y) and np.isfinite(x).all() and np.isfinite(y).all() and any(x) and any(y):
                u, v = np.array(x), np.array(y)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                    links[a].add(b)

    def least(a):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return min(seen)

    got = {r["vec_id"] if r["vec_id"] is not None else (1 << 63) - 1: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df, chunk=chunk).collect()}
    assert got == {a: (len(links[a]), least(a) if least(a) < (1 << 63) - 1 else None) for a in ids}


def brute_print(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    got = simhash.simhash_groups(docs).collect()
    prints = [brute_print(r[1]) for r in rows]
    ids = [r[0] if r[0] is not None else (1 << 63) - 1 for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min(i for i, x in zip(ids, group, strict=True) if x == g) for g in group}
    want = sorted((i, f"{p:016x}", least[g]) for i, p, g in zip(ids, prints, group, strict=True))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else (1 << 63) - 1, r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.simhash_groups(empty).count() == 0


def test_near_copies(spark, empty):
    rng = random.Random(11)
    texts = [prose(rng, 300) for _ in range(20)]
    edited = texts[0].split()
    edited[100] = edited[200] = "edit"
    df = spark.createDataFrame([*enumerate(texts), (90, texts[1]), (91, " ".join(edited)), (92, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert (got[90], got[91]) == (1, 0) and all(got[i] == i for i in range(20))
    assert simhash.near_copies(empty).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copy_roots(ids, texts, similarity=0.8):
    """Smallest id of each row's component, by comparing all pairs."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i, p in enumerate(sets):
        for j, q in enumerate(sets[:i]):
            if len(p & q) >= similarity * len(p | q):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return [min(ids[k] for k in range(len(ids)) if root[k] == r) for r in root]


def edited_texts(rng, bases, copies):
    """Texts and copies with 0 to 14 of 200 words changed, so on both sides of a similarity of 0.8."""
    out = []
    for _ in range(bases):
        words = prose(rng, 200).split()
        out.append(" ".join(words))
        for _ in range(copies):
            w = list(words)
            for at in rng.sample(range(200), rng.randrange(15)):
                w[at] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def test_near_copies_are_brute_force(spark):
    rng = random.Random(23)
    texts = [*edited_texts(rng, 15, 3), None, "", "Two words", "two  WORDS", "one"]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(zip(ids, texts, strict=True), "doc_id long, text string")).collect()}
    want = dict(zip(ids, near_copy_roots(ids, texts), strict=True))
    assert 20 < len(set(want.values())) < 60 and got == want


def test_near_copies_in_a_crowd_are_brute_force(spark):
    rng = random.Random(41)
    base = prose(rng, 200).split()
    texts = []
    for _ in range(120):  # a template: all meet, most below 0.8, and the true partner is any of them
        w = list(base)
        for at in rng.sample(range(5, 195), 4):
            w[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    for k in range(0, 120, 6):
        w = texts[k].split()
        w[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    ids = rng.sample(range(1000), len(texts))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(zip(ids, texts, strict=True), "doc_id long, text string")).collect()}
    want = dict(zip(ids, near_copy_roots(ids, texts), strict=True))
    assert 80 < len(set(want.values())) < 135 and got == want


def test_near_copies_with_passages_are_brute_force(spark):
    rng = random.Random(43)
    texts = []
    for k in range(40):
        words = prose(rng, 200).split()
        new = [f"new{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 60))]
        texts += [" ".join(words), " ".join(words + new if k % 2 else words[:80] + new[:16] + words[96:])]
    ids = rng.sample(range(1000), len(texts))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(zip(ids, texts, strict=True), "doc_id long, text string")).collect()}
    want = dict(zip(ids, near_copy_roots(ids, texts), strict=True))
    assert 40 < len(set(want.values())) < 75 and got == want


def test_language_model_learns_from_every_part(spark):
    vocab = lm.Vocabulary({w: i for i, w in enumerate([b"", b"one", b"two"])}, np.array([200, 400, 400]), 1000, 3)
    ids = spark.range(3000).select(F.col("id").alias("did"), F.lit("one two one two").alias("text"))
    fresh = lm.Network.fresh(vocab.counts[: vocab.frequent], vocab.rare_tokens).flat()
    last = ids.where(F.pmod(F.xxhash64("did"), F.lit(lm.PARTS)) == lm.PARTS - 1)
    assert last.count() and not np.array_equal(lm.trained(last, vocab, lm.ROUNDS, lm.PARTS).flat(), fresh)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (7, 7), (3, 4), (4, 5), (5, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 9: 8}


def test_toxicity(spark, empty):
    rng = random.Random(2)
    data = [(i, prose(rng, 60) + (" you idiot moron fool" if i % 4 == 0 else "")) for i in range(400)]
    df = spark.createDataFrame([*data, (900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, marks).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert 0 <= got[900]["score"] <= 1 and len(got) == 402
    assert toxicity.score_toxicity(empty, marks.limit(0)).count() == 0


def test_lm_gradients():
    rng = np.random.default_rng(0)
    net = lm.Network.fresh(np.arange(1024, 0, -1), 50.0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(1, 1025, (3, 4)), rng.integers(0, 1025, (3, 4))
    h = rng.standard_normal((4, net.hidden)) * 0.1

    def loss():
        now, total = h, 0.0
        for a, b in zip(x, y, strict=True):
            now = net.step(now, a)[0]
            total -= net.outputs(now, b).sum()
        return total / y.size

    grads = net.window(h, x, y)[1]
    for name in lm.NAMES:
        i = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        net.p[name][i] += 1e-5
        up = loss()
        net.p[name][i] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grads[name][i]) < 1e-2 * abs(grads[name][i]) + 1e-6, name
        net.p[name][i] += 1e-5


def test_lm_scores(spark, docs, rows, empty):
    import math
    import zlib
    from collections import Counter

    toks = [(t or "").lower().split() + [""] for _, t, *_ in rows]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0 for i, *_ in rows]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for t, h in zip(toks, held, strict=True))
    for head in (lm.HEAD, 20):
        got = lm.score_documents(docs, head=head).collect()
        assert sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_documents(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert [tuple(r) for r in sorted(got, key=str)] == [tuple(r) for r in sorted(mixing.mix(docs).collect(), key=str)]
    by = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2] += r["taken"]
        s[3] = max(s[3], r["size"])
    total = sum(s[0] for s in by.values())
    assert abs(sum(s[1] for s in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(t - taken) <= most and t <= 2 * size + 1e-9 for size, t, taken, most in by.values())
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("crowd", [1000, 0])
def test_repeats(spark, crowd, empty):
    rng = random.Random(3)
    shared = prose(rng, 12)
    data = [(i, prose(rng, 20) + shared + prose(rng, 20)) for i in range(6)] + [(7, "a" * 150), (8, None), (9, ""), (10, prose(rng, 30)), (10, "é" * 60), (None, shared + "tail")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    seen, length = {}, 40
    raw = [(t or "").encode() for _, t in data]
    for d, t in enumerate(raw):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((d, p))
    gone = [np.zeros(len(t), bool) for t in raw]
    for places in seen.values():
        for d, p in places if len(places) > 1 else ():
            gone[d][p : p + length] = True
    want = sorted((str(i), len(t), int(g.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest()) for (i, _), t, g in zip(data, raw, gone, strict=True))
    got = repeats.remove_repeats(df, length=length, seed=8, crowd=crowd).select("doc_id", "n_bytes", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == want
    assert repeats.remove_repeats(empty).count() == 0


def test_lines(docs, rows, empty):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    ids = [r[0] if r[0] is not None else (1 << 63) - 1 for r in rows]
    owner = {}
    for i, r in zip(ids, rows, strict=True):
        for x in (r[1] or "").split("\n"):
            owner[key(x)] = min(owner.get(key(x), i), i)
    want = []
    for i, r in zip(ids, rows, strict=True):
        have = (r[1] or "").split("\n")
        kept = [x for x in have if len(key(x)) < 10 or owner[key(x)] == i]
        want.append((i, len(have), len(have) - len(kept), "\n".join(kept)))
    for batches in (4, 7):
        got = lines.drop_repeated_lines(docs, batches=batches).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else (1 << 63) - 1, r["n_lines"], r["n_dropped"], r["text"] or "") for r in got) == sorted(want)
    assert lines.drop_repeated_lines(empty).count() == 0


def test_line_store_takes_any_order(spark):
    store = lines.LineStore(spark, fanout=2)
    for part in ([(1, 1, 9)], [(1, 1, 3), (2, 2, 4)], [(2, 2, 1), (3, 3, 5)], [(4, 4, 6)]):
        store.add(spark.createDataFrame(part, "h1 long, h2 long, did long"))
    assert {(r["h1"], r["owner"]) for r in store.owners().collect()} == {(1, 9), (2, 4), (3, 5), (4, 6)}
    assert len(store.runs) < 4
    store.drop()


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() <= 200 and set(corpus_pipeline.COLUMNS) < set(out.columns)
