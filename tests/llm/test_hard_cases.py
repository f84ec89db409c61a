"""Hard cases of the operators: clashing columns, very long texts, hot keys, short items, far ranges, plain versions of scores."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from skyloom.llm import decontaminate, embeddings, licenses, lines, lm, mixing, repeats, simhash, toxicity
from skyloom.llm.components import components
from skyloom.llm.queries import ORACLES, QUERIES
from tests.llm.test_llm import prose

DATA = "/root/testdata"


def test_operators_leave_other_columns_alone(spark):
    names = ["part", "whole", "threshold", "h", "budget", "key", "drops", "overlaps_", "th", "did", "fold", "label", "pos", "w", "capped", "level"]
    rows = [(i, f"mit license you fool {prose(random.Random(i % 3), 40)}\nthe same line here\n{i}", ("a", "b", None)[i % 3], *range(i, i + len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    bench = spark.createDataFrame([(1, prose(random.Random(1), 20))], "item_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    found = [mixing.mix(docs), lines.drop_repeated_lines(docs), licenses.scan_licenses(docs), decontaminate.add_overlaps(docs, bench), toxicity.score_toxicity(docs, marks)]
    for out in found:
        assert sorted(map(tuple, out.select("doc_id", *names).collect())) == sorted((r[0], *r[3:]) for r in rows)


def test_licenses_are_brute_force():
    finder = licenses.NoticeFinder(licenses.BASE, licenses.FUZZY)
    rng = random.Random(5)
    pool = [*"mit license apache general public free software under the of a gnu licence".split(), "é", "MIT", "License,", "general-public"]
    for _ in range(300):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, n.label) for n in licenses.BASE for i in range(len(words)) if words[i : i + len(n.words.split())] == n.words.split()]
        r = finder.scan(text.encode())
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_fuzzy_notices_are_brute_force():
    """Every notice with few enough edits somewhere is found, none else."""
    finder = licenses.NoticeFinder((), licenses.FUZZY)
    rng = random.Random(8)
    for _ in range(150):
        notice = rng.choice(licenses.FUZZY)
        data = list(notice.words)
        for _ in range(rng.randrange(notice.errors + 4)):
            at, kind = rng.randrange(len(data)), rng.randrange(3)
            data[at : at + (kind != 1)] = [] if kind == 0 else ["q"]
        text = f"{prose(rng, 5)} {''.join(data)} {prose(rng, 5)}".encode()
        plain = b" " + b" ".join(text.translate(licenses.FOLD).split()) + b" "
        want = {n.label for n in licenses.FUZZY if regex.search(rb"(?<= )(?:" + regex.escape(n.words.encode()) + rb"){e<=%d}(?= )" % n.errors, plain)}
        assert set(filter(None, finder.scan(text)["labels"].split(","))) == want


def test_close_notices_are_all_found():
    finder = licenses.NoticeFinder((), licenses.FUZZY)
    spans = finder.scan(b"released under the mit licence released under the mit license")["spans"]
    assert [(s["first_word"], s["errors"]) for s in spans if s["label"] == "mit-notice"] == [(0, 1), (5, 0)]


def test_long_texts_of_notices_take_linear_work():
    import time

    finder = licenses.NoticeFinder(licenses.BASE, licenses.FUZZY)
    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        assert finder.scan(b"mit license x " * n)["n_base"] == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


def widest(length: int) -> int:
    """The most equal words of a stretch of that length, equal at both ends, that keeps none of the masks whole."""
    masks = [(len(m), int(m, 2)) for m in decontaminate.MASKS]
    best = {1: 1}  # the last six words as bits -> equal words
    for i in range(1, length):
        now = {}
        for bits, n in best.items():
            for word in (1,) if i == length - 1 else (0, 1):
                new = (bits << 1 | word) & 63
                if not any(i + 1 >= size and new & mask == mask for size, mask in masks):
                    now[new] = max(now.get(new, 0), n + word)
        best = now
    return max(best.values(), default=0)


def test_masks_hold_for_every_length():
    assert all(widest(n) < 0.8 * n for n in range(12, 400))


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_items_of_every_length(spark, block):
    """Items of 1 to 40 words, whole and with a fifth of the inner words changed, against a plain version."""
    rng = random.Random(block)
    items, docs = [], []
    for n in range(1, 41):
        words = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for copy in range(4):
            w, changes = list(words), int(0.2 * n + 1e-9) if copy else 0
            for at in rng.sample(range(1, n - 1), min(changes + (copy == 3), max(n - 2, 0))):
                w[at] = f"new{rng.randrange(10**6)}"
            docs.append(((n - 1) * 4 + copy, " ".join([*(f"x{rng.randrange(99)}" for _ in range(rng.randrange(9))), *w, "y"])))
    got = {(r["doc_id"], h["item_id"]) for r in decontaminate.add_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block).collect() for h in r["overlaps"]}
    want = set()
    for d, text in docs:
        mine, (n, item) = text.split(), items[d // 4]
        theirs = item.split()
        for shift in range(-len(theirs) + 1, len(mine)):
            at = [i for i, w in enumerate(theirs) if 0 <= i + shift < len(mine) and mine[i + shift] == w]
            if any(q - p >= 0 and at[q] - at[p] + 1 >= min(12, n) and q - p + 1 >= 0.8 * (at[q] - at[p] + 1) for p in range(len(at)) for q in range(p, len(at))):
                want.add((d, n))
    assert got == want and {d for d, _ in want} >= set(range(0, 160, 4)) | set(range(1, 160, 4))


def test_texts_that_repeat_themselves(spark):
    """One word many times: seeds meet all over, spans start at every byte."""
    docs = spark.createDataFrame([(1, "a " * 30_000), (2, "a " * 20 + "b"), (3, "c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a " * 300), (2, "c")], "item_id long, text string")
    got = {r["doc_id"]: [(h["item_id"], h["words"]) for h in r["overlaps"]] for r in decontaminate.add_overlaps(docs, bench).collect()}
    assert got == {1: [(1, 300)], 2: [(1, 20)], 3: [(2, 1)]}
    out = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(docs).collect()}
    assert out == {1: (60_000, 1), 2: (0, 0), 3: (0, 0)}


def test_long_texts_are_sampled_in_pieces(spark):
    rng = random.Random(4)
    long = prose(rng, 2500)
    long = re.sub("[^a-z0-9 ]", "e", long)
    texts = [long[:3000] + long[5000:9000] + "end", long, "x" + long[4000:4500]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = [np.zeros(len(t), bool) for t in texts]
    seen: dict[str, list] = {}
    for d, t in enumerate(texts):
        for p in range(len(t) - 399):
            seen.setdefault(t[p : p + 400], []).append((d, p))
    for places in seen.values():
        for d, p in places if len(places) > 1 else ():
            gone[d][p : p + 400] = True
    old = repeats.PIECE
    for piece in (1000, old):
        found = [list(repeats.sampled([t.encode() for t in texts], 400, 64, piece))]
        assert all(f["lo"].max(initial=0) <= 20_000 for x in found for _, f in x)
    rows = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs).collect()}
    assert rows == {d: int(g.sum()) for d, g in enumerate(gone)}
    pieces, whole = ({(first + int(r), int(x), w) for first, f in repeats.sampled([t.encode() for t in texts], 400, 64, most) for r, x, lo, hi in zip(f["row"], f["x"], f["lo"], f["hi"], strict=True) for w in range(lo, hi + 1)} for most in (1000, old))
    assert pieces == whole


@pytest.mark.parametrize("crowd", [1000, 5])
def test_passages_of_over_50_words_go_from_400_bytes(spark, crowd):
    """One passage in twenty documents, whose neighbours there all differ: bytes decide, not words."""
    rng = random.Random(6)
    rows = []
    for size in (399, 400, 401):
        words = [f"{rng.randrange(10**6):06d}" for _ in range(56)]
        passage = f" {' '.join(words)} ".ljust(size - 1, "x") + " "
        assert len(passage) == size and len(passage.split()) > 50
        rows += [(size * 100 + k, prose(rng, 20) + chr(65 + k) + passage + chr(65 + k) + prose(rng, 20)) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(docs, crowd=crowd).collect()}
    assert got == {d: (d // 100, 1) if d >= 40_000 else (0, 0) for d, _ in rows}


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="no test tables")
def test_repeats_of_a_table_are_brute_force(spark):
    """Lengths and hashes over all documents of a table."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    first: dict[bytes, tuple] = {}
    gone = {d: np.zeros(len(t) + 1, np.int64) for d, t in raw.items()}
    for d, t in raw.items():
        for p in range(len(t) - 399):
            key = hashlib.blake2b(t[p : p + 400], digest_size=12).digest()
            other = first.setdefault(key, (d, p))
            if other != (d, p):
                for e, q in ((d, p), other):
                    gone[e][q] += 1
                    gone[e][q + 400 if q + 400 < len(gone[e]) else -1] -= 1
    got = {r["doc_id"]: (r["n_removed"], r["sha"]) for r in repeats.remove_repeats(docs).select("doc_id", "n_removed", F.sha2("kept", 256).alias("sha")).collect()}
    for d, t in raw.items():
        cover = np.cumsum(gone[d])[: len(t)] > 0
        assert got[d] == (int(cover.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~cover].tobytes()).hexdigest())


def test_a_line_in_every_document(spark):
    docs = spark.range(6000).select((F.col("id") + 5).alias("doc_id"), F.concat(F.lit("A line that all hold\n"), F.concat(F.lit("own line number "), "id"), F.lit("\nA line that all hold \nshort")).alias("text"))
    out = lines.drop_repeated_lines(docs)
    assert out.groupBy("n_dropped").count().orderBy("n_dropped").collect() == [(0, 1), (2, 5999)]
    assert out.where("doc_id = 5").first()["n_dropped"] == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("skyloom_run")]


def test_texts_of_many_lines(spark):
    many = "\n".join(f"line number {i} of many" for i in range(100_000))
    docs = spark.createDataFrame([(1, many), (2, many + "\nand a last one"), (2, "line number 7 of many\nelse here it is")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], len(r["text"])) for r in lines.drop_repeated_lines(docs).collect())
    assert got == [(1, 100_000, 0, len(many)), (2, 2, 1, 15), (2, 100_001, 100_000, 14)]


def test_vectors_of_any_size(spark):
    rows = [(1, [1e200, 0.0]), (2, [1.0, 0.0]), (3, [1e-200, 1e-202]), (4, [3e300, 4e300]), (5, [0.3, 0.4]), (6, [1 / 3, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (1, 4), 5: (1, 4), 6: (3, 1)}


def test_a_hub_of_many_edges(spark):
    edges = spark.range(1, 200_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    out = components(edges)
    assert out.count() == 200_000 and out.where("component <> 0").count() == 0


def plain_log10(net: lm.Network, vocab: lm.Vocabulary, counts: dict[bytes, int], text: bytes) -> float:
    """The log10 probability of a text, token by token."""
    p, h, last, total = {k: v.astype(float) for k, v in net.p.items()}, np.zeros(net.hidden), 0, 0.0
    n = net.hidden
    for word in [*text.lower().split(), lm.END]:
        a = p["x"][last]
        z, r = (1 / (1 + np.exp(-(a[i * n : (i + 1) * n] + h @ p["u"][:, i * n : (i + 1) * n]))) for i in (0, 1))
        c = np.tanh(a[2 * n :] + (r * h) @ p["uc"])
        h = (1 - z) * h + z * c
        logits = h @ p["wc"] + p["bc"]
        groups = np.exp(logits - logits.max())
        rank = vocab.rank.get(word, -1)
        known = 0 <= rank < vocab.frequent
        group = rank // net.slots if known else net.classes
        prob = groups[group] / groups.sum()
        if known:
            inner = np.exp(h @ p["wo"][group] + p["bo"][group])
            prob *= inner[rank % net.slots] / inner.sum()
        else:
            prob *= (counts.get(word, 0) + 0.1) / vocab.rare_floor()
        total += math.log10(prob)
        last = rank if known else net.rare
    return total


def test_lm_scores_are_those_of_single_tokens(spark):
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)] + [None, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(lm.id_of("doc_id").alias("did"), (lm.crc_bucket("doc_id", 10) == 0).alias("held_out"), "text")
    train = rows.where("NOT held_out").select("did", "text")
    counts = lm.cut(lm.token_counts(train))
    for head in (lm.HEAD, 30):
        vocab = lm.head_of(counts, head)
        net = lm.trained(train, vocab, lm.ROUNDS, lm.PARTS)
        known = {bytes(r["word"]): r["c"] for r in counts.collect()}
        assert len(vocab.rank) <= head and vocab.rank[lm.END] == 0
        got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs, head=head).collect()}
        for i, t in enumerate(texts):
            assert abs(got[i] - plain_log10(net, vocab, known, (t or "").encode())) < 1e-2 + 1e-4 * len(t or "")


def test_long_words_are_counted_by_the_join(spark):
    docs = spark.createDataFrame([(i, "w" * 500 + " a b") for i in range(1, 30)], "doc_id long, text string")
    counts = lm.cut(lm.token_counts(docs.select(F.col("doc_id").alias("did"), "text")))
    assert max(map(len, lm.head_of(counts, 100).rank)) <= lm.LONGEST
    assert all(r["n_known"] == r["n_tokens"] == 4 for r in lm.score_documents(docs).collect())


def test_calibration_has_not_seen_its_labels(spark):
    """Labels by chance: with a lexicon learnt from all rows the calibration fold would look separable."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(rng, 30) + f" unique{i}") for i in range(600)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, rng.randrange(2)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert model.curve[1].max() - model.curve[1].min() < 0.8


def test_near_copies_of_other_similarities(spark):
    from tests.llm.test_llm import edited_texts, near_copy_roots

    texts = edited_texts(random.Random(77), 10, 3)
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(zip(ids, texts, strict=True), "doc_id long, text string")
    for similarity in (0.7, 0.9):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs, similarity=similarity).collect()}
        assert got == dict(zip(ids, near_copy_roots(ids, texts, similarity), strict=True))
    assert simhash.most_apart(0.9) < simhash.most_apart(0.8)


def test_rows_without_an_id_keep_one_of_a_group(spark):
    rng = random.Random(2)
    text, other = prose(rng, 80), prose(rng, 80)
    docs = spark.createDataFrame([(None, text), (None, text + " more"), (None, other), (4, other), (4, text + " x y"), (4, prose(rng, 50))], "doc_id long, text string")
    stays = simhash.near_copy_rows(docs).where("stays")
    assert stays.count() == 3 and stays.where("did = 4").count() == 3


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.sql(f"create view {t} as select * from '{DATA}/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    want = c.sql(ORACLES[name])
    assert want.columns == df.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_the_written_hash_is_the_hash():
    """Texts of every length up to 120 bytes through op5's SQL and its fingerprint."""
    import duckdb

    c = duckdb.connect()
    texts = ["x" * (n % 7) + "Yé"[: n % 3] + "abcdefghij" * (n // 10) + "z" * (n % 10) for n in range(120)] + [None, "", "two words", "A b c d"]
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    got = {d: f for d, f, _ in c.sql(ORACLES["op5_simhash_near_dedup"]).fetchall()}
    assert got == {i: f"{simhash.fingerprint((t or '').encode()):016x}" for i, t in enumerate(texts)}


@pytest.mark.parametrize("few", [10**6, 0])
def test_components_in_one_task_or_many(spark, few, monkeypatch):
    import skyloom.llm.components as C

    monkeypatch.setattr(C, "FEW_EDGES", few)
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {i: i for e in edges for i in e}
    for _ in range(70):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: r for i, r in root.items() if r != i}
