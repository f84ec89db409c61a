"""Every stage of the corpus pipeline against a plain version of it, each on what its predecessor kept."""

import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skyloom.llm import toxicity
from tests.llm.test_llm import edited_texts, near_copy_roots, prose

NULL_ID = (1 << 63) - 1
BLANKS = " \t\n\x0b\x0c\r"
INSULTS = "idiot moron fool clown".split()


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def order(row):
    return tuple((x is None, 0 if x is None else x) for x in row)


def plain_toxicity(rows, model):
    return [r for r in rows if model.scores([(r["text"] or "").encode()])[0] < 0.5]


def plain_lines(rows):
    number = lambda r: NULL_ID if r["doc_id"] is None else r["doc_id"]
    key = lambda line: lowered(line.strip(BLANKS))
    owner = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), NULL_ID), number(r))
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), NULL_ID) >= number(r)]
        out.append(r if len(kept) == len(lines) else r | {"text": "\n".join(kept), "n_chars": len("\n".join(kept))})
    return out


def plain_near_copies(rows):
    ids = [NULL_ID if r["doc_id"] is None else r["doc_id"] for r in rows]
    return [r for r, i, root in zip(rows, ids, near_copy_roots(ids, [r["text"] for r in rows]), strict=True) if i == root]


def overlaps(mine, item):
    """Whether some stretch laid side by side is long enough, equal at both ends and at 80 % of its words."""
    for shift in range(-len(item) + 1, len(mine)):
        at = [i for i, w in enumerate(item) if 0 <= i + shift < len(mine) and mine[i + shift] == w]
        for p, low in enumerate(at):
            for q in range(p, len(at)):
                size = at[q] - low + 1
                if size >= min(12, len(item)) and q - p + 1 >= 0.8 * size:
                    return True
    return False


def plain_decontamination(rows, items):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", lowered(t))
    return [r for r in rows if not any(overlaps(words(r["text"]), words(t)) for i, t in items if i is not None and words(t))]


def plain_mix(rows):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r) for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    goal, free, left = {}, set(sources), 1.5 * sum(total.values())
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * total[s]}
        if not over:
            goal |= {s: share * weight[s] for s in free}
            break
        goal |= {s: 2.0 * total[s] for s in over}
        free, left = free - over, left - sum(2 * total[s] for s in over)
    spot = lambda r: xxhash.xxh64_intdigest(struct.pack("<q", NULL_ID if r["doc_id"] is None else r["doc_id"]), 42) & ((1 << 63) - 1)
    out = []
    for s in sources:
        own = [r for r in rows if r["source"] == s]
        whole = min(int(goal[s] // total[s]), 2) if total[s] else 0
        rest, extra = goal[s] - whole * total[s], set()
        for h in sorted({spot(r) for r in own}) if rest > 0 else []:
            words = sum(size(r) for r in own if spot(r) == h)
            if words > rest and 2 * rest < words:
                break
            extra.add(h)
            if words > rest:
                break
            rest -= words
        for r in own:
            copies = whole + (spot(r) in extra)
            if copies:
                out.append(r | {"size": size(r), "source_size": total[s], "target": goal[s], "copies": copies, "taken": copies * size(r)})
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    items = [(i, prose(rng, 20)) for i in range(3)] + [(7, "Seven words that stand here for good"), (8, None), (9, ""), (None, prose(rng, 20))]
    texts = edited_texts(rng, 8, 3) + [prose(rng, rng.randrange(5, 60)) for _ in range(60)]
    toxic = [f"{prose(rng, 15)} you {' '.join(rng.sample(INSULTS, 3))} {prose(rng, 15)}" for _ in range(40)]
    for k in range(3):
        words = items[k][1].split()
        words[6] = "changed"
        texts.append(f"{prose(rng, 20)} {' '.join(words)}\n{prose(rng, 20)}")
    texts += [f"{prose(rng, 20)} seven words, that stand here FOR good {prose(rng, 8)}", f"{prose(rng, 20)} seven words"]
    texts += [f"{prose(rng, 9)}\n A shared Line of text {i % 2}\t\nshort\n{prose(rng, 9)}" for i in range(6)]
    texts += [None, "", " \n ", "x" * 50_000]
    rows = [(i, t, "de", ("web", "books", None, "Code")[i % 4], len(t or ""), "e") for i, t in enumerate(texts + toxic)]
    rows += [rows[5], rows[30], (None, prose(rng, 30), None, None, None, None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    write("documents", rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
    write("benchmark", items, "item_id long, text string")
    write("labels", [(i, 1, int(i >= len(texts))) for i in range(len(texts) + len(toxic))] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return path, items, toxic


def test_stages_are_brute_force(spark, folder):
    path, items, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet"))
    plain = {"toxicity": lambda r: plain_toxicity(r, model), "line_dedup": plain_lines, "simhash_near_dedup": plain_near_copies, "benchmark_decontamination": lambda r: plain_decontamination(r, items), "source_mixing": plain_mix}
    rows = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        got = [r.asDict() for r in stage(spark, spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema), path).collect()]
        want = plain[name](rows)
        assert len(want) < len(rows) or name == "line_dedup"
        columns = list(want[0])
        for r in got + want:
            if "target" in r:
                r["target"] = round(r["target"], 6)
        assert sorted(([r[c] for c in columns] for r in got), key=order) == sorted(([r[c] for c in columns] for r in want), key=order), name
        if name == "toxicity":
            left = {r["text"] for r in got}
            assert not left & set(toxic) and len(got) == docs.count() - len(toxic)
        rows = want
    final = [r.asDict() | {"target": round(r["target"], 6)} for r in corpus_pipeline.run(spark, path).collect()]
    assert sorted(([r[c] for c in columns] for r in final), key=order) == sorted(([r[c] for c in columns] for r in rows), key=order)


def test_stages_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").select(*corpus_pipeline.COLUMNS).where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder[0])
        assert docs.count() == 0
