"""Operators that relate texts to each other, against plain Python, with odd rows and hot groups."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import decontaminate, linededup, mixing, neardup
from helixframe.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD)) if w]


def test_decontamination_equals_brute_force(spark):
    r = random.Random(1)
    voc = ["The", "of", "é-x", "Cat", "d0g", "SAT", "on", "mat."]
    make = lambda n: " ".join(r.choice(voc) for _ in range(n))
    items = [(0, make(20)), (1, make(15)), (2, "short item here"), (3, "of"), (4, None), (5, " .. "), (None, make(14)), (1, make(13))]
    items.append((6, items[0][1]))
    docs = [(i, make(r.randrange(0, 60))) for i in range(40)] + [(90, None), (91, "")]
    docs += [(50 + i, f"{make(20)} {items[i % 2][1].upper()} {make(5)}") for i in range(12)] + [(70, "see SHORT; item, here"), (None, items[1][1]), (50, "other " + items[0][1])]
    docs += [docs[45]] * 3
    d = spark.createDataFrame([(*x, 1, True) for x in docs], "doc_id bigint, text string, n_words int, key boolean")
    b = spark.createDataFrame([(*x, 2) for x in items], "item_id bigint, text string, words int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.contained(d, b).collect())
    want = []
    for i, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for item, t in items:
            v = plain_words(t)
            size = min(13, len(v))
            windows = {tuple(v[k:k + size]) for k in range(len(v) - size + 1)} if v else set()
            for k in range(len(w) - size + 1):
                if v and item is not None and tuple(w[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found.add(str(item))
        want.append((i is None, i or 0, len(w), len(hit), ",".join(sorted(found))))
    assert got == sorted(want)
    assert all(x[3] == 0 for x in (tuple(r) for r in decontaminate.contained(d, b.limit(0)).select("doc_id", "key", "n_words", "n_hit").collect()))
    assert decontaminate.contained(d.limit(0), b).count() == 0


def one_edit(a, b):
    if a == b:
        return True
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return abs(len(a) - len(b)) <= 1 and (a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:])


@pytest.mark.parametrize("block", [4, 8, 256])
def test_line_dedup_equals_brute_force(spark, block):
    r = random.Random(block)
    lines = []
    for _ in range(30):
        lines.append("".join(r.choice("abä") for _ in range(r.choice([4, 8, 9, 10, 15, 16, 17, 31, 33]))))
        for _ in range(3):
            x, p = list(r.choice(lines)), 0
            p = r.randrange(len(x))
            kind = r.randrange(3)
            x[p:p + (kind > 0)] = [] if kind == 1 and len(x) > 2 else [r.choice("abc")]
            lines.append("".join(x))
    docs = [(i, "\n".join(r.choice(lines) for _ in range(6)), 5) for i in range(25)]
    docs += [(None, docs[3][1], 5), docs[5], (40, None, None), (41, "", 1), (42, "x" * 3000 + "y", 0), (43, "x" * 3001 + "y", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lines int")
    got = sorted((x.row.doc_id is None, x.row.doc_id or 0, x.text or "", x.n_lines, x.n_dropped, x.row["lines"] or 0) for x in linededup.dedup_lines(d, block, 4).collect())
    place = lambda i, p: (i is None, i or 0, p)
    every = [(place(i, p), x) for i, t, _ in docs if t is not None for p, x in enumerate(t.split("\n")) if len(x) >= 4]
    want = []
    for i, t, c in docs:
        rows = [] if t is None else t.split("\n")
        keep = [x for p, x in enumerate(rows) if len(x) < 4 or not any(o < place(i, p) and one_edit(x, y) for o, y in every)]
        want.append((i is None, i or 0, "\n".join(keep), len(rows), len(rows) - len(keep), c or 0))
    assert got == sorted(want) and sum(x[4] for x in got) > 50


def test_equal_lines_of_every_length_go(spark):
    long = "A line of more than forty code points, as it stands here."
    docs = [(0, f"Les.\n\n{long}\nLes.\n \nx"), (1, f"Les.\n\n \nLes!\nx\n{long}!\n{' ' * 50}\ny"), (2, f"y\nLes.\n\n{' ' * 50}"), (3, "Les."), (4, None), (5, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x.row.doc_id: (x.text, x.n_lines, x.n_dropped) for x in linededup.dedup_lines(d).collect()}
    assert got == {0: (f"Les.\n\n{long}\n \nx", 6, 1), 1: (f"\n \nLes!\n{' ' * 50}\ny", 8, 3), 2: ("", 4, 3), 3: ("", 1, 1), 4: (None, 0, 0), 5: ("", 1, 0)}
    kept = {x.row.doc_id: x.n_dropped for x in linededup.dedup_lines(d, least=40).collect()}
    assert kept == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(300)] + [(r.randrange(500, 900), r.randrange(500, 900)) for _ in range(300)] + [(7, 7), (None, 3), (2, 1)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in edges:
        if u is not None:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if x in got} and {x for x in root if find(x) != x} <= set(got)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def plain_classes(docs, size, percent):
    sets, root = [], list(range(len(docs)))
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            root[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            best[find(i)] = min(best.get(find(i), doc_id), doc_id)
    return sorted((d is None, d or 0, len(s), best.get(find(i), -1) if s else -1 if d is None else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


@pytest.mark.parametrize(("size", "percent", "depth", "nodes"), [(3, 85, 4, 1024), (5, 80, 3, 1024), (3, 85, 4, 20)])
def test_near_classes_equal_brute_force(spark, monkeypatch, size, percent, depth, nodes):
    """A hot family of near copies around the threshold, copies, short and odd texts; also with clusters in blocks."""
    monkeypatch.setattr(neardup, "BLOCK_NODES", nodes)
    r = random.Random(size * nodes)
    voc = [f"W{i}" for i in range(400)]
    docs = []
    for family, many in ((0, 90), (1, 20), (2, 5), (3, 3)):
        base = [r.choice(voc) for _ in range(120 + family)]
        for _ in range(many):
            w = list(base)
            for _ in range(r.randrange(8)):
                w[r.randrange(len(w))] = r.choice(voc)
            docs.append(" ".join(w))
    docs += [docs[0]] * 20 + ["a", "A", "a b", "b a", "a b c", None, "", " \n", "x " * 4000, "x " * 3999 + "y"] + [" ".join(r.choice(voc) for _ in range(50)) for _ in range(60)]
    r.shuffle(docs)
    docs = list(enumerate(docs)) + [(None, docs[4]), (None, "alone in the world"), (17, docs[17])]
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id bigint, text string, node string")
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_shingles, -1 if x.component_id is None else x.component_id) for x in neardup.near_classes(d, size, percent, depth=depth).collect())
    assert got == plain_classes(docs, size, percent)
    assert neardup.near_classes(d.limit(0), size, percent).count() == 0


def test_one_row_of_each_class_stays(spark):
    text = lambda word: " ".join(f"{word}{i}" for i in range(60))
    a, b, c, d = (text(w) for w in "abcd")
    docs = [(1, a), (1, a), (1, a + " end"), (2, a), (None, a), (None, b), (None, b), (None, b + " end"), (3, c), (3, d), (None, None), (None, None), (4, None), (4, ""), (5, "")]
    kept = neardup.keep_first(spark, spark.createDataFrame([(*x, 7) for x in docs], "doc_id bigint, text string, key int"), "")
    assert kept.columns == ["doc_id", "text", "key"]
    got = Counter((x.doc_id, x.text and x.text[0]) for x in kept.collect())
    assert got == Counter([(1, "a"), (None, "b"), (3, "c"), (3, "d"), (None, None), (4, None), (4, ""), (5, "")])


def test_mixing_fills_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("other", "en", "d", 100)], "domain string, language string, origin string, tokens bigint")
    get = lambda total: {r.origin: r.goal for r in mixing.budgets(leaves, F.lit(float(total)), {"web": 0.5, "other": 0.5}, {"en": 0.5, "de": 0.5}, 0.1, 1).collect()}
    assert get(160) == {"a": 10, "b": 30, "c": 40, "d": 80}  # a's shortage goes to its sibling b
    assert get(400) == {"a": 10, "b": 140, "c": 150, "d": 100}  # d is full: its shortage goes to the other domain
    assert get(10_000) == {"a": 10, "b": 1000, "c": 1000, "d": 100}


def test_mixing_takes_prefixes_of_epochs(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randrange(0, 30), r.choice(["en", "de", None]), r.choice(["src1", "src1", "src13", None]), i, "s") for i in range(600)] + [(None, "a b", "en", "src1", 0, "s"), (1, None, "en", "src1", 0, "s")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, domain string")
    wide = mixing.mix(d, share=0.9, bucket=10).collect()
    flat = mixing.mix(d, share=0.9, bucket=10_000).collect()
    key = lambda rows: Counter((x.row.doc_id, x.epoch) for x in rows)
    assert key(wide) == key(flat) and max(key(wide).values()) <= 2
    have = Counter()
    for _, t, lang, source, *_ in rows:
        have[(lang, source)] += len((t or "").split())
    got = Counter()
    for x in wide:
        assert x.n_tokens == len(x.row.text.split()) > 0
        got[(x.row.lang, x.row.source)] += x.n_tokens
    assert all(got[k] <= 2 * have[k] for k in got) and abs(sum(got.values()) - 0.9 * sum(have.values())) < 30 * len(have)
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mix_sources(spark, d, "").columns == ["doc_id", "text", "lang", "source", "n_chars", "epoch"]


def test_mixing_spreads_documents_without_ids(spark):
    """A leaf of documents without ids is cut into buckets like any other; the choice does not depend on their size."""
    rows = [(None, f"text number {i} " + "w " * (i % 5), "en", "src1", 0) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    chosen = [Counter((x.row.text, x.epoch) for x in mixing.mix(d, share=0.5, bucket=b).collect()) for b in (10, 10_000)]
    assert chosen[0] == chosen[1] and 1000 < sum(chosen[0].values()) < 2000


def test_line_dedup_of_an_empty_table(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint")
    assert linededup.dedup_lines(d).count() == 0 and linededup.drop_lines(spark, d, "").columns == d.columns


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["river", "stone", "house", "green"]) + str(r.randrange(50)) for _ in range(40)), "en", f"src{i % 3}", 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/some/benchmark.parquet")
    assert 0 < corpus_pipeline.run(spark, f"{tmp_path}/some").count() <= 120


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    r = random.Random(5)
    voc = {"en": "the house stands near a green river and many small boats pass".split(), "de": "das kleine haus steht nahe einem fluss und viele boote ziehen".split()}
    text = lambda lang, n=40: " ".join(r.choice(voc[lang]) + str(r.randrange(9)) * (k % 5 == 0) for k in range(n))
    rows = [(i, text(lang), lang, f"src{i % 5}", 0) for i, lang in enumerate(["en", "de"] * 60)]
    item = "zeta alpha quick brown foxes jump over lazy dogs while nine owls watch quietly"
    line = "This very long boiler plate line stands in several documents unchanged."
    rows[0] = (0, text("en", 120), "en", "src0", 0)
    rows += [(199, rows[2][1], "en", "src1", 0), (200, rows[0][1] + " at last", "en", "src1", 0), (201, text("en", 20) + " " + item, "en", "src1", 0), (202, "1234 5678", "en", "src1", 0)]
    rows += [(210 + i, line.replace("very", "verz") + "\n" + text("en") if i == 2 else line + "\n" + text("en"), "en", "src2", 0) for i in range(4)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).toPandas().astype({"doc_id": "int64"}))
        seen[name] = {x.doc_id: x.text for x in docs.collect()}
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(x[0] for x in rows) - set(seen["language_id"]) == {202}
    assert [line in seen["line_dedup"][210 + i] for i in range(4)] == [True, False, False, False] and "verz" not in seen["line_dedup"][212]
    assert set(seen["language_id"]) - set(seen["line_dedup"]) == {199}
    assert set(seen["line_dedup"]) - set(seen["minhash_neardup"]) == {200}
    assert set(seen["minhash_neardup"]) - set(seen["decontamination"]) == {201}
    assert set(seen["source_mix"]) < set(seen["decontamination"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
