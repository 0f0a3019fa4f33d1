"""Parity-sketch join, source divergence and filter interaction audit against plain Python."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import divergence, filteraudit, parityjoin

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x20\x09-\x0D]+"


def plain_links(docs, size, percent):
    """Of (id, text) rows: (id, set size, component, links), a row for each."""
    keyed = sorted({(d, t) for d, t in docs}, key=repr)
    sets = []
    for _, text in keyed:
        w = re.findall(WORD, (text or "").translate(FOLD))
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root, links = list(range(len(keyed))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(keyed)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            links.update((i, j))
            root[max(find(i), find(j))] = min(find(i), find(j))
    best = defaultdict(lambda: None)
    for i, (d, _) in enumerate(keyed):
        if d is not None:
            best[find(i)] = d if best[find(i)] is None else min(best[find(i)], d)
    place = {k: i for i, k in enumerate(keyed)}
    out = [(d, len(sets[i]), best[find(i)] if sets[i] else d, links[i]) for d, t in docs for i in [place[d, t]]]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("size", "percent", "group", "flush"), [(4, 85, 1024, 1 << 20), (5, 80, 16, 500), (3, 60, 8, 1 << 20)])
def test_links_equal_brute_force(spark, monkeypatch, size, percent, group, flush):
    """Families around the threshold of every size, one of them hot; copies, short, odd and repeated rows; small groups."""
    monkeypatch.setattr(parityjoin, "GROUP", group)
    monkeypatch.setattr(parityjoin, "FLUSH", flush)
    r = random.Random(size)
    voc = [f"W{i}" for i in range(500)]
    docs = []
    for length, many in ((150, 80), (40, 20), (300, 6), (12, 12), (9, 12), (700, 3), (20, 15)):
        base = [r.choice(voc) for _ in range(length)]
        for _ in range(many):
            w = list(base)
            for _ in range(r.randrange(1 + max(2, length // 15))):
                k = r.randrange(len(w))
                w[k:k + r.randrange(2)] = [r.choice(voc)] * r.randrange(1, 3)
            docs.append(" ".join(w))
    docs += [docs[0]] * 20 + ["a", "A", "a b", "b a", "a b c", "a b c d", None, "", " \n", "x " * 4000, "x " * 3999 + "y"]
    docs += [" ".join(r.choice(voc) for _ in range(r.randrange(5, 60))) for _ in range(60)]
    r.shuffle(docs)
    docs = list(enumerate(docs)) + [(None, docs[4]), (None, "alone in the world of words"), (17, docs[17]), (18, docs[4])]
    d = spark.createDataFrame([(*x, "n", 1) for x in docs], "doc_id bigint, text string, node string, n bigint")
    got = parityjoin.linked_classes(d, size, percent).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id, x.n_links) for x in got), key=repr) == plain_links(docs, size, percent)
    assert sum(x.n_links > 0 for x in got) > 60
    assert parityjoin.linked_classes(d.limit(0), size, percent).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 85, 95, 100])
def test_linked_sets_share_a_key(percent):
    """Every two sets at the threshold meet at a key, from the least sizes on."""
    rng = np.random.default_rng(percent)
    sets = []
    for n in [*range(1, 40), 60, 100, 250, 600]:
        for _ in range(30):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            b = a.copy()
            for _ in range(n):  # change or add while the link holds
                c = b.copy() if rng.random() < 0.5 else np.append(b, np.uint64(0))
                c[rng.integers(len(c))] = rng.integers(0, 1 << 62)
                c[-1] = c[-1] or np.uint64(rng.integers(0, 1 << 62))
                common = len(np.intersect1d(a, c))
                if 100 * common < percent * (len(a) + len(c) - common):
                    break
                b = c
            sets += [a, b]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    key, of = parityjoin.block_keys(np.concatenate(sets), row, len(sets), percent)
    keys = defaultdict(set)
    for k, i in zip(key.tolist(), of.tolist(), strict=True):
        keys[i].add(k)
    for i in range(0, len(sets), 2):
        assert set(sets[i].tolist()) == set(sets[i + 1].tolist()) or keys[i] & keys[i + 1], (percent, len(sets[i]))
    assert percent < 80 or len(key) < sum(map(len, sets)) + 40 * len(sets)


def test_folded_sketch_bounds_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        b = np.concatenate((a[:rng.integers(200)], rng.integers(0, 1 << 62, rng.integers(1, 90)).astype(np.uint64)))
        x, y = parityjoin.folded([a, b], 40)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_joint_traversal_equals_sum_over_cells():
    rng = np.random.default_rng(0)
    for _ in range(120):
        rows_a, rows_b, columns = (int(x) for x in rng.integers(1, 40, 3) * (1, 1, 6))
        zero = [rng.integers(1, 100, n) for n in (rows_a, rows_b)]
        full = [np.where(rng.random((n, columns)) < rng.choice([0, 0.02, 0.5]), rng.integers(1, 10 ** 9, (n, columns)), -1) for n in (rows_a, rows_b)]
        trees = [divergence.Square(*np.nonzero(m >= 0), m[m >= 0], 4) for m in full]
        a, b = (np.where(m < 0, z[:, None], m) for m, z in zip(full, zero, strict=True))
        want = divergence.gap(a[:, None, :], b[None, :, :]).sum(axis=2)
        assert (divergence.joint(*trees, *zero, columns) == want).all()


def plain_divergence(docs, least, top):
    docs = [tuple(x or "" for x in d) for d in docs]
    count, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(FOLD))
        count[lang, source].update(w)
        held[lang].update(set(w))
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in held[lang].items() if n >= least]
        groups = sorted(s for x, s in count if x == lang)
        v = len(kept)

        def shares(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        p = {s: shares(count[lang, s]) for s in groups}
        q = shares(sum((count[lang, s] for s in groups), Counter()))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-gap(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -x, k + 1) for k, (x, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("side", "columns"), [(256, 160), (3, 5)])
def test_divergence_equals_brute_force(spark, monkeypatch, side, columns):
    """Hot source, sources without terms, ties, odd rows; also with blocks of three groups and strips of five terms."""
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    r = random.Random(1)
    voc = [f"{a}{b}" for a in ("Tee", "ß", "éa", "zed", "Ab") for b in "abcdefghijkl"]
    docs = []
    for k in range(220):
        source = "hot" if k % 3 == 0 else f"s{r.randrange(8)}"
        own = voc[(k % 7) * 6:(k % 7) * 6 + 25]
        docs.append((k, " ".join(r.choice(own) for _ in range(r.randrange(30))) + "_" + r.choice(own) + "7x", r.choice(["en", "en", "de"]), source))
    docs += [(300, None, "en", "none"), (300, "", "en", "none"), (None, "Tee tee", None, None), (302, "12 34", "xx", "a"), (303, "", "xx", "b"), (304, "word", "yy", "alone"), docs[5], docs[5]]
    docs += [(400 + i, "Ärger " * 500 + "ärger", "long", "t" + str(i % 2)) for i in range(12)]
    d = spark.createDataFrame([(*x, 1, "p") for x in docs], "doc_id bigint, text string, lang string, source string, n bigint, term string")
    got = sorted((x.lang, x.source, x.part, x.item, x.value, x["rank"]) for x in divergence.divergences(d, 5, 4).collect())
    assert got == plain_divergence([(x[2], x[3], x[1]) for x in docs], 5, 4)
    assert divergence.divergences(d.limit(0)).count() == 0


def test_shares_are_exact_for_huge_counts(spark):
    rows = [(10 ** 13 + 7, 3 * 10 ** 13 + 1, 12345), (0, 0, 1), (0, 10 ** 15, 10 ** 6), (10 ** 15, 10 ** 15, 1)]
    d = spark.createDataFrame(rows, "c bigint, n bigint, v bigint").withColumn("p", divergence.price(F.col("c"), F.col("n"), F.col("v")))
    assert [x.p for x in d.collect()] == [1 + 10 ** 9 * (c + 2) // (n + 2 * v) for c, n, v in rows]


def plain_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    marks = defaultdict(lambda: [0, 0])
    for i, q, x in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], q == 1), max(marks[i][1], x == 1)]
    rows = defaultdict(list)
    for i, t, part in docs:
        t = t or ""
        w = re.findall(WORD, t)
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)),
            i is not None and i > first[t]), strict=True) if bad}
        rows[part or ""].append((fails, *(marks[i] if i in marks else (0, 0))))
    out = []
    for part, docs in rows.items():
        total, lines = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                total[f] += len(gone)
                lines.append((f, (part, "".join(order), k + 1, len(left), len(gone), sum(f in x[0] for x in docs) - len(gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone))))
        out += [(*x, total[f]) for f, x in lines]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    r = random.Random(8)
    text = lambda n, words, extra="": " ".join(r.choice(words) for _ in range(n)) + extra
    many, few = [f"w{i}é" for i in range(900)], ["Ab", "ab"]
    docs = [(i, text(r.choice([5, 199, 200, 230]), r.choice([many, many, few]), r.choice(["", "", " $", " ABCDEFGHIJ" * 8])), r.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(200 + i, docs[i % 4][1], r.choice(["en", "de"])) for i in range(60)]  # copies
    docs += [(300, None, "en"), (301, "", "en"), (None, docs[0][1], "en"), (None, None, "fr"), docs[3], docs[3], (500, "x y " * 20000, "de")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in [*range(0, 320, 2), 3, 3, None, 9999]]
    d = spark.createDataFrame([(*x, 5, 1) for x in docs], "doc_id bigint, text string, lang string, mask int, good int")
    m = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    count = filteraudit.mask_counts(d, m, F.coalesce("lang", F.lit("")))
    got = sorted(tuple(x) for x in filteraudit.audit(count).collect())
    assert got == plain_audit(docs, labels) and len(got) == 600 * 4
    assert filteraudit.audit(filteraudit.mask_counts(d.limit(0), m, F.col("lang"))).count() == 0
    assert filteraudit.mask_counts(d, m.limit(0), F.lit("all")).agg(F.sum("good")).first()[0] == 0


def test_removal_step_is_the_first_failing_filter():
    orders, step = filteraudit.removal_steps(np.arange(32), 5)
    assert len(orders) == 120
    for o, row in zip(orders.tolist(), step.tolist(), strict=True):
        assert row == [next((k for k, f in enumerate(o) if m >> f & 1), 5) for m in range(32)]
