"""Decontamination, language, line dedup and near-duplicates against plain versions."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegate.llm import decontaminate, language, line_dedup, simhash
from tidegate.llm.components import connected


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- decontamination -----------------------------------------------------------------------------

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


LONG = " ".join(f"w{i % 97}" for i in range(40_000))
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew soup again"
ITEMS = [(1, ITEM), (2, "Short item"), (3, None), (4, "..."), (1, ITEM), (None, "no id here"), (5, "a a a a"), (6, LONG[:400])]
DOCS = [(1, None, "x"), (2, "", "x"), (3, "!!!", "x"), (4, ITEM.upper() + " and more", "x"), (5, "ends with short", "x"),
        (6, "item starts", "x"), (7, "a a a a a a", "x"), (8, LONG, "x"), (None, "short ITEM, no-id-here", "x"),
        (4, ITEM.upper() + " and more", "x"), (9, "ünï Short\titem ünï", "x"), (10, " ".join(["filler"] * 200) + " short item", "x")]


def judged(docs, items, window=13):
    out = []
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i : i + n])].add("" if item is None else str(item))
    for key, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for win, ids in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= ids
        out.append((key, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def doc_table(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, segment string").repartition(2)


@pytest.mark.parametrize("small", [False, True])
def test_contamination(spark, doc_table, monkeypatch, small):
    if small:  # many segments, blocks and steps
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(doc_table, items)
    rows = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()]
    assert sorted(rows, key=repr) == judged(DOCS, ITEMS)
    kept = decontaminate.drop_contaminated(doc_table, items).collect()
    gone = {d for d, *_, bad in judged(DOCS, ITEMS) if bad}
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in doc_table.collect() if r.doc_id not in gone)


def test_only_judged_rows_go(spark):
    rows = [(None, ITEM, "x"), (None, "clean without an id", "x"), (None, None, "x"), (None, "", "x"), (7, "short item", "x"),
            (7, "another text", "x"), (7, "another text", "x"), (8, "short item", "x"), (8, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_hash_0 string").repartition(3)
    kept = decontaminate.drop_contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted((r for r in rows if r[1] not in (ITEM, "short item")), key=repr)


def test_no_items_and_no_documents(spark, doc_table):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(doc_table, items.limit(0)).collect()} == {0}
    assert decontaminate.contamination(doc_table.limit(0), items).count() == 0


def test_phrase_and_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "one two three four. one three two"), (2, "two x x x three one"), (3, "two"), (4, "three one")],
                                 "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([("q", "two three")], "item_id string, text string")
    index = decontaminate.build_index(docs)
    assert [tuple(r) for r in decontaminate.phrase_matches(index, items).collect()] == [(1, "q", 0, 1, 2)]
    near = decontaminate.proximity_matches(index, items, slop=1).select("doc_id", "doc_word").collect()
    assert sorted(map(tuple, near)) in ([(1, 1), (1, 6)], [(1, 2), (1, 5)])
    assert {r.doc_id for r in decontaminate.proximity_matches(index, items, slop=4).collect()} == {1, 2}


# -- language ------------------------------------------------------------------------------------

SAYINGS = {"en": "the weather and the thing that nothing else with these", "fr": "les oiseaux dans leurs nids avec beaucoup de voix",
           "de": "die schöne straße und der große bücherschrank dort"}


def test_languages_and_odd_texts(spark):
    rows = [(i, lang, SAYINGS[lang]) for i, lang in enumerate(list(SAYINGS) * 8)] + [(90, None, "unlabelled"), (91, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    filters = language.train(docs)
    asked = [(1, "The nothing weather", "x"), (2, "beaucoup de nids", "x"), (3, "große Straße", "x"), (4, None, "x"), (5, "", "x"),
             (6, "12 34 !!", "x"), (7, "жжж", "x"), (8, SAYINGS["de"] * 3000, "x"), (8, SAYINGS["de"] * 3000, "x"), (None, "the", "x")]
    table = spark.createDataFrame(asked, "doc_id long, text string, score string")
    got = [tuple(r) for r in language.identify(table, filters, keys=["doc_id"]).collect()]
    by_id = {k: (lang, score) for k, lang, score in got}
    assert len(got) == len(asked)
    assert [by_id[k][0] for k in (1, 2, 3, 4, 5, 6, 8, None)] == ["en", "fr", "de", "und", "und", "und", "de", "en"]
    assert by_id[4] == ("und", 0.0) and by_id[7][1] == 0.0 and by_id[7][0] in SAYINGS
    assert all(0 <= s <= 1 for _, _, s in got)
    kept = language.drop_undetermined(table, filters, 0.5)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 8, None}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, None, "the text")], "doc_id long, lang string, text string")
    filters = language.train(docs)
    assert [tuple(r) for r in language.identify(docs, filters, keys=["doc_id"]).collect()] == [(1, "und", 0.0)]
    assert language.identify(docs.limit(0), filters, keys=["doc_id"]).count() == 0


def test_filters_hold_what_they_learned_and_many_languages():
    langs = [f"l{i:03}" for i in range(70)]
    grams = np.arange(2000, dtype=np.int64)
    table = np.zeros((1 << 15, 2), np.uint64)
    for slot in language._slots(grams, 1 << 15):
        np.bitwise_or.at(table, (slot, (grams % 70) // 64), np.uint64(1) << (grams % 70 % 64).astype(np.uint64))
    masks = language.Filters((langs, 0, 1 << 15, table)).masks(grams)
    assert all(masks[g, g % 70 // 64] >> np.uint64(g % 70 % 64) & np.uint64(1) for g in range(2000))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = language.train(docs.where(~language.held_out(docs.doc_id)))
    found = language.identify(docs, filters, keys=["doc_id", "lang"]).where(language.held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found) > 100


# -- lines ---------------------------------------------------------------------------------------

def deduped(rows, ratio, least):
    pages, seen = Counter(h for _, h, _ in rows), Counter()
    for _, host, text in rows:
        seen.update({(host, line.strip(" ")) for line in (text or "").split("\n") if line.strip(" ")})
    drop = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for key, host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if (host, x.strip(" ")) not in drop]
        out.append((key, host, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines(spark):
    rows = [(i, "a" if i % 3 else "b", f"menu\nbody {i}\n menu \n\nfooter {i % 2}") for i in range(40)]
    rows += [(50, None, "menu\nx"), (51, None, None), (52, "a", ""), (53, "a", "menu"), (54, "c", "menu\nonly"), (53, "a", "menu"),
             (55, "b", "long\n" * 20_000 + "end"), (None, "b", "menu")]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = line_dedup.drop_boilerplate(table, table.source, ratio=0.3, least=5, counts=("n_lines", "n_dropped"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == deduped(rows, 0.3, 5)
    assert "Python" not in (plan := got._jdf.queryExecution().toString()) and "Arrow" not in plan
    clash = table.withColumnsRenamed({"source": "host"}).withColumn("lines", table.doc_id).withColumn("__lines", table.doc_id)
    kept = line_dedup.drop_boilerplate(clash.drop("__lines"), clash.host, ratio=0.3, least=5)
    assert sorted(map(repr, (r.text for r in kept.collect()))) == sorted(repr(r[2]) for r in deduped(rows, 0.3, 5))
    assert line_dedup.drop_boilerplate(table.limit(0), table.source).count() == 0


def test_lines_of_groups_of_copies(spark):
    own = lambda i, n=8: [f"own {i} {j}" for j in range(n)]
    pages = [["menu", *own(i)] for i in range(60)] + [own(i) for i in range(60, 100)]
    near = [[x if (i + j) % 20 else f"edit {i} {j}" for j, x in enumerate(own(500, 20))] for i in range(200)]
    texts = ["\n".join(p) for p in [*pages, *[own(600)] * 300, *near, ["menu"], [" ", ""]]] + [None]
    table = spark.createDataFrame([(i, h, t) for h in ("a", None) for i, t in enumerate(texts)], "line int, host string, text string")
    got = line_dedup.drop_boilerplate(table, table.host, by_group=True)
    plan = got._jdf.queryExecution().toString() + line_dedup.boilerplate(
        table, table.host, table.text, by_group=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and got.columns == table.columns
    without = lambda i, t: t if i >= 60 else t[5:]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(
        repr((i, h, without(i, t))) for h in ("a", None) for i, t in enumerate(texts))
    assert line_dedup.drop_boilerplate(table.limit(0), table.host, by_group=True).count() == 0


# -- near-duplicates -----------------------------------------------------------------------------

def fingerprint(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_fingerprints():
    texts = [None, "", "  ", "One", "one two three", "A b c d e", "é é é é é é", "x\x85y z\tq r", "w " * 50_000, LONG]
    got = simhash.majority(*simhash.shingle_hashes(pa.array(texts), 4))
    assert got.tolist() == [fingerprint(t) for t in texts]


def classes(fps, radius=4):
    fps = np.array(sorted(set(fps)), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps) <= radius
    label = np.arange(len(fps))
    while (new := np.where(near, label, len(fps)).min(axis=1)).tolist() != label.tolist():
        label = new
    return {int(f): int(fps[i]) for f, i in zip(fps, label)}


def cloud(rng, centres=12, spread=40):
    """Fingerprints around few centres, near and far, and a crowd that shares most of its bits."""
    out = []
    for c in rng.integers(0, 1 << 63, centres, dtype=np.uint64).tolist():
        for _ in range(spread):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            out.append(c ^ sum(1 << int(b) for b in flips))
    return out + [int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)] + [0, (1 << 64) - 1]


@pytest.mark.parametrize("hot", [8192, 10])
@pytest.mark.parametrize("parts", [2, 3, 4, 5])
def test_links_close_to_the_same_classes(spark, monkeypatch, hot, parts):
    monkeypatch.setattr(simhash, "_BLOCKS", {parts: simhash._BLOCKS[parts]})
    monkeypatch.setattr(simhash, "DENSE", 50)
    fps = cloud(np.random.default_rng(parts))
    signed = np.array(sorted(set(fps)), np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    groups = {r.node: r.root for r in connected(simhash.link_fingerprints(distinct, hot=hot)).collect()}
    want, got = defaultdict(set), defaultdict(set)
    for f, root in classes(fps).items():
        want[root].add(f)
    for f in signed:
        got[groups.get(f, f)].add(f % (1 << 64))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_groups_of_documents(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base, 1), (3, base + " more", 1), (9, base, 1), (None, base, 1), (7, None, 1), (8, "", 1), (8, "", 1), (4, "quite another text", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, low int")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, keys=["doc_id"]).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (None, 3), (7, 7), (8, 7), (4, 4)}
    left = simhash.one_of_each_group(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 7]
    assert simhash.near_duplicates(docs.limit(0), keys=["doc_id"]).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
