import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gneiss.llm import bands, components, jaccard, linededup, paradedup, suffix
from gneiss.llm.components import connected
from gneiss.llm.storage import CLEANUP, materialize

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = re.compile("[A-Z]+")


def root_of(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100, 100)]
    parent = {x: x for p in pairs for x in p}
    for a, b in pairs:
        ra, rb = root_of(parent, a), root_of(parent, b)
        parent[max(ra, rb)] = min(ra, rb)
    got = connected(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["root"] for r in got} == {x: root_of(parent, x) for x in parent}
    assert connected(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def sets_of(texts):
    out = {}
    for k, t in texts.items():
        w = BLANK.findall(UPPER.sub(lambda m: m[0].lower(), t or ""))
        out[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
    return out


def jaccard_components(texts):
    sets = sets_of(texts)
    parent = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            ra, rb = root_of(parent, a), root_of(parent, b)
            parent[max(ra, rb)] = min(ra, rb)
    return {k: (len(sets[k]), root_of(parent, k)) for k in sets}


@pytest.mark.parametrize(("frequent", "short", "long"), [(64, 64, 256), (2, 2, 256), (2, 2, 16)])
def test_jaccard_equals_brute_force(docs, texts, monkeypatch, frequent, short, long):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "LONG", long)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs).collect()}
    assert got == jaccard_components(texts)


def test_jaccard_of_odd_tables(odd, empty):
    assert jaccard.components(empty).count() == 0
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.components(odd).collect())
    assert got == [("3", 0, 3), ("7", 21, 7), ("7", 21, 7), ("7", 22, 7), ("None", 0, None), ("None", 21, 7)]
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns


def test_keep_one_by_row(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [
        (None, text("a"), 1), (None, text("b"), 2), (None, None, 3), (None, "", 4), (None, text("c"), 5), (None, text("c"), 6),
        (7, text("d"), 7), (7, text("e"), 8), (7, text("e"), 9), (8, text("f"), 10), (None, text("f") + " more", 11), (9, "", 12), (9, "", 13),
        (3, text("g"), 14), (4, text("g"), 15), (4, text("h"), 16),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, row long")
    out = jaccard.keep_one(table)
    left = sorted(r["row"] for r in out.collect())
    assert out.columns == table.columns
    assert left in [sorted({1, 2, 3, 4, c, 7, e, 10, 12, 13, 14, 16}) for c in (5, 6) for e in (8, 9)]


def expected_lines(texts):
    places, sets = defaultdict(list), {}
    for k, t in texts.items():
        for i, line in enumerate((t or "").split("\n")):
            w = [x for x in line.split(" ") if x]
            if len(w) >= linededup.MIN_WORDS:
                places[line].append((k, i))
                sets[line] = frozenset((" ".join(w[j : j + 3]) + ("" if j + 2 < len(w) else " "))[: linededup.CHARS] for j in range(len(w) - 1))
    parent = {x: x for x in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[root_of(parent, a)] = root_of(parent, b)
    groups = defaultdict(list)
    for x in sets:
        groups[root_of(parent, x)] += places[x]
    gone = defaultdict(set)
    for g in groups.values():
        for k, i in g:
            if (k, i) != min(g):
                gone[k].add(i)
    return gone


def test_lines_against_brute_force(docs, texts):
    gone = expected_lines(texts)
    got = {r["doc_id"]: {int(x) for x in r["removed_lines"].split(",") if x} for r in linededup.report(docs).collect()}
    total = sum(map(len, gone.values()))
    missed = sum(len(gone[k] - got[k]) for k in texts)
    assert total and not any(got[k] - gone[k] for k in texts)
    assert missed <= 0.02 * total


@pytest.mark.parametrize("short", [64, 2])
def test_bands_leave_no_similar_pair_apart(spark, monkeypatch, short):
    monkeypatch.setattr(bands, "SHORT_BAND", short)
    rng = random.Random(3)
    sets, posted = {}, set()
    for g in range(90):
        core = [rng.randrange(10**6) for _ in range(12)]
        for _ in range(rng.randint(1, 3)):
            # a common phrase in all sets, a core for each group
            k = len(sets)
            sets[k] = sorted({*range(4), *core, *rng.sample(range(10**6), rng.randint(0, 2))})
            posted |= {(k, -1), (k, -2 - g % 5)}
    order = rng.sample(range(1000), len(sets))
    sets = {order[k]: v for k, v in sets.items()}
    table = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    rows = spark.createDataFrame([(order[k], b) for k, b in posted], "node long, band long")
    got = {r["node"]: r["root"] for r in bands.united(rows, lambda wanted: table.join(wanted, "node"), 75).collect()}
    parent = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = set(sets[a]), set(sets[b])
        if 100 * len(x & y) >= 75 * len(x | y):
            ra, rb = root_of(parent, a), root_of(parent, b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {k: root_of(parent, k) for k in sets if k in got} and {k for k in sets if root_of(parent, k) != k} <= set(got)


def test_short_and_unspaced_lines(spark, tmp_path):
    han = "".join(chr(0x4E00 + i) for i in range(60))
    rows = [
        (1, f"Read more\nHome\n\n{han}\na\tb\tc\td\te\tf\tg\n\r"), (2, f"Home\nRead more\n\n{han}\u4e00\na\tb\tc\td\te\tf\tg\n\r"),
        (3, "ha ha ha ha ha\nHouse\nRead less now"), (4, "ha ha ha ha ha ha ha\n" + han[::-1]),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed_lines"] for r in entry.queries()["op2_fuzzy_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "0,1,3,4", 3: "", 4: "0"}


def test_lines_of_odd_tables(odd, empty):
    assert linededup.report(empty).count() == 0
    out = linededup.drop_duplicates(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert linededup.drop_duplicates(empty).count() == 0


def removed(texts, length=200):
    raw = {k: (t or "").encode() for k, t in texts.items()}
    seen = defaultdict(int)
    for b in raw.values():
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] += 1
    for k, b in raw.items():
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        yield k, (len(b), sum(mask), sum(1 for i, m in enumerate(mask) if m and (not i or not mask[i - 1])), hashlib.sha256(kept).hexdigest())


def test_suffix_equals_brute_force(docs, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.report(docs).collect()}
    assert got == dict(removed(texts))


def test_suffix_order():
    rng = random.Random(4)
    for _ in range(200):
        a = np.array([rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 70))], dtype=np.int64)
        assert suffix.suffix_order(a).tolist() == sorted(range(len(a)), key=lambda i: a[i:].tolist())


def test_suffix_of_long_pieces(monkeypatch, spark):
    monkeypatch.setattr(suffix, "PIECE", 300)
    rng = random.Random(8)
    block = "".join(rng.choice("abcdefgh") for _ in range(900))
    texts = {1: block + "".join(rng.choice("xyz") for _ in range(2000)), 2: "head " + block[:700]}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    part = next(suffix.tv.slices(__import__("pyarrow").array([texts[1]])))
    assert sum(1 for _ in suffix._pieces(part)) > 1
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix.report(rows).collect()} == dict(removed(texts))


def test_suffix_of_odd_tables(odd, empty):
    assert suffix.report(empty).count() == 0 and suffix.report(odd).count() == odd.count()
    out = suffix.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta. " + " ".join(f"word{i}" for i in range(30)) + ". " + " ".join(f"tok{i}" for i in range(20)) + "."


def test_passages(spark):
    clean = " ".join(f"plain{i}" for i in range(80)) + "."
    rows = [(1, "Some start here. " + PASSAGE + " Other stuff follows now."), (2, "Wholly different begin text, ok. Yes. " + PASSAGE), (3, clean), (4, None), (5, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = paradedup.passages(table).collect()
    assert {r["doc_id"] for r in got} == {1, 2} and {r["first_doc_id"] for r in got} == {1}
    texts = {r["doc_id"]: r["text"] for r in paradedup.remove_passages(table).collect()}
    assert texts[1] == rows[0][1] and "word7" not in texts[2] and texts[3] == clean


def test_passages_find_every_long_repeat(docs, texts):
    words = {k: BLANK.findall((t or "").lower()) for k, t in texts.items()}
    where = defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - 54):
            where[tuple(w[i : i + 55])].add(k)
    due = {k for v in where.values() if len(v) > 1 for k in v}
    found = {r["doc_id"] for r in paradedup.passages(docs).collect()}
    assert len(due - found) <= 0.05 * len(due)
    short = defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - 9):
            short[tuple(w[i : i + 10])].add(k)
    assert found <= {k for v in short.values() if len(v) > 1 for k in v}


def test_passages_without_punctuation(spark):
    rng = random.Random(11)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, spans = [], {}
    for i in range(0, 60, 2):
        shared = own(50 + i % 7)
        for k in (i, i + 1):
            head = own(rng.randrange(1, 90)) + " "
            rows.append((k, head + shared + " " + own(rng.randrange(1, 90))))
            spans[k] = (len(head), len(head) + len(shared))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["start"], r["stop"]): r["removed"] for r in paradedup.passages(table).collect()}
    assert got == {(k, *v): k % 2 == 1 for k, v in spans.items()}


def test_passages_miss_no_document(docs, texts):
    words = {k: BLANK.findall(UPPER.sub(lambda m: m[0].lower(), t or "")) for k, t in texts.items()}
    where = defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(k)
    due = {k for v in where.values() if len(v) > 1 for k in v}
    assert due and due <= {r["doc_id"] for r in paradedup.passages(docs).collect()}


def test_passages_of_odd_tables(odd, empty):
    assert paradedup.passages(empty).count() == 0
    paradedup.passages(odd).collect()


def test_near_copies_meet_in_proportion_to_their_number(spark, monkeypatch):
    rng = random.Random(12)
    core = list(range(40))
    # each lacks a few values of the core, so that many are only similar to some others
    sets = {k: sorted({*rng.sample(core, 35), 1000 + k}) for k in range(120)}
    table = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    rows = spark.createDataFrame([(k, b) for k in sets for b in range(2)], "node long, band long")
    tried, real = [], bands.verified

    def verified(pairs, *rest):
        tried.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(bands, "verified", verified)
    got = {r["node"]: r["root"] for r in bands.united(rows, lambda wanted: table.join(wanted, "node"), 75).collect()}
    parent = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = set(sets[a]), set(sets[b])
        if 100 * len(x & y) >= 75 * len(x | y):
            ra, rb = root_of(parent, a), root_of(parent, b)
            parent[max(ra, rb)] = min(ra, rb)
    assert len(set(got.values())) < 30 and got == {k: root_of(parent, k) for k in sets if k in got} and {k for k in sets if root_of(parent, k) != k} <= set(got)
    assert sum(tried) < 10 * len(sets)


def test_sets_that_share_much_but_are_not_similar_are_not_compared(spark, monkeypatch):
    rng = random.Random(5)
    # lists of common values in which most members differ by more than they may
    sets = {k: sorted(rng.sample(range(30), 20)) for k in range(200)}
    table = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    rows = spark.createDataFrame([(k, 0) for k in sets], "node long, band long")
    tried, real = [], bands.verified

    def verified(pairs, *rest):
        tried.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(bands, "verified", verified)
    got = {r["node"]: r["root"] for r in bands.united(rows, lambda wanted: table.join(wanted, "node"), 75).collect()}
    parent = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = set(sets[a]), set(sets[b])
        if 100 * len(x & y) >= 75 * len(x | y):
            ra, rb = root_of(parent, a), root_of(parent, b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {k: root_of(parent, k) for k in sets if k in got} and {k for k in sets if root_of(parent, k) != k} <= set(got)
    assert sum(tried) < 6 * len(sets), tried


def test_lines_are_kept_without_their_runs(spark, monkeypatch):
    line = "one line that two documents share but for its end"
    rows = spark.createDataFrame([(1, line), (2, line + "s"), (3, line + "s!")], "doc_id long, text string")
    kept, real = [], linededup.united

    def united(posted, fetch, *rest):
        kept.append(dict(fetch(posted.select("node").distinct()).dtypes))
        return real(posted, fetch, *rest)

    monkeypatch.setattr(linededup, "united", united)
    assert linededup.report(rows, min_words=1, every=True).where("n_removed = 1").count() == 2
    assert [c["body"] for c in kept] == ["string"]


def test_units_of_lines_hold_no_shingles(spark):
    assert "shingles" not in paradedup.UNITS
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(25)) for i in range(3))
    rows = spark.createDataFrame([(1, text), (2, "no line"), (3, None), (4, text)], "doc_id long, text string")
    every = spark.createDataFrame([(1,)], "n long")
    none = paradedup.find_sets(rows.select("text"), paradedup.bitfilter.build(every))
    assert none.count() == 0 and none.columns == ["n1", "n2", "shingles"]


def test_lines_alike_between_word_starts(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij\U00020000") for _ in range(80))
    lines = [[word() for _ in range(6)] for _ in range(10)]
    # all words begin with another letter: no shingle at a word's start is the same
    rows = [(1, "\n".join(map(" ".join, lines))), (2, "\n".join(" ".join("Z" + w[1:] for w in x) for x in lines)), (3, " ".join(word() for _ in range(6)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in entry.queries()["op2_fuzzy_line_dedup"](spark, str(tmp_path)).collect()}
    assert got[1] == got[3] == 0 and got[2] >= 9


def test_shared_places_take_a_bit_each():
    rng = random.Random(8)
    places = [sorted(rng.sample(range(1 << 12), 300)) for _ in range(4)]
    rows = [zlib.compress(np.diff(np.array(p, dtype=np.int64), prepend=0).astype("<u4").tobytes()) for p in places]
    wanted = np.zeros(1 << 12, dtype=bool)
    wanted[[x for p in places for x in p]] = True
    assert (jaccard._packed(rows, 1 << 12) == np.packbits(wanted)).all()
    tracemalloc.start()
    jaccard._packed(rows, 1 << jaccard.SHARED_BITS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < (1 << jaccard.SHARED_BITS) // 4, peak


@pytest.mark.parametrize("few", [0, 50_000])
def test_components_by_exchanges_or_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    pairs = [(i, i + 1) for i in range(40) if i % 9] + [(70, 60), (60, 50), (50, 70), (5, 5), (99, 99)]
    parent = {x: x for p in pairs for x in p}
    for a, b in pairs:
        ra, rb = root_of(parent, a), root_of(parent, b)
        parent[max(ra, rb)] = min(ra, rb)
    out = connected(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    rows = out.collect()
    assert sorted((r["node"], r["root"]) for r in rows) == sorted((x, root_of(parent, x)) for x in parent)


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(CLEANUP, None)
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(40):
        if not files() - before:
            break
        time.sleep(0.25)
    assert not files() - before and out.count() == 7
    assert spark.conf.get(CLEANUP, None) == setting


def test_prefix_lists_carry_shared_shingles_only(spark, monkeypatch):
    rng = random.Random(12)
    sets = {k: rng.sample(range(60), 8) + rng.sample(range(10**3, 10**6), rng.randint(0, 6)) for k in range(50)}
    root = {k: k - k % 5 for k in sets}
    often = defaultdict(set)
    for k, v in sets.items():
        for x in v:
            often[x].add(k)
    expected = set()
    for k, v in sets.items():
        for place, x in enumerate(sorted(v, key=lambda x: (len(often[x]), x)), 1):
            if place <= len(v) - -(-75 * len(v) // 100) + 1 and len(often[x]) > 1:
                expected.add((x, k, len(v) - place + 1))
    met = defaultdict(set)
    for x, k, _ in expected:
        met[x].add(root[k])
    expected = {(x, k, room) for x, k, room in expected if len(met[x]) > 1}
    written, real = {}, bands.materialize

    def kept(df, label):
        out = real(df, label)
        written[label] = (set(out.columns), out.count())
        return out

    monkeypatch.setattr(bands, "materialize", kept)
    table = spark.createDataFrame([(k, v, len(v), [0]) for k, v in sets.items()], "node long, body array<long>, n int, mark array<long>")
    nodes = spark.createDataFrame(list(root.items()), "node long, root long")
    got = bands._prefix_lists(nodes, table, 75, lambda body: body).collect()
    assert expected and {(r["token"], r["node"], r["room"]) for r in got} == expected and len(got) == len(expected)
    assert all(r["root"] == root[r["node"]] and r["n"] == len(sets[r["node"]]) for r in got)
    assert written["band-tokens"][0] == {"node", "token"}
    assert written["band-shared"][1] == sum(len(v) for v in often.values() if len(v) > 1)
