import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from gneiss.llm import decontam, quality, sharding, toxicity
from gneiss.llm import textvec as tv

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = re.compile("[A-Z]+")


def counts(text):
    text = text or ""
    words, seen, dup = BLANK.findall(text), set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_quality_counts_and_verdicts(spark, docs, texts):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels, per_class=150)
    rows = quality.assess(docs, field).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["kept"] and r["base_failed"])
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r["kept"], known[r["doc_id"]]) for r in rows if r["doc_id"] in known and not r["base_failed"]]
    assert sum(k == bool(q) for k, q in judged) >= 0.95 * len(judged)
    kept = quality.keep_good(docs, field)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def brute_decode(field, x):
    import itertools

    emission = x @ field.emission
    best = max(itertools.product((0, 1), repeat=len(x)), key=lambda y: field.start[y[0]] + sum(emission[t, y[t]] for t in range(len(y))) + sum(field.transition[a, b] for a, b in zip(y, y[1:], strict=False)))
    return list(best)


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(1)
    field = quality.LineField(rng.normal(size=(quality.FEATURES, 2)), rng.normal(size=(2, 2)) * 2, rng.normal(size=2))
    sequences = [rng.normal(size=(n, quality.FEATURES)) for n in (3, 0, 7, 1, 5)]
    borders = np.cumsum([0, *map(len, sequences)])
    labels = field.decode(np.concatenate(sequences), borders)
    for s, a, b in zip(sequences, borders[:-1], borders[1:], strict=True):
        assert labels[a:b].tolist() == (brute_decode(field, s) if len(s) else [])


def test_quality_marks_notices_and_symbols_inside_good_documents(spark, docs, texts):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [t for i, t in texts.items() if known.get(i) == 1 and t and t.isascii() and len(t.split()) > 80 and t.count("\n") >= 3 and "icense" not in t][:20]
    junk = ["This work is licensed under the GNU General Public License, version 3.", "H%%% eno### th$$$ ouan&&& st*** er### on%%% heat$$$ thea&&&"]
    marked, spared, n = 0, 0, 0
    for body in good:
        lines = body.split("\n")
        mixed = [*lines[:1], junk[0], *lines[1:2], junk[1], *lines[2:]]
        part = next(iter(quality.tv.slices(pa.array(["\n".join(mixed)]))))
        seen = quality.describe(part)
        found = field.decode(seen.features, seen.borders)
        worded = [x for x in mixed if x.split()]
        marked += sum(1 for x, y in zip(worded, found, strict=True) if x in junk and y == 0)
        spared += sum(1 for x, y in zip(worded, found, strict=True) if x not in junk and y == 1)
        n += len(worded) - 2
        assert quality.judge(part, field).kept.all() or quality.judge(part, field).lines.base_failed.all()
    assert good and marked >= 0.9 * 2 * len(good) and spared >= 0.8 * n, (len(good), marked, spared, n)


def test_latent_labels_follow_lines_not_documents():
    # the second number tells boilerplate; documents of either label hold a line of the other kind
    line = lambda bad: np.array([1.0, bad] + [0.0] * (quality.FEATURES - 2))
    docs = [np.stack([line(0)] * 11 + [line(1)])] * 20 + [np.stack([line(1)] * 11 + [line(0)])] * 20
    got = quality.latent_labels(docs, [1] * 20 + [0] * 20, [np.full(12, 9.0)] * 40)
    assert got[0].tolist() == [1] * 11 + [0] and got[-1].tolist() == [0] * 11 + [1]


def test_quality_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    field = quality.fit(odd, none)
    assert quality.assess(empty, field).count() == 0 and quality.assess(odd, field).count() == odd.count()
    part = next(tv.slices(pa.array([" ".join(f"w{i}" for i in range(60))])))
    assert quality.judge(part, field).kept.tolist() == [True]


def test_decontamination_equals_brute_force(spark, docs, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(9001, "the of and"), (9002, "In"), (9003, ""), (9004, None), (9002, "fox JUMPS over"), (None, "lazy dog near the old river bank while many people watch it run and then go")], items.schema)
    items = items.unionByName(more)
    words = lambda s: WORD.findall(UPPER.sub(lambda m: m[0].lower(), s or ""))
    windows = {}
    for r in items.collect():
        w = words(r["text"])
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(r["item_id"])
    sizes = {len(k) for k in windows}
    rows = {r["doc_id"]: r for r in decontam.report(docs, items).collect()}
    assert len(rows) == len(texts)
    for k, t in texts.items():
        w, hit, ids = words(t), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    ids |= windows[tuple(w[i : i + m])]
        ids = sorted(str(i) for i in ids if i is not None)
        due = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
        assert tuple(rows[k])[1:] == due, k


def test_decontamination_of_odd_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, odd.first()["text"])], "item_id long, text string")
    nothing = spark.createDataFrame([], items.schema)
    assert decontam.report(empty, items).count() == 0
    assert decontam.report(odd, nothing).where("contaminated").count() == 0
    left = decontam.drop_contaminated(odd, items)
    assert left.columns == odd.columns and sorted(r["node"] for r in left.collect()) == [2, 5]


def test_decontamination_with_repeated_items(spark):
    long_, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "head " + long_), (2, other), (3, "clean words only")], "doc_id long, text string")
    for rows in ([(5, long_), (5, long_), (5, long_.upper())], [(5, long_), (5, other), (5, long_)], [(5, long_), (6, long_)]):
        items = spark.createDataFrame(rows, "item_id long, text string")
        ids, texts = {r[0] for r in rows}, {r[1] for r in rows}
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.report(docs, items).collect()}
        assert got == {1: (40, len(ids), True), 2: (40, 1, True) if other in texts else (0, 0, False), 3: (0, 0, False)}
        assert {r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()} == {3} | ({2} - {2 for _ in texts & {other}})


def test_decontamination_keeps_versions_of_an_item_apart(spark):
    words = [f"w{i}" for i in range(26)]
    other = [f"v{i}" for i in range(13)]
    # two texts of one id that only together cover 13 words of the document; item 6 makes it a candidate
    texts = [(5, words[:11] + ["x"] * 4), (5, ["y"] * 7 + words[7:15]), (6, other)]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words + other))], "doc_id long, text string")
    assert [(r["n_hit"], r["n_items"]) for r in decontam.report(docs, items).collect()] == [(13, 1)]


def test_shards(docs, texts):
    rows = sharding.shard(docs, 16).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and {r["law"] for r in rows} == {"bytes"}
    by, slots, groups = Counter(), {}, {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), None)
        by[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault(raw, set()).add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean, longest = sum(by.values()) / 16, max(r["size"] for r in rows)
    assert all(abs(by[s] - mean) <= 0.01 * mean + longest for s in range(16))


def test_shards_cut_a_hot_group(spark):
    rows = spark.createDataFrame([(i, "same text" if i % 3 else f"other {i}") for i in range(3000)], "doc_id long, text string")
    by = Counter()
    for r in sharding.shard(rows, 16).collect():
        by[r["shard"]] += r["size"]
    mean = sum(by.values()) / 16
    assert all(abs(v - mean) <= 0.02 * mean for v in by.values())


def test_shards_of_odd_tables(odd, empty):
    assert sharding.shard(empty).count() == 0
    rows = sharding.shard(odd, 4).collect()
    assert len(rows) == 6
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_toxicity_on_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    toxic, clean = [r["predicted"] for r in rows if r["toxic"]], [r["predicted"] for r in rows if not r["toxic"]]
    # some 350 toxic rows to learn from; with 1,700 it is over 0.99 and under 0.005
    assert np.mean(toxic) > 0.8, np.mean(toxic)
    assert np.mean(clean) < 0.1, np.mean(clean)


def test_counterfactual_pairs_lower_the_gap():
    rng = np.random.default_rng(3)
    rows, labels, pairs = [], [], []
    for i in range(200):
        y = i % 2
        own = [10 + y * 5, 40 + int(rng.integers(5))] + ([100] if y and i % 4 == 1 else []) + ([101] if not y and i % 40 == 0 else [])
        rows.append(np.array(sorted(own), dtype=np.int32))
        labels.append(y)
        if 100 in own:
            pairs.append((i, np.array(sorted(101 if x == 100 else x for x in own), dtype=np.int32)))
    free, tied = toxicity.Classifier.fit(rows, labels, []), toxicity.Classifier.fit(rows, labels, pairs, strength=50.0)
    assert tied.weights[100] < free.weights[100]
    assert toxicity.swapped("Old women and THE gay friend") == "young men and THE lesbian friend" and toxicity.swapped("manly womenfolk") is None


def test_toxicity_is_the_same_with_a_neutral_mention(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.n_pairs > 100 and model.gap < 0.01
    bodies = [r["text"] or "" for r in docs.orderBy("doc_id").limit(200).collect()]
    said = [toxicity.mentioning(b) for b in bodies]
    assert all(len(s) > len(b) for s, b in zip(said, bodies, strict=True))
    one, two = (np.concatenate([model.score(p) for p in toxicity.tv.slices(pa.array(t))]) for t in (bodies, said))
    assert np.abs(one - two).mean() < 0.01


def test_toxicity_without_labels(spark, odd, empty):
    model = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["score"] < 1e-300 and r["predicted"] == 0 for r in toxicity.scored(odd, model).collect())
    assert toxicity.scored(empty, model).count() == 0


def test_written_shards_hold_every_row_once(spark, odd, tmp_path):
    rows = odd.withColumn("slot", odd["node"])
    sharding.write_shards(rows, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert len({(r["shard"], r["slot_"]) for r in back.collect()}) == rows.count()
