"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with the odd cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendra.llm import chat, decontaminate, lines, media, mixing, ngrams, quality, simhash, suffixes, toxicity
from dendra.llm.common import fold, stars

ODD = [(1, "a b c d"), (1, "a b c d"), (2, None), (3, ""), (None, "x y z"), (4, "é ü ß 中文\tA\x0bB"), (5, "w " * 30000), (6, "a b c d")]
SCHEMA = "doc_id long, text string"


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    texts = [words(rng, rng.randint(1, 120), vocabulary) for _ in range(n)]
    for i in range(0, n, 5):
        texts[i] = texts[(i * 7) % n]
    for i in range(3, n, 7):
        texts[i] = texts[i - 1].replace("a", "b", 1)
    for i in range(4, n, 9):
        texts[i] += " " + texts[1][:70] + " " + words(rng, 3, vocabulary)
    return [(i, t) for i, t in enumerate(texts)]


def clashing(df):
    """With columns whose names the operators use inside."""
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(("score", "predicted", "key", "row", "pos", "h", "fp", "bucket", "size", "blob", "home", "label"))))


def frame(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA))


def test_quality_votes_and_odd_rows(spark):
    rng = random.Random(2)
    good = [words(rng, 40, ["river", "stone", "cloud", "meadow", "winter"]) for _ in range(80)]
    bad = [words(rng, 40, ["BUY!!", "NOW!!", "***", "$$$"]) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    marks = spark.createDataFrame([(i, int(i < 80)) for i in range(160) if i % 4], "doc_id long, quality int")
    docs = frame(spark, rows)
    model = quality.fit(docs, quality.marked(marks, "quality"))
    out = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert all((out[i]["score"] >= 0.7) == (i < 80) and 0 <= out[i]["score"] <= 1 for i in range(160) if i % 4 == 0)
    for i, text in rows[:20] + ODD:  # each neighbour by itself, without blocks
        z = np.log1p(quality.term_counts(text)) * model.idf
        z = z / max(np.sqrt((z * z).sum()), 1e-30) @ model.axes
        near = sorted(((float(z @ v) / max(math.sqrt(float(z @ z)), 1e-30), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: model.neighbours]
        total = sum(max(c, 0) ** model.power for c, _ in near)
        vote = sum(max(c, 0) ** model.power * y for c, y in near) / total if total > 1e-9 else model.base
        assert model.score(quality.term_counts(text)[None])[0] == pytest.approx(vote, abs=1e-4)
        assert (i, text) not in rows or out[i]["score"] == pytest.approx(vote, abs=1e-4)
    odd = quality.score(frame(spark, ODD), model)
    assert odd.count() == len(ODD) and "key" in odd.columns
    held = {r["doc_id"]: r["score"] for r in odd.collect()}
    assert held[2] == held[3] == pytest.approx(model.base, abs=1e-6)
    assert quality.fit(docs, quality.marked(marks.limit(0), "quality")) is None
    assert quality.score(docs.limit(0), None).count() == 0 and {r["score"] for r in quality.score(docs, None).collect()} == {0.5}


def test_toxicity_by_compression(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioustnr") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    foul = ["blorgface", "snivelwit", "grubthunk", "moldbrain"]
    rows = []
    for i in range(600):
        text = words(rng, 60, vocabulary).split()
        if i % 4 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(foul))
        rows.append((i, " ".join(text)))
    docs = frame(spark, rows)
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600) if i % 5], "doc_id long, toxic int")
    model = toxicity.fit(docs, quality.marked(marks, "toxic"))
    out = toxicity.score(docs, model).collect()
    held = [r for r in out if r["doc_id"] % 5 == 0]
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert b"blorgface" in model.toxic and b"blorgface" not in model.ordinary
    odd = {r["doc_id"]: r for r in toxicity.score(frame(spark, ODD), model).collect()}
    assert odd[2]["score"] == odd[3]["score"] and odd[3]["predicted"] == 0
    assert toxicity.fit(docs, quality.marked(marks.limit(0), "toxic")) is None
    for only, rate in ((0, 0.0), (1, 1.0)):  # one label alone: its rate stands for every text
        alone = toxicity.fit(docs, quality.marked(marks.where(f"toxic = {only}"), "toxic"))
        assert alone == rate and {(r["score"], r["predicted"]) for r in toxicity.score(docs, alone).collect()} == {(rate, only)}
    blank = spark.createDataFrame([(i, "") for i in range(20)], SCHEMA)
    assert toxicity.fit(blank, quality.marked(spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int"), "toxic")) == 0.0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_held_out_on_the_given_table(spark):
    """On labelled rows that the fit didn't see."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = quality.marked(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "toxic")
    model = toxicity.fit(docs, marks.where(fold(F.col("doc_id"), 5) != 0))
    held = toxicity.score(docs.join(marks.where(fold(F.col("doc_id"), 5) == 0), "doc_id").select("doc_id", "text", "label"), model)
    n = {(r["label"], r["predicted"]): r["count"] for r in held.groupBy("label", "predicted").count().collect()}
    hit = n.get((1, 1), 0)
    assert 2 * hit / (2 * hit + n.get((0, 1), 0) + n.get((1, 0), 0)) > 0.65


def removed(rows, length):
    """By every string of the length, in a dictionary."""
    seen, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], (doc is None, doc))
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] < (doc is None, doc) if doc is not None else seen[raw[i : i + length]][0] is False:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.setdefault((doc, text), (len(raw), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("length", "q"), [(50, 20), (30, 8), (51, 20)])
def test_suffixes_against_brute_force(spark, length, q):
    rows = corpus() + [(100, "z" * 400), (101, "z" * 399 + "y"), (102, None), (103, ""), (None, corpus()[1][1])]
    got = suffixes.remove_repeats(frame(spark, rows), length, q).collect()
    want = removed(rows, length)
    assert len(got) == len(rows)
    by_id = {d: v for (d, _), v in want.items()}
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) == by_id[r["doc_id"]], r["doc_id"]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_suffixes_long_text_and_repeated_ids(spark):
    rng = random.Random(5)
    body = "".join(rng.choice("abcd ") for _ in range(1_300_000))  # more than one chunk
    rows = [(1, body), (2, "start " + body[500_000:1_200_000] + " end"), (2, "another text of the same id " * 4), (2, "another text of the same id " * 4)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixes.remove_repeats(frame(spark, rows), keep_text=False).collect())
    assert got[0] == (1, 1_300_000, 0) and got[-1][1:] == (700_010, 700_000 + 0) or got[-1][2] >= 700_000
    assert [g[2] for g in got if g[1] == 112] == [0, 0]
    assert suffixes.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_suffixes_of_a_passage_in_all_texts_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PART", 2000)  # as a larger input: more buckets than shuffle partitions
    rng = random.Random(15)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) + passage + "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80))) for _ in range(80)]
    rows = [(None if i % 3 == 0 else i, t) for i, t in enumerate(texts)]
    want = removed(rows, 50)
    got = {(r["doc_id"], bytes(r["kept"])): (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert got == {(d, v[-1]): v for (d, _), v in want.items()} and len(got) == len(rows)


def plain_fingerprint(text, shingle):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    parts = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark):
    rows = corpus(7, 120) + [r for r in ODD if r[0] != 1] + [(900 + i, f"one two three {i % 3} five") for i in range(9)]
    rows = [(None if d is None else d + 1000 * (i >= 120), t) for i, (d, t) in enumerate(rows)]
    got = {(r["doc_id"]): r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fp = {d: plain_fingerprint(t, 3) for d, t in rows}
    assert all(r["fp"] % 2**64 == fp[d] for d, r in got.items())
    ids = sorted(d for d in fp if d is not None)
    edges = [(a, b) for a in ids for b in ids if a <= b and (fp[a] ^ fp[b]).bit_count() <= 3]
    nodes, root = stars(*np.array(edges).T)
    least = dict(zip(nodes.tolist(), root.tolist(), strict=True))
    assert all(got[d]["component_id"] == least.get(d, d) for d in ids)
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_anchors_cover_three_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    for a, b in zip(x, y, strict=True):
        index, key, home = simhash.anchors(np.array([a, b]))
        assert set(key[(index == 0) & home].tolist()) & set(key[index == 1].tolist())
    many = np.unique(np.concatenate([x[:1] ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j)) for i in range(64) for j in range(i)]))
    big = np.tile(many, 1)
    pairs = sum(len(a) for a, _ in simhash.near_pairs(np.zeros(len(big), np.uint64), big, np.ones(len(big), bool), 3))
    whole = sum(int((np.bitwise_count(big ^ v) <= 3).sum()) - 1 for v in big)
    assert pairs == whole


def test_media_round_trip(spark, tmp_path):
    rows = [*ODD, (7, "x" * 64), (8, "x" * 65)]
    members = media.store(frame(spark, rows), str(tmp_path / "a"))
    for r in media.features(members).join(members.select("doc_id", "media"), "doc_id").collect():
        stored = bytes(r["media"])
        side = int.from_bytes(stored[16:20], "big"), int.from_bytes(stored[20:24], "big")  # of the header chunk, which comes first
        data = zlib.decompress(stored[stored.index(b"IDAT") + 4 : stored.index(b"IEND") - 8])
        rows_of = [data[k * (side[0] + 1) + 1 : (k + 1) * (side[0] + 1)] for k in range(side[1])]
        flat = [v for row in rows_of for v in row]
        mean = sum(flat) / len(flat)
        spread = math.sqrt(sum((v - mean) ** 2 for v in flat) / len(flat))
        assert side[0] == media.WIDTH and (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        parts = dict(p.split("=") for p in r["feature"].split(";"))
        assert int(parts["h"]) == side[1] and abs(float(parts["mean"]) - mean) < 1e-3 and abs(float(parts["std"]) - spread) < 1e-3
        cells = [[v for row in rows_of[min(a * side[1] // 8, side[1] - 1) : max(a * side[1] // 8 + 1, (a + 1) * side[1] // 8)] for v in row[b * side[0] // 8 : (b + 1) * side[0] // 8]] for a in range(8) for b in range(8)]
        means = [sum(c) / len(c) for c in cells]
        assert parts["ahash"] == f"{sum(1 << (63 - k) for k, m in enumerate(means) if m > sum(means) / 64 + 1e-9):016x}"
    got = sorted(media.features(members).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    for r, (doc, text) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        data = (text or "").encode()
        padded = data + b"\0" * ((-len(data)) % 64 if data else 64)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (doc, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert media.features(media.store(frame(spark, rows).limit(0), str(tmp_path / "b"))).count() == 0


def test_media_ranges_and_retries(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    media.store(spark.range(50).selectExpr("id AS doc_id", "repeat(string(id), 100) AS text"), path).count()
    reader = media.ArchiveReader(path, 700, 3)
    parts = reader.partitions()
    assert len(parts) > 5
    ids = [d for p in parts for b in reader.read(p) for d in b.column(0).to_pylist()]
    assert sorted(ids) == list(range(50))
    calls = collections.Counter()
    plain = zlib.crc32

    def flaky(data, *a):
        calls["n"] += 1
        return plain(data, *a) ^ (calls["n"] % 7 == 0)

    monkeypatch.setattr(media.zlib, "crc32", flaky)
    assert sorted(d for p in parts for b in reader.read(p) for d in b.column(0).to_pylist()) == list(range(50))
    with pytest.raises(ValueError):
        media.from_png(b"not a picture")


def test_chat_trees(spark):
    hard = "a\\<s> \\\\[INST] <|im_end|>\n<|im_start|>user\nx\\"
    nodes = [
        (1, 1, None, "user", hard, 1.0), (1, 2, 1, "assistant", "b", 2.0), (1, 3, 1, "assistant", "c" + hard, 5.0), (1, 4, 3, "user%\n<", None, 0.0), (1, 4, 3, "user%\n<", None, 0.0),
        (2, 1, 9, None, "orphan", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (3, 3, 2, "user", "below", 0.0), (None, 1, None, "assistant", "n", 1.0),
    ]
    df = spark.createDataFrame(nodes, "conv_id long, node_id long, parent_id long, role string, text string, score double").withColumn("leaf", F.lit(1)).withColumn("above", F.lit(2))
    made = chat.format_trees(df)
    back = made.withColumn("parts", chat.parse(F.col("formatted"))).select("*", F.transform("parts", chat.role_of).alias("roles"), F.transform("parts", chat.text_of_turn).alias("texts"))
    rows = {(r["conv_id"], r["leaf_id"]): r for r in back.collect()}
    assert set(rows) == {(1, 2), (1, 4), (2, 1), (None, 1)}
    best = rows[1, 4]
    assert best["rank"] == 1 and best["roles"] == ["user", "assistant", "user%\n<"] and best["texts"] == [hard, "c" + hard, ""]
    assert [best["formatted"][s["start"] : s["start"] + s["length"]] for s in best["spans"]][0] == "" and best["spans"][1]["length"] > 0
    assert chat.format_trees(df, best=1).count() == 3 and chat.format_trees(df.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert chat.parse(F.col("f")) is not None and len(chat.format_trees(chat.turns_as_tree(turns)).first()["spans"]) == 3


def test_mixing_targets_and_budget(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(500, None, "only"), (501, "x", None), (501, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(1)).withColumn("weight", F.lit(2))
    first, again = (sorted(map(tuple, mixing.mix(docs).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(rows)
    by = collections.defaultdict(list)
    for _, source, size, source_size, target, taken in first:
        by[source].append((size, source_size, target, taken))
        assert 0 <= taken <= 3 * size
    total = sum(s for v in by.values() for s, *_ in v)
    assert sum(v[0][2] for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert v[0][1] == sum(s for s, *_ in v) and v[0][2] <= 3 * v[0][1] + 1e-6 and abs(sum(t for *_, t in v) - v[0][2]) <= 1
    assert mixing.mix(docs.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, last = [i], row
        for j, d in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def line_rows():
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh éü") for _ in range(rng.randint(20, 60))) for _ in range(25)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(line))
                kind = rng.randrange(3)
                line[k : k + 1] = [] if kind == 0 else [rng.choice("xyz")] if kind == 1 else [line[k], rng.choice("xyz")]
            own.append("".join(line))
        rows.append((i, "\n".join(own)))
    return rows


def test_lines_against_all_pairs(spark):
    rows = line_rows()
    flat = [(d, p, line) for d, t in rows for p, line in enumerate(t.split("\n"))]
    gone = {(d, p) for d, p, line in flat if len(line) >= 24 and any((e, q) < (d, p) and len(o) >= 24 and abs(len(o) - len(line)) <= 2 and distance(o, line) <= 2 for e, q, o in flat)}
    got = {(r["doc"], r["pos"]) for r in lines.removals(frame(spark, rows)).collect()}
    assert got == gone and len(gone) > 20
    kept = {r["doc_id"]: r["text"] for r in lines.dedup(frame(spark, rows + [(100, None), (101, "")])).collect()}
    assert all(kept[d] == "\n".join(line for p, line in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in rows) and kept[100] is None and kept[101] == ""
    assert lines.removals(frame(spark, ODD)).count() == 0 and lines.dedup(frame(spark, ODD).limit(0)).count() == 0


def test_bands_against_plain_distance(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(1, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("abé")) if rng.random() < 0.5 else b and b.pop(rng.randrange(len(b)))
        if abs(len(a) - len(b)) <= 2:
            pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (0, 1, 2):
        near = [p for p in pairs if distance(*p) <= threshold]
        assert sorted(map(tuple, lines.within(df, "a", "b", threshold).select("a", "b").collect())) == sorted(near)


def test_decontamination(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnop"
    items = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(30))) for i in range(8)]
    docs = []
    for i in range(40):
        text = " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
        if i % 4 == 0:
            own = list(items[i % 8][1])
            for _ in range(i % 16):
                own[rng.randrange(len(own))] = rng.choice("XYZ")
            text = text[:100] + "  \n" + "".join(own).upper() + " " + text[100:]
        docs.append((i, text))
    docs += [(50, None), (51, ""), (None, items[0][1])]
    bench = spark.createDataFrame(items + [(90, None), (91, "  ")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    want = set()
    for d, t in docs:
        for i, item in items:
            n = decontaminate.least_distance(decontaminate.normal(item), decontaminate.normal(t))[0] if t else 10**6
            if n <= int(0.08 * len(item)):
                want.add((d, i, n))
    for chars in (1 << 20, 400):
        got = {tuple(r) for r in decontaminate.matches(frame(spark, docs), bench, broadcast_chars=chars).collect()}
        assert got == want and len(want) > 5
    clean = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in {w[0] for w in want})
    assert decontaminate.matches(frame(spark, docs), bench.limit(0)).count() == 0 and decontaminate.matches(frame(spark, docs).limit(0), bench).count() == 0


def plain_least(item, text):
    """The least distance of an item to any part of a text, by rows of the whole table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        row = _next(row, item, c)
        best = min(best, row[-1])
    return best


def _next(row, item, c):
    out = [0]
    for i, d in enumerate(item, 1):
        out.append(min(row[i - 1] + (d != c), row[i] + 1, out[-1] + 1))
    return out


def test_bit_parallel_distance_against_the_table():
    rng = random.Random(21)
    for _ in range(400):
        item, text = ("".join(rng.choice("abé") for _ in range(rng.randint(1, n))) for n in (80, 120))
        assert decontaminate.least_distance(item, text)[0] == plain_least(item, text)


def test_decontamination_of_short_overlapping_and_long(spark):
    rng = random.Random(22)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20))
    bench = spark.createDataFrame([(1, "the"), (2, "A  the"), (3, passage), (4, passage[50:]), (5, "the")], "item_id long, text string")
    long_text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30000))
    docs = frame(spark, [(1, "the the a the"), (2, "a the"), (3, "The"), (4, long_text + " " + passage), (5, long_text), (6, passage[50:]), (6, passage[50:])])
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(2, 2, 0), (3, 1, 0), (3, 5, 0), (4, 3, 0), (4, 4, 0), (6, 4, 0), (6, 4, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == [1, 5]


def test_language_model_mixture(spark, monkeypatch):
    """Scores recomputed from counts and the learned weights."""
    held = {}
    learn = ngrams._weights

    def kept(*args):
        held["w"] = learn(*args)
        return held["w"]

    monkeypatch.setattr(ngrams, "_weights", kept)
    rows = corpus(17, 60)
    docs = frame(spark, rows).withColumn("train", F.col("doc_id") % 10 != 0)
    got = {r["doc_id"]: r["score"] for r in ngrams.score(docs).collect()}
    token = {d: [w.lower() for w in t.split()] + [None] for d, t in rows}
    train = [ws for d, ws in token.items() if d % 10]
    one = collections.Counter(w for ws in train for w in ws)
    two = collections.Counter(p for ws in train for p in zip(["<start>", *ws], ws))
    n, v = sum(one.values()), len(one)
    weight = held["w"]
    assert np.allclose(weight.sum(axis=1), 1) and (weight >= 0).all()
    for d, ws in token.items():
        total = 0.0
        for before, w in zip(["<start>", *ws], ws):
            context = len(train) if before == "<start>" else one[before]
            a, b, c = weight[min(23, math.ceil(math.log2(context + 1)))]
            total += math.log10(a / (v + 1) + b * one[w] / n + (c * two[before, w] / context if context else 0.0))
        assert got[d] == pytest.approx(total)


def test_language_model(spark):
    rows = corpus(11, 80) + [(200, None), (201, ""), (202, "w " * 5000)] + [(None, "a b")]
    train = {d: d is not None and d % 10 != 0 for d, _ in rows}
    docs = frame(spark, rows).withColumn("train", F.coalesce(F.col("doc_id") % 10 != 0, F.lit(False)))
    got = {r["doc_id"]: r for r in ngrams.score(docs).collect()}
    token = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None] for d, t in rows}
    count = collections.Counter(w for d, ws in token.items() if train[d] for w in ws)
    n, v = sum(count.values()), len(count)
    for d, ws in token.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r["score"] < 0
    held = [d for d in token if d is not None and not train[d]]
    assert sum(got[d]["score"] for d in held) > sum(got[d]["base_score"] for d in held)
    assert ngrams.score(docs.limit(0)).count() == 0


def test_lines_of_repeated_rows_and_of_great_length(spark):
    rng = random.Random(31)
    long_line = "".join(rng.choice("abcdefgh ij") for _ in range(6000))
    near = long_line[:3000] + "X" + long_line[3001:4500] + long_line[4501:]
    apart = "".join(rng.choice("abcdefgh ij") for _ in range(6000))
    twice = "a line that stands here two times\na line that stands here two times\nanother line, of one place only"
    rows = [(1, twice), (1, twice), (2, long_line), (3, near + "\n" + apart), (4, "short"), (5, twice + "\n" + "short")]
    got = {(r["doc_id"], r["text"]) for r in lines.dedup(frame(spark, rows)).collect()}
    kept = "a line that stands here two times\nanother line, of one place only"
    assert got == {(1, kept), (2, long_line), (3, apart), (4, "short"), (5, "short")}
    assert lines.dedup(frame(spark, rows)).count() == len(rows)


def test_lines_of_one_family_have_a_witness(spark, monkeypatch):
    monkeypatch.setattr(lines, "PARTS", 3)
    base = "the same notice on every page, number {:03d}, of this edition and no other"
    rows = [(i, base.format(i)) for i in range(120)] + [(500, base.format(7)), (501, "x" * 30), (502, "x" * 28 + "yy")]
    flat = sorted(rows)
    gone = {d for d, line in flat if any(e < d and abs(len(o) - len(line)) <= 2 and distance(o, line) <= 2 for e, o in flat)}
    assert {r["doc"] for r in lines.removals(frame(spark, rows)).collect()} == gone and len(gone) > 100


def test_lines_by_shuffled_lookups(spark, monkeypatch):
    """Beyond what is broadcast, with hot lines, the result is the same."""
    rows = line_rows() + [(1000 + i, "a line that very many documents share") for i in range(200)]
    want = sorted(map(tuple, lines.removals(frame(spark, rows), short=True).collect()))
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    monkeypatch.setattr(lines, "HOT_LINES", 20)
    assert sorted(map(tuple, lines.removals(frame(spark, rows), short=True).collect())) == want


def test_chat_and_mixing_of_long_texts(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} <s>") for i in range(700)] + [(2, 0, "user", "x"), (2, 1, "assistant", "[INST] long " * 20000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    back = chat.format_trees(chat.turns_as_tree(df)).withColumn("parts", chat.parse(F.col("formatted"))).select("conv_id", F.transform("parts", chat.text_of_turn).alias("texts")).collect()
    assert {r["conv_id"]: r["texts"] for r in back} == {c: [t for d, _, _, t in turns if d == c] for c in (1, 2)}
    docs = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "v", "a"), (3, "u " * 10, "b")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {1: 300_000, 2: 1, 3: 10}
