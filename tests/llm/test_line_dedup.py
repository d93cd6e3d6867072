"""Line dedup against brute force over all pairs of lines."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lectio.llm import blocks, line_dedup


def normal(line):
    return re.sub(r"\s+", " ", line.lower()).strip(" ")


def shingle_set(line):
    return {line[i : i + line_dedup.SHINGLE] for i in range(max(1, len(line) - line_dedup.SHINGLE + 1))}


def slow(rows):
    """{(doc_id, pos)} of the lines that go."""
    places = {}
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if normal(line):
                places.setdefault(normal(line), []).append((-1 if i is None else i, pos))
    lines = list(places)
    sets = [shingle_set(x) for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) >= line_dedup.MIN_SHINGLES:
                common = len(sets[a] & sets[b])
                if common >= line_dedup.SIMILARITY * (len(sets[a]) + len(sets[b]) - common):
                    root[find(a)] = find(b)
    groups = {}
    for k, line in enumerate(lines):
        groups.setdefault(find(k), []).extend(places[line])
    return {p for g in groups.values() for p in sorted(g)[1:]}


def corpus(seed, n_docs=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 45))] for _ in range(40)]
    rows = []
    for i in range(n_docs):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", "  "]).join(words).upper() if rng.random() < 0.1 else " ".join(words))
            lines += [""] * (rng.random() < 0.2)
        rows.append((i * 3 + 1, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("pairs", [16, 3])
def test_lines(spark, monkeypatch, pairs):
    monkeypatch.setattr(line_dedup, "ALL_PAIRS", pairs)
    rows = [*corpus(1), (0, None), (500, ""), (501, "x " * 50_000 + "end")]
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n_dropped int, n_chars string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(got) == len(rows)
    gone = slow(rows)
    for i, text in rows:
        if text is None:
            assert got[i].text is None and got[i].n_lines == 0
            continue
        lines = text.split("\n")
        expected = "\n".join(x for pos, x in enumerate(lines) if (i, pos) not in gone)
        assert got[i].n_lines == len(lines)
        assert got[i].text == expected


def test_no_rows_and_repeated_rows(spark):
    rows = [(1, "same line here again and again\nother"), (1, "same line here again and again\nother"), (2, "Same  line here again and again"), (None, "solo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs).collect())
    assert got == [(0, "solo", 0), (1, rows[0][1], 0), (1, rows[0][1], 0), (2, "", 1)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_only_the_text_passes_are_python(spark):
    """Lines are cut and pairs compared in Arrow batches; what decides and drops is DataFrame functions."""
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "MapInArrow" in line_dedup.cut(docs)._jdf.queryExecution().toString()


def test_recall_by_bands():
    rng = random.Random(3)
    found = total = 0
    for _ in range(400):
        line = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(60, 200)))
        k = rng.randrange(len(line))
        other = line[:k] + "#" + line[k + rng.randrange(2) :]
        a, b = line_dedup.shingle_set(line), line_dedup.shingle_set(other)
        if len(a & b) >= 0.8 * len(a | b):
            bands, has = line_dedup.band_hashes([line, other])
            assert has.all()
            total += 1
            found += bool((bands[0] == bands[1]).any())
    assert total > 200 and found >= 0.99 * total


def test_pairs_are_verified_as_sets_are():
    rng = random.Random(7)
    lines = ["", "short", "exactly8", "aaaaaaaaaaaaaaaaaaaaaaaaa", "éèê" * 9] + ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    long = ["".join(rng.choice("abcd ") for _ in range(rng.randint(20, 90))) for _ in range(80)]
    first = len(lines)
    lines += long + [x[:-1] + "z" for x in long]
    a, b = (np.array([rng.randrange(len(lines)) for _ in range(line_dedup.PAIRS)]) for _ in range(2))
    a[:80], b[:80] = np.arange(first, first + 80), np.arange(first + 80, first + 160)
    got = line_dedup.close(lines, a, b)
    for x, y, near in zip(a, b, got, strict=True):
        p, q = shingle_set(lines[x]), shingle_set(lines[y])
        assert near == (min(len(p), len(q)) >= 4 and len(p & q) >= 0.8 * len(p | q))
    assert 20 < got.sum() < len(got)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Lines of lower similarity that fill large buckets are told apart, those outside a bucket's largest part included."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    base = words(20)
    rows = []
    for i in range(120):
        line = list(base)
        for k in rng.sample(range(20), 3):
            line[k] = words(1)[0]
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(line)[:-1] + "#")]
    expected = {i for i, _ in slow(rows)}
    for block, anchors in ((1024, 16), (8, 2)):
        monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
        monkeypatch.setattr(blocks, "ANCHORS", anchors)
        got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_dropped}
        assert got == expected


def test_columns_of_any_name(spark):
    rows = [(1, "the same line of text here\nother", 1, 2, 3, 4), (2, "the same line of text here", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r1 int, r2 int, `drop` int, place int")
    got = sorted(map(tuple, line_dedup.dedup_lines(docs).select(*docs.columns).collect()))
    assert got == [rows[0], (2, "", 1, 2, 3, 4)]


def test_two_lines_that_share_a_key_stay_two(spark):
    place = lambda i: [(i, 0, i, i)]
    rows = [(5, 1, "first line", 1, [], place(1)), (5, 2, "second line", 1, [], place(2)), (5, 2, "second line", 1, [], place(3)), (6, 1, "third", 1, [], place(4))]
    lines = spark.createDataFrame(rows, "k1 long, k2 long, line string, n long, bands array<long>, places array<struct<doc_id:long,pos:int,r1:long,r2:long>>")
    lines, signed = line_dedup.told_apart(lines, line_dedup.signatures(lines))
    assert lines.select("k1", "line").distinct().count() == signed.count() == 3
    assert {r.n for r in signed.collect()} == {1, 2}


def test_large_buckets_lose_no_pair(spark):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    rows = []
    for size, slots, values in ((24, 3, 10), (30, 3, 30), (40, 4, 12)):
        base, choices = words(size), [words(values) for _ in range(slots)]
        for _ in range(250):
            line = list(base)
            for k, choice in enumerate(choices):
                line[k * size // slots + 2] = rng.choice(choice)
            rows.append((len(rows), " ".join(line)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.n_dropped}
    assert got == {i for i, _ in slow(rows)}


def test_shingles_start_at_every_character(spark):
    urls = [" ".join(f"https://{site}{k}.example/{k * 977}" for k in range(4)) for site in ("alpha", "beta", "gamma")]
    pairs = ["abcdefghij klmnopqrst uvwxyz12", "abcdefghij klmnopqrst uvwxyz13", "x" * 9, "x" * 12, "tiny", "tiny", "tine"]
    long = "".join(random.Random(2).choices("0123456789", k=60))
    rows = [*enumerate([*urls, *pairs, long, long[:-1] + "x", "Z\u2028" + long]), *((i + 100, t) for i, t in corpus(3))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    gone = slow(rows)
    assert {i for i, _ in gone if i < 100} == {4, 8, 11, 12}
    assert got == {i: "\n".join(x for pos, x in enumerate(t.split("\n")) if (i, pos) not in gone) for i, t in rows}


def test_no_step_runs_python(spark, monkeypatch):
    """Every table on the way is DataFrame functions; lines of one bucket that are apart are verified too, from texts and from sets made once."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    base = words(20)
    rows = []
    for i in range(60):
        line = list(base)
        for k in rng.sample(range(20), 3):
            line[k] = words(1)[0]
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(line)[:-1] + "#")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, labels = [], []

    def recorded(df, label, stays=False, write=line_dedup.written):
        plans.append(df._jdf.queryExecution().toString())
        labels.append(label)
        return write(df, label, stays)

    monkeypatch.setattr(line_dedup, "written", recorded)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 16)
    for repeated, held in ((0, 1 << 30), (1 << 30, 0)):
        monkeypatch.setattr(line_dedup, "REPEATED", repeated)
        monkeypatch.setattr(line_dedup, "HELD", held)
        labels.clear()
        got = {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.n_dropped}
        assert got == {i for i, _ in slow(rows)}
        assert "line-apart" in labels and ("line-sets" in labels) == (held > 0)
    assert not [p for p in plans if re.search("Python|Pandas|Arrow", p)]


def test_every_position_of_any_text(spark):
    lines = ["", "short", "exactly8", "a" * 30, "éèê" * 9, "\U0001f600 emoji \U0001f601\U0001f602 \U0001f600 emoji \U0001f601", "漢字かな交じり文の一行です。", "x1 " * 500]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    first = "".join(line_dedup.SAMPLED[1])
    sizes = {r.i: (r.n, r.m) for r in rows.selectExpr("i", "line").select("i", line_dedup.F.size(line_dedup.F.array_distinct(line_dedup.every(line_dedup.F.col("line")))).alias("n"), line_dedup.F.size(line_dedup.F.array_distinct(line_dedup.beginning(line_dedup.F.col("line"), first))).alias("m")).collect()}
    for i, line in enumerate(lines):
        full = {s for s in shingle_set(line) if len(s) == line_dedup.SHINGLE}
        assert sizes[i] == (len(full), sum(s[0] in first for s in full))


def test_similar_lines_share_a_key(spark):
    """Lines of any length and kind of characters, at similarities of 0.8 and more, and a line with its own repetition."""
    rng = random.Random(3)
    pairs = []
    while len(pairs) < 1500:
        alphabet = rng.choice(["abcdefghijklmnopqrstuvwxyz     ", "0123456789abcdef ", "etaoin shrdlu ", "漢字仮名交文一行表示試験用"])
        line = "".join(rng.choice(alphabet) for _ in range(rng.randint(12, 600))).strip() or "x"
        other = line
        for _ in range(rng.randint(1, 1 + len(line) // 70)):
            k = rng.randrange(len(other))
            other = other[:k] + "#" * rng.randrange(3) + other[k + rng.randrange(3) :]
        a, b = shingle_set(line), shingle_set(other)
        if line != other and min(len(a), len(b)) >= 4 and len(a & b) >= 0.8 * len(a | b):
            pairs.append((line, other))
    pairs += [(x, " ".join([x] * 10)) for x, _ in pairs if len(x) > 150][:100]
    rows = [(2 * i + k, " ".join(line.split())) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    placed = line_dedup.placed(spark.createDataFrame(rows, "doc_id long, text string"))
    keys = {r.i: set(r.bands) for r in placed.selectExpr("places[0].doc_id AS i", "bands").collect()}
    assert all(len(k) <= 2 * line_dedup.SKETCH for k in keys.values())
    lost = [pair for i, pair in enumerate(pairs) if not keys[2 * i] & keys[2 * i + 1]]
    print("lost", len(lost), "of", len(pairs), [len(a) for a, _ in lost])
    assert len(lost) <= 0.005 * len(pairs)


def family(lines, words, seed):
    """Lines of a family, in each of which so many other words stand for those of the first: a few are similar, most are just not."""
    rng = random.Random(seed)
    other = lambda: "".join(rng.choice("abcdefghijou") for _ in range(7))
    base = [other() for _ in range(40)]
    rows = []
    for i in range(lines):
        line = list(base)
        for k in rng.sample(range(40), rng.randint(*words)):
            line[k] = other()
        rows.append((i, " ".join(line)))
    return rows


def test_a_family_is_not_compared_line_by_line(spark, monkeypatch):
    """Lines that share only what all lines of their family have aren't paired, whatever shingles are counted, and no pair is lost."""
    rows = family(160, (0, 7), 5)
    rows += [(i + 1000, line[:-1] + "#") for i, line in rows[::9]]
    tried = []

    def recorded(df, label, stays=False, write=line_dedup.written):
        out = write(df, label, stays)
        if label == "line-apart":
            tried.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", recorded)
    expected = {i for i, _ in slow(rows)}
    for counted in (1 << 20, 40, 1):
        monkeypatch.setattr(line_dedup, "BLOCK_LINES", counted)
        got = {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.n_dropped}
        assert got == expected and 20 < len(got) < len(rows)
    assert len(tried) == 3 and tried[0] < len(rows)


def test_tables_on_the_way_go(spark, monkeypatch):
    left = {}

    def recorded(df, label, stays=False, write=line_dedup.written):
        out = write(df, label, stays)
        left[out.written_to] = label
        return out

    monkeypatch.setattr(line_dedup, "written", recorded)
    rows = family(60, (0, 7), 6)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    exists = lambda path: spark._jvm.java.io.File(path.removeprefix("file:").replace("//", "/")).exists()
    assert "line-cut" in left.values() and [label for path, label in left.items() if exists(path)] == ["line-drops"]
    assert {r.doc_id for r in out.collect() if r.n_dropped} == {i for i, _ in slow(rows)}
