import random
import re

from pyspark.sql import functions as F

from plotline.llm import line_dedup


def shingles(line):
    n = max(len(line) - line_dedup.SHINGLE + 1, 1)
    return {line[i:i + line_dedup.SHINGLE] for i in range(n)}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


def components(lines):
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(lines):
        for j in range(i):
            if similar(a, lines[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(lines))]


def changed(rng, line, edits):
    chars = list(line)
    for _ in range(edits):
        chars[rng.randrange(len(chars))] = rng.choice("abcdef é")
    return "".join(chars)


def test_similar_lines_against_brute_force(spark):
    rng = random.Random(11)
    syllables = ["th", "nd", "er", "in", "re", "ation", "é", " of ", " the ", "漢", "\U0001f600"]
    lines = set()
    for size in (2, 5, 9, 14, 20, 30, 60, 140):
        for _ in range(12):
            base = "".join(rng.choices(syllables, k=size))
            lines.add(base)
            for edits in (1, 1, 2, 3):
                lines.add(changed(rng, base, edits))
                lines.add(base[:len(base) - edits] or "x")
    template = "".join(rng.choices(syllables, k=80))  # one dense group: near copies of one line, some of them strays
    lines |= {changed(rng, template, rng.randint(1, 4)) for _ in range(60)}
    lines |= {"-" * k for k in (10, 40, 41, 300, 310)}
    lines |= {"=+" * k for k in (9, 60)} | {"abcdefghijklmnopq" * k for k in (3, 4, 30)}  # few shingles, many times
    lines = sorted(lines)
    table = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    roots = {r.node: r.root for r in line_dedup.similar_lines(table).collect()}
    want = components(lines)
    got = [roots.get(i, i) for i in range(len(lines))]
    split = [i for i, (g, w) in enumerate(zip(got, want)) if g != w]
    merged = {g: {want[i] for i in range(len(lines)) if got[i] == g} for g in set(got)}
    assert all(len(w) == 1 for w in merged.values())  # never a false link
    assert len(split) <= 0.01 * len(lines)
    short = [i for i in range(len(lines)) if len(shingles(lines[i])) < line_dedup.LONG * 0.8]
    assert not set(short) & set(split)  # exact for short lines


def test_large_bucket_of_unlike_lines_misses_no_pair(spark, monkeypatch):
    """All lines share their band keys and are below 0.8 to the leader and to each other, but for planted pairs."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    template = "".join(rng.choices(letters, k=150))
    lines = [template + "".join(rng.choices(letters, k=40)) for _ in range(3000)]
    assert not any(similar(lines[0], x) for x in lines[1:])
    planted = {}
    for k in rng.sample(range(1, 3000), 200):  # an end is cut off or changed: 0.8 or a little more
        planted[len(lines)] = k
        lines.append(lines[k][:-rng.randint(1, 30)] if k % 2 else changed(rng, lines[k], 2))
    planted = {a: b for a, b in planted.items() if similar(lines[a], lines[b])}
    assert len(planted) > 150
    monkeypatch.setattr(line_dedup, "band_keys", lambda t: t.select(F.lit(7).cast("long").alias("key"), "lid"))
    order = list(range(len(lines)))
    rng.shuffle(order)
    table = spark.createDataFrame([(k, lines[i]) for k, i in enumerate(order)], "lid long, line string")
    place = {i: k for k, i in enumerate(order)}
    roots = {r.node: r.root for r in line_dedup.similar_lines(table).collect()}
    missed = [a for a, b in planted.items() if roots.get(place[a], -1) != roots.get(place[b], -2)]
    assert not missed
    assert len(roots) <= 2 * 200  # no false links


def test_unlike_long_lines_do_not_leave_the_prefix_join(spark):
    """Lines of about 630 characters that share half of their segments: each meets each on some rare shingle."""
    rng = random.Random(9)
    segments = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=45)) for _ in range(21)]
    lines = ["".join(segments[i] for i in sorted(rng.sample(range(21), 14))) for _ in range(60)]
    lines += [changed(rng, lines[k], 3) for k in range(5)]
    like = {(i, j) for j in range(len(lines)) for i in range(j) if similar(lines[i], lines[j])}
    assert len(like) >= 5
    open_ = spark.createDataFrame([(i, i, True) for i in range(len(lines))], "lid long, root long, stray boolean")
    rows = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    met = line_dedup._prefix_pairs(open_, rows, 0.8).collect()
    got = {(min(r.x, r.y), max(r.x, r.y)) for r in met}
    assert like <= got  # none is lost
    assert len(got - like) <= 0.1 * len(lines) * (len(lines) - 1) / 2


def test_rounds_read_only_lines_that_share_a_bucket(spark, monkeypatch):
    rng = random.Random(3)
    lines = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=90)) for _ in range(200)]
    lines += [changed(rng, lines[k], 1) for k in range(10)]
    read, check = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, texts, least: read.append(texts.count()) or check(pairs, texts, least))
    rows = spark.createDataFrame(list(enumerate(lines)), "lid long, line string")
    roots = {r.node: r.root for r in line_dedup.similar_lines(rows).collect()}
    assert all(roots[200 + k] == k for k in range(10))
    assert read and max(read) < 40  # not all 210 lines, whose texts every round would shuffle


def table(spark):
    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(12))
    a, b, c, d = line(), line(), line(), line()
    rows = [(5, f"{a}\n\n{b}"), (2, f"{b[:-1]}x\n{c}\n{c}"), (9, a), (1, None), (3, ""), (4, " \n "), (7, f"{d}\r\n{c}!"),
            (7, f"{c}\nfresh words"), (8, f"{d}"), (8, f"{d}"), (None, f"{d}\nonly here"), (6, "long " * 30_000)]
    return rows, spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, tag string, gone int")


def expected(rows):
    """First occurrences by (doc_id, text hash, line); here texts of one id never compete, so the hash is left out."""
    spots = sorted({(i is not None, i or 0, t, k, x) for i, t in rows if t for k, x in enumerate(t.split("\n")) if x.strip()},
                   key=lambda s: s[:2] + (s[3],))
    root = components([s[-1] for s in spots])
    lost = {s[:4] for s, r in zip(spots, root) if spots[r][:4] != s[:4] and s[0]}
    out = []
    for i, t in rows:
        parts = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(parts) if (i is not None, i or 0, t, k) not in lost]
        out.append((i, None if t is None else "\n".join(kept), len(parts), len(parts) - len(kept)))
    return out


def test_texts_keep_one_line_of_each_component(spark):
    rows, docs = table(spark)
    got = [tuple(r) for r in line_dedup.dedup_lines(docs).collect()]
    want = expected(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(re.fullmatch(r"fresh words|.+\nfresh words", t) for i, t, *_ in got if i == 7 and "fresh" in t)
    stage = line_dedup.without_repeated_lines(docs)
    assert stage.schema.names == docs.schema.names
    kept = sorted(((r.doc_id, r.text) for r in stage.collect()), key=str)
    assert kept == sorted(((i, t) for i, t, _, gone in want if not gone or t.strip()), key=str)


def test_empty_table_and_plan(spark):
    _, docs = table(spark)
    assert line_dedup.dedup_lines(docs.filter(F.lit(False))).count() == 0
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
