import random
import re
from collections import Counter

from fixtures import SCHEMA, documents, prose

from sedge.llm import line_dedup


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows):
    lines = []
    for i, t in {(r[0], r[1]) for r in rows}:
        for k, line in enumerate((t if t is not None else "").split("\n")):
            words = re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ").split(" ")
            if len(words) >= 3:
                lines.append((i, k, words))
    lines.sort(key=lambda x: x[:2])
    out = []
    for at, (i, k, w) in enumerate(lines):
        for j, m, v in lines[:at]:
            if v == w or (min(len(v), len(w)) >= 8 and distance_one(v, w)):
                out.append((i, k, j, m, int(v != w)))
                break
    return out


def rows_with_near_lines():
    rng = random.Random(8)
    rows = [r[:2] for r in documents()]
    base = [prose(rng, n) for n in (2, 3, 7, 8, 9, 15, 40) for _ in range(3)]
    for d in range(200, 260):
        own = []
        for line in rng.sample(base, 6):
            w = line.split()
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + ["new"] + w[i:], w[:i] + w[i + 1 :], w[:i] + [prose(rng, 1)] + w[i + 1 :], w])
            own.append(rng.choice([" ", "", "\t"]) + "  ".join(w).upper())
        rows.append((d, "\n".join(own)))
    return rows


def test_matches_brute_force(spark):
    rows = rows_with_near_lines()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, line int, n int, keys int").repartition(5)
    got = list(map(tuple, line_dedup.repeated_lines(df).collect()))
    twice = Counter(r[:1] for r in rows)
    assert Counter(got) == Counter({r: twice[r[:1]] for r in brute(rows)}) and len({r[4] for r in got}) == 2
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    gone = {r[:2] for r in got}
    for i, t in rows:
        assert texts[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert line_dedup.repeated_lines(df).collect() == [] and line_dedup.dedup_lines(df).collect() == []


def test_every_line_is_judged(spark):
    long = "\u6211\u4eec\u4eca\u5929\u53bb\u5317\u4eac\u770b\u957f\u57ce"
    rows = [(1, f"Home\n{long}\n\nsee also"), (2, f"home\n \n{long}\n  See  also"), (3, f"{long[:4]}\u4e0a{long[5:]}\n\nnew"), (4, f"{long[:7]}\n{long[:6]}\u4e0a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.repeated_lines(df, every=True).collect()))
    assert got == [(2, 0, 1, 0, 0), (2, 2, 1, 1, 0), (2, 3, 1, 3, 0), (3, 0, 1, 1, 1)]
    assert [r.text for r in line_dedup.dedup_lines(df, every=True).orderBy("doc_id").collect()] == [rows[0][1], " ", "\nnew", rows[3][1]]


def test_repeated_ids_keep_their_own_text(spark):
    """Lines go by the row they stand in, not by an id that several rows have."""
    head = "one shared line of words"
    rows = [(1, head, 9), (2, head, 9), (2, "only here one two three", 9), (None, f"{head}\nlast words of all", 9), (3, f"a b c\na b c\n{head}", 9), (3, f"a b c\na b c\n{head}", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines_gone int")
    got = sorted(map(tuple, line_dedup.dedup_lines(df).collect()), key=repr)
    assert got == sorted([(1, head, 0), (2, "", 1), (2, rows[2][1], 0), (None, "last words of all", 1), (3, "a b c", 2), (3, "a b c", 2)], key=repr)


def test_many_lines_share_a_half(spark):
    """A template that many lines share: one group, no pairs but with its earliest."""
    lines = [f"status of the job that ran on host {i} was checked and found good by unit {i * 7}" for i in range(3000)]
    df = spark.createDataFrame([(i, "\n".join(lines[i * 100 : i * 100 + 100])) for i in range(30)], "doc_id long, text string")
    assert line_dedup.repeated_lines(df).collect() == []
    more = spark.createDataFrame([(99, "\n".join(x.replace("unit ", "unit x") for x in lines))], "doc_id long, text string")
    got = line_dedup.repeated_lines(df.union(more)).collect()
    assert len(got) == 3000 and all(r.edits == 1 and r.of_doc_id * 100 + r.of_line_no == r.line_no for r in got)
