import random

from fixtures import prose

from sedge.llm import quotation

SCHEMA = "conv_id long, turn long, role string, text string, thread int, position int, hash int"


def test_parse_levels():
    own, quoted = quotation.parse("On Monday, Ann wrote:\n> b one\n> b two\n>> a\n>  \nmine\n > late\nend")
    assert own == "mine\nend"
    assert quoted == [(1, ["b one", "b two"]), (2, ["a"]), (1, [" "]), (1, ["late"])]
    assert quotation.parse(None) == ("", []) and quotation.parse("") == ("", [])


def make(seed=0, n=12, turns=14):
    """Conversations with known replies; quotations of whole texts or of single lines."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for c in range(n):
        bodies = []
        for t in range(turns):
            own = [prose(rng, rng.randint(4, 9)) for _ in range(rng.randint(1, 3))]
            text, parent = "\n".join(own), None
            if t and rng.random() < 0.7:
                parent = rng.randrange(t)
                lines = rng.choice([bodies[parent], [rng.choice(bodies[parent])]])
                quote = "\n".join("> " + x.upper() for x in lines)
                if truth[c, parent] is not None:
                    quote += "\n" + "\n".join(">> " + x for x in bodies[truth[c, parent]])
                text = f"Someone wrote:\n{quote}\n{text}"
            truth[c, t] = parent
            bodies.append(own)
            rows.append((c, t, "user", text, "\n".join(own)))
    return rows, truth


def test_replies_threads_and_order(spark):
    rows, truth = make()
    df = spark.createDataFrame([(*r[:4], 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    got = {(r.conv_id, r.turn): r for r in quotation.reply_order(df).collect()}
    assert len(got) == len(rows)

    def root(c, t):
        return t if truth[c, t] is None else root(c, truth[c, t])

    for c, t, _, _, own in rows:
        r = got[c, t]
        assert (r.reply_to, r.thread, r.text) == (truth[c, t], root(c, t), own)
    for c in {r[0] for r in rows}:
        order = sorted((root(c, t), t) for k, t in truth if k == c)
        assert [got[c, t].position for _, t in order] == list(range(len(order)))


def test_latest_earlier_message_counts(spark):
    rows = [(1, 0, "a", "yes"), (1, 1, "b", "yes"), (1, 2, "a", "> yes\nno"), (1, 3, "b", "yes"), (2, 0, "a", "> yes\n> unseen"), (2, 1, "a", "> yes\n> unseen")]
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_quoted) for r in quotation.reply_order(spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA)).collect()}
    assert got == {(1, 0): (None, 0), (1, 1): (None, 0), (1, 2): (1, 1), (1, 3): (None, 0), (2, 0): (None, 1), (2, 1): (None, 1)}


def test_awkward_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "u", ""), (None, 1, "u", "x"), (1, None, "u", "> x"), (5, 5, "u", "w " * 50_000), (5, 6, "u", "> " + "w " * 50_000)]
    got = quotation.reply_order(spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA)).collect()
    assert len(got) == 7 and sorted(r.position for r in got if r.conv_id == 1) == [0, 1, 2, 3]
    assert [r.reply_to for r in got if (r.conv_id, r.turn) == (5, 6)] == [5]
    assert quotation.reply_order(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_levels_are_linked(spark):
    rows = [(1, 0, "a", "red fox"), (1, 1, "b", "> red fox\nblue owl"), (1, 2, "a", "> blue o... cut\n>> red fox\nsure"), (1, 3, "b", "> blue owl\n>> red fox\n>>> unseen\n> blue owl\nend"), (1, 4, "a", ">> unseen\n>>> blue owl\nlast")]
    got = {r.turn: r for r in quotation.reply_order(spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SCHEMA)).collect()}
    assert {t: r.reply_to for t, r in got.items()} == {0: None, 1: 0, 2: 0, 3: 1, 4: 1}
    assert {r.thread for r in got.values()} == {0}
    sources = {t: r.sources and [tuple(s) for s in r.sources] for t, r in got.items()}
    assert sources == {0: None, 1: [(0, 1, 0, 2)], 2: [(1, 2, 0, 2)], 3: [(0, 1, 1, 2), (1, 2, 0, 2), (3, 1, 1, 2)], 4: [(1, 3, 1, 2)]}
