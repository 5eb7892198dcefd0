import random

from hypothesis import given
from hypothesis import strategies as st

from tillspark.llm import chat

TURNS = st.lists(st.tuples(st.text(max_size=8), st.text(alphabet=st.sampled_from("\\#<:/ntur>\n a"), max_size=30)), max_size=5)


@given(TURNS)
def test_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def best_path(rows):
    """Brute force: all root-to-leaf paths of one tree by their total score."""
    parent = {m: p for m, p, _ in rows}
    score = {m: s for m, _, s in rows}
    parents = set(parent.values())
    best = None
    for leaf in parent:
        if leaf in parents:
            continue
        path, at = [], leaf
        while at in parent and at not in path:
            path.append(at)
            at = parent[at]
        if at in path:
            continue
        key = (-sum(score[m] for m in path), -len(path), leaf)
        best = min(best, (key, path[::-1])) if best else (key, path[::-1])
    return best[1] if best else []


def test_best_paths_match_brute_force(spark):
    r = random.Random(6)
    trees = {}
    for t in range(12):
        n = r.randrange(1, 40)
        trees[t] = [(m, r.randrange(m) if m and r.random() < 0.9 else None, float(r.randrange(4))) for m in range(n)]
    trees[50] = [(m, m - 1 if m else None, 1.0) for m in range(100)]
    trees[51] = [(1, 2, 1.0), (2, 1, 1.0), (3, None, 1.0), (4, 99, 5.0)]
    rows = [(t, m, p, s) for t, of in trees.items() for m, p, s in of]
    rows += rows[:5]
    messages = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, score double")
    got = {}
    for x in chat.best_paths(messages).orderBy("tree_id", "position").collect():
        got.setdefault(x["tree_id"], []).append(x["message_id"])
    assert got == {t: best_path(of) for t, of in trees.items()}


def test_one_row_of_a_repeated_message_id_counts(spark):
    rows = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "second", 5.0), (1, 2, 1, "assistant", "first", 2.0), (1, 3, 1, "assistant", "other", 3.0)]
    schema = "tree_id long, message_id long, parent_id long, role string, text string, score double"
    for order in (rows, rows[::-1]):
        out = chat.format_trees(spark.createDataFrame(order, schema).repartition(3)).collect()
        assert [chat.parse(r["formatted"]) for r in out] == [[("user", "hi"), ("assistant", "other")]]
        both = chat.format_trees(spark.createDataFrame(order, schema), branches=2).where("branch = 2").head()
        assert chat.parse(both["formatted"])[1] == ("assistant", "first")


def test_linear_rows_nulls_and_ties(spark):
    rows = [(1, 0, "user", "a", "x"), (1, 1, None, None, "x"), (1, 1, "assistant", "b", "x"), (1, 1, "assistant", "b", "x"), (None, None, "user", "", "x"), (3, 5, "assistant", "<\\#", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score string")
    out = {r["tree_id"]: (chat.parse(r["formatted"]), r["loss_spans"], r["formatted"]) for r in chat.format_trees(chat.linear(table)).collect()}
    assert out[1][0] == [("user", "a"), ("", ""), ("assistant", "b"), ("assistant", "b")]
    assert out[None][0] == [("user", "")]
    formatted, span = out[3][2], out[3][1][0]
    assert chat.unescape(formatted[span["start"] : span["stop"]]) == "<\\#"
    assert chat.format_trees(chat.linear(table.limit(0))).collect() == []
