from hypothesis import given
from hypothesis import strategies as st

from loam.llm import pagediff as D


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_longest_common_subsequence(a, b):
    shared = sorted(D.shared_lines(a, b))
    assert len(shared) == longest(a, b)
    it = iter(b)
    assert all(a[i] in it for i in shared)  # the shared lines stand in the other one in their order


def test_nearness():
    assert D.nearness("h/a/x", "h/a/y") > D.nearness("h/a/x", "h/b/x") > D.nearness("h/a/x", "g/a/x") == (-1, 0)
    assert D.nearness("C:\\a\\x1", "C:\\a\\x2") > D.nearness("C:\\a\\x1", "C:\\a\\y")


def test_table(spark):
    page = lambda body: f"Menu\nHome\n\n{body}\n\nImprint"
    rows = [("h/a/1", page("one"), ""), ("h/a/2", page("two"), ""), ("h/b/3", page("three"), ""), ("g/x", page("alone"), ""), ("h/a/0", None, ""), (None, page("x"), ""), ("h/e", "", "")]
    frame = spark.createDataFrame(rows, "path string, content string, nearest string")
    for parts in (1, 4):
        got = {r.path: (r.nearest, r.shared, r.content) for r in D.differenced(frame.repartition(parts)).collect()}
        assert got["h/a/1"] == ("h/a/2", 3, "one") and got["h/a/2"][1:] == (3, "two") and got["g/x"] == (None, 0, page("alone")) and got["h/a/0"] == (None, 0, None)
        assert len(got) == 6
    assert D.differenced(frame.limit(0)).count() == 0
