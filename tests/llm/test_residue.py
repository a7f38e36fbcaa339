from collections import Counter

import pytest

from loam.llm import residue as R


class Flat(dict):
    """Weights as a corpus of ordinary text gives them: common words weigh little."""

    COMMON = {"the", "to", "this", "a", "of", "and", "is", "was", "not", "on", "in", "you", "your", "have", "it", "may", "been", "or", "for", "try", "again", "please"}

    def __missing__(self, term):
        return 1.0 if term[0] == "\x01" or term in self.COMMON else 6.0


@pytest.fixture(scope="module")
def index():
    return R.Index(Flat(), frozenset({"city", "customer", "title", "your_name", "date", "дата", "owner"}), [])


@pytest.mark.parametrize(
    "text, label",
    [
        ("Please enable JavaScript to view this document.", "script"), ("A | B | C\nYour browser is not supported. Update it to open shared notes.", "script"), ("您的浏览器不支持脚本，无法显示内容。", "script"), ("Checking your browser before opening zulin.", "script"),
        ("<html><body><h1>Access denied</h1>Access denied</body></html>", "error"), ("502 页面不存在", "error"), ("honur.test refused the request.", "error"), ("Ошибка 504: страница не найдена.", "error"), ("Gateway timed out (429)", "error"), ("服务器内部错误（404），请稍后再试。编号 c5", "error"),
        ("Head\n\nLorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"), ("Text goes here. Text goes here.", "filler"), ("测试测试测试。测试测试测试。", "filler"),
        ("Project: <%= city %>", "placeholder"), ("ask [INSERT customer] now", "placeholder"), ("x {{ title }} y", "placeholder"), ("【Your Name】", "placeholder"), ("Date: %DATE%", "placeholder"), ("a {DATE} b", "placeholder"), ("Дата: __ДАТА__", "placeholder"), ("<owner here>", "placeholder"), ("[[customer]]", "placeholder"), ("XXDATEXX", "placeholder"),
        ("The header template reads `{{ title }}` and `${owner}`; the build fills both.", None), ("```\n<h1>{{ title }}</h1>\nexport x=${HOME}/idx\n```\nfine", None), ("So 504 (Gateway Timeout) came from Zeind, not from us.", None), ("Our page saver stored 302 pages that only asked readers to enable JavaScript, and 26 that said Access denied; we dropped them.", None),
        ("print(key, x[key] * 2)  # y", None), ("100 % of it % done {see Klia} [sic] [16]", None), ("2025-01-01 ERROR merge: skip status=404", None), ("", None), (None, None), ("   \n", None), ("xxxxxxxx", None),
    ],
)
def test_label(index, text, label):
    assert index.residue(text) == label


def test_no_single_term_is_needed(index):
    # each exemplar without its weightiest term: found wherever the rest still passes the thresholds
    missed, able = [], 0
    for label, ts in R.seeds():
        own = {t: index.weights[t] * n for t, n in Counter(ts).items()}
        top = max(own, key=own.get)
        if any("㐀" <= t[0] <= "鿿" for t in ts) or sum(own.values()) - own[top] < R.CONTAINED * sum(own.values()):
            continue
        able += 1
        passage = " ".join(t for t in ts if t != top)
        if index.residue(passage) is None:
            missed.append(passage)
    assert able and not missed


def test_table(spark):
    rows = spark.createDataFrame([(1, "Access denied", ""), (2, None, ""), (3, "", ""), (4, "Real text about access.", ""), (5, "word " * 100_000 + "\nAccess denied", ""), (1, "Access denied", "")] + [(k, f"sound text number {k}", "") for k in range(10, 40)], "doc_id long, text string, label string")
    got = {r.doc_id: r.label for r in R.labelled(rows).collect()}
    assert {k for k, v in got.items() if v} == {1, 5}
    assert R.labelled(rows.limit(0)).count() == 0


def test_learns_from_what_stands_beside_seeds(spark):
    told = [f"Access denied. Quux the frobnicator to go on. Mark {chr(97 + k) * 5}" for k in range(6)]
    alone = ["Quux the frobnicator to go on."]
    sound = [f"A sound text number {k} about tables. Nothing else is here." for k in range(60)]
    rows = spark.createDataFrame(list(enumerate(told + alone + sound)), "doc_id long, text string")
    assert {r.doc_id for r in R.labelled(rows).collect() if r.label} == set(range(7))


def test_names_are_learned_from_sure_shapes(spark):
    texts = ["a {{ flurb }} b", "c <%= flurb %> d", "now [flurb] here", "now [other] here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.label for r in R.labelled(rows).collect()} == {0: "placeholder", 1: "placeholder", 2: "placeholder", 3: None}


def test_worn_latin():
    latin = R.Latin()
    assert all(latin(w) for w in ("lorem", "eiusm", "incididun", "venia", "seddo", "nonproident")) and not any(latin(w) for w in ("letters", "windows", "estación", "table", "zuzammen"))


def test_memory_does_not_grow_with_the_texts_of_a_task():
    # counts are handed on part by part, and none is lost
    texts = [f"w{k} w{k + 1} " + "x" * 1_000 for k in range(300)]
    parts = list(R.tallied(lambda text: set(text.split()), iter([texts[:100], [None, ""], texts[100:]]), held=10_000))
    assert len(parts) > 20 and max(sum(map(len, c)) for c in parts) < 12_000
    assert sum(parts, Counter()) == Counter(w for text in texts for w in set(text.split()))


def test_long_text(index):
    # a long text gives what its lines give, with memory for a piece of it at once
    import tracemalloc

    assert index.residue("sound text 。 of no kind\n" * 30_000 + "Access denied") == "error"
    text = "It may have been moved to the tables 。 by them, JavaScript was here.\n" * 30_000 + "服务器内部错误"
    tracemalloc.start()
    assert index.residue(text) is None
    assert R.document_terms(text, {"tables", "nothing"}, {"内部", "外部"}) == {"tables", "内部"}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 2 * len(text)


def _crowd():
    # two documents that seeds match hold 5,100 passages, two others 2,100 names; each of the rest holds one passage or one name
    from itertools import islice, product

    words = ["".join(w) for w in islice(product("bdfgklmnpr", "aeiou", "bdfgklmnpr", "aeiou", "st"), 5_100)]
    told = "Access denied.\n" + "\n".join(f"Quux {w} zorn{w} blick{w}." for w in words)
    sure = "\n".join("{{ %sing }}" % w for w in words[:2_100])
    some = words[::300] + words[-2:]
    named = words[:2_100:300] + words[2_098:2_100]
    texts = [told, told, sure, sure, *[f"Quux {w} zorn{w} blick{w}." for w in some], *[f"now [{w}ing] here" for w in named], "Quux of another kind.", "now [other] here", None, ""]
    return list(enumerate(texts)), set(range(4 + len(some) + len(named)))


def test_all_that_is_learned_counts(spark):
    rows, found = _crowd()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in R.labelled(table).collect() if r.label} == found


def test_blocks_find_what_one_index_finds(spark, monkeypatch):
    rows, found = _crowd()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(R, "PASSAGES", 900)
    monkeypatch.setattr(R, "NAMES", 150)
    assert {r.doc_id for r in R.labelled(table).collect() if r.label} == found


def test_blocks_are_whole():
    lines = [f"line {k}" for k in range(10)] + ["x" * 100, "y"]
    for blocks in (R.in_blocks(lines, 3), R.in_blocks(lines, 100, 30), R.in_blocks(lines, 100)):
        assert [line for block in blocks for line in block.split("\n")] == lines
    assert [b.count("\n") + 1 for b in R.in_blocks(lines, 5)] == [5, 5, 2] and R.in_blocks([], 5) == []


def test_many_cjk_pairs():
    text = "今天的会议纪要 and more 页"
    pairs = {"会议", "议纪", "页", "要页", "纪", "无关", *[chr(0x4E00 + k) + chr(0x5E00 + k) for k in range(50)]}
    assert R.document_terms(text, set(), pairs) == {t for t in pairs if t in text}


def test_crowded_terms_are_looked_at_by_few():
    # 3,000 exemplars share their posted terms; a passage is compared with those that it could hold, and a passage that comes again with none
    def exemplar(k):
        return ("error", ("quux", "zorn", *[f"w{k:04}{c}" for c in "abc"]))

    index = R.Index(Flat(quux=60.0, zorn=60.0), frozenset(), [exemplar(k) for k in range(3_000)], alone=True)
    looked = Counter()
    for t, own in index.postings.items():
        index.postings[t] = [(*p[:-2], type("Own", (dict,), {"items": lambda self: looked.update(["once"]) or dict.items(self)})(p[-2]), p[-1]) for p in own]
    long = ("quux", *[f"x{k}" for k in range(100)])
    assert index.match(long) is None and index.match(("quux", "other")) is None and looked["once"] == 0
    assert index.match(exemplar(7)[1]) == "error" and (n := looked["once"]) > 0
    assert index.match(exemplar(7)[1]) == "error" and looked["once"] == n
