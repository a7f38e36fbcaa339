from loam.llm import ocr as O
from loam.session import Scratch

SCHEMA = "path string, content string, processed_at long, noise string"
GOOD = "the quick handle moves under every folder while another reader counts the letters slowly"


def kinds(spark, rows):
    scratch = Scratch(spark, "t")
    recs = scratch.keep(O.records(spark.createDataFrame(rows, SCHEMA)))
    out = {}
    for r in O.noise(recs, scratch).collect():
        out.setdefault(r.path, set()).add(r.noise)
    return out


def test_kinds(spark):
    base = [(f"/g{k}", GOOD, 1, "") for k in range(12)]
    rows = base + [
        ("/h", "a divi-\nded word and a soft\xad\nened one", 1, ""),
        ("/n", "first page text here.\n- 12 -\n\nsecond page\n- 13 -", 1, ""),
        ("/n2", "Page 3 / 9\nwords, words.\f第 4 / 9 页\nmore words.", 1, ""),
        ("/r", "Lab sheet / Box\nsome text goes here.\fLab sheet / Box\nand here it goes on.", 1, ""),
        ("/rb", "LAB SHEET / BOX | 7\n\nsome text goes here.\n\nLAB SHEET / BOX | 8\n\nand on.", 1, ""),
        ("/m", "the qu1ck bandle m0ves under every f0lder while an0ther reader", 1, ""),
        ("/s", "Title: One\n\nsound text here.\n\nbox ....... 12\nbag ....... 17\n\nwrapped\nlines", 1, ""),
        ("/z", "会 议 纪 要", 1, ""), ("/e", "", 1, ""), ("/0", None, 1, ""), (None, "- 1 -", 1, ""), ("/d", "old\n- 1 -\n", 1, ""), ("/d", "now sound.", 2, ""),
    ]
    assert kinds(spark, rows) == {"/h": {"hyphenation"}, "/n": {"page_number"}, "/n2": {"page_number"}, "/r": {"running_header"}, "/rb": {"running_header", "page_number"}, "/m": {"misread"}}


def test_one_word_is_enough_with_support(spark):
    # a digit or sign inside letters needs no context; a word of letters only needs the form beside one of its neighbours
    rows = [(f"/g{k}", GOOD, 1, "") for k in range(12)] + [("/one", "the qu1ck handle", 1, ""), ("/sign", "every f@lder here", 1, ""), ("/two", "the quick bandle rnoves", 1, ""), ("/edge", "counts every1 folder", 1, ""), ("/alone", "a bandle apart", 1, "")]
    assert kinds(spark, rows) == {"/one": {"misread"}, "/two": {"misread"}}
    scratch = Scratch(spark, "t")
    got = {r.path: r.content for r in O.repaired(scratch.keep(O.records(spark.createDataFrame(rows, SCHEMA))), scratch).collect()}
    assert got["/one"] == "the quick handle" and got["/two"] == "the quick handle rnoves" and got["/alone"] == "a bandle apart"


def test_a_rare_sound_word_stays(spark):
    rows = [(f"/g{k}", "Wir planen für morgen und für immer", 1, "") for k in range(20)] + [(f"/t{k}", "Die Tür war geschlossen, als die Uhr stand", 1, "") for k in range(2)] + [("/x", "Wir planen für rnorgen, die Tür war zu", 1, "")]
    scratch = Scratch(spark, "t")
    recs = scratch.keep(O.records(spark.createDataFrame(rows, SCHEMA)))
    got = {r.path: r.content for r in O.repaired(recs, scratch).collect()}
    assert got["/t0"].startswith("Die Tür war") and got["/x"] == "Wir planen für morgen, die Tür war zu"


def test_damaged_texts_come_back(spark):
    words = "handle folder reader quick moves under while another counts letters slowly every".split()
    lines = [" ".join(words[(i + k) % len(words)] for k in range(8)) for i in range(len(words))]
    rows = [(f"/g{n}", line + ".", 1, "") for n in range(90) for line in [" ".join(lines[n % len(lines) :] + lines[: n % len(lines)])]]
    damage = [("rn", "m", "m"), ("l", "1", "l"), ("o", "0", "o"), ("h", "b", "h")]
    cases = []
    for n, line in enumerate(lines):
        for _, bad, good in damage:
            hit = next((w for w in line.split() if good in w[1:-1]), None)
            if hit and bad != "m":
                cases.append((f"/d{len(cases)}", line.replace(hit, hit[0] + hit[1:-1].replace(good, bad, 1) + hit[-1], 1), line))
    scratch = Scratch(spark, "t")
    recs = scratch.keep(O.records(spark.createDataFrame(rows + [(p, t, 1, "") for p, t, _ in cases], SCHEMA)))
    got = {r.path: r.content for r in O.repaired(recs, scratch).collect()}
    right = sum(got[p] == want for p, _, want in cases)
    assert len(cases) >= 20 and right >= 0.95 * len(cases), (right, len(cases))


def test_headers_without_a_gap(spark):
    text = "Lab sheet / Box 7\nsome text goes\nLab sheet / Box 8\nand here it goes\nLAB SHEET / BOX 9\nto its end."
    rows = [("/h", text, 1, ""), ("/s", "Größe – Box\nsome text\nGRÖSSE – BOX\nmore text.", 1, ""), ("/n", "Do not forget: this\nline and\nthe other: one.", 1, "")]
    assert kinds(spark, rows) == {"/h": {"running_header", "page_number"}, "/s": {"running_header"}}


def test_repaired(spark):
    rows = [(f"/g{k}", GOOD, 1, "") for k in range(12)] + [("/x", "Lab sheet / Box\nThe qu1ck ban-\ndle m0ves\nunder every\n12\n\fLab sheet / Box\nf0lder now.\n\nbox ..... 3\nNext one.\n13", 1, ""), ("/only", "- 3 -", 1, ""), ("/zh", "会 议 纪\n 要 。", 1, "")]
    scratch = Scratch(spark, "t")
    got = {r.path: r.content for r in O.repaired(scratch.keep(O.records(spark.createDataFrame(rows, SCHEMA))), scratch).collect()}
    assert got["/x"] == "The quick bandle moves under every folder now.\n\nbox ..... 3\n\nNext one." or got["/x"] == "The quick handle moves under every folder now.\n\nbox ..... 3\n\nNext one."
    assert got["/only"] == "" and got["/zh"] == "会议纪要。" and got["/g1"] == GOOD


def test_context_decides(spark):
    rows = [(f"/a{k}", "file handle stays, a handle bar", 1, "") for k in range(8)] + [(f"/b{k}", "wax bundle stays", 1, "") for k in range(8)] + [("/x", "file hand1e stays", 1, "")]
    recs = O.records(spark.createDataFrame(rows, SCHEMA))
    scratch = Scratch(spark, "t")
    fixes = {(r.before, r.word): r.form for r in O.corrections(scratch.keep(O.spots(recs)), scratch).collect()}
    assert fixes["file", "hand1e"] == "handle"


def test_skeleton():
    assert O.skeleton("rnodern") == O.skeleton("modern") and O.skeleton("c1ose") == O.skeleton("close") and O.skeleton("Te!slerk") == O.skeleton("teislerk")
    assert O.reread("FILE Hand1e x", [("Hand1e", "file", "y", "handle")]) == "FILE Handle x"


def test_empty(spark):
    assert kinds(spark, []) == {}
