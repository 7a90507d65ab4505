import random

import pytest

S = pytest.importorskip("quernstone.llm.sentences")


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return S.fit(docs, sample=1000)


def parts(text, model):
    spans = S.split(text, model)
    assert all(0 <= a < b <= len(text) for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)
    return [text[a:b] for a, b in spans]


WHOLE = [
    "Dr. Ashfenwick and Prof. Marigny split the token (approx. 10.037 MB) and then mapped the orchard.",
    "“The lighthouse failed! Nobody mapped it,” said C. O. Kelreth and then split the river.",
    "“Who sealed the archive?” U. Halby asked in 1806.",
    "R. Ashostigny asked: “Did the chapel rename the river?”",
    "It was built with rustq 7.28.6 on St. Dunigny Street, No. 14 before the counter replaced Briigny.",
    "Runs began at 2 a.m. and ended at 4:06 p.m. on Sept. 3, 1832.",
    "The orchard (it was sparse!) counted Velnak (see [[Garensa]]).",
    "(See also Sec. 11 and pp. 1-657.)",
    "Mrs. Velia wrote, 'The trial is sparse. Keep it.' and left at 4.4 ns.",
    "Der 507. Hafen maß den Schlüssel usw. bis 1707.",
    "Am 22. März 1853 zählte D. H. Ashburn den Beleg.",
    "—No divide el contador —dijo D. V. Ashnak—.",
    "« Le moulin est salé ! » s’écria H. D. Silcoria.",
    "Архив сжался на 6,2 %, т. е. до 46 тыс. байт, как писал Моргорск.",
    "«Το λεξικό χάθηκε!» είπε ο κ. Λορμόρα.",
    "केलगढ़ से लोरनक 3.7 कि.मी. दूर है।",
    "braid-2は697頁の圧縮器を測った……しかし止まった。",
    "“语料太大。”凯河说。",
    "قال د. لورستان: «انقسم السجل.»",
    "ቬልናክ ከቬልናክ 71.053 ኪ.ሜ ይርቃል።",
    "Կելմորա մատյանը 1803 թ. չափվեց։",
    "“사전이 사라졌다.”라고 타르낙 씨가 말했다.",
]


@pytest.mark.parametrize("sentence", WHOLE)
def test_whole(sentence, model):
    assert parts(sentence + " ", model) == [sentence]
    assert parts(f"The night run stopped. {sentence}" if sentence[0].isascii() else sentence, model)[-1] == sentence


@pytest.mark.parametrize(
    "text, want",
    [
        ("The night run stopped at 9 p.m. C. K. Fenashensa asked: “Did the river split the page?” We doubled the bridge.", ["The night run stopped at 9 p.m.", "C. K. Fenashensa asked: “Did the river split the page?”", "We doubled the bridge."]),
        ("What a mixer! Why? 55 counters lost the ledger.", ["What a mixer!", "Why?", "55 counters lost the ledger."]),
        ("Nobody knew why the table crossed Garigny... \"It doubled a bridge.\" It kept 4 gates.", ["Nobody knew why the table crossed Garigny...", '"It doubled a bridge."', "It kept 4 gates."]),
        ("It lost it.<ref>Ruddale, p. 105.</ref> It kept it.&lt;ref name=&quot;x&quot; /&gt; What a gate!", ["It lost it.<ref>Ruddale, p. 105.</ref>", "It kept it.&lt;ref name=&quot;x&quot; /&gt;", "What a gate!"]),
        ("多大的档案啊！“账本太大。”塔河说。多大的港口啊！", ["多大的档案啊！", "“账本太大。”塔河说。", "多大的港口啊！"]),
        ("ใครถูกวัดหรือไม่ คลังข้อมูลมี 8 หน้า เราใช้ quill-2 กับท่าเรือ", ["ใครถูกวัดหรือไม่", "คลังข้อมูลมี 8 หน้า", "เราใช้ quill-2 กับท่าเรือ"]),
        ("Quel port ! Cf. p. 2 et fig. 338 du port. Qui compte le palier ?", ["Quel port !", "Cf. p. 2 et fig. 338 du port.", "Qui compte le palier ?"]),
    ],
)
def test_split(text, want, model):
    assert parts(text, model) == want


def test_structure(model):
    text = (
        "<page>\n <title>A. B.</title>\n <text xml:space=\"preserve\">﻿It kept\n4 gates.\n\n== Head. ==\n{{Infobox\n| a = No. 5. See.\n}}\nIt lost 3 pages\n* an item\n** second item. It merged 2 gates.\n"
        "<!-- Keep. As is. -->\n{| class=\"x\"\n| a || 1.\n|}\n[[Category:X. Y.]]\n-- M. Briia 01:22\n: No mark here</text>\n</page>"
    )
    assert parts(text, model) == ["It kept\n4 gates.", "It lost 3 pages", "an item", "second item.", "It merged 2 gates.", "No mark here"]


@pytest.mark.parametrize("text", [None, "", "   ", "\n\n", "﻿", "{{open", "== a ==", "<!-- x", "...", "“", "((", "'"])
def test_odd_texts(text, model):
    spans = S.split(text, model)
    assert len(spans) <= 1


def test_long_text(model):
    text = "It kept 4 gates. " * 4000
    assert len(S.split(text, model)) == 4000
    S.split("(" * 5000 + "“" * 5000 + "." * 5000, model)
    S.split("{{" * 3000 + "a.b " * 3000, model)


def test_words_are_seen_whole():
    long = "a" * 500
    c = S.candidates(f"It kept {long} {long}b. {long}c kept it. ")[0]
    s = f"It kept {long} {long}b. {long}c kept it. "
    ctx = S.context(s, 0, c, s, c[2])
    assert ctx[1:4] == (long + "b", long, long + "c")
    assert S._words[long + "b"][0] == long + "b"
    q = f'“{long} kept it!” said {long}d and {long}e left {long}f. '
    c = S.candidates(q)[0]
    assert S.context(q, 0, c, q, c[2])[-1] == ("said", long + "d", "and", long + "e", "left")


def test_lines_of_namespace_links(model):
    assert parts("It kept it.\n[[Luokka:X. Y.]] [[หมวดหมู่:Z. W.|a]]\nIt [[a:b. c]] lost it.", model) == ["It kept it.", "It [[a:b. c]] lost it."]


def test_sample_is_bounded(spark):
    docs = spark.range(5000).selectExpr("id % 7 AS doc_id", "'It kept it. It lost it.' AS text")
    assert S.fit(docs, sample=3).weights is not None
    few = spark.range(50).selectExpr("id AS doc_id", "concat('It kept ', id, ' gates.\n\nIt lost it.') AS text")
    assert S.fit(few, sample=2500).weights == S.fit(few, sample=50).weights


def test_held_out_paragraph_ends(spark):
    """Joined by a blank, paragraphs must come apart at their old ends: held-out accuracy."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = S.fit(docs, sample=600)
    rnd, right, wrong = random.Random(1), 0, 0
    for r in docs.filter("kind = 'article' AND text IS NOT NULL").select("text", "doc_id").orderBy("doc_id").collect()[150:]:
        full, spans = S.blocks(r.text)
        paras = [full[a:b].strip() for a, b in spans]
        paras = [p for p in paras if p and p[-1] in ".!?。！？।։።" and p[0].isalpha() and S._script(p[0]) != "thai" and "\n" not in p]
        if len(paras) > 1:
            joined, ends, at = " ".join(paras), set(), 0
            for p in paras[:-1]:
                at += len(p)
                ends.add(at)
                at += 1
            got = {b for _, b in S.split(joined, model)}
            right += len(ends & got)
            wrong += len(ends - got)
    assert right > 200 and right / (right + wrong) > 0.98


def test_frame(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "It is. It was.", "x"), (3, "One.", None), (3, "One.", None)], "doc_id bigint, text string, start_pos string")
    got = sorted(((r.doc_id or 0, r.start_pos, r.end_pos) for r in S.sentences(df, model=model).collect()))
    assert got == [(0, 0, 6), (0, 7, 14), (3, 0, 4), (3, 0, 4)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.sentences(empty).count() == 0
