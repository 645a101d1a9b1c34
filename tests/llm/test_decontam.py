from emporia.llm import decontam as D

from .cases import CLASHING, ODD, documents, prose
from .helpers import write

ITEMS = [
    (0, "A farmer named Tom Miller sells 12 apples for 3 dollars each and later buys 40 kg of seed at the market in Paris with what he earned"),
    (1, "the quick brown fox jumps over the lazy dog while seven cats watch from the old stone wall near the river bank"),
    (2, "too short"),
    (3, None),
    (None, "an item without an id still has words enough to be found in a document of the corpus by its windows"),
    (5, "the quick brown fox jumps over the lazy dog while seven cats watch from the old stone wall near the river bank"),
]
SAME_SLOTS = "A farmer named Anna Smith sells 15 apples for 7 dollars each and later buys 66 kg of seed at the market in Oslo with what he earned"
MIXED = "A farmer named Anna Smith sells 15 apples for 7 dollars each"


def _found(spark, tmp_path, texts, items=ITEMS):
    write(spark, tmp_path, "documents", documents(texts), files=2)
    write(spark, tmp_path, "benchmark", items)
    return {(r.doc_id, r.item_id): r for r in D.op3_template_decontamination(spark, str(tmp_path)).collect()}


def test_copies_and_reparameterised_questions(spark, tmp_path):
    fox = ITEMS[1][1]
    texts = [prose(1, 100) + ". " + fox + ". " + prose(2, 100),        # inside other text
             SAME_SLOTS,                                               # other names and numbers
             fox.replace(" ", " ### ").upper().lower(),                # marks between the words
             " ".join(fox.split()[:15]) + " " + prose(3, 50),          # a long excerpt
             " ".join(fox.split()[:8]) + " " + prose(4, 50),           # a short one
             prose(5, 300), "12 13 14 15 16 17 18 19 20 21 22", ITEMS[4][1], fox, fox]
    got = _found(spark, tmp_path, texts)
    assert {k for k in got if k[1] == 0} == {(1, 0)}
    assert {k for k in got if k[1] == 1} == {(i, 1) for i in (0, 2, 3, 8, 9)}
    assert {k for k in got if k[1] == 5} == {(i, 5) for i in (0, 2, 3, 8, 9)}    # equal items are all reported
    assert {k for k in got if k[1] is None} == {(7, None)}
    assert got[0, 1].share == 1.0 and got[3, 1].longest >= D.RUN


def test_slots_must_be_consistent(spark, tmp_path):
    item = [(0, "then Tom gave 5 apples to Tom and Tom gave 5 pears to him and Tom gave 5 plums to all and Tom gave 5 nuts away")]
    good = "then Anna gave 8 apples to Anna and Anna gave 8 pears to him and Anna gave 8 plums to all and Anna gave 8 nuts away"
    bad = "then Anna gave 8 apples to Bob and Carl gave 3 pears to him and Dora gave 9 plums to all and Eve gave 2 nuts away"
    assert set(_found(spark, tmp_path, [good, bad], item)) == {(0, 0)}


def test_types_of_words():
    t = D.Tokens(["Tom has 3 apples, 1,250.5 kg. In Paris two men", "Élan x2y kg"])
    words = [(t.raw[s:e].decode(), int(k)) for s, e, k in zip(t.s, t.e, t.slot)]
    assert words == [("Tom", 0), ("has", 0), ("3", 1), ("apples", 0), ("1,250.5", 1), ("kg", 2), ("In", 0), ("Paris", 3),
                     ("two", 1), ("men", 0), ("Élan", 0), ("x", 0), ("2", 1), ("y", 0), ("kg", 0)]


def test_odd_texts_and_empty_tables(spark, tmp_path):
    assert _found(spark, tmp_path / "a", ODD) == {}
    assert _found(spark, tmp_path / "b", []) == {}
    assert _found(spark, tmp_path / "c", [ITEMS[1][1]], []) == {}


def test_clean_removes_rows_and_keeps_columns(spark, tmp_path):
    texts = [ITEMS[1][1], prose(1, 50), None]
    rows = [(*r, 1, "t", 2, 3, 4, 5, 6) for r in documents(texts)] + [(None, ITEMS[1][1]) + (None,) * 10, (None, "kept") + (None,) * 10]
    docs = spark.createDataFrame(rows, CLASHING)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = D.clean(docs, bench)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None) == [(1, texts[1]), (2, None)]
    assert [r.text for r in out.collect() if r.doc_id is None] == ["kept"]


def test_given_tables_hold_every_verbatim_item(spark):
    import re

    import duckdb
    sf = "/root/testdata/sf0.01"
    flat = lambda t: " " + " ".join(re.findall(r"[^\W\d_]+|\d+", t.lower())) + " "
    docs = [(k, flat(t)) for k, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()]
    items = [(k, flat(t)) for k, t in duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()]
    truth = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in D.op3_template_decontamination(spark, sf).collect()}
    assert truth and truth <= got and len(got - truth) <= len(truth) // 20


def test_copies_in_another_letter_case(spark, tmp_path):
    items = [(0, "When did Anna Berg tell Carl Dorn and Eva Frank that Gustav Holm had sold Ida Juhl a boat in Kiel"),
             (1, "Der alte Mann trug am Morgen den Korb mit Brot und Käse über die Brücke zum Markt der Stadt, wo Frau Groß und Herr Öz auf ihn warteten")]
    texts = [f(t) for _, t in items for f in (str, str.lower, str.upper)] + [prose(1, 50).upper()]
    got = _found(spark, tmp_path, texts, items)
    assert set(got) == {(d, i) for i in range(2) for d in range(3 * i, 3 * i + 3)}
    assert all(got[d, 0].share == 1.0 for d in range(3))
    back = _found(spark, tmp_path / "b", [t for _, t in items], [(i, t.lower()) for i, t in items])
    assert set(back) == {(0, 0), (1, 1)}


def test_words_by_code_point():
    words = lambda x: [t.raw[s:e].decode() for t in [D.Tokens([x])] for s, e in zip(t.s, t.e)]
    assert words("asked—twice—quietly… “it’s”\u00a0Ça, e\u0301t\u00e9 ٣٤ x²") == ["asked", "twice", "quietly", "it", "s", "Ça", "e\u0301t\u00e9", "٣٤", "x", "²"]
    assert words("問題A：最大のAI、第3章。") == ["問", "題", "A", "最", "大", "の", "AI", "第", "3", "章"]
    assert words("ก็ที่") == ["ก็", "ที่"] and words("か\u3099 \U00020000漢") == ["か\u3099", "\U00020000", "漢"]
    both = [D.Tokens([x]).word.tolist() for x in ("Straße ΟΔΟΣ İ ÉTÉ", "STRASSE οδος İ été")]
    assert both[0] == both[1]


def test_other_scripts_and_marks(spark, tmp_path):
    items = [(0, "下列哪一项不是太阳系的行星？甲、水星。乙、月亮。丙、火星。丁、木星。"),
             (1, "ข้อใดต่อไปนี้ไม่ใช่ดาวเคราะห์ในระบบสุริยะ"),
             (2, 'she asked - twice - "quietly" and then - "loudly" - why it\'s "not" so - "ever" - here')]
    texts = ["前文" + items[0][1] + "后文", items[0][1].replace("、", " ").replace("。", "\n"), "ก่อน " + items[1][1],
             "she asked—twice—“quietly” and then—“loudly”—why it’s “not” so—“ever”—here", "今天天气很好我们去公园散步然后回家吃饭看电视睡觉"]
    assert set(_found(spark, tmp_path, texts, items)) == {(0, 0), (1, 0), (2, 1), (3, 2)}


def test_dense_and_short_items_are_found_exactly(spark, tmp_path):
    items = [(0, "Compute 12 + 7 - 3 * 45 / 9"), (1, "Solve 3x = 12"), (2, "12"), (3, "..."),
             (4, "In the table 4 5 6 7 8 9 10 the first row of values is 11 12 13 14 15 16 and the last row is 21 22 23 24 25 26 27 28 as shown"),
             (5, "the value of a is 10 20 30 40 50 60 70 and the value of b is 11 21 31 41 51 61 71 while c has none")]
    texts = ["Now compute 12 + 7 - 3 * 45 / 9, please", "Compute 11 + 7 - 3 * 45 / 9", prose(1, 30) + " solve 3X = 12", "solve 3 x 13",
             "first row of values is 11 12 13 14 15 16 and the last one",      # an excerpt of 14 words
             items[5][1].replace("0", "5").replace("1 ", "9 ")]                # other values in all places
    got = _found(spark, tmp_path, texts, items)
    assert set(got) == {(0, 0), (0, 2), (2, 1), (2, 2), (4, 2), (4, 4), (5, 5)}
    assert got[4, 4].longest == 10 and got[5, 5].share == 1.0 and got[0, 0].n_windows == 2
