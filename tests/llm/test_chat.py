from emporia.llm import chat as C

from .helpers import same, write

SF001 = "/root/testdata/sf0.001"

TALK = [
    (1, 0, "user", "How do I boil\nan egg?\n\nAnd how long?"),
    (1, 1, "assistant", "> How do I boil an egg?\nIn water."),
    (1, 2, "user", "> > how do I BOIL an egg?\n> In water.\n\nThanks, that helps."),
    (1, 3, "user", ">And how long?\nStill open."),
    (1, 4, "assistant", "> never said this\nNo link."),
    (1, 5, "user", "> How do I boil\n> an egg?\n>\n> And how long?\nWhole message quoted."),
    (2, 0, "user", "> In water.\nQuoted from elsewhere."),
    (2, 1, "user", "> Later words.\nQuotes what only comes later."),
    (2, 2, "user", "Later words."),
    (3, 0, "user", None),
    (3, 1, "user", ""),
    (3, 2, "user", ">>> \n>\n"),
    (3, 3, "user", "a > b\n  > Still open.\r\nc"),
    (None, 1, "user", "> In water.\nx"),
    (4, None, "user", "> In water.\nx"),
    (1, 1, "assistant", "> How do I boil an egg?\nIn water."),
    (5, 0, "user", "one\n> In water.\ntwo\n> And how long?"),
]


def test_links_and_threads(spark, tmp_path):
    got = same(C.op1_quotation_links, C.SQL, spark, write(spark, tmp_path, "conversations", TALK))
    names = sorted(["conv_id", "turn", "role", "text", "n_quotes", "max_level", "n_linked", "reply_conv", "reply_turn",
                    "thread_conv", "thread_turn", "depth"])
    by = {(r[names.index("conv_id")], r[names.index("turn")]): dict(zip(names, r)) for r in got}
    reply = lambda c, t: (by[c, t]["reply_conv"], by[c, t]["reply_turn"])
    assert reply(1, 1) == (1, 0) and reply(1, 2) == (1, 1) and reply(1, 3) == (1, 0) and reply(1, 5) == (1, 0)
    assert reply(1, 4) == (None, None) and reply(2, 0) == (1, 1) and reply(2, 1) == (None, None) and reply(3, 3) == (1, 3)
    assert by[1, 2]["max_level"] == 2 and by[1, 2]["text"] == "Thanks, that helps." and by[1, 2]["depth"] == 2
    assert (by[2, 0]["thread_conv"], by[2, 0]["thread_turn"], by[2, 0]["depth"]) == (1, 0, 2)
    assert by[None, 1]["n_linked"] == 0 and by[3, 0]["text"] == ""


def test_rows_stand_in_reply_order(spark, tmp_path):
    write(spark, tmp_path, "conversations", TALK)
    rows = [(r.thread_conv, r.thread_turn, r.conv_id, r.turn) for r in C.op1_quotation_links(spark, str(tmp_path)).collect()
            if r.thread_conv is not None]
    assert rows == sorted(rows)


def test_deep_chain(spark, tmp_path):
    rows = [(7, t, "user", (f"> message number {t - 1}\n" if t else "") + f"message number {t}") for t in range(30)]
    got = same(C.op1_quotation_links, C.SQL, spark, write(spark, tmp_path, "conversations", rows))
    assert len(got) == 30


def test_given_and_empty_tables(spark, tmp_path):
    same(C.op1_quotation_links, C.SQL, spark, SF001)
    assert not same(C.op1_quotation_links, C.SQL, spark, write(spark, tmp_path, "conversations", []))


def test_extra_columns_do_not_clash(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, l string, p string, said string, depth string, clean string"
    write(spark, tmp_path, "conversations", TALK, schema)
    a = C.op1_quotation_links(spark, str(tmp_path)).collect()
    assert len(a) == len(TALK) and sum(r.reply_conv is not None for r in a) >= 7


def test_long_quote(spark, tmp_path):
    body = "\n".join(f"line {i} of a long text" for i in range(6000))
    rows = [(1, 0, "user", body), (1, 1, "user", "\n".join("> " + x for x in body.split("\n")) + "\nok")]
    write(spark, tmp_path, "conversations", rows)
    got = {r.turn: r for r in C.op1_quotation_links(spark, str(tmp_path)).collect()}
    assert got[1].reply_turn == 0 and got[1].text == "ok" and got[1].n_quotes == 1
