"""Injected models, chat texts, code targets."""

from pyspark.sql import functions as F

from kairograph.functions.text import contains_cjk
from kairograph.operators import adapters as ad
from kairograph.operators import decode as de
from kairograph.operators import graph as gr
from kairograph.operators import training as tr


def test_embed(spark):
    d = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    got = {r.id: r.v for r in ad.embed(d, "text", lambda: lambda texts: [[len(t), 1] for t in texts], batch=1).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0]}


def test_complete_tries_again(spark):
    def make():
        calls = {}

        def client(messages):
            text = messages[-1]["content"]
            calls[text] = calls.get(text, 0) + 1
            if text == "never":
                raise OSError("down")
            if text == "later" and calls[text] < 2:
                return "漢"
            return "fine " + text

        return client

    form = "kind string, id long, messages array<struct<role:string,content:string>>"
    d = spark.createDataFrame([("entity", k, [("user", t)]) for k, t in enumerate(("now", "later", "never"))], form).coalesce(1)
    got = {r.id: r for r in ad.complete(d, make, tries=2, backoff=0, accept=lambda a: "漢" not in a).collect()}
    assert got[0].answer == "fine now" and got[0].tries_used == 1
    assert got[1].answer == "fine later" and got[1].tries_used == 2
    assert got[2].answer is None and got[2].error == "OSError: down"
    assert d.select(ad.chat_text(F.col("messages")).alias("x")).first().x == "<|user|>\nnow\n<|assistant|>\n"
    assert spark.range(1).select(contains_cjk(F.lit("漢"))).first()[0]


def test_targets_and_shuffle(spark):
    s = spark.createDataFrame([(1, "A_name"), (2, "<z1_00><z2_01>"), (3, "unknown"), (4, None)], "id long, output string")
    names = spark.createDataFrame([(7, "A name")], "entity long, name string")
    codes = spark.createDataFrame([(7, "<z1_05><z2_06>")], "entity long, tokens string")
    kept, counts = tr.targets_as_codes(s, names, codes)
    assert {r.id: r.output for r in kept.collect()} == {1: "<z1_05><z2_06>", 2: "<z1_00><z2_01>"} and counts.first() == (2, 2)
    a, b = ([r.id for r in tr.shuffled(s.repartition(n), "id", 5).collect()] for n in (1, 3))
    assert a == b and sorted(a) == [1, 2, 3, 4]


def test_prefix_ends_and_neighbours(spark):
    codes = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "e long, z0 int, z1 int")
    got = {r.parent: r.tokens for r in de.allowed_with_end(de.prefix_table(codes, 2, "e"), 2, 99).collect()}
    assert got == {"": [0], "0": [0, 1], "0-0": [99], "0-1": [99]}
    e = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "src long, dst long")
    assert [r.node for r in gr.neighbours(e, spark.createDataFrame([(1,)], "node long")).collect()] == [2]
