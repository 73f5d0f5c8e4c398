"""Steps whose rows must not grow as the square of a group."""

from kairograph.operators import decode as de
from kairograph.operators import facts as fa
from kairograph.operators import ranking as rk


def test_ranks_of_one_large_group(spark):
    """400 answers of one query at one time; places follow from running counts, not from pairs of answers."""
    rows = [(i, i % 200 + 10, 0, 1, 0) for i in range(300)] + [(300 + i, i + 10, 0, 1, 1) for i in range(400)]
    f = spark.createDataFrame(rows, "seq long, s long, r long, o long, t long")
    q = fa.queries_of(f.where("t = 1"), 1)
    got = {(r["dir"], r["answer"]): (r["raw_rank"], r["filtered_rank"]) for r in rk.ranks(f, q, 1).where("dir = 1").collect()}
    n = {x: sum(1 for _, s, _, _, t in rows if s == x and t == 0) for x in [1, *range(10, 410)]}
    order = sorted(n, key=lambda x: (-n[x], x))
    for x in range(10, 410):
        raw = order.index(x) + 1
        assert got[1, x] == (raw, 1 + sum(1 for y in order[: raw - 1] if not 10 <= y < 410))
    plan = rk.ranks(f, q, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "ahead" in plan and plan.count("Window") >= 3


def test_filters_of_one_code_are_not_compared(spark):
    """Ids that ask for one code give no pair twice, nor do those that ask for several things; the rows of
    the former pass no aggregate."""
    filters = spark.createDataFrame([(1, "<z1_00>"), (1, "<z1_00> "), (2, "<z1_00>"), (2, "7"), (2, "<z1_01>"), (3, "8"), (3, "entity 8"), (4, "x"), (None, "9")], "id long, filter string")
    names = spark.createDataFrame([("entity 7", 7), ("entity 8", 8)], "name string, entity long")
    codes = spark.createDataFrame([("<z1_00>", 7), ("<z1_00>", 8), ("<z1_00>", 8), ("<z1_01>", 9), ("<z1_01>", 7)], "tokens string, entity long")
    out = de.resolve_filters(filters, names, codes)
    got = sorted((r["id"] or 0, r["entity"]) for r in out.collect())
    assert got == [(0, 9), (1, 7), (1, 8), (2, 7), (2, 8), (2, 9), (3, 8)]
    assert out._jdf.queryExecution().optimizedPlan().toString().split("\n")[0].startswith("Union")


def test_filters_of_prompts_meet_last(spark):
    """300 answers of one query: every prompt lists the other 299; lists are gathered for each key, not for each prompt."""
    from kairograph.operators import prompts as pr

    f = spark.createDataFrame([(i, i + 10, 0, 1, 0) for i in range(300)], "seq long, s long, r long, o long, t long")
    names = spark.createDataFrame([(1, "n1"), *((i, f"n{i}") for i in range(10, 310))], "id long, name string")
    out = pr.prompt_rows(f, names, spark.createDataFrame([(0, "r")], "id long, name string"), 1, "test", with_history=False)
    rows = out.where("meta.direction = 'backward'").collect()
    assert len(rows) == 300 and all(r.filters == [f"n{i}" for i in range(10, 310) if f"n{i}" != r.output] for r in rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [id#" in line and "collect_list" in line for line in plan.splitlines())


def test_rolling_history_over_batches(spark, tmp_path):
    """Days in several batches against plain counts, one day in two of them."""
    import random

    from kairograph.streaming import facts as st

    rng = random.Random(6)
    rows, form = [(k, rng.randrange(4), 0, k % 5, k // 12, "unused") for k in range(120)], "seq long, s long, r long, o long, t long, more string"
    folder = f"file://{tmp_path}/in"
    for lo in range(0, 120, 30):  # batches cut days in two
        spark.createDataFrame(rows[lo : lo + 30], form).coalesce(1).write.mode("append").parquet(folder)
    stream = st.rolling_history(spark.readStream.schema(form).option("maxFilesPerTrigger", 1).parquet(folder), 5)
    got = {r["seq"]: (r["e"], r["n_before"], r["newest_t"]) for r in st.run_to_table(stream, "append").collect()}
    for seq, s, _, _, t, _ in rows:
        old = [x[4] for x in rows if x[1] == s and x[4] < t]
        assert got[seq] == (s, min(len(old), 5), max(old, default=None))
