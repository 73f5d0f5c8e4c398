"""Spelling variants by letter-parity masks.

A word's mask has one bit per letter: whether the letter occurs an odd number of times. One
inserted or deleted letter flips one bit, one replaced letter flips two. The bits are dealt to three
bands, so a band without a flip is equal on both sides. What the other bands then look like follows
from the edit:

* one flip, or two in one band: two bands are equal, and the pair is joined on both;
* one flip in each of two bands: the third is equal, and the lost letter (of the one word) or the
  gained letter (of the other) flips the band after it; a word asks with each letter's bit flipped.

Candidates have lengths that differ by at most one and masks that differ in at most two bits, and are
verified by edit distance inside the join. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The letters words are made of, the usual ones first, so that each band gets some of every frequency.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz" + "".join(map(chr, range(0xC0, 0x100)))
BANDS = 3
RUN = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int | None = None) -> DataFrame:
    """(word, n): how often each letter run occurs, A-Z lower-cased. With ``drop_one_in``, a run loses
    the code point at (h mod its length) where that number divides h, the crc32 of ``id:run``.

    Null texts have no runs, null ids count as empty, a repeated row counts as often as it stands."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), 1)).alias("run"))
    w = F.translate("run", UPPER, LOWER)
    if drop_one_in:
        rows = rows.select(w.alias("w"), F.crc32(F.concat("id", F.lit(":"), w)).alias("h"))
        at = (F.col("h") % F.length("w")).cast("int")
        w = F.when(F.col("h") % drop_one_in == 0, F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))).otherwise(F.col("w"))
    return rows.select(w.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.call_function("div", place, F.lit(BANDS)).cast("int"))


def with_bands(words: DataFrame) -> DataFrame:
    """(word, n, len, b0, b1, b2, places): the bands of each word's mask and its distinct letters' places.
    Letters beyond ``LETTERS`` share bits with others, which only adds candidates."""
    place = lambda c: F.when(F.position(c, F.lit(LETTERS)) > 0, F.position(c, F.lit(LETTERS)) - 1).otherwise(F.ascii(c) % len(LETTERS))
    rows = words.where(F.length("word") > 0).select("word", "n", F.length("word").alias("len"), F.transform(F.split("word", ""), place).alias("places"))
    band = lambda k: F.aggregate("places", F.lit(0), lambda m, p: F.when(p % BANDS == k, m.bitwiseXOR(_bit(p))).otherwise(m))
    return rows.select("word", "n", "len", *(band(k).alias(f"b{k}") for k in range(BANDS)), F.array_distinct("places").alias("places"))


def _keyed(rows: DataFrame, asks: bool) -> DataFrame:
    """For each band k: k, x (its bits), y (the next band's), z (the last one's), len. Asking rows come
    with their own and the next length, and once per letter of the next band with that bit flipped."""
    out = []
    for k in range(BANDS):
        x, y, z = (F.col(f"b{(k + j) % BANDS}") for j in range(BANDS))
        if asks:
            flips = F.transform(F.filter("places", lambda p: p % BANDS == (k + 1) % BANDS), _bit)  # noqa: B023
            plain = [F.struct(y.alias("y"), (F.col("len") + d).alias("len"), F.lit(d).alias("kind")) for d in (0, 1)]
            probes = F.transform(flips, lambda b: F.struct(y.bitwiseXOR(b).alias("y"), F.col("len").alias("len"), F.lit(2).alias("kind")))  # noqa: B023
            out.append(F.transform(F.concat(F.array(*plain), F.array_distinct(probes)), lambda s: F.struct(F.lit(k).alias("k"), x.alias("x"), s["y"].alias("y"), z.alias("z"), s["len"].alias("len"), s["kind"].alias("kind"))))  # noqa: B023
        else:
            out.append(F.array(F.struct(F.lit(k).alias("k"), x.alias("x"), y.alias("y"), z.alias("z"), F.col("len").alias("len"))))
    return rows.select("word", "n", F.inline(F.concat(*out)))


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of ``words`` (word, n) one edit apart, once; words are distinct."""
    rows = materialize(with_bands(words))
    a, b = _keyed(rows, True).alias("a"), _keyed(rows, False).alias("b")
    c = F.col
    same = c("a.k").eqNullSafe(c("b.k")) & (c("a.x") == c("b.x")) & (c("a.y") == c("b.y")) & (c("a.len") == c("b.len"))
    flips = F.bit_count(c("a.z").bitwiseXOR(c("b.z")))
    once = (c("a.k") == 0) | (flips > 0)  # where all bands are equal, only the first key tells
    alike = F.when(c("a.kind") == 2, flips == 1).when(c("a.kind") == 1, flips == 1).otherwise(flips.isin(0, 2) & once & (c("a.word") < c("b.word")))
    near = F.levenshtein(c("a.word"), c("b.word"), 1) == 1
    pairs = a.join(b, same & alike & near).select(c("a.word").alias("p"), c("a.n").alias("pn"), c("b.word").alias("q"), c("b.n").alias("qn"))
    low = c("p") < c("q")
    ordered = pairs.select(F.when(low, c("p")).otherwise(c("q")).alias("a"), F.when(low, c("pn")).otherwise(c("qn")).alias("a_n"), F.when(low, c("q")).otherwise(c("p")).alias("b"), F.when(low, c("qn")).otherwise(c("pn")).alias("b_n"))
    return ordered.distinct()  # a letter that both words have may be asked with from either side


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): follows forms to the last by doubling. A form occurs at least twice
    as often as its word, so chains have at most 63 steps and no cycle."""
    up = materialize(forms.select("word", F.col("form").alias("root")))
    for _ in range(7):
        step = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = materialize(up.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not up.where("moved").limit(1).count():
            return up.select("word", "root")
        up = up.drop("moved")
    raise ValueError("forms do not end: a form must occur at least twice as often as its word")


def group_spellings(words: DataFrame, *, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n), words being distinct.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that is at
    least ``ratio`` (2 or more) times the word's n, else null; ``root`` the last word reached by
    following forms. A word without near words has n_near 0; empty tables give no rows."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = materialize(words.select("word", "n"))
    pairs = near_words(words)
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"{y}_n").alias("other_n"))
    both = pairs.select(F.inline(F.array(side("a", "b"), side("b", "a"))))  # one plan for both directions
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    told = words.join(near, "word", "left")
    told = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    roots = _roots(told.where(F.col("form").isNotNull()))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, drop_one_in: int | None = None, ratio: int = 2) -> DataFrame:
    """Spelling groups of the words of ``docs`` of at least ``min_length`` code points and ``min_count`` occurrences."""
    words = word_counts(docs, id_col=id_col, text_col=text_col, drop_one_in=drop_one_in)
    return group_spellings(words.where((F.length("word") >= min_length) & (F.col("n") >= min_count)), ratio=ratio)
