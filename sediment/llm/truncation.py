"""Text cut off by field limits or in transfer, told by word trigrams, in plain SQL expressions.

Words keep their punctuation, digits count by their number only, and a line break is a word. Of every
text the trigrams inside (another word of the line follows) and at ends (a line break or the end of the
text follows) are counted, once per distinct text. A text whose last trigram is frequent inside but
almost never at an end was cut; where longer n-grams are known well enough, they decide. A last word that
was cut itself is told by the longer words that usually stand in its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.operators.skew import lookup_join
from sediment.runtime import materialize

#: Lengths of the n-grams that are counted.
LENGTHS = (3, 5, 7)
#: An n-gram decides if it occurs at least this often in other texts.
SUPPORT = 4
#: A text is cut if at most this share of the occurrences stand at an end.
MOST_AT_END = 0.04

#: So many wanted n-grams are broadcast (some 40 MB); more are looked up in the counts of all n-grams.
BROADCAST_GRAMS = 1_000_000

_BLANKS = " \t\n\r\x0b\x0c\u00a0"
# Words that stand in brackets where a text was cut, and characters that close a sentence.
_CUT_SIGN = r"(?i)^\s*(?:cut|truncated|more|snip|continued|cont\.?)\s*[\]>)}]$"
_STOPS, _CLOSERS, _CLOSED = [".", "!", "?", "。", "！", "？"], "'\"”’)]*_`", ["}", "]", ">", "`"]
_BREAK = "⏎"


def prepared(documents: DataFrame) -> DataFrame:
    """(doc_id, source, key, body) of the texts that are neither null nor blank; key is a digest of body."""
    body = _bare(F.regexp_replace("text", r"\r\n?", "\n"))
    return documents.select("doc_id", F.lower(F.trim("source")).alias("source"), body.alias("body")).where("body != ''").withColumn("key", F.xxhash64("body"))


def _bare(c: Column, chars: str = _BLANKS) -> Column:
    return F.rtrim(c, F.lit(chars))


def _shorter(c: Column, n: Column | int) -> Column:
    return F.left(c, F.length(c) - n)


def without_mark(texts: DataFrame) -> DataFrame:
    """texts with ``plain``, the body without a sign of the cut at its end ([cut], <truncated>, -- more --) and
    the blanks before it. Told from the last opening bracket or the last dashes on, wherever they stand, by
    operations that take time in proportion to the text."""
    sign = F.substring_index(F.translate("body", "<({", "[[["), "[", -1)
    dashes = texts.withColumn("sign", sign).withColumn("a", _bare(F.col("body"), "-")).withColumn("b", _bare(F.col("a")))
    dashes = dashes.withColumn("c", F.when((F.length("body") - F.length("a") >= 2) & (F.lower(F.right("b", F.lit(4))) == "more"), _bare(_shorter(F.col("b"), 4)))).withColumn("d", _bare(F.col("c"), "-"))
    bracketed = (F.length("sign") < F.length("body")) & F.col("sign").rlike(_CUT_SIGN)
    plain = F.when(bracketed, _bare(_shorter(F.col("body"), F.length("sign") + 1))).when(F.length("c") - F.length("d") >= 2, _bare(F.col("d"))).otherwise(F.col("body"))
    return dashes.withColumn("plain", plain).drop("sign", "a", "b", "c", "d")


def _shaped(c: Column) -> Column:
    return F.translate(F.lower(c), "012345678", "999999999")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, r"\s+"), "")


def _bullet(line: Column) -> Column:
    """The sign a line begins with, if it is no letter or digit: part of the longer n-grams, as the
    same words may end a list item, but not a sentence."""
    return F.regexp_extract(line, r"^\s*([^\w\s]*)", 1)


def _lines(rows: DataFrame, *keep: str) -> DataFrame:
    """rows with the words w of their column line and the line's bullet."""
    return rows.select(*keep, _bullet(F.col("line")).alias("bullet"), _words(F.col("line")).alias("w"))


#: Words before the last one of the longest n-gram; line breaks stand before the first of a line.
_BEFORE = LENGTHS[-1] - 1
_NEAR = [f"w{o}" for o in range(_BEFORE + 1)]


def _every_place(cells: DataFrame) -> DataFrame:
    """(bullet, w0, w1, ..., next): a row for each word w0 of the lines, with the words before it (w1 directly) and the one
    after it, null at the end of the line."""
    n = F.size("w")
    padded = F.concat(F.array_repeat(F.lit(_BREAK), _BEFORE), F.col("w"))
    shifted = [F.slice(padded, F.lit(_BEFORE + 1 - o), n).alias(f"w{o}") for o in range(_BEFORE + 1)]
    after = F.slice(F.concat(F.col("w"), F.array(F.lit(None).cast("string"))), F.lit(2), n).alias("next")
    return cells.select("bullet", *shifted, after).select("bullet", F.inline(F.arrays_zip(*_NEAR, "next")))


def _last_place(cells: DataFrame, *keep: str) -> DataFrame:
    """(bullet, w0, w1, ...): the same for the last word of each line; null without words."""
    at = lambda o: F.when(F.size("w") > o, F.get("w", F.size("w") - 1 - o)).otherwise(_BREAK if o else F.lit(None).cast("string"))
    return cells.select(*keep, "bullet", *[at(o).alias(f"w{o}") for o in range(_BEFORE + 1)])


def _longer(rows: DataFrame) -> DataFrame:
    """rows with the digests g3, g5 and g7 of the n-grams that end at their places."""
    rows = rows.withColumn("g3", F.xxhash64("w2", "w1", "w0"))
    return rows.withColumn("g5", F.xxhash64("bullet", "w4", "w3", "g3")).withColumn("g7", F.xxhash64("bullet", "w6", "w5", "g5")).drop("bullet", *_NEAR[1:])


def gram_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, pair, word, inside, at_end) of the n-grams of the distinct texts: the trigrams whose first two
    words are wanted, with their last word and the digest of the two before it, and the wanted longer n-grams.
    wanted is (need), distinct digests of pairs and longer n-grams. A bounded number of them is broadcast and
    sieves the n-grams before they are counted; otherwise all are counted, combined before the shuffle, and
    then looked up."""
    lines = texts.select(F.explode(F.split(_shaped(F.col("body")), "\n")).alias("line"))
    at = _every_place(_lines(lines)).withColumn("pair", F.xxhash64("w2", "w1")).withColumn("stop", F.col("next").isNull().cast("long")).drop("next")
    few = wanted.count() <= BROADCAST_GRAMS
    if few:
        at = at.join(F.broadcast(wanted), F.col("pair") == F.col("need"), "left_semi")
    none_l, none_s = F.lit(None).cast("long"), F.lit(None).cast("string")
    rows = [F.struct(F.col("g3").alias("gram"), "pair", F.col("w0").alias("word"), F.col("pair").alias("need"))]
    rows += [F.struct(F.col(g).alias("gram"), none_l.alias("pair"), none_s.alias("word"), F.col(g).alias("need")) for g in ("g5", "g7")]
    grams = _longer(at).select("stop", F.explode(F.array(*rows)).alias("r")).select("stop", "r.*")
    if few:
        grams = grams.join(F.broadcast(wanted), "need", "left_semi")
    counts = grams.groupBy("gram", "pair", "word", "need").agg((F.count(F.lit(1)) - F.sum("stop")).alias("inside"), F.sum("stop").alias("at_end"))
    return (counts if few else lookup_join(counts, wanted, "need", "left_semi")).drop("need")


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason) of every text that is not blank; reason is null for whole texts, else
    ``mark`` (a sign put there by the cut), ``structure`` (an open JSON value or code fence, or a damaged
    last character), ``words`` (the last n-gram) or ``part`` (the last word). Repeated doc_ids are
    judged row by row; a text too rare to compare counts as whole. Texts are read to their end, of any length."""
    docs = prepared(documents)
    ids = materialize(docs.select("doc_id", "source", "key"))
    texts = materialize(docs.groupBy("key").agg(F.first("body").alias("body")))  # read twice
    opens, closes = (F.length(F.translate("body", c, "")) for c in ("}]", "{["))
    json = F.col("body").rlike(r"^[\[{]") & (opens != closes)
    fence = ((F.length("body") - F.length(F.replace("body", F.lit("```"), F.lit("")))) / 3).cast("long") % 2 == 1
    known = without_mark(texts).withColumn("sure", F.when(F.col("plain") != F.col("body"), "mark").when(json | fence | F.col("body").endswith("\ufffd"), "structure")).drop("body")
    dots = F.when(F.col("plain").endswith("…"), _bare(_shorter(F.col("plain"), 1))).when(F.col("plain").endswith("..."), _bare(_bare(F.col("plain"), "."))).otherwise(F.col("plain"))
    known = known.withColumn("core", dots).withColumn("dots", F.col("core") != F.col("plain"))
    bare = ~F.right(_bare(F.col("core"), _CLOSERS), F.lit(1)).isin(_STOPS) & ~F.right("core", F.lit(1)).isin(_CLOSED)
    last = lambda c: _shaped(F.substring_index(c, "\n", -1))
    known = known.withColumn("doubtful", F.col("sure").isNull() & (F.col("core") != "") & (F.col("dots") | bare))
    # of the texts that do not end in a clear way the last lines; not filtered before, as that would repeat the expressions
    known = materialize(known.select("key", "sure", "dots", "doubtful", *[F.when(F.col("doubtful"), last(c)).alias(c) for c in ("core", "plain")]))
    tails = known.where("doubtful").select("key", "dots", F.explode(F.array(*[
        F.struct(F.lit(dotted).alias("dotted"), F.col(c).alias("line")) for c, dotted in (("core", False), ("plain", True))
    ])).alias("t")).select("key", "dots", "t.*").where("dots or not dotted")
    tails = _last_place(_lines(tails, "key", "dots", "dotted"), "key", "dots", "dotted").withColumn("pair", F.xxhash64("w2", "w1"))
    tails = materialize(_longer(tails)).withColumnRenamed("w0", "word").where("word is not null")
    wanted = tails.select(F.explode(F.array("pair", "g5", "g7")).alias("need")).distinct()
    counts = materialize(gram_counts(texts, wanted))  # read twice
    grams = F.array(*[F.struct(F.lit(m).alias("k"), F.col(f"g{m}").alias("gram")) for m in LENGTHS])
    ends = tails.select("key", "dots", "dotted", "word", "pair", F.explode(grams).alias("e")).select("key", "dots", "dotted", "word", "pair", "e.*")
    seen = lookup_join(ends, counts.select("gram", "inside", "at_end"), "gram", "left")
    # the end of the text itself is no evidence; before dots the n-gram flows on, with dots it stops
    flows = F.max(F.when(~F.col("dotted"), F.coalesce("inside", F.lit(0)))).alias("flows")
    stops = F.max(F.when(F.col("dotted") == F.col("dots"), F.greatest(F.coalesce("at_end", F.lit(0)) - 1, F.lit(0)))).alias("stops")
    by_k = seen.groupBy("key", "k").agg(flows, stops, F.max(F.when(~F.col("dotted"), F.col("pair"))).alias("pair"), F.max(F.when(~F.col("dotted"), F.col("word"))).alias("word"))
    short = F.col("k") == LENGTHS[0]
    longest = by_k.groupBy("key").agg(
        F.max(F.when(F.col("stops") + F.col("flows") >= SUPPORT, F.struct("k", "stops", "flows"))).alias("best"),
        F.max(F.when(short, F.struct("stops", "flows", "pair", "word"))).alias("tri"),
    ).select("key", "best", "tri.*").withColumn("stem", F.xxhash64("pair", "word"))
    # longer words in place of the last one: of each word only the beginnings as long as a last word after its pair
    lengths = tails.where("not dotted").groupBy("pair").agg(F.collect_set(F.length("word")).alias("lengths"))
    places = lookup_join(counts.where("pair is not null and length(word) > 1").select("pair", "word", (F.col("inside") + F.col("at_end")).alias("n")), lengths, "pair", "inner")
    stems = F.transform(F.filter("lengths", lambda n: n < F.length("word")), lambda n: F.xxhash64("pair", F.left("word", n)))
    starts = places.select(F.explode(stems).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("longer"))
    whole = lookup_join(longest, starts, "stem", "left")
    cut_words = F.col("best").isNotNull() & (F.col("best.stops") <= MOST_AT_END * (F.col("best.stops") + F.col("best.flows")))
    longer = F.coalesce("longer", F.lit(0))
    cut_part = (longer >= SUPPORT) & (F.greatest(F.col("flows") - 1, F.col("stops") - 1) <= MOST_AT_END * longer)
    found = whole.select("key", F.when(cut_words, "words").when(cut_part, "part").alias("guess")).where("guess is not null")
    sure = known.where("sure is not null").select("key", F.col("sure").alias("guess"))
    return lookup_join(ids, found.unionByName(sure), "key", "left").select("doc_id", "source", F.col("guess").alias("reason"))


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, reason) of the texts that were cut."""
    return judged(documents).where("reason is not null")


def truncation_report(documents: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, share) per source, most often cut first; blank texts do not count."""
    return judged(documents).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count("reason").alias("n_cut"), F.round(F.count("reason") / F.count(F.lit(1)), 6).alias("share")
    )
