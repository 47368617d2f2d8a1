"""Benchmark decontamination by template windows.

Numbers, names (capitalised words) and units become typed placeholders, so a
question asked again with other parameters keeps its template.  Documents' and
items' windows of ``WINDOW`` template words are hash-joined; matched windows on
one diagonal (document place minus item place) must map the item's slot values
to the document's one to one in value.  A document is reported with an item when
consistent windows cover at least ``MIN_COVERAGE`` of what the item's windows can.

Lower-cased windows, matched with all values, find verbatim copies in another case
(where capitals make other names) and items without a specific window; an item
shorter than a window is one window of its whole length.

DataFrame functions only.  Each text is split once; codes of runs of words are made
by doubling, and tested against a bitmap of the items' codes before anything
leaves the text's row.  The documents are not shuffled: the windows left meet a
broadcast of the item windows, whose number is checked; beyond the bound the
join is left to Spark, which shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 8
#: words of a window that must not be placeholders
MIN_LITERALS = 4
MIN_COVERAGE = 0.5
#: share of an item's slot values that must map to one value of the document
MIN_CONSISTENT = 0.8
#: item windows (rows of about 100 bytes) up to which they are broadcast
MAX_BROADCAST_WINDOWS = 500_000
#: bits of the bitmap that documents' windows are tested against before the join (64 a window or more, up to this)
MAX_BITS = 1 << 20
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
         "mg", "g", "kg", "ton", "tons", "ounce", "ounces", "pound", "pounds", "ml", "l", "liter", "liters",
         "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours",
         "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars",
         "euro", "euros", "percent", "degree", "degrees", "mph", "km/h", "watt", "watts", "volt", "volts")

#: what lies between words: a run of other characters that holds white space, or starts or ends the text.
#: It is tried where a run starts only, so long runs without white space (part of a word) cost no more than others.
_BETWEEN = (r"(?=[^\p{L}\p{N}])(?<![^\p{L}\p{N}])"
            r"(?:^[^\p{L}\p{N}]++|[^\p{L}\p{N}\x20\x09-\x0D]*+(?:[\x20\x09-\x0D][^\p{L}\p{N}]*+|$))")


def bare_words(text: Column) -> Column:
    """Words without punctuation at their edges; words of punctuation alone are dropped."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BETWEEN), lambda t: t != "")


def placeholder(word: Column) -> Column:
    """``<num>``, ``<unit>``, ``<name>`` or null."""
    first = F.substring(word, 1, 1)
    return F.when(first.between("0", "9"), "<num>").when(F.lower(word).isin(*UNITS), "<unit>") \
        .when(F.lower(first) != first, "<name>")


def template_code(word: Column) -> Column:
    return F.xxhash64(F.coalesce(placeholder(word), F.lower(word)))


def plain_code(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def slot_value(word: Column) -> Column:
    """The lower-cased value of a placeholder, null for other words."""
    return F.when(placeholder(word).isNotNull(), F.lower(word))


def with_run_codes(rows: DataFrame, name: str, lengths: list[int]) -> DataFrame:
    """``rows`` plus an array ``name``_n for each n of ``lengths``: at each place the code of the n words from there.

    Runs double (two of one word, two of two, ...), and two that overlap make any
    length between.  The last n - 1 entries, runs past the end, mean nothing.
    """
    def pairs(column: str, step: int) -> Column:
        return F.zip_with(column, F.slice(column, step + 1, F.size(column)), lambda x, y: F.xxhash64(x, y))

    done, longest = {1: name}, max(lengths, default=1)
    while 2 * max(done) <= longest:
        half = max(done)
        rows = rows.withColumn(f"{name}__{2 * half}", pairs(done[half], half))
        done[2 * half] = f"{name}__{2 * half}"
    for n in lengths:
        half = max(d for d in done if d <= n)
        rows = rows.withColumn(f"{name}_{n}", F.col(done[n]) if n in done else pairs(done[half], n - half))
    return rows


def _words_of(places: Column, length: Column) -> Column:
    """Number of words that runs of ``length`` words at ``places`` cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + length - 1)))))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW,
                 min_literals: int = MIN_LITERALS) -> tuple[DataFrame, list[int]]:
    """(item, item_text, n_words, length, place, code, slots) of the items' windows, and the lengths of plain ones.

    ``length`` 0: template windows that are specific enough, ``n_words`` the words
    they cover.  Else: windows of ``length`` lower-cased words (``window``, or the
    whole item if shorter), ``n_words`` all words of the item.  Rows alike in id
    and text count once; ids with several texts are several items.
    """
    key = ["item", "item_text"]
    words = items.select(F.col(id_col).alias("item"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("item_text"),
                         F.col(text_col).alias("text")).dropDuplicates(key) \
        .select(*key, bare_words(F.col("text")).alias("words"))
    coded = words.select(*key, "words", F.size("words").alias("n_words"), F.least(F.size("words"), F.lit(window)).alias("length"),
                         F.transform("words", template_code).alias("t"), F.transform("words", plain_code).alias("p"))
    lengths = sorted(coded.filter("n_words > 0").agg(F.collect_set("length")).first()[0])

    template = with_run_codes(coded, "t", [window]).select(
        *key, "words", F.posexplode(F.slice(f"t_{window}", 1, F.greatest(F.col("n_words") - (window - 1), F.lit(0)))).alias("at", "code"))
    template = template.select(*key, F.lit(0).alias("length"), (F.col("at") + 1).alias("place"), "code",
                               F.transform(F.slice("words", F.col("at") + 1, window), slot_value).alias("slots")) \
        .filter(F.size(F.filter("slots", lambda s: s.isNull())) >= min_literals)
    total = template.groupBy(*key).agg(F.collect_set("place").alias("places")).select(
        F.col("item").alias("i"), F.col("item_text").alias("t"), _words_of(F.col("places"), F.lit(window)).alias("n_words"))
    template = template.join(total, template["item"].eqNullSafe(total["i"]) & (template["item_text"] == total["t"])).drop("i", "t")
    if not lengths:
        return template, lengths
    runs = F.coalesce(*[F.when(F.col("length") == n, F.col(f"p_{n}")) for n in lengths])
    plain = with_run_codes(coded, "p", lengths).filter("n_words > 0").select(
        *key, "n_words", "length", F.posexplode(F.slice(runs, 1, F.col("n_words") - F.col("length") + 1)).alias("at", "code"))
    plain = plain.select(*key, "n_words", "length", (F.col("at") + 1).alias("place"), "code", F.array().cast("array<string>").alias("slots"))
    return template.unionByName(plain), lengths


def may_be_known(code: Column, wins: DataFrame, n: int) -> Column:
    """False only for codes that ``wins`` lacks: a test against a bitmap of at most ``MAX_BITS`` bits, a literal of the plan."""
    bits = min(MAX_BITS, max(1 << 12, 1 << (64 * n).bit_length()))
    slot = lambda c: F.shiftrightunsigned(c.bitwiseAND(bits - 1), 6).cast("int")
    bit = lambda c: c.bitwiseAND(63).cast("int")
    marks = wins.groupBy(slot(F.col("code")).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(code & 63 AS int))")).alias("marks"))
    words = [0] * (bits // 64)
    for row in marks.collect():  # at most MAX_BITS / 64 rows
        words[row["slot"]] = row["marks"]
    bitmap = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return F.getbit(F.get(bitmap, slot(code)), bit(code)) == 1


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  min_literals: int = MIN_LITERALS, min_coverage: float = MIN_COVERAGE,
                  min_consistent: float = MIN_CONSISTENT) -> DataFrame:
    """(id, text_code, item, n_windows, coverage, n_slots, n_changed) of each document that holds an item.

    ``n_windows`` matched item windows, ``coverage`` the share of the item's
    words in them, ``n_slots`` slot pairs, ``n_changed`` those with other values
    (0: verbatim but for punctuation and case).  Pairs without a template match
    but with matched lower-cased windows have those windows' count and coverage
    (of all the item's words) and no slots; there an item of fewer than
    ``window`` words is one window that counts wherever its words stand, and one
    of fewer than ``min_literals`` words counts only where it is the whole
    document.  Documents alike in id and text give one row; null ids are kept;
    empty tables give no rows.  Other columns are not read.  Each text is split
    once; of its windows only those that may be an item's leave its row.
    """
    wins, lengths = item_windows(items, item_id_col, item_text_col, window, min_literals)
    n_wins = wins.count()
    by_code = wins.groupBy("length", "code").agg(
        F.collect_list(F.struct("item", "item_text", "n_words", "place", "slots")).alias("hits"))
    if n_wins <= MAX_BROADCAST_WINDOWS:
        by_code = F.broadcast(by_code)

    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_code"), bare_words(text).alias("words"))
    coded = words.select("id", "text_code", "words", F.size("words").alias("n_own"),
                         F.transform("words", template_code).alias("t"), F.transform("words", plain_code).alias("p"))
    coded = with_run_codes(with_run_codes(coded, "t", [window]), "p", lengths)
    # the runs of a text in one array: template windows first, then the plain ones by length
    runs = [(0, window, f"t_{window}")] + [(n, n, f"p_{n}") for n in lengths]
    number = [F.greatest(F.col("n_own") - (n - 1), F.lit(0)) for _, n, _ in runs]
    own = coded.select("id", "text_code", "words", "n_own", F.posexplode(F.concat(
        *[F.slice(column, 1, count) for (_, _, column), count in zip(runs, number)])).alias("pos", "code")) \
        .filter(may_be_known(F.col("code"), wins, n_wins))
    start, length, at = F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("int")
    for (kind, _, _), count in zip(runs, number):
        inside = F.col("pos") >= start
        length, at = F.when(inside, kind).otherwise(length), F.when(inside, F.col("pos") - start + 1).otherwise(at)
        start = start + count
    own = own.select("id", "text_code", "words", "n_own", "code", length.alias("length"), at.alias("at")).filter(
        (F.col("length") == 0) | (F.col("length") >= min_literals) | (F.col("length") == F.col("n_own")))
    # a few words go on with a window, never its text: a long text's windows would copy it each
    own = own.select("id", "text_code", "length", "code", "at", F.slice("words", F.col("at"), window).alias("own"))

    met = own.join(by_code, ["length", "code"]).select("id", "text_code", "length", "at", "own", F.explode("hits").alias("hit"))
    # equal templates have their slots in the same places
    pair = F.filter(F.arrays_zip(F.col("hit.slots").alias("v"), F.transform("own", F.lower).alias("u")), lambda x: x["v"].isNotNull())
    met = met.select("id", "text_code", "hit.item", "hit.item_text", "hit.n_words", "length", F.col("hit.place").alias("place"),
                     (F.col("at") - F.col("hit.place")).alias("shift"), pair.alias("pairs"))
    who = ["id", "text_code", "item", "item_text", "n_words", "length"]
    diagonal = met.groupBy(*who, "shift").agg(
        F.collect_set("place").alias("places"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    values = F.array_distinct(F.transform("pairs", lambda x: x["v"]))
    single = F.size(F.filter(values, lambda v: F.size(F.filter("pairs", lambda x: x["v"] == v)) == 1))
    diagonal = diagonal.withColumn("n_values", F.size(values)).withColumn("n_single", single) \
        .filter(F.col("n_single") >= min_consistent * F.col("n_values"))
    # templates add up over the diagonals, plain windows stay on theirs
    found = diagonal.groupBy(*who, F.when(F.col("length") > 0, F.col("shift")).alias("line")).agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    run = F.when(F.col("length") == 0, F.lit(window)).otherwise(F.col("length"))
    found = found.select(
        "id", "text_code", "item", F.when(F.col("length") == 0, F.col("item_text")).alias("item_text"),
        (F.col("length") > 0).alias("plain"), F.size("places").alias("n_windows"),
        (_words_of(F.col("places"), run) / F.col("n_words")).alias("coverage"), F.size("pairs").alias("n_slots"),
        F.size(F.filter("pairs", lambda x: x["v"] != x["u"])).alias("n_changed")) \
        .filter(F.col("coverage") >= min_coverage)
    # ids with several texts are several items: a pair has the templates' rows, or else the best plain one
    key = ["id", "text_code", "item"]
    numbers = ["n_windows", "coverage", "n_slots", "n_changed"]
    found = found.groupBy(*key, "item_text", "plain").agg(*[F.max(c).alias(c) for c in numbers])
    first = F.min("plain").over(Window.partitionBy(*key))
    return found.withColumn("first", first).filter(F.col("plain") == F.col("first")).select(*key, *numbers)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` that hold no item, with the columns of ``docs``."""
    found = contamination(docs, items, id_col, text_col, **options).select(
        F.col("id").alias("_found_id"), F.col("text_code").alias("_found_code")).distinct()
    code = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(found, docs[id_col].eqNullSafe(found["_found_id"]) & (code == found["_found_code"]), "left_anti")
