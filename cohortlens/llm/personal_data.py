"""Personal data by candidate generation and gradient boosting.

High-recall generators propose spans: four strict kinds (``BASE_KINDS``, reported
whenever their format check holds) and looser ones that overlap them.  Boosted
trees score every candidate on format and context; a threshold for each loose
kind, calibrated to ``MIN_PRECISION`` on all its candidates that were not fitted
on, selects the spans to add.  Of overlapping added spans the best scored one stays, and none that
overlaps a strict one.

DataFrame and Spark ML only.  Places come from the lengths of the pieces between
matches (``split``) and of the matches (``regexp_extract_all``), summed by a
window over the candidates of one text, so texts are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.shared import settled

# Patterns are written so that no start is tried twice and no repetition recurses:
# a run is only entered at its first character or where the last match ended (\G),
# and what nothing follows is possessive.  They match what the plain forms match.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_MAIL_LIKE = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]?(?:@|at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(]?(?:\.|dot|DOT)[\])]?\x20?[A-Za-z]{2,20}){1,4}+"
_NUMBER_LIKE = r"(?:(?<![0-9])|\G)\(?[0-9]{2,5}+\)?(?:[\x20./-][0-9]{2,8}+){1,5}+"
_ACCOUNT_LIKE = r"(?:(?<![A-Za-z0-9])|\G)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+"

BASE_KINDS = ("email", "ip", "card", "phone")
#: kind -> (pattern, cheap test that a text may hold one)
GENERATORS: dict[str, tuple[str, str]] = {
    "email": (_EMAIL, "@"), "ip": (_IP, r"[0-9]\.[0-9]"), "card": (_CARD, r"[0-9][\x20-]?[0-9]"), "phone": (_PHONE, r"\+[0-9]"),
    "mail_like": (_MAIL_LIKE, r"[\[(](?:@|at|AT)[\])]|@"), "number_like": (_NUMBER_LIKE, r"[0-9]{2}\)?[\x20./-][0-9]{2}"),
    "account_like": (_ACCOUNT_LIKE, r"[A-Z]{2}[0-9]{2}"),
}
LOOSE_KINDS = tuple(k for k in GENERATORS if k not in BASE_KINDS)
KINDS = BASE_KINDS + LOOSE_KINDS
LEFT, RIGHT = 32, 16
#: distinct candidates chosen by hash, shared evenly among the kinds; four fifths of them are fitted on
MAX_TRAIN = 20_000
MIN_PRECISION = 0.95
#: positives of a kind, of those not fitted on, below which no threshold is set
MIN_POSITIVES = 5
TREES, DEPTH, SEED = 10, 3, 17
_BINS = 200


_SPAN = "struct<kind:string,nth:int,gap:int,match:string,left:string,right:string>"


def _kind_spans(kind: str) -> Column:
    """Matches of a kind with the length of the piece before each and its surroundings."""
    m, p = F.col(f"m_{kind}"), F.col(f"p_{kind}")
    around = F.arrays_zip(m.alias("m"), F.slice(p, F.lit(1), F.size(m)).alias("p"), F.slice(p, F.lit(2), F.size(m)).alias("q"))
    return F.transform(around, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("nth"), F.char_length(x["p"]).alias("gap"), x["m"].alias("match"),
        F.right(x["p"], F.lit(LEFT)).alias("left"), F.left(x["q"], F.lit(RIGHT)).alias("right")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_code, kind, nth, start, end, match, left, right) of every generator's spans.

    Matches of a kind are leftmost and do not overlap; places are code points.
    Rows alike in id and text give one set of candidates.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_code"), text.alias("text"))
    parts = rows.select("id", "text_code", *[
        F.when(F.col("text").rlike(may), F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"m_{k}")
        for k, (p, may) in GENERATORS.items()], "text")
    parts = parts.select("id", "text_code", *[f"m_{k}" for k in GENERATORS], *[
        F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"p_{k}") for k, (p, _) in GENERATORS.items()])
    parts = parts.filter(F.greatest(*[F.size(f"p_{k}") for k in GENERATORS]) > 0)
    each = [F.coalesce(_kind_spans(k), F.array().cast(f"array<{_SPAN}>")) for k in GENERATORS]
    found = parts.select("id", "text_code", F.explode(F.concat(*each)).alias("c")).select("id", "text_code", "c.*") \
        .dropDuplicates(["id", "text_code", "kind", "nth"])
    upto = Window.partitionBy("id", "text_code", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("match")).over(upto).cast("bigint")
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("match")).drop("gap")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(d == "", 0).otherwise(
        F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))))
    return F.aggregate(value, F.lit(0), lambda a, b: a + b) % 10 == 0


def _octets(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def with_checks(found: DataFrame) -> DataFrame:
    """``found`` plus ``base``: a strict kind whose format check holds."""
    digits = _digits(F.col("match"))
    n = F.length(digits)
    card = F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    ok = F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", _octets(F.col("match"))) \
        .when(F.col("kind") == "card", card).when(F.col("kind") == "phone", n.between(9, 15)).otherwise(False)
    return found.withColumn("base", ok)


_CONTACT = r"(?i)(?:phone|tel|call|fax|mobile|contact|mail|write|reach)"
_MONEY = r"(?i)(?:card|visa|iban|account|bank|credit|pay)"
_IDENTITY = r"(?i)(?:ssn|social|passport|licen[cs]e|tax|national|born|birth|id\b|no\.)"
_HOST = r"(?i)(?:ip|host|server|address|login)"


def features(found: DataFrame) -> DataFrame:
    """``found`` plus numeric columns of format and context."""
    m, left, right = F.col("match"), F.col("left"), F.col("right")
    digits = _digits(m)
    n = F.length(digits)
    flag = lambda c: c.cast("double")
    cols = {
        "f_length": F.char_length(m), "f_digits": n, "f_letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "f_upper": F.length(F.regexp_replace(m, "[^A-Z]", "")), "f_dots": F.length(F.regexp_replace(m, r"[^.]", "")),
        "f_dashes": F.length(F.regexp_replace(m, "[^-]", "")), "f_spaces": F.length(F.regexp_replace(m, "[^ ]", "")),
        "f_groups": F.size(F.split(m, "[^0-9]+")), "f_distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "f_plus": flag(m.startswith("+")), "f_at": flag(m.contains("@")), "f_paren": flag(m.contains("(")),
        "f_zero": flag(digits.startswith("0")), "f_luhn": flag(F.when(n.between(12, 19), luhn(digits)).otherwise(False)),
        "f_contact": flag(left.rlike(_CONTACT)), "f_money": flag(left.rlike(_MONEY)),
        "f_identity": flag(left.rlike(_IDENTITY)), "f_host": flag(left.rlike(_HOST)),
        "f_after_word": flag(left.rlike(r"[\p{L}\p{N}]$")), "f_before_word": flag(right.rlike(r"^[\p{L}\p{N}]")),
        "f_line_start": flag((left == "") | left.endswith("\n")),
    }
    return found.select("*", *[c.cast("double").alias(k) for k, c in cols.items()])


def _label(found: DataFrame) -> Column:
    """Weak label: the strict check, or for loose kinds a word of their use in the left context."""
    n = F.col("f_digits")
    loose = F.when(F.col("kind") == "mail_like", F.col("match").rlike(r"(?i)[\[(](?:@|at)[\])]")) \
        .when(F.col("kind") == "number_like", ((F.col("f_contact") > 0) & n.between(7, 15)) | ((F.col("f_identity") > 0) & n.between(8, 14))) \
        .when(F.col("kind") == "account_like", (F.col("f_money") > 0) & n.between(8, 30)).otherwise(False)
    return (F.col("base") | loose).cast("double")


@dataclass
class Scorer:
    """A fitted model and the least score of each loose kind (absent: never selected)."""

    model: PipelineModel | None
    thresholds: dict[str, float]

    def score(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        if self.model is None:
            return rows.withColumn("score", F.lit(0.0))
        return self.model.transform(rows).withColumn("score", vector_to_array("probability")[1]) \
            .drop("features", "rawPrediction", "probability", "prediction")


def kind_shares(counts: dict[str, int], total: int) -> dict[str, float]:
    """The part of each kind that a sample of ``total`` takes: even quotas, what small kinds leave goes to larger ones."""
    shares = {}
    for k, (kind, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        quota = total / (len(counts) - k)
        shares[kind] = min(1.0, quota / max(1, n))
        total -= min(n, quota)
    return shares


def fit(rows: DataFrame, max_train: int = MAX_TRAIN, min_precision: float = MIN_PRECISION) -> Scorer:
    """Boosted trees on four fifths of a hash sample of about ``max_train`` distinct candidates, thresholds on all others.

    The sample is even by kind.  Copies of a text are all fitted on (once) or not
    at all.  Without candidates of both labels there is no model and nothing is added.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    code = F.xxhash64("text_code", "kind", "nth")
    counts = rows.groupBy("kind").agg(F.approx_count_distinct(code).alias("n")).collect()  # at most one row a kind
    if not counts:
        return Scorer(None, {})
    least = F.lit(0)
    for kind, share in sorted(kind_shares({r["kind"]: r["n"] for r in counts}, max_train).items()):
        least = F.when(F.col("kind") == kind, F.lit(int(800_000 * share))).otherwise(least)
    fitted = F.pmod(code, F.lit(1_000_000)) < least
    train = rows.filter(fitted).withColumn("label", _label(rows)).dropDuplicates(["text_code", "kind", "nth"])
    train = settled(train, "pii-sample")
    if train.select("label").distinct().count() < 2:
        return Scorer(None, {})
    inputs = sorted(c for c in rows.columns if c.startswith("f_"))
    scorer = Scorer(Pipeline(stages=[
        VectorAssembler(inputCols=inputs, outputCol="features"),
        GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32)]).fit(train), {})
    held = scorer.score(rows.filter(~fitted & F.col("kind").isin(*LOOSE_KINDS)).withColumn("label", _label(rows)))
    # precision of all at or above a score, by bins of it
    bins = held.groupBy("kind", F.floor(F.col("score") * _BINS).alias("bin")).agg(
        F.sum("label").alias("hits"), F.count("*").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.select("kind", "bin", F.sum("hits").over(above).alias("hits"), F.sum("n").over(above).alias("n"))
    good = bins.filter((F.col("hits") >= MIN_POSITIVES) & (F.col("hits") >= min_precision * F.col("n")))
    for r in good.groupBy("kind").agg(F.min("bin").alias("bin")).collect():  # at most one row a kind
        scorer.thresholds[r["kind"]] = r["bin"] / _BINS
    return scorer


def select_spans(scored: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Strict spans, and loose ones at or above their threshold that are best where they overlap."""
    least = F.lit(None).cast("double")
    for kind, t in sorted(thresholds.items()):
        least = F.when(F.col("kind") == kind, F.lit(t)).otherwise(least)
    rows = scored.filter(F.col("base") | (F.col("score") >= least))
    if not thresholds:
        return rows
    # islands of overlapping spans, then the best loose one of those without a strict one
    order = Window.partitionBy("id", "text_code").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("is_first", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("is_first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("id", "text_code", "island")
    best = F.row_number().over(island.orderBy(F.col("base").desc(), F.col("score").desc(), "start", "kind"))
    return rows.withColumn("best", best).filter(F.col("base") | (F.col("best") == 1)).drop("is_first", "island", "best")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scorer: Scorer | None = None,
                   max_train: int = MAX_TRAIN, min_precision: float = MIN_PRECISION) -> DataFrame:
    """(id, text_code, kind, nth, start, end, match, base, score) of the spans to redact.

    A null text counts as empty; null ids are kept; rows alike in id and text give
    one set of spans; empty tables give none.  Other columns are not read.
    """
    rows = settled(features(with_checks(candidates(docs, id_col, text_col))), "pii-candidates")
    scorer = scorer or fit(rows, max_train, min_precision)
    # strict spans need no score
    loose = scorer.score(rows.filter(~F.col("base") & F.col("kind").isin(*scorer.thresholds)))
    both = rows.filter("base").withColumn("score", F.lit(1.0)).unionByName(loose)
    return select_spans(both, scorer.thresholds).select(
        "id", "text_code", "kind", "nth", "start", "end", "match", "base", "score")


def digest(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of ``docs`` each: counts by strict kind, the digest of strict spans, all spans as text."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    said = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    line = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), said.alias("said"))
    text_of = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["said"]), ",")
    per = spans.groupBy("id", "text_code").agg(
        *[F.sum(F.when(F.col("base") & (F.col("kind") == k), 1).otherwise(0)).alias(f"n_{k}") for k in BASE_KINDS],
        F.sum(F.when(F.col("base"), 0).otherwise(1)).alias("n_added"),
        text_of(F.collect_list(F.when(F.col("base"), line))).alias("base_spans"),
        text_of(F.collect_list(line)).alias("spans"))
    rows = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row_code"))
    both = rows.join(per, rows["row_id"].eqNullSafe(per["id"]) & (rows["row_code"] == per["text_code"]), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    return both.select(F.col("row_id").alias(id_col), *[zero(f"n_{k}") for k in BASE_KINDS],
                       F.sha2(none("base_spans").cast("binary"), 256).alias("base_sha256"), none("spans").alias("spans"),
                       zero("n_added"))
