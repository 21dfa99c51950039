"""Sentence ends learnt from texts without labels: abbreviations, starters and pairs by likelihood ratios (Kiss and Strunk 2006).

A model is three aggregations over all words of a corpus; deciding joins the words that end in a mark with it. No Python
worker runs, and nothing is collected: the model's tables are broadcast only where they are small."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The thresholds of the published method.
ABBREVIATION, PAIR, STARTER = 0.3, 7.88, 30.0
#: Likelihood that an abbreviation is written with its period.
DOTTED = 0.99
#: Rows up to which a table of the model is broadcast.
BROADCAST_ROWS = 200_000


@dataclass
class Boundaries:
    """types: type, abbreviation, starter, opens (seen with a small letter, and with a capital only after ends), of
    types that have at least one of these. pairs: type, next_type that stand together across a period."""

    types: DataFrame
    pairs: DataFrame


#: White space between words; marks that open a word and such that close one, each as a class of its own.
SPACE, OPENING, CLOSING = r"[\x20\x09-\x0D]", r"[\"'(\[{“‘«]", r"[\"')\]}”’»]"


def _bare(x: Column) -> Column:
    """A text without opening marks before its words and closing ones behind them.

    The marks go in two passes over the text, not word by word; all else is passed over at its first sign."""
    out = F.regexp_replace(F.coalesce(x, F.lit("")), rf"{OPENING}(?<![^\x20\x09-\x0D](?s:.)){OPENING}*+", "")
    return F.regexp_replace(out, rf"{CLOSING}++(?=\z|{SPACE})", "")


def words(x: Column) -> Column:
    """The words of a text without opening marks before and closing ones behind them; those without any other sign go."""
    return F.array_remove(F.split(_bare(x), rf"{SPACE}+"), "")


def type_of(w: Column) -> Column:
    """A word in lower case without marks at its end; numbers are all ##."""
    low = F.lower(F.regexp_replace(w, r"[.,;:!?]+\z", ""))
    return F.when(low.rlike(r"^[0-9][0-9.,:/-]*\z"), F.lit("##")).otherwise(low)


def log_ratio(n_both: Column, n_first: Column, n_second: Column, n: Column) -> Column:
    """-2 log of the likelihood that second is as likely after first as elsewhere, over that of two likelihoods."""
    rest, others = n_second - n_both, n - n_first
    p, p1, p2 = n_second / n, n_both / n_first, rest / others
    term = lambda k, m, q: F.when(k > 0, k * F.ln(q)).otherwise(0.0) + F.when(m > k, (m - k) * F.ln(1 - q)).otherwise(0.0)
    return 2 * (term(n_both, n_first, p1) + term(rest, others, p2) - term(n_both, n_first, p) - term(rest, others, p))


def _runs(x: Column, marks: str, sign: str) -> Column:
    """The words of a text, cut where sign has a line break; sign stands between words of which the first ends in one of marks."""
    lines = F.regexp_replace(F.btrim(_bare(x), F.lit(" \t\n\x0b\x0c\r")), rf"{SPACE}+", "\n")
    return F.split(F.concat(F.lit("\t" if "\n" in sign else ""), F.regexp_replace(lines, rf"(?<=[{marks}])\n", sign)), "\n")


def _neighbours(docs: DataFrame, text: str, marks: str, *keep: str) -> DataFrame:
    """A row for each word of docs that ends in one of marks, with the next one; none for the last. No other word gets a row."""
    runs = docs.select(*keep, F.explode(_runs(F.col(text), marks, "\t")).alias("__r")).where(F.contains("__r", F.lit("\t")))
    w = runs.select(*keep, F.split("__r", "\t").alias("__w"))
    rest = F.size("__w") - 1
    return w.select(*keep, F.inline(F.arrays_zip(F.slice("__w", F.lit(1), rest).alias("word"), F.slice("__w", F.lit(2), rest).alias("next"))))


def _shapes(distinct: DataFrame) -> DataFrame:
    """Words with type, dot (it ends in one period), upper and lower."""
    shape = {"type": type_of(F.col("word")), "dot": F.col("word").rlike(r"(^|[^.])\.\z"), "upper": F.col("word").rlike(r"^\p{Lu}"), "lower": F.col("word").rlike(r"^\p{Ll}")}
    return distinct.withColumns(shape)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def train(docs: DataFrame, text: str = "text", keep=lambda df, name: df) -> Boundaries:
    """A model of the texts of docs. keep(df, name) may store a table on the way, so that a later step reads it again.

    Null and empty texts have no words; rows that repeat count as often as they stand. Without words the model is empty."""
    # Words are counted as they stand; what they look like is found out once for each distinct one. A tab stands before
    # those that open a text or follow a mark.
    forms = docs.select(F.explode(_runs(F.col(text), ".!?:", "\n\t")).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    forms = _shapes(forms.select(F.ltrim("form", F.lit("\t")).alias("word"), "n", F.when(F.startswith("form", F.lit("\t")), 0).otherwise(F.col("n")).alias("inside")).where("word != ''"))
    of = lambda c, n="n": F.sum(F.when(F.col(c), F.col(n)).otherwise(0))
    counts = forms.groupBy("type").agg(F.sum("n").alias("n"), of("dot").alias("n_dot"), of("lower").alias("n_lower"), of("upper").alias("n_upper"), of("upper", "inside").alias("n_inside"))
    counts = keep(counts, "types")
    total = F.broadcast(counts.agg(F.sum("n").alias("all"), F.sum("n_dot").alias("dots")))  # one row
    p, plain = F.col("dots") / F.col("all"), F.col("n") - F.col("n_dot")
    ratio = 2 * (F.col("n_dot") * (F.ln(F.lit(DOTTED)) - F.ln(p)) + plain * (F.ln(F.lit(1 - DOTTED)) - F.ln(1 - p)))
    size = F.length(F.translate("type", ".", "")).cast("double")
    score = ratio * F.exp(-size) * (F.length("type") - size + 1) * F.pow(size, -plain.cast("double"))
    short = F.col("type").rlike(r"^\p{L}") & (F.col("n_dot") > 0) & (F.col("dots") < F.col("all"))
    judged = counts.join(total).withColumn("abbreviation", F.coalesce(F.when(short, score >= ABBREVIATION), F.lit(False)))
    judged = judged.withColumn("opens", (F.col("n_lower") > 0) & (F.col("n_upper") > 0) & (F.col("n_inside") == 0))
    known = keep(judged.where("abbreviation").select("type"), "abbreviations")

    # What follows a period, by what stands before it: after an end, or after an abbreviation, a letter or a number.
    follows = _shapes(_neighbours(docs, text, ".").groupBy("word", "next").agg(F.count("*").alias("n")))
    follows = follows.where("dot").withColumn("next_type", type_of(F.col("next"))).groupBy("type", "next_type").agg(F.sum("n").alias("n_both"))
    follows = follows.join(_small(known.withColumn("abbreviation", F.lit(True))), "type", "left").withColumn("held", F.coalesce("abbreviation", F.lit(False)) | (F.col("type") == "##") | F.col("type").rlike(r"^\p{L}\z"))
    follows = keep(follows.select("type", "next_type", "n_both", "held"), "follows")
    ends = follows.where("NOT held").groupBy(F.col("next_type").alias("type")).agg(F.sum("n_both").alias("n_after"))
    breaks = F.broadcast(follows.where("NOT held").agg(F.sum("n_both").alias("n_breaks")))  # one row
    n = lambda c: F.col(c).cast("double")
    after = judged.join(ends, "type", "left").join(breaks)
    more = (F.col("n_after") / F.col("n_breaks") > F.col("n") / F.col("all")) & F.col("type").rlike(r"^\p{L}")
    starter = F.coalesce(F.when(more & (F.col("n_breaks") < F.col("all")), log_ratio(n("n_after"), n("n_breaks"), n("n"), n("all")) >= STARTER), F.lit(False))
    types = keep(after.withColumn("starter", starter).where("abbreviation OR starter OR opens").select("type", "abbreviation", "starter", "opens"), "model")

    firsts, seconds = counts.select("type", F.col("n_dot").alias("n_first")), counts.select(F.col("type").alias("next_type"), F.col("n").alias("n_second"))
    pairs = follows.where("held AND next_type != '##' AND n_both > 1").join(firsts, "type").join(seconds, "next_type").join(total).where("n_first < all")
    pairs = pairs.join(_small(types.where("starter").select(F.col("type").alias("next_type"))), "next_type", "left_anti")
    tied = (F.col("n_both") / F.col("n_first") > F.col("n_second") / F.col("all")) & (log_ratio(n("n_both"), n("n_first"), n("n_second"), n("all")) >= PAIR)
    return Boundaries(types, keep(pairs.where(tied).select("type", "next_type"), "pairs"))


def ends(docs: DataFrame, model: Boundaries, key: str, text: str = "text") -> DataFrame:
    """key, type, next_type of each place in docs where a sentence ends and another one follows.

    ! and ? end one always, dots in a row before a capital. A period does, unless the word is an abbreviation or a single
    letter: then only before a capital that starts sentences, or is else written small; or a number before a small letter.
    Pairs that stand together across a period are never cut."""
    at = _shapes(_neighbours(docs, text, ".!?", key))
    after = {"next_type": type_of(F.col("next")), "next_upper": F.col("next").rlike(r"^\p{Lu}"), "next_lower": F.col("next").rlike(r"^\p{Ll}")}
    at = at.withColumns(after).select(key, "word", "type", "dot", "next_type", "next_upper", "next_lower")
    types = model.types
    at = at.join(_small(types.select("type", "abbreviation").where("abbreviation")), "type", "left")
    at = at.join(_small(types.where("starter OR opens").select(F.col("type").alias("next_type"), F.lit(True).alias("begins"))), "next_type", "left")
    at = at.join(_small(model.pairs.withColumn("pair", F.lit(True))), ["type", "next_type"], "left")
    none = lambda c: F.coalesce(c, F.lit(False))
    short = none("abbreviation") | F.col("type").rlike(r"^\p{L}\z")
    cut = (
        F.when(F.col("word").rlike(r"[!?]\z"), F.lit(True)).when(~F.col("dot"), F.col("next_upper")).when(none("pair"), F.lit(False))
        .when(short, F.col("next_upper") & none("begins")).when(F.col("type") == "##", ~F.col("next_lower")).otherwise(F.lit(True))
    )
    return at.where(cut).select(key, "type", "next_type")


def sentence_counts(docs: DataFrame, model: Boundaries, key: str, text: str = "text") -> DataFrame:
    """key and n_sentences for each distinct key of docs, over all its rows; 0 where there are no words."""
    base = docs.groupBy(key).agg(F.sum(_bare(F.col(text)).rlike(r"[^\x20\x09-\x0D]").cast("long")).alias("some"))
    cuts = ends(docs, model, key, text).groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("cuts"))
    return base.join(cuts, F.col(key).eqNullSafe(F.col("__k")), "left").select(key, (F.col("some") + F.coalesce("cuts", F.lit(0))).alias("n_sentences"))
