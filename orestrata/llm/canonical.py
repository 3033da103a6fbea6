"""Mapping freely typed values to the entries of a reference list.

A set-similarity join with prefix filter: values and names become sets of
character q-grams, ordered by their rarity over everything; two sets of the
wanted Jaccard similarity must share one of their rarest grams, so only those
prefixes are joined. Length and position of the shared gram drop most
candidates, the rest are verified exactly, an edit check follows, and each
value keeps its best entry.

Only distinct values are joined; their results go back to the rows afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from orestrata.functions import normalize
from orestrata.operators.packed import split_packed
from orestrata.session import settle

#: What only says that nothing is known; "other" does name something, if nothing that is listed.
UNKNOWN = [x for x in normalize.UNKNOWN if x != "other"] + ["n a", "not provided", "not specified", "null"]
#: What names both sexes in one word or two; a mere pool doesn't say of what.
BOTH_SEXES = [x for x in normalize.SEX_MIXED if x not in ("pooled", "pool")] + ["mixed sexes", "pooled sexes"]
#: Names of tags that state a sex, and of those that state a tissue or organ.
SEX_TAG = r"(?i)\b(?:sex|gender)\b"
TISSUE_TAG = r"(?i)\b(?:tissue|organ|anatomical site|body site)\b"

_TAG = r"(?s)^\s*([^:=]+?)\s*[:=]\s*(.*)$"
_IDENTIFIER = r"(?i)^\s*(?:https?://\S*/|obo[/:])?\s*(?:ncbi\s*:?\s*)?(?:ncbitaxon|taxonomy|taxid|txid|taxon|pato)?\s*[:_ ]*\s*([0-9]+)\s*$"


@dataclass(frozen=True)
class Match:
    """Gram length, and the edits allowed from a length on, for one vocabulary.

    An edit changes at most ``gram`` grams and a swap of letters one more, so of
    two names so close the larger set, of m grams, shares all but ``lost``: their
    Jaccard similarity is at least (m - lost) / (m + lost).
    """

    gram: int
    far_length: int  # from this length on two edits pass in a label, below it one
    near_length: int  # below this length none does
    stems: bool = False  # the beginning of a name means it; its names are so few that all their grams are joined


MATCHES = {"organism": Match(3, 14, 5), "tissue": Match(2, 9999, 4), "sex": Match(2, 9999, 4, True)}


def _lost(length: Column, label: Column | None = None) -> Column:
    """Grams that a name of this length may lose to the edits allowed; of a value, of which no kind is known, two fewer letters count."""
    far = length >= _by_vocab(lambda m: m.far_length - (2 if label is None else 0))
    far = far & label if label is not None else far
    return F.when(far, _by_vocab(lambda m: 2 * m.gram)).otherwise(_by_vocab(lambda m: m.gram + 1))


def _by_vocab(what) -> Column:
    """A literal of the vocabulary's Match."""
    out = None
    for v, m in MATCHES.items():
        hit = F.col("vocab") == v
        out = F.when(hit, F.lit(what(m))) if out is None else out.when(hit, F.lit(what(m)))
    return out


def tidy(x: Column) -> Column:
    """Lower case; underscores, hyphens, periods, quotes and any white space as one space."""
    plain = F.regexp_replace(F.lower(x), r"(?U)[\s_\-.\"'“”‘’„]+", " ")
    return F.trim(plain)


def _bare(x: Column) -> Column:
    """Without additions in parentheses or brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*[\(\[][^\)\]]*[\)\]]", " "), r"\s+", " "))


def _grams(text: Column, vocab_gram: Column) -> Column:
    """Distinct q-grams of the text between two edge marks."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    last = F.greatest(F.length(padded) - vocab_gram, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(padded, i + 1, vocab_gram)))


def names_of(terms: DataFrame) -> DataFrame:
    """(vocab, term_id, name, kind): labels, synonyms, and for species names the initial with the epithet where only one entry has it."""
    named = terms.where(F.col("term_id").isNotNull()).select(
        "vocab", "term_id",
        F.explode(F.array_distinct(F.filter(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>"))), lambda x: x.isNotNull()))).alias("raw"),
        "label")
    kind = F.when(F.col("raw") == F.col("label"), "label").otherwise("synonym")
    full = named.select("vocab", "term_id", tidy(F.col("raw")).alias("name"), kind.alias("kind")).where("name <> ''")
    words = F.split(tidy(F.col("label")), " ")
    short = (
        terms.where("vocab = 'organism'").where(F.size(words) == 2)
        .select("vocab", "term_id", F.concat(F.substring(words[0], 1, 1), F.lit(" "), words[1]).alias("name")))
    alone = short.groupBy("vocab", "name").agg(F.min("term_id").alias("term_id"), F.countDistinct("term_id").alias("n")).where("n = 1")
    return full.unionByName(alone.select("vocab", "term_id", "name", F.lit("short").alias("kind"))).distinct()


def _variants(raw: Column) -> Column:
    """What of a value may be the name: all of it, without additions, and of a species name its first two words."""
    bare = _bare(F.regexp_replace(raw, r"(?s),.*$", ""))
    whole, short = tidy(raw), tidy(bare)
    two = F.concat_ws(" ", F.slice(F.split(short, " "), 1, 2))
    species = F.array(whole, short, two)
    return F.when(F.col("vocab") == "organism", species).otherwise(F.array(whole, tidy(_bare(raw))))


def similarity_join(values: DataFrame, names: DataFrame) -> DataFrame:
    """Best entry of every value: (vocab, text, term_id, jaccard) from (vocab, text) and (vocab, term_id, name, kind).

    Values without an entry in reach are absent.
    """
    gram = _by_vocab(lambda m: m.gram)
    v = values.select("vocab", "text").distinct().withColumn("grams", _grams(F.col("text"), gram))
    n = names.withColumn("grams", _grams(F.col("name"), gram))
    both = v.select("vocab", F.explode("grams").alias("gram")).unionByName(n.select("vocab", F.explode("grams").alias("gram")))
    rarity = both.groupBy("vocab", "gram").agg(F.count("*").alias("freq"))

    def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
        tall = df.select(*keys, F.explode("grams").alias("gram")).join(rarity, ["vocab", "gram"])
        grouped = tall.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("freq", "gram"))), lambda s: s["gram"]).alias("grams"))
        return grouped.withColumn("size", F.size("grams"))

    # Sets that share all but ``lost`` grams of the larger one have one of their ``lost + 1`` rarest grams in common.
    stems = _by_vocab(lambda m: m.stems)

    def prefixes(df: DataFrame, keep: list[str]) -> DataFrame:
        length = F.when(stems, F.col("size")).otherwise(F.least(F.col("size"), F.col("lost") + 1))
        return df.select("vocab", *keep, F.posexplode(F.slice("grams", F.lit(1), F.greatest(length, F.lit(1)))).alias("at", "gram"))

    left = ordered(v, ["vocab", "text"]).withColumn("lost", _lost(F.length("text")))
    right = ordered(n, ["vocab", "term_id", "name", "kind"]).withColumn("lost", _lost(F.length("name"), F.col("kind") == "label"))
    lp = prefixes(left, ["text", "grams", "size"])
    rp = prefixes(right, ["term_id", "name", "kind", "grams", "size", "lost"]).select(
        "vocab", "gram", "term_id", "name", "kind", "lost", F.col("grams").alias("ngrams"), F.col("size").alias("nsize"), F.col("at").alias("nat"))
    joined = lp.join(rp, ["vocab", "gram"])
    larger = F.greatest("size", "nsize")
    in_length = stems | (F.abs(F.col("size") - F.col("nsize")) <= F.col("lost"))
    could = F.least(F.col("size") - F.col("at"), F.col("nsize") - F.col("nat"))  # shared grams from here on, at most
    # Only the first shared gram of a pair counts all others, so the filter is applied to the pair's first place.
    first = joined.where(in_length).groupBy("vocab", "text", "term_id", "name", "kind", "lost").agg(
        F.min_by(could, F.col("at")).alias("could"), F.first("grams").alias("grams"), F.first("ngrams").alias("ngrams"),
        F.first("size").alias("size"), F.first("nsize").alias("nsize"))
    shared = F.size(F.array_intersect("grams", "ngrams"))
    verified = (
        first.where(stems | (F.col("could") >= larger - F.col("lost"))).withColumn("shared", shared)
        .withColumn("jaccard", F.col("shared") / (F.col("size") + F.col("nsize") - F.col("shared")))
        .where(stems | (F.col("jaccard") >= (larger - F.col("lost")) / (larger + F.col("lost")) - 1e-9)))
    edits = F.levenshtein("text", "name")
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    swapped = (edits == 2) & (F.length("text") == F.length("name")) & (letters("text") == letters("name"))
    long, short = F.length("name"), F.col("kind") == "short"
    near = (
        (edits == 0) | ((long >= _by_vocab(lambda m: m.near_length)) & ~short & ((edits <= 1) | swapped))
        | ((F.col("kind") == "label") & (long >= _by_vocab(lambda m: m.far_length)) & (edits <= 2))
        | (short & (long >= 8) & (F.substring("text", 1, 2) == F.substring("name", 1, 2)) & ((edits <= 1) | swapped)))
    # A cut-off word of one sex that begins no name of another.
    stem = (F.col("vocab") == "sex") & (F.length("text") >= 3) & F.startswith("name", "text")
    close = verified.withColumn("edits", F.when(stem, F.least(edits, F.lit(1))).otherwise(edits)).where(near | stem)
    best = Window.partitionBy("vocab", "text").orderBy(F.desc("jaccard"), "edits", "kind", "term_id")
    return close.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("vocab", "text", "term_id", "jaccard", "edits")


def map_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(vocab, raw, term_id): the entries meant by every distinct value, ``unmatched`` if none is.

    Values that only say that nothing is known give no row. A value that is an
    identifier means the entry of that vocabulary with the same digits or none.
    A value of the vocabulary ``sex`` may name two. Ties between entries go to
    the smaller term_id.
    """
    known = values.where(F.col("raw").isNotNull()).select("vocab", "raw").distinct()
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("raw"), r"(?U)[\s\"'“”‘’]+", " "), r"^\s+|[\s.;,]+$", ""))
    known = known.withColumn("plain", plain).where(~F.col("plain").isin(UNKNOWN) & ~tidy(F.col("raw")).isin(UNKNOWN))
    digits = F.regexp_extract("raw", _IDENTIFIER, 1)
    tagged = known.withColumn("digits", F.when(F.col("vocab") != "tissue", digits).otherwise(F.lit("")))
    # Bare digits of a sex tag are codes, not identifiers, unless as long as those are.
    by_id = tagged.where((F.col("digits") != "") & ((F.length("digits") >= 5) | ~F.col("raw").rlike(r"^\s*[0-9]+\s*$")))
    ids = terms.select("vocab", "term_id", F.regexp_extract("term_id", r"([0-9]+)$", 1).alias("digits"))
    from_id = by_id.join(ids, ["vocab", "digits"], "left").select("vocab", "raw", F.coalesce("term_id", F.lit("unmatched")).alias("term_id"))
    rest = tagged.join(by_id.select("vocab", "raw"), ["vocab", "raw"], "left_anti")
    both = (F.col("vocab") == "sex") & F.col("plain").isin(BOTH_SEXES)
    from_both = rest.where(both).join(terms.where("vocab = 'sex' and lower(label) in ('male', 'female')").select("vocab", "term_id"), "vocab").select("vocab", "raw", "term_id")
    parts = F.when(F.col("vocab") == "sex", F.split(F.col("raw"), r"(?i)\s*(?:[/&+,]|\band\b|\bor\b)\s*")).otherwise(F.array("raw"))
    pieces = (
        rest.where(~both).select("vocab", "raw", F.posexplode(F.filter(parts, lambda p: F.trim(p) != "")).alias("part", "piece"))
        .select("vocab", "raw", "part", F.posexplode(_variants(F.col("piece"))).alias("variant", "text")).where("text <> ''"))
    found = similarity_join(pieces, names_of(terms))
    hits = pieces.join(found, ["vocab", "text"], "left")
    order = Window.partitionBy("vocab", "raw", "part").orderBy(F.col("edits").asc_nulls_last(), "variant", "term_id")
    chosen = hits.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    from_name = chosen.select("vocab", "raw", F.coalesce("term_id", F.lit("unmatched")).alias("term_id"))
    blank = rest.where(~both).join(pieces.select("vocab", "raw").distinct(), ["vocab", "raw"], "left_anti").select("vocab", "raw", F.lit("unmatched").alias("term_id"))
    return from_id.unionByName(from_both).unionByName(from_name).unionByName(blank).distinct()


def typed_values(series: DataFrame) -> DataFrame:
    """(id, field, vocab, raw): every freely typed value of the four fields of ``series``."""
    split = split_packed(series, "id", ["organisms", "characteristics"], tagged=["characteristics"])
    names = split.where("field = 'organisms'").select("id", "field", F.lit("organism").alias("vocab"), F.col("val").alias("raw"))
    tag, value = F.regexp_extract("val", _TAG, 1), F.regexp_extract("val", _TAG, 2)
    vocab = F.when(tag.rlike(SEX_TAG), "sex").when(tag.rlike(TISSUE_TAG), "tissue")
    tags = split.where("field = 'characteristics'").select("id", "field", vocab.alias("vocab"), value.alias("raw")).where("vocab is not null")
    out = names.unionByName(tags)
    for column, kind in (("organism_ids", "organism"), ("sex_ids", "sex")):
        out = out.unionByName(series.select("id", F.lit(column).alias("field"), F.lit(kind).alias("vocab"), F.explode(column).alias("raw")))
    return out


def map_series(series: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, field, term_id), distinct: the entries meant by the values of each field, ``unmatched`` if a value means none."""
    typed = settle(typed_values(series).where(F.col("raw").isNotNull()).distinct(), "typed")
    mapped = map_values(typed, terms)
    return typed.join(mapped, ["vocab", "raw"]).select("id", "field", "term_id").distinct()
