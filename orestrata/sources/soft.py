"""Block-structured study text: stripping of data tables, checks, parsing into records.

A file is read line by line and leaves as its blocks, so its size doesn't matter
and no shuffle is needed until a record is put together. Errors are a column, one
text per file, so that one bad file doesn't stop a run.
"""

from __future__ import annotations

import io
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orestrata.functions.normalize import lookup, map_assay, map_sex, SPECIES
from orestrata.functions.text import accession_number, labelled, sorted_distinct, strip

_TABLES = "sample|platform|series_matrix"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text, error): whole files, strict UTF-8; gzip is opened by suffix. Spark lists no file of length 0."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        import gzip

        import pyarrow as pa

        for batch in batches:
            texts, errors = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    texts.append((gzip.decompress(data) if name.endswith(".gz") else data).decode("utf-8"))
                    errors.append(None)
                except (OSError, EOFError, UnicodeDecodeError) as e:
                    texts.append(None)
                    errors.append(f"unreadable: {type(e).__name__}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["file", "text", "error"])

    return raw.mapInArrow(run, "file string, text string, error string")


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def strip_tables(text: Column) -> Column:
    """The text without its data tables, an unterminated one to its end. Tables of comparisons stay; a stray end marker is an ordinary line.

    One pass of a pattern over the text, whatever the number of lines.
    """
    ended = F.concat(F.regexp_replace(text, r"\r\n", "\n"), F.lit("\n"))
    table = rf"(?ims)^!(?:{_TABLES})_table_begin.*?(?:^!(?:{_TABLES})_table_end[^\n]*\n|\z)"
    return F.regexp_replace(F.regexp_replace(ended, table, ""), r"\n\z", "")


def write_stripped(files: DataFrame, path: str) -> None:
    """(file, text) as gzipped lines without data tables, a folder for each study, of those that ``path`` lacks."""
    key = F.regexp_extract("file", r"(GSE\d+)[^/]*$", 1)
    files.where("error is null").select(key.alias("gse"), strip_tables(F.col("text")).alias("value")).write.partitionBy("gse").option("compression", "gzip").mode("append").text(path)


def reconstruction(stripped: DataFrame, raw: DataFrame, key: str = "gse") -> DataFrame:
    """(key, problems, checked, differs) of stripped texts (key, text) against the raw ones that were kept: whether stripping these gives those."""
    kept = raw.select(key, strip_tables(F.col("text")).alias("__again"), F.lit(True).alias("__kept"))
    joined = stripped.join(kept, key, "left")
    checked = F.coalesce("__kept", F.lit(False))
    return joined.select(key, problems(F.col("text"), F.col(key)).alias("problems"), checked.alias("checked"), (checked & ~F.col("text").eqNullSafe(F.col("__again"))).alias("differs"))


def validation_outcomes(checked: DataFrame) -> DataFrame:
    """(n_files, n_broken, n_checked, n_differing) of ``reconstruction``."""
    return checked.agg(F.count("*").alias("n_files"), F.count_if(F.size("problems") > 0).alias("n_broken"), F.count_if("checked").alias("n_checked"), F.count_if("differs").alias("n_differing"))


def problems(text: Column, accession: Column) -> Column:
    """Names of the structural rules a stripped file breaks, in order."""
    all_ = lines(text)
    count = lambda p: F.size(F.filter(all_, lambda x: x.rlike(p)))
    rules = [
        ("no_series", count(r"^\^SERIES\b") == 0), ("several_series", count(r"^\^SERIES\b") > 1), ("no_sample", count(r"^\^SAMPLE\b") == 0),
        ("no_title", count(r"^!Series_title\s*=") == 0), ("leftover_table", count(f"(?i)^!({_TABLES})_table_(begin|end)") > 0),
        ("other_accession", ~F.exists(all_, lambda x: F.regexp_extract(x, r"^\^SERIES\s*=\s*(\S+)", 1) == accession))]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


class _Lines:
    """State of one file that is read line by line: its open block, and the first thing that is wrong with it."""

    KINDS = ("DATABASE", "SERIES", "PLATFORM", "SAMPLE")

    def __init__(self) -> None:
        self.inside, self.pos, self.number, self.error = False, 0, -1, None
        self.kind = self.accession = None
        self.attributes: list[dict] = []

    def _wrong(self, what: str) -> None:
        self.error = self.error or what

    def take(self, line: str):
        """A block that this line closes, or None."""
        self.pos += 1
        low = line[:20].lower()
        if low.startswith("!series_table_begin"):
            self.inside = True
        elif low.startswith("!series_table_end"):
            self.inside = False
        elif line.startswith("^"):
            if self.inside:
                self._wrong("unterminated table")
            head = _HEADER.match(line)
            kind = head.group(1).upper() if head else ""
            if not head:
                self._wrong("malformed header")
            elif kind not in self.KINDS:
                self._wrong("unknown block")
            done, self.inside = self.close(), False
            self.number, self.kind, self.accession, self.attributes = self.number + 1, kind, head.group(2).strip() if head else None, []
            return done
        elif line.startswith("!") and not self.inside:
            name, equals, value = line[1:].partition("=")
            name = name.strip()
            if not name:
                self._wrong("malformed attribute")
            elif self.kind is None or name.split("_", 1)[0].upper() != self.kind or "_" not in name:
                self._wrong("attribute outside its block")
            else:
                self.attributes.append({"pos": self.pos, "key": name, "value": value.strip() if equals else ""})
        return None

    def close(self):
        return None if self.kind is None else (self.number, self.kind, self.accession, self.attributes)

    def end(self):
        if self.inside:
            self._wrong("unterminated table")
        return self.close()


_HEADER = re.compile(r"\^([A-Za-z]+)\s*=\s*(.*)$")
_ATTRIBUTES = pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.string()), ("value", pa.string())]))
_BLOCKS = "file string, error string, block_no int, kind string, accession string, attributes array<struct<pos:int,key:string,value:string>>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), _ATTRIBUTES]
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "error", "block_no", "kind", "accession", "attributes"])


def blocks(files: DataFrame) -> DataFrame:
    """(file, error, block_no, kind, accession, attributes): attributes are (pos, key, value) in file order.

    Lines that begin with neither ``^`` nor ``!`` are ignored, and so is what
    stands between the markers of a comparison table. Blocks leave as they end,
    so only one is held at a time; what is wrong with a file comes in a row of
    its own, which a file without a block has too.
    """

    def run(batches):
        for batch in batches:
            for name, text, error in zip(*(batch.column(c).to_pylist() for c in range(3))):
                state, held = _Lines(), []
                for line in io.StringIO(text or "", newline=None):
                    done = state.take(line.rstrip("\n"))
                    if done:
                        held.append((name, None, *done))
                        if len(held) >= 256:
                            yield _rows(held)
                            held = []
                last = state.end()
                if last:
                    held.append((name, None, *last))
                held.append((name, error or state.error, None, None, None, None))
                yield _rows(held)

    return files.select("file", "text", "error").mapInArrow(run, _BLOCKS)


def stream_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The same from gzipped files of any size, line by line as Spark reads them; a file is never held whole.

    A gzipped file can't be split, so its lines come to one task in order. A line
    that isn't UTF-8 makes the file an error.
    """
    lines_ = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path).select("_metadata.file_path", F.col("value").cast("binary").alias("value"))

    def run(batches):
        name, state, held = None, _Lines(), []
        for batch in batches:
            for path_, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path_ != name:
                    held += finish(name, state)
                    name, state = path_, _Lines()
                try:
                    line = raw.decode("utf-8")
                except UnicodeDecodeError:
                    state._wrong("not UTF-8")
                    continue
                done = state.take(line)
                if done:
                    held.append((name, None, *done))
            if held:
                yield _rows(held)
                held = []
        held += finish(name, state)
        if held:
            yield _rows(held)

    def finish(name, state):
        if name is None:
            return []
        last = state.end()
        return ([(name, None, *last)] if last else []) + [(name, state.error, None, None, None, None)]

    return lines_.mapInArrow(run, _BLOCKS)


def values_of(attributes: Column, key: str, prefix: bool = False) -> Column:
    """Values of a key, or of all keys that begin with it, in file order, blank ones left out."""
    match = (lambda a: F.startswith(a["key"], F.lit(key))) if prefix else (lambda a: a["key"] == key)
    return F.filter(F.transform(F.filter(attributes, match), lambda a: a["value"]), lambda v: F.trim(v) != "")


def first_of(attributes: Column, key: str) -> Column:
    return F.get(values_of(attributes, key), F.lit(0))


def parse_date(text: Column) -> Column:
    """``Jan 01 2024`` or ``2024-01-01``; anything else is null."""
    return F.coalesce(F.try_to_date(text, "MMM d yyyy"), F.try_to_date(text, "yyyy-MM-dd"))


def tag(raw: Column) -> Column:
    """(name, value, raw), split at the first colon; without one the name is blank."""
    at = F.instr(raw, ":")
    name = F.when(at > 0, strip(F.substring(raw, F.lit(1), at - 1))).otherwise(F.lit(""))
    value = F.when(at > 0, strip(F.substring(raw, at + 1, F.length(raw)))).otherwise(strip(raw))
    return F.struct(name.alias("name"), value.alias("value"), raw.alias("raw"))


def parse_records(files: DataFrame) -> DataFrame:
    """One canonical row per file (file, text, error) with ``error``; a row with an error holds nothing else."""
    return records_of(blocks(files))


def _own(attributes: Column, kind: str, accession: Column) -> tuple[Column, Column]:
    """Whether a block lacks the line with its own accession, and whether such a line differs from its header."""
    said = values_of(attributes, f"{kind}_geo_accession")
    return F.size(said) == 0, F.exists(said, lambda v: v != accession)


def _accession_rules(name: str, kind: str, form: str) -> list[tuple[Column, str]]:
    """Rules that every sample or platform block keeps, and what breaking one is called."""
    one = name[:-1]
    return [
        (F.exists(name, lambda x: _own(x["attributes"], kind, x["accession"])[0]), f"no {one} accession"),
        (F.exists(name, lambda x: _own(x["attributes"], kind, x["accession"])[1]), f"{one} accession differs"),
        (F.exists(name, lambda x: ~x["accession"].rlike(f"^{form}[1-9][0-9]*$")), f"ill-formed {one} accession")]


def records_of(b: DataFrame) -> DataFrame:
    """The records of blocks.

    Errors: unreadable or malformed text, headers or attributes; a missing or
    repeated study block; a file name that names another study; accessions that
    are missing, ill-formed or differ from their header; missing titles; repeated
    samples; declared samples that aren't those present, by count or as a
    multiset; a date of no known form.
    """
    attributes = F.col("attributes")
    per = b.groupBy("file").agg(
        F.first("error", ignorenulls=True).alias("error"), F.count_if(F.col("kind") == "SERIES").alias("n_series"),
        F.max(F.when(F.col("kind") == "SERIES", F.struct("accession", "attributes"))).alias("s"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "SAMPLE", F.struct("block_no", "accession", "attributes")))).alias("samples"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "PLATFORM", F.struct("block_no", "accession", "attributes")))).alias("platforms"))
    series = F.col("s.attributes")
    own = F.transform("samples", lambda x: x["accession"])
    declared = values_of(series, "Series_sample_id")
    sample = lambda key, prefix=True: sorted_distinct(F.flatten(F.transform("samples", lambda x: values_of(x["attributes"], key, prefix))))
    tags = F.transform(F.flatten(F.transform("samples", lambda x: values_of(x["attributes"], "Sample_characteristics", True))), tag)
    dates = {c: first_of(series, f"Series_{c}") for c in ("submission_date", "last_update_date")}
    bad_date = F.lit(False)
    for d in dates.values():
        bad_date = bad_date | (d.isNotNull() & parse_date(d).isNull())
    named = F.regexp_extract("file", r"(GSE\d+)[^/]*$", 1)
    error = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("n_series") != 1, "not exactly one study block").when(F.coalesce(F.col("s.accession"), F.lit("")) == "", "no accession")
        .when((named != "") & (named != F.col("s.accession")), "file names another study").when(F.size(F.array_distinct(own)) != F.size(own), "repeated sample")
        .when(F.array_sort(declared) != F.array_sort(own), "declared samples differ").when(bad_date, "unknown date form"))
    lacks, differs = _own(series, "Series", F.col("s.accession"))
    titled = lambda x, k: F.size(values_of(x["attributes"], f"{k}_title")) > 0
    more = [
        (lacks, "no series accession"), (differs, "series accession differs"), (~F.col("s.accession").rlike("^GSE[1-9][0-9]*$"), "ill-formed series accession"),
        (first_of(series, "Series_title").isNull(), "no series title")]
    for name, kind, form in (("samples", "Sample", "GSM"), ("platforms", "Platform", "GPL")):
        more += _accession_rules(name, kind, form)
    more.append((F.exists("samples", lambda x: ~titled(x, "Sample")), "sample without title"))
    for bad, name in more:
        error = F.coalesce(error, F.when(bad, F.lit(name)))
    sexes = F.transform(F.filter(tags, lambda t: F.lower(t["name"]).isin("sex", "gender")), lambda t: t["value"])
    ids, sex_status = map_sex(sexes)
    organisms = sample("Sample_organism")
    organism_ids = sorted_distinct(F.transform(organisms, lambda n: lookup(SPECIES, F.lower(n))))
    out = per.withColumn("error", error).select(
        "file", "error", F.col("s.accession").alias("gse"), first_of(series, "Series_title").alias("title"),
        F.array_join(values_of(series, "Series_summary"), "\n").alias("summary"), F.array_join(values_of(series, "Series_overall_design"), "\n").alias("overall_design"),
        values_of(series, "Series_type").alias("type"), values_of(series, "Series_pubmed_id").alias("pubmed_ids"),
        *[parse_date(d).alias(c) for c, d in dates.items()],
        F.transform("platforms", lambda p: p["accession"]).alias("platform_ids"), F.size("samples").alias("n_samples"), organisms.alias("organisms"),
        sample("Sample_molecule").alias("molecules"), sample("Sample_source_name").alias("source_names"), tags.alias("tags"),
        sample("Sample_library_strategy").alias("library_strategies"), organism_ids.alias("organism_ids"),
        F.when(F.size(organisms) == 0, "absent").when(F.size(organism_ids) > 0, "mapped").otherwise("unmapped").alias("organism_status"),
        ids.alias("sex_ids"), sex_status.alias("sex_status"),
        F.transform(F.array_sort(F.transform(own, lambda a: F.struct(accession_number(a).alias("n"), a.alias("a")))), lambda s: s["a"]).alias("sample_accessions"))
    free = F.concat_ws(" ", F.array_join("type", "; "), "title", "summary", "overall_design")
    kinds, labels, status = map_assay(F.array_join("type", "; "), free)
    out = out.withColumns({"assay_categories": F.array_sort(kinds), "assay_labels": F.array_sort(labels), "assay_status": status})
    names = F.array_sort(F.array_distinct(F.transform("tags", lambda t: t["name"])))
    grouped = F.transform(names, lambda n: F.struct(n.alias("name"), sorted_distinct(F.transform(F.filter(F.col("tags"), lambda t: t["name"] == n), lambda t: t["value"])).alias("values")))
    out = out.withColumn("characteristics", grouped)
    text = labelled([
        ("Title", F.col("title")), ("Study type", F.array_join("type", "; ")), ("Organisms", F.array_join("organisms", ", ")), ("Summary", F.col("summary")),
        ("Overall design", F.col("overall_design")), ("Source names", F.array_join("source_names", ", ")), ("Molecules", F.array_join("molecules", ", ")),
        ("Characteristics", F.array_join(F.transform("characteristics", lambda c: F.concat(c["name"], F.lit(": "), F.array_join(c["values"], ", "))), " | "))])
    out = out.withColumn("embed_text", text)
    keep = [c for c in out.columns if c not in ("file", "error", "tags")]
    return out.select("file", "error", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in keep])
