"""Readers and writers of tables, JSON trees, vectors, evaluation cases and catalogs."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orestrata.functions.text import accession_number, storage_bucket
from orestrata.schemas import RECORD, VECTOR


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Lines of JSON; malformed lines and lines without the key are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())


def append_jsonl(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, added to a folder; the commit makes them visible all at once."""
    df.write.mode("append").json(path)


def read_seen(spark: SparkSession, path: str, schema: str, key: str) -> list[str]:
    """Keys a folder of JSON lines holds; none before it exists. They come to the driver that crawls, a few bytes each."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(schema).json(path).where(F.col(key).isNotNull()).select(key).distinct()
        return rows.toArrow().column(0).to_pylist()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """One text column as gzipped lines."""
    df.select(column).write.option("compression", "gzip").mode("errorifexists").text(path)


def inventory(records: DataFrame) -> DataFrame:
    """(gse, title, embed_text), with ``error`` where a key is missing, ill-formed or repeated."""
    n = records.groupBy("gse").agg(F.count("*").alias("__n"))
    error = F.when(~F.coalesce(F.col("gse").rlike("^GSE[1-9][0-9]*$"), F.lit(False)), "bad key").when(F.col("__n") > 1, "repeated key").when(F.trim(F.coalesce("title", F.lit(""))) == "", "no title")
    return records.join(n, "gse", "left").select("gse", "title", "embed_text", error.alias("error"))


def require_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns and types of a contract, in its order; missing, foreign or differing ones are errors."""
    have, want = {f.name: f.dataType for f in df.schema.fields}, {f.name: f.dataType for f in schema.fields}
    wrong = sorted(set(have) ^ set(want)) + sorted(n for n in set(have) & set(want) if have[n].simpleString() != want[n].simpleString())
    if wrong:
        raise ValueError(f"columns differ from the contract: {wrong}")
    return df.select(*want)


def ensure_table(spark: SparkSession, name: str, schema: T.StructType, revision: str, reset: bool = False) -> bool:
    """Creates a table of a contract if it isn't there, True if so; one of another revision is an error unless it is to be made anew."""
    if reset:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if spark.catalog.tableExists(name):
        held = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        if held.get("revision") != revision:
            raise ValueError(f"the table has revision {held.get('revision')!r}")
        return False
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet TBLPROPERTIES ('revision' = '{revision}')")
    return True


def load_live_queries(path: str, most: int = 100) -> list[dict]:
    """Queries of a model comparison (query_id, query, intent, filters), each complete and with an id of its own."""
    out: list[dict] = []
    with open(path, encoding="utf-8") as lines:
        for n, line in enumerate(lines, 1):
            if not line.strip():
                continue
            case = json.loads(line)
            if set(case) - {"query_id", "query", "intent", "filters"} or any(not str(case.get(k, "")).strip() for k in ("query_id", "query", "intent")):
                raise ValueError(f"line {n}: bad fields")
            if any(case["query_id"] == c["query_id"] for c in out):
                raise ValueError(f"line {n}: repeated id")
            out.append(case)
    if not 1 <= len(out) <= most:
        raise ValueError("no queries, or too many")
    return out


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """Canonical records of a tree of JSON files, with ``error`` where the file name and the key differ or a key repeats."""
    raw = spark.read.schema(RECORD).option("recursiveFileLookup", "true").option("multiLine", "true").json(root).withColumn("__file", F.col("_metadata.file_name"))
    counted = raw.groupBy("gse").agg(F.count("*").alias("__n"))
    out = raw.join(counted, "gse", "left")
    error = F.when(F.concat("gse", F.lit(".json")) != F.col("__file"), "file name differs").when(F.col("__n") > 1, "repeated key").when(F.col("gse").isNull(), "no key")
    return out.withColumn("error", error).drop("__n", "__file")


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON, in folders by storage bucket; the commit makes them visible all at once."""
    df.withColumn("bucket", storage_bucket(F.col("gse"))).write.partitionBy("bucket").mode("errorifexists").json(path)


def read_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """A vector table with ``error``: wrong dimension, a number that isn't finite, a repeated id."""
    df = spark.read.schema(VECTOR).parquet(path)
    twice = df.groupBy("id").agg(F.count("*").alias("__n"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    error = F.when(F.col("id").isNull(), "no id").when(F.coalesce(F.size("vector"), F.lit(-1)) != dims, "wrong dimension").when(~finite, "not finite").when(F.col("__n") > 1, "repeated id")
    return df.join(twice, "id", "left").withColumn("error", error).drop("__n")


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors with rows by accession number; refuses to overwrite."""
    df.withColumn("__k", accession_number(F.col("id"))).repartitionByRange("__k", "id").sortWithinPartitions("__k", "id").drop("__k").write.mode("errorifexists").parquet(path)


def load_cases(path: str, most_bytes: int = 1 << 20, most_cases: int = 1000) -> list[dict]:
    """Evaluation cases of a JSONL file: bounded in size, with known fields only and without repeated ids."""
    known = {"query_id", "query", "intent", "filters", "judgments", "constraints", "expected_ncbi_count"}
    if os.path.getsize(path) > most_bytes:
        raise ValueError("case file too large")
    seen, out = set(), []
    with open(path, encoding="utf-8") as lines:
        for n, line in enumerate(lines, 1):
            if not line.strip():
                continue
            case = json.loads(line)
            extra = set(case) - known
            if extra or not str(case.get("query_id", "")).strip() or not str(case.get("query", "")).strip():
                raise ValueError(f"line {n}: bad fields {sorted(extra)}")
            if case["query_id"] in seen:
                raise ValueError(f"line {n}: repeated id")
            if any(not (isinstance(g, int) and 0 <= g <= 3) for g in case.get("judgments", {}).values()):
                raise ValueError(f"line {n}: grades are 0 to 3")
            seen.add(case["query_id"])
            out.append(case)
            if len(out) > most_cases:
                raise ValueError("too many cases")
    return out


def cases_frame(spark: SparkSession, cases: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) of evaluation cases."""
    q = spark.createDataFrame([(c["query_id"], c["query"]) for c in cases], "query_id string, query string")
    rows = [(c["query_id"], d, g) for c in cases for d, g in c.get("judgments", {}).items()]
    return q, spark.createDataFrame(rows, "query_id string, doc_id string, grade int")


def batch_results(responses: DataFrame, expected: DataFrame, dims: int) -> DataFrame:
    """(key, pos, vector, error): responses (key, vector, error) in the order of what was asked (key, pos).

    Missing, unasked and repeated keys and wrong dimensions become errors.
    """
    r = responses.groupBy("key").agg(F.count("*").alias("n"), F.first("vector").alias("vector"), F.first("error", ignorenulls=True).alias("said"))
    both = expected.join(r, "key", "full_outer")
    error = (
        F.when(F.col("pos").isNull(), "unasked").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("said").isNotNull(), F.col("said"))
        .when(F.coalesce(F.size("vector"), F.lit(-1)) != dims, "wrong dimension"))
    return both.select("key", "pos", F.when(error.isNull(), F.col("vector")).alias("vector"), error.alias("error"))


def write_report(report: dict, path: str) -> None:
    """A small report as JSON, visible only when complete."""
    write_text(json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True), path)


def write_text(text: str, path: str) -> None:
    """A small text, visible only when complete."""
    partial = f"{path}.part"
    with open(partial, "w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(partial, path)


def markdown_table(df: DataFrame, most_rows: int = 1000, cell: int = 120) -> str:
    """An ordered small result as a Markdown table."""
    rows = df.limit(most_rows).collect()

    def text(x) -> str:
        flat = " ".join(str("" if x is None else x).split()).replace("|", "\\|")
        return flat if len(flat) <= cell else flat[:cell - 1] + "…"

    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(map(text, r)) + " |" for r in rows)])


def comparison_report(side_by_side: DataFrame, overlaps: DataFrame, queries: list[dict]) -> str:
    """A deterministic Markdown report of a model comparison: per query the models' documents by mode, then what they share."""
    lines = ["# Comparison of models"]
    for q in queries:
        lines += ["", f"## Query: {q['query_id']}", "", f"**Search:** {' '.join(q['query'].split())}"]
        for mode in [r.mode for r in side_by_side.where(F.col("query_id") == q["query_id"]).select("mode").distinct().orderBy("mode").collect()]:
            own = side_by_side.where((F.col("query_id") == q["query_id"]) & (F.col("mode") == mode)).drop("query_id", "mode").orderBy("rank")
            lines += ["", f"### {mode}", "", markdown_table(own)]
        shared = overlaps.where(F.col("query_id") == q["query_id"]).drop("query_id").orderBy("left", "right")
        lines += ["", "### Shared", "", markdown_table(shared)]
    return "\n".join(lines) + "\n"
