"""Vectors of texts: model contracts, query and document encoding, and the incremental build of a vector table.

An encoder is a callable the caller brings, made once a task from a factory: it
takes texts and returns one vector each. Nothing here knows a model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orestrata.functions.text import SPACE, accession_number
from orestrata.operators.incremental import delta_problems
from orestrata.session import settle


@dataclass(frozen=True)
class Variant:
    """Contract of one model: dimensions, templates of texts, most tokens a text counts with."""

    name: str
    dimensions: int
    document_format: str
    query_format: str
    most_tokens: int


#: The models and their contracts.
VARIANTS = {v.name: v for v in (
    Variant("bge_small_v15", 384, "{embed_text}", "Represent this sentence for searching relevant passages: {query}", 512),
    Variant("medcpt_v1", 768, "[title, embed_text]", "{query}", 512),
    Variant("qwen3_06b_1024_v1", 1024, "{embed_text}", "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: {query}", 8192),
    Variant("gemini_embedding_2_3072_v1", 3072, "document: title: {title} | text: {embed_text}", "task: search result | query: {query}", 8192),
)}

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def variant(name: str) -> Variant:
    if name not in VARIANTS:
        raise ValueError(f"no model {name!r}")
    return VARIANTS[name]


def unit(vectors, dims: int) -> np.ndarray:
    """Vectors of length 1; an error if one has another dimension, isn't finite or has no length."""
    x = np.asarray(vectors, dtype=np.float64)
    if x.ndim != 2 or x.shape[1] != dims:
        raise ValueError(f"{dims} dimensions expected")
    norm = np.sqrt((x * x).sum(axis=1))
    if not np.isfinite(x).all() or not (norm > 0).all():
        raise ValueError("a vector isn't finite or has no length")
    return (x / norm[:, None]).astype(np.float32)


def encode_query(model: Variant, query: str, encode: Encoder) -> list[float]:
    """The unit vector of a query in the model's template; blank queries are errors."""
    tidy = query.strip()
    if not tidy:
        raise ValueError("blank query")
    return unit(encode([model.query_format.format(query=tidy)]), model.dimensions)[0].tolist()


def document_text(model: Variant):
    """The text a model takes for a document with ``title`` and ``embed_text``, as a Column; a pair of texts is parted by a line break."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("embed_text", F.lit(""))
    if model.document_format.startswith("["):
        return F.concat_ws("\n", title, text)
    out, rest = [], model.document_format
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            out.append(F.lit(head))
        if brace:
            name, _, rest = tail.partition("}")
            out.append({"title": title, "embed_text": text}[name])
        else:
            rest = ""
    return F.concat(*out)


def truncations(records: DataFrame, model: Variant, tokens=None) -> DataFrame:
    """(model, n, n_truncated): documents longer than the model reads, by ``tokens`` of their text, words unless given."""
    count = tokens or (lambda c: F.size(F.filter(F.split(c, SPACE), lambda w: w != "")))
    return records.agg(F.lit(model.name).alias("model"), F.count("*").alias("n"), F.count_if(count(document_text(model)) > model.most_tokens).alias("n_truncated"))


def encode_documents(records: DataFrame, model: Variant, factory: Callable[[], Encoder], key: str = "gse", batch: int = 128) -> DataFrame:
    """(key, vector): unit vectors of the documents. The encoder is made once a task and given texts of like length together."""
    rows = records.select(key, document_text(model).alias("text"))

    def run(batches):
        encode = factory()
        for b in batches:
            texts = b.column(1).to_pylist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out = np.zeros((len(texts), model.dimensions), dtype=np.float32)
            for at in range(0, len(order), batch):
                part = order[at:at + batch]
                out[part] = unit(encode([texts[i] for i in part]), model.dimensions)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * model.dimensions)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=[key, "vector"])

    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vector array<float>")


def build_vectors(
        records: DataFrame, base: DataFrame | None, model: Variant, factory: Callable[[], Encoder], key: str = "gse", replace: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """(vectors, report): the vector table of all records, encoding only those the base lacks or that are to be replaced.

    Keys the records no longer have vanish. ``report`` counts encoded, kept and
    deleted rows; if nothing changes the base itself is returned.
    """
    target = records.select(key).distinct()
    if base is None:
        vectors = settle(encode_documents(records, model, factory, key), "vectors")
        return vectors, {"encoded": vectors.count(), "kept": 0, "deleted": 0, "skipped": False}
    again = target.join(replace.select(key).distinct(), key, "left_semi") if replace is not None else target.limit(0)
    delta = settle(target.join(base.select(key), key, "left_anti").unionByName(again).distinct(), "delta")
    gone = base.select(key).distinct().join(target, key, "left_anti").count()
    n_delta, n_target = delta.count(), target.count()
    if n_delta == 0 and gone == 0:
        return base, {"encoded": 0, "kept": n_target, "deleted": 0, "skipped": True}
    fresh = settle(encode_documents(records.join(delta, key, "left_semi"), model, factory, key), "vectors")
    kept = base.select(key, "vector").join(target, key, "left_semi").join(delta, key, "left_anti")
    return kept.unionByName(fresh), {"encoded": n_delta, "kept": n_target - n_delta, "deleted": gone, "skipped": False}


def plan_problems(delta: DataFrame, records: DataFrame, base: DataFrame, key: str = "gse") -> DataFrame:
    """(problem, n) of a delta that was declared beforehand."""
    return delta_problems(delta, records, base, key)


def in_order(vectors: DataFrame, key: str = "gse") -> DataFrame:
    """(row, key, vector) with rows from 0 by the number of the accession, then the key."""
    from orestrata.operators.rollup import numbered

    return numbered(vectors.withColumn("__n", accession_number(F.col(key))), ["__n", key], "row").drop("__n")


def publish(spark: SparkSession, staged: str, final: str) -> None:
    """A validated folder in place of the published one: the old one steps aside, and comes back if the swap fails.

    What a crash leaves behind is mended by ``recover``.
    """
    fs, path = _files(spark, final)
    backup = path(final + ".backup")
    if fs.exists(backup):
        raise FileExistsError("an unfinished replacement is in the way")
    had = fs.exists(path(final))
    if had and not fs.rename(path(final), backup):
        raise OSError("the published folder can't be moved")
    if not fs.rename(path(staged), path(final)):
        if had:
            fs.rename(backup, path(final))
        raise OSError("the staged folder can't be moved")
    if had:
        fs.delete(backup, True)


def recover(spark: SparkSession, final: str, valid: Callable[[str], bool]) -> str:
    """Finishes or undoes a replacement that was cut short: ``done``, ``kept`` (the new folder stands) or ``restored`` (the old one)."""
    fs, path = _files(spark, final)
    backup = path(final + ".backup")
    if not fs.exists(backup):
        return "done"
    if fs.exists(path(final)) and valid(final):
        fs.delete(backup, True)
        return "kept"
    fs.delete(path(final), True)
    fs.rename(backup, path(final))
    return "restored"


def _files(spark: SparkSession, place: str):
    """The file system of a place, and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make
