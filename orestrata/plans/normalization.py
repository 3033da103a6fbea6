"""Queries of the normalizers, text functions and log functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orestrata.functions import normalize as N
from orestrata.functions import text as X
from orestrata.operators.packed import split_packed
from orestrata.session import scratch_dir, spread, table
from orestrata.streaming import logs as L


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gsm")


def _tags(spark, sf_dir) -> DataFrame:
    """(gsm, name, value) of every tag of the samples."""
    return _samples(spark, sf_dir).select("gsm", F.explode(N.tags_of(F.col("characteristics_ch1"))).alias("t")).select("gsm", "t.name", "t.value")


def _of(spark, sf_dir, field) -> DataFrame:
    names = [k for k, v in N.FIELD_OF_TAG.items() if v == field]
    return _tags(spark, sf_dir).where(F.col("name").isin(names))


def normalize_tokens(spark, sf_dir):
    return _samples(spark, sf_dir).where("organism_ch1 is not null").groupBy(N.token(F.col("organism_ch1")).alias("token")).agg(F.count("*").alias("n"))


def field_values(spark, sf_dir):
    field = N.lookup(N.FIELD_OF_TAG, F.col("name"))
    return _tags(spark, sf_dir).groupBy(field.alias("field")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def sex_rules(spark, sf_dir):
    v = _of(spark, sf_dir, "sex").groupBy("value").agg(F.count("*").alias("n"))
    return N.with_sex(v, "value").select("value", "n", "reason", F.array_join("ids", "|").alias("ids"), "confidence")


def sex_fold(spark, sf_dir):
    per = _of(spark, sf_dir, "sex").groupBy("gsm").agg(F.collect_set("value").alias("values"))
    ids, status = N.map_sex(F.col("values"))
    return per.select("gsm", F.array_join(ids, "|").alias("ids"), status.alias("status"))


def curated_lookup(spark, sf_dir):
    per = _of(spark, sf_dir, "tissue").groupBy("gsm").agg(F.collect_set("value").alias("values"))
    ids, status = N.map_curated(F.col("values"), N.TISSUES)
    return per.select("gsm", F.array_join(ids, "|").alias("ids"), status.alias("status"))


def organism_map(spark, sf_dir):
    ids, status = N.map_organisms(F.col("organisms"))
    return table(spark, sf_dir, "series").select("id", F.array_join(ids, "|").alias("ids"), status.alias("status"))


def organism_terms(spark, sf_dir):
    """Exact look-up of sample species in the reference list, by label or synonym."""
    terms = table(spark, sf_dir, "term_list").where("vocab = 'organism'")
    names = terms.select("term_id", F.explode(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name")).select("term_id", N.token(F.col("name")).alias("token"))
    used = _samples(spark, sf_dir).where("organism_ch1 is not null").select("gsm", N.token(F.col("organism_ch1")).alias("token"))
    return used.join(names, "token", "left").groupBy(F.coalesce("term_id", F.lit("unmapped")).alias("term_id")).agg(F.count("*").alias("n"))


def age_parse(spark, sf_dir):
    return _of(spark, sf_dir, "age").groupBy("value").agg(F.count("*").alias("n")).select("value", "n", N.age_of(F.col("value")).alias("age"))


def stage_reject(spark, sf_dir):
    """Stages of every series and sample text that stands where a stage could: values of all tags, by their token."""
    v = _tags(spark, sf_dir).select(N.token(F.col("value")).alias("token")).distinct()
    return v.select("token", N.stage_of(F.col("token")).alias("label")).where("label is not null")


def assay_tags(spark, sf_dir):
    kinds, labels, status = N.map_assay(F.col("type"), F.concat_ws(" ", F.coalesce("type", F.lit("")), X.surface(["title", "summary", "overall_design"])))
    return spread(table(spark, sf_dir, "series").select("id", "type", "title", "summary", "overall_design")).select("id", F.array_join(kinds, "|").alias("kinds"), F.array_join(labels, "|").alias("labels"), status.alias("status"))


def assay_texts(spark, sf_dir):
    """Technologies that every document names, and whether one of them is of single cells."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = d.select("doc_id", N.assay_labels(F.col("text")).alias("labels"))
    single = F.arrays_overlap("labels", X.lit_strings(N.SINGLE_CELL))
    return labels.where(F.size("labels") > 0).select("doc_id", F.array_join("labels", "|").alias("labels"), single.alias("single_cell"))


def single_cell_share(spark, sf_dir):
    """Of each document source, how many documents name a technology, and how many one of single cells."""
    d = spread(table(spark, sf_dir, "documents").select("source", "text")).select("source", N.assay_labels(F.col("text")).alias("labels"))
    return d.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.size("labels") > 0).alias("n_named"), F.count_if(F.arrays_overlap("labels", X.lit_strings(N.SINGLE_CELL))).alias("n_single"))


def fuzzy_edit1(spark, sf_dir):
    v = _of(spark, sf_dir, "sex").select(N.token(F.col("value")).alias("token")).distinct()
    return v.where((F.levenshtein("token", F.lit("male"), 1) >= 0) | (F.levenshtein("token", F.lit("female"), 1) >= 0))


def embed_text_compose(spark, sf_dir):
    text = X.labelled([("Title", F.col("title")), ("Study type", F.col("type")), ("Organisms", F.col("organisms")), ("Summary", F.col("summary")), ("Overall design", F.col("overall_design"))])
    return table(spark, sf_dir, "series").select("id", F.md5(text).alias("digest"), F.length(text).alias("n_chars"))


def list_blobs(spark, sf_dir):
    s = table(spark, sf_dir, "series").where("organisms is not null")
    return s.select("id", X.list_blob(F.col("organisms"), 200).alias("blob"), F.size(X.split_list(F.col("organisms"))).alias("n"))


def storage_buckets(spark, sf_dir):
    return table(spark, sf_dir, "series").groupBy(X.storage_bucket(F.col("gse")).alias("bucket")).agg(F.count("*").alias("n"))


def token_bounds(spark, sf_dir):
    return table(spark, sf_dir, "series").agg(F.sum(X.token_bound(F.col("search_text"))).alias("bound"), F.max(X.token_bound(F.col("search_text"))).alias("largest"))


def backoff(spark, sf_dir):
    """Waiting time before the next attempt for keys that were sent again so many times."""
    sent = table(spark, sf_dir, "gsm").groupBy("gsm").agg(F.count("*").alias("attempts"))
    return sent.groupBy("attempts").agg(F.count("*").alias("n_keys")).select("attempts", "n_keys", X.backoff_seconds(F.col("attempts")).alias("seconds"))


def tag_split(spark, sf_dir):
    """Distinct values of the sex tags of every series, whatever separates the tags."""
    names = [k for k, v in N.FIELD_OF_TAG.items() if v == "sex"]
    split = split_packed(table(spark, sf_dir, "series"), "id", ["characteristics"], tagged=["characteristics"])
    tags = split.select("id", F.explode(N.tags_of(F.regexp_replace("val", r"[|;\t\r\n,]", " "))).alias("t")).where(F.col("t.name").isin(names))
    return tags.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("t.value")), "|").alias("sexes"))


def normalized_rows(spark, sf_dir):
    """Every normalized column of every series."""
    s = spread(table(spark, sf_dir, "series").select("id", "organisms", "characteristics", "title", "summary", "overall_design", "type"))
    out = N.normalize_rows(s)
    ids = [c for c in out.columns if c.endswith("_ids") or c in ("assay_categories", "assay_labels", "age_norm")]
    return out.select("id", *[F.array_join(c, "|").alias(c) for c in ids], *[f"{f}_status" for f in N.STATUS_FIELDS])


def mapped_counts(spark, sf_dir):
    s = spread(table(spark, sf_dir, "series").select("organisms", "characteristics", "title", "summary", "overall_design", "type"))
    return N.mapped_counts(N.normalize_rows(s))


def assay_refresh(spark, sf_dir):
    """Series whose stored assay columns differ from those computed anew; all other columns pass through."""
    s = spread(table(spark, sf_dir, "series").select("id", "gse", "type", "title", "summary", "overall_design", "assay_categories", "assay_labels", "assay_status"))
    fresh = N.refresh_assays(s.withColumns({"old_labels": F.col("assay_labels"), "old_status": F.col("assay_status")}))
    return fresh.select("gse", F.array_join("assay_labels", "|").alias("labels"), "assay_status", (~F.col("old_status").eqNullSafe(F.col("assay_status"))).alias("changed"))


def _curated(spark, sf_dir, field):
    per = _of(spark, sf_dir, field).groupBy("gsm").agg(F.array_sort(F.collect_set("value")).alias("values"))
    ids, status = N.map_curated(F.col("values"), N.CURATED[field], tuple(N.NO_ANCESTRY) if field == "ethnicity" else ())
    return per.select("gsm", F.array_join("values", "|").alias("tags"), F.array_join(ids, "|").alias("ids"), status.alias("status"))


def cell_type_map(spark, sf_dir):
    return _curated(spark, sf_dir, "cell_type")


def cell_line_map(spark, sf_dir):
    return _curated(spark, sf_dir, "cell_line")


def disease_map(spark, sf_dir):
    return _curated(spark, sf_dir, "disease")


# --- logs -------------------------------------------------------------------------------------------------------------

def _lines(events: DataFrame) -> DataFrame:
    """Event rows as log lines: some plain text, some with secrets in text, in nested members and in unknown fields, some of health checks."""
    n, e = F.col("event_id"), F.col("event_type")
    health = n % 5 == 0
    message = (
        F.when(n % 4 == 0, F.concat(F.lit("password=\"a b "), n, F.lit("\" done"))).when(n % 4 == 1, F.concat(F.lit("cookie: sid="), n, F.lit("; next")))
        .when(n % 4 == 2, F.concat(F.lit("access_key_id=AK"), n, F.lit(", kept"))).otherwise(F.concat(F.lit("sent by "), F.col("user_id"))))
    detail = F.struct(F.concat(F.lit("Basic "), n).alias("Authorization"), F.concat(F.lit("secret-access-key: S"), n, F.lit(" end")).alias("note"), n.alias("tries"))
    as_json = F.to_json(F.struct(
        F.when(health, "request.completed").otherwise(e).alias("event"), F.when(F.col("value") > 50, "error").alias("level"), F.concat(F.lit("svc."), e).alias("logger"),
        message.alias("message"), n.cast("string").alias("event_id"), F.col("ts").cast("string").alias("timestamp"), F.when(n % 3 == 0, "POST").otherwise("GET").alias("method"),
        F.when(health, "/healthz").otherwise("/search").alias("route"), F.when(n % 7 == 0, 500).otherwise(200).alias("status_code"),
        detail.alias("detail"), F.concat(F.lit("sid="), n).alias("Set-Cookie"), F.concat(F.lit("q"), n).alias("query")))
    return events.select(F.when(n % 11 == 0, F.concat(F.lit("Bearer x"), n, F.lit(" api-key='k 1' "), e)).otherwise(as_json).alias("value"))


def log_redact_filter(spark, sf_dir):
    out = L.parse(_lines(spread(table(spark, sf_dir, "events"))), excluded=("svc.click",))
    inner = {"auth": "$.detail.Authorization", "note": "$.detail.note", "tries": "$.detail.tries", "cookie": "$.Set-Cookie", "query": "$.query", "body_level": "$.level"}
    return out.select("event", "level", "logger", "message", "method", "route", "status_code", *[F.get_json_object("body", p).alias(n) for n, p in inner.items()])


def _streamed(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_pipeline(spark, sf_dir):
    """The same over a file stream, through an idempotent batch sink."""
    import uuid

    from orestrata.streaming.sinks import LedgerSink

    run = uuid.uuid4().hex
    sink = LedgerSink(f"{scratch_dir(spark)}/stream-{run}/out")
    parsed = L.parse(_lines(_streamed(spark, sf_dir)), excluded=("svc.click",))
    L.deliver(parsed, sink, f"{scratch_dir(spark)}/stream-{run}/checkpoint").awaitTermination()
    return sink.read(spark, parsed.schema).groupBy("event", "level").agg(F.count("*").alias("n"))


def hourly_archive(spark, sf_dir):
    """Hourly gzipped folders written by a stream, read back and counted."""
    import uuid

    run = f"{scratch_dir(spark)}/archive-{uuid.uuid4().hex}"
    events = _streamed(spark, sf_dir).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    L.archive(events, f"{run}/out", f"{run}/checkpoint").awaitTermination()
    back = spark.read.schema("event_id long, event_type string, ts timestamp, year int, month int, day int, hour int").json(f"{run}/out")
    return back.groupBy("year", "month", "day", "hour").agg(F.count("*").alias("n"))


def minute_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("level"))
    out = L.windowed_drops(e, width="1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "level", "n")


def token_bucket(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return L.admit(e, "user_id", "ts", 1 / 7200, 3.0, tie="event_id").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("admitted").alias("n_admitted"))


QUERIES = {f.__name__: f for f in (
    normalize_tokens, field_values, sex_rules, sex_fold, curated_lookup, cell_type_map, cell_line_map, disease_map, organism_map, organism_terms, age_parse, stage_reject,
    assay_tags, assay_texts, single_cell_share, assay_refresh, normalized_rows, mapped_counts, fuzzy_edit1,
    embed_text_compose, list_blobs, storage_buckets, token_bounds, backoff, tag_split, log_redact_filter, stream_pipeline, hourly_archive, minute_counts, token_bucket)}

# --- SQL --------------------------------------------------------------------------------------------------------------

_WS = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _token(x: str) -> str:
    inner = f"regexp_replace(regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g'), '^[\"'']+|[\"'']+$', '', 'g')"
    return f"regexp_replace(lower(regexp_replace({inner}, '[ .]+$', '')), '{_WS}+', ' ', 'g')"


def _strings(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _case(table_: dict, x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _tag_sql(table_: str, key: str, column: str) -> str:
    """CTE ``tags`` (key, name, value)."""
    hidden = "chr(57344) || chr(57345) || chr(57346) || chr(57347)"
    masked = f"""array_to_string(list_transform(string_split({column}, '"'), lambda x, i: CASE WHEN i % 2 = 0 AND i < len(string_split({column}, '"')) AND NOT contains(x, chr(10)) THEN translate(x, '|;' || chr(9) || ',', {hidden}) ELSE x END), '"')"""
    commas = "regexp_replace(regexp_replace(m, '([^0-9]),', '\\1;', 'g'), ',([^0-9])', ';\\1', 'g')"
    value = _strip("regexp_extract(t, '(?s)^([^:=]*)[:=](.*)$', 2)")
    return f"""tags AS (SELECT {key}, lower({_strip("regexp_extract(t, '(?s)^([^:=]*)[:=](.*)$', 1)")}) AS name, translate({value}, {hidden}, '|;' || chr(9) || ',') AS value
  FROM (SELECT {key}, unnest(regexp_split_to_array(CASE WHEN regexp_matches(m, '[|;\\t\\r\\n]') THEN m ELSE {commas} END, '[|;\\t\\r\\n]+')) AS t FROM (SELECT {key}, {masked} AS m FROM {table_})))"""


_TAGS = _tag_sql("gsm", "gsm", "characteristics_ch1").removesuffix(")") + ")"
_TAGS = f"all_{_TAGS}, tags AS (SELECT * FROM all_tags WHERE name <> '' AND value <> '')"


def _field(field: str) -> str:
    return _strings([k for k, v in N.FIELD_OF_TAG.items() if v == field])


def _status(ids: str, unknown: str) -> str:
    return f"CASE WHEN len({ids}) > 0 THEN 'mapped' WHEN {unknown} THEN 'unknown' ELSE 'unmapped' END"


def _rules(rules, x: str) -> str:
    return "array_to_string(list_filter([" + ", ".join("CASE WHEN regexp_matches(%s, '(?i)%s') THEN '%s' END" % (x, p.replace("'", "''"), label) for p, label in rules) + "], lambda x: x IS NOT NULL), '|')"


_FREE = "concat_ws(' ', coalesce(type, ''), coalesce(title, ''), coalesce(summary, ''), coalesce(overall_design, ''))"
_AGE = "'^(\\d+(?:\\.\\d+)?)\\s*([a-z-]+)?'"
def _near(t: str) -> str:
    """At most one edit from either word; the distance there is counted in bytes, so other letters count as one."""
    plain = f"regexp_replace({t}, '[^\\x00-\\x7f]', '?', 'g')"
    return f"(levenshtein({plain}, 'male') <= 1 OR levenshtein({plain}, 'female') <= 1)"


def _redact(x: str) -> str:
    """Secrets in text, by the rules of the operator written for RE2."""
    bearer, assigned = X.BEARER.replace("'", "''"), X.ASSIGNMENT.replace("'", "''")
    return f"regexp_replace(regexp_replace({x}, '{bearer}', 'Bearer {X.MASK}', 'g'), '{assigned}', '\\1\\2{X.MASK}', 'g')"


def _member(name: str, x: str) -> str:
    return f"CASE WHEN replace(lower(trim('{name}')), '-', '_') IN ({', '.join(repr(k) for k in X.SECRET_KEYS)}) THEN '{X.MASK}' ELSE {_redact(x)} END"


_LOG = f"""e AS (SELECT *, event_id % 11 = 0 AS plain, event_id % 5 = 0 AS health, CASE event_id % 4 WHEN 0 THEN 'password="a b ' || event_id || '" done' WHEN 1 THEN 'cookie: sid=' || event_id || '; next'
  WHEN 2 THEN 'access_key_id=AK' || event_id || ', kept' ELSE 'sent by ' || user_id END AS said FROM events),
p AS (SELECT CASE WHEN plain THEN 'python.log' WHEN health THEN 'request.completed' ELSE event_type END AS event, CASE WHEN NOT plain AND value > 50 THEN 'error' ELSE 'info' END AS level,
  CASE WHEN plain THEN 'root' ELSE 'svc.' || event_type END AS logger,
  CASE WHEN plain THEN {_redact("'Bearer x' || event_id || ' api-key=''k 1'' ' || event_type")} ELSE {_redact('said')} END AS message,
  CASE WHEN NOT plain THEN CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END END AS method,
  CASE WHEN NOT plain THEN CASE WHEN health THEN '/healthz' ELSE '/search' END END AS route, CASE WHEN NOT plain THEN CASE WHEN event_id % 7 = 0 THEN 500 ELSE 200 END END AS status_code,
  CASE WHEN NOT plain THEN {_member('Authorization', "'Basic ' || event_id")} END AS auth, CASE WHEN NOT plain THEN {_member('note', "'secret-access-key: S' || event_id || ' end'")} END AS note,
  CASE WHEN NOT plain THEN event_id::VARCHAR END AS tries, CASE WHEN NOT plain THEN {_member('Set-Cookie', "'sid=' || event_id")} END AS cookie,
  CASE WHEN NOT plain THEN {_redact("'q' || event_id")} END AS query FROM e),
k AS (SELECT *, level AS body_level FROM p WHERE NOT starts_with(logger, 'svc.click')
  AND NOT coalesce(event = 'request.completed' AND method = 'GET' AND route = '/healthz' AND status_code >= 200 AND status_code < 300, false))"""


def _curated_sql(field: str, source: str = "tags", key: str = "gsm") -> str:
    """CTE ``f_<field>`` (key, tags, ids, status) from CTE ``tags``."""
    unknown = _strings(N.UNKNOWN + (N.NO_ANCESTRY if field == "ethnicity" else []))
    known = {k.replace("'", "''"): v for k, v in N.CURATED[field].items()}
    bare = _strip("regexp_replace(t, '\\s*\\(.*?\\)\\s*', ' ', 'g')")
    return f"""v_{field} AS (SELECT {key}, value, {_token('value')} AS t FROM {source} WHERE name IN {_field(field)}),
m_{field} AS (SELECT *, t IN {unknown} AS u, CASE WHEN t IN {unknown} THEN NULL ELSE coalesce({_case(known, 't')}, {_case(known, bare)}) END AS i FROM v_{field}),
f_{field} AS (SELECT {key}, list_sort(list(DISTINCT value)) AS tags, coalesce(list_sort(list(DISTINCT i) FILTER (i IS NOT NULL)), []) AS i, bool_or(u) AS u FROM m_{field} GROUP BY {key})"""


def _sex_sql(key: str) -> str:
    """CTEs v, r, s (key, value, t, reason, ids) from CTE ``tags``."""
    return f"""v AS (SELECT {key}, value, {_token('value')} AS t FROM tags WHERE name IN {_field('sex')}),
r AS (SELECT *, CASE WHEN t IN {_strings(N.UNKNOWN)} THEN 'unknown' WHEN t IN {_strings(N.SEX_EXACT)} THEN 'exact' WHEN t IN {_strings(N.SEX_MIXED)} THEN 'mixed'
  WHEN t IN {_strings(N.STAGE_WORDS)} THEN 'leaked_stage' WHEN contains(t, '/') OR regexp_matches(t, '{N.STRAIN_PATTERN}') THEN 'leaked_strain'
  WHEN regexp_matches(t, '^\\d+(\\.\\d+)?$') THEN 'numeric_code' WHEN regexp_matches(t, '\\d') THEN 'leaked_age'
  WHEN length(t) >= 4 AND regexp_matches(t, '^\\p{{L}}+$') AND {_near('t')} THEN 'fuzzy' ELSE 'unrecognized' END AS reason FROM v),
s AS (SELECT *, CASE reason WHEN 'exact' THEN [{_case(N.SEX_EXACT, 't')}] WHEN 'mixed' THEN ['{N.FEMALE}', '{N.MALE}']
  WHEN 'fuzzy' THEN [CASE WHEN levenshtein(regexp_replace(t, '[^\\x00-\\x7f]', '?', 'g'), 'male') <= 1 THEN '{N.MALE}' ELSE '{N.FEMALE}' END] ELSE [] END AS ids FROM r)"""


def _stage(t: str) -> str:
    return f"""CASE WHEN {t} IN {_strings(N.UNKNOWN)} THEN NULL WHEN {_case(N.STAGES, t)} IS NOT NULL THEN {_case(N.STAGES, t)} WHEN regexp_matches({t}, '^e\\d+(\\.\\d+)?$') THEN 'embryonic'
WHEN regexp_matches({t}, '^l[1-4]$') OR contains({t}, 'instar') THEN 'larval' WHEN regexp_matches({t}, '^p\\d+$') THEN 'postnatal'
WHEN regexp_matches({t}, '^(i{{1,3}}|iv|v|vi{{1,3}})[abc]?$') OR regexp_matches({t}, '^\\d+[abc]?$') THEN 'tumor_stage' END"""


def _age(t: str) -> str:
    num, unit = f"regexp_extract({t}, {_AGE}, 1)", f"coalesce(regexp_extract({t}, {_AGE}, 2), '')"
    return f"CASE WHEN {num} = '' THEN NULL WHEN {unit} = '' THEN {num} ELSE {num} || ' ' || {_case(N.AGE_UNITS, unit)} END"


_ORGANISM = f"""n AS (SELECT id, list_filter(list_transform(regexp_split_to_array(organisms, '[,;]'), lambda x: {_strip('x')}), lambda x: x <> '') AS l FROM series),
m AS (SELECT id, l, list_filter(list_transform(l, lambda x: {_case(N.SPECIES, 'lower(x)')}), lambda x: x IS NOT NULL) AS i0 FROM n),
o AS (SELECT id, coalesce(array_to_string(list_transform(list_filter(list_zip(i0, range(1, len(i0) + 1)), lambda x: list_position(i0, x[1]) = x[2]), lambda x: x[1]), '|'), '') AS ids,
  CASE WHEN coalesce(len(l), 0) = 0 THEN 'absent' WHEN len(i0) > 0 THEN 'mapped' ELSE 'unmapped' END AS status FROM m)"""
_ASSAY = f"a AS (SELECT id, gse, assay_status AS old, coalesce({_rules(N.ASSAY_CATEGORIES, 'lower(type)')}, '') AS kinds, coalesce({_rules(N.ASSAY_LABELS, _FREE)}, '') AS labels FROM series)"
_ASSAY_STATUS = "CASE WHEN labels <> '' THEN 'detailed' WHEN kinds <> '' THEN 'category' ELSE 'absent' END"


def _all_fields() -> str:
    """CTE ``normal``: one row per series with every normalized column."""
    tags = _tag_sql("series", "id", "characteristics")
    ctes = [_ORGANISM, f"all_{tags}", "tags AS (SELECT * FROM all_tags WHERE name <> '' AND value <> '')", _sex_sql("id"),
            "f_sex AS (SELECT id, list_sort(list_distinct(flatten(list(ids)))) AS i, bool_or(reason = 'unknown') AS u FROM s GROUP BY id)",
            *[_curated_sql(f, key="id") for f in N.CURATED],
            f"v_st AS (SELECT id, {_token('value')} AS t FROM tags WHERE name IN {_field('dev_stage')}), w_st AS (SELECT id, t, {_stage('t')} AS label FROM v_st)",
            f"f_dev_stage AS (SELECT id, coalesce(list_sort(list(DISTINCT label) FILTER (label <> 'tumor_stage')), []) AS i, bool_or(t IN {_strings(N.UNKNOWN)}) AS u FROM w_st GROUP BY id)",
            f"v_ag AS (SELECT id, {_token('value')} AS t FROM tags WHERE name IN {_field('age')})",
            f"f_age AS (SELECT id, coalesce(list_sort(list(DISTINCT {_age('t')}) FILTER ({_age('t')} IS NOT NULL)), []) AS i FROM v_ag GROUP BY id)", _ASSAY]
    fields = ["sex", *N.CURATED, "dev_stage"]
    picked = ", ".join(
        f"coalesce(array_to_string(f_{f}.i, '|'), '') AS {f}_ids, CASE WHEN f_{f}.id IS NULL THEN 'absent' ELSE {_status(f'f_{f}.i', f'f_{f}.u')} END AS {f}_status" for f in fields)
    joins = " ".join(f"LEFT JOIN f_{f} ON f_{f}.id = o.id" for f in [*fields, "age"])
    return ", ".join(ctes) + f""", normal AS (SELECT o.id, o.ids AS organism_ids, o.status AS organism_status, {picked}, a.kinds AS assay_categories, a.labels AS assay_labels, {_ASSAY_STATUS} AS assay_status,
  coalesce(array_to_string(f_age.i[1:40], '|'), '') AS age_norm, CASE WHEN f_age.id IS NULL THEN 'absent' WHEN len(f_age.i) > 0 THEN 'parsed' ELSE 'unmapped' END AS age_status
  FROM o JOIN a ON a.id = o.id {joins})"""


_SEX = f"{_TAGS}, {_sex_sql('gsm')}"
SQL = {
    "normalize_tokens": f"SELECT {_token('organism_ch1')} AS token, count(*) AS n FROM gsm WHERE organism_ch1 IS NOT NULL GROUP BY 1",
    "field_values": f"WITH {_TAGS} SELECT {_case(N.FIELD_OF_TAG, 'name')} AS field, count(*) AS n, count(DISTINCT value) AS n_values FROM tags GROUP BY 1",
    "sex_rules": f"""WITH {_SEX} SELECT value, count(*) AS n, any_value(reason) AS reason, any_value(array_to_string(ids, '|')) AS ids,
any_value(CASE reason WHEN 'exact' THEN 1.0 WHEN 'mixed' THEN 0.9 WHEN 'fuzzy' THEN 0.75 ELSE 0.0 END)::DOUBLE AS confidence FROM s GROUP BY value""",
    "sex_fold": f"""WITH {_SEX}, f AS (SELECT gsm, list_sort(list_distinct(flatten(list(ids)))) AS i, bool_or(reason = 'unknown') AS u FROM s GROUP BY gsm)
SELECT gsm, array_to_string(i, '|') AS ids, {_status('i', 'u')} AS status FROM f""",
    "curated_lookup": f"WITH {_TAGS}, {_curated_sql('tissue')} SELECT gsm, array_to_string(i, '|') AS ids, {_status('i', 'u')} AS status FROM f_tissue",
    "organism_map": f"WITH {_ORGANISM} SELECT * FROM o",
    "organism_terms": f"""WITH t AS (SELECT term_id, {_token('name')} AS token FROM (SELECT term_id, unnest(list_concat([label], coalesce(synonyms, []))) AS name FROM term_list WHERE vocab = 'organism')),
g AS (SELECT {_token('organism_ch1')} AS token FROM gsm WHERE organism_ch1 IS NOT NULL)
SELECT coalesce(term_id, 'unmapped') AS term_id, count(*) AS n FROM g LEFT JOIN t USING (token) GROUP BY 1""",
    "age_parse": f"WITH {_TAGS}, v AS (SELECT value, count(*) AS n, {_token('value')} AS t FROM tags WHERE name IN {_field('age')} GROUP BY value) SELECT value, n, {_age('t')} AS age FROM v",
    "stage_reject": f"WITH {_TAGS}, v AS (SELECT DISTINCT {_token('value')} AS token FROM tags) SELECT token, label FROM (SELECT token, {_stage('token')} AS label FROM v) WHERE label IS NOT NULL",
    "assay_tags": f"WITH {_ASSAY} SELECT id, kinds, labels, {_ASSAY_STATUS} AS status FROM a",
    "assay_texts": f"""WITH l AS (SELECT doc_id, coalesce({_rules(N.ASSAY_LABELS, 'text')}, '') AS labels FROM documents)
SELECT doc_id, labels, list_has_any(string_split(labels, '|'), [{', '.join("'" + x + "'" for x in N.SINGLE_CELL)}]) AS single_cell FROM l WHERE labels <> ''""",
    "fuzzy_edit1": f"WITH {_SEX} SELECT DISTINCT t AS token FROM v WHERE {_near('t')}",
    "embed_text_compose": """WITH t AS (SELECT id, concat_ws(chr(10), CASE WHEN trim(coalesce(title, ''), ' ') <> '' THEN 'Title: ' || title END, CASE WHEN trim(coalesce(type, ''), ' ') <> '' THEN 'Study type: ' || type END,
CASE WHEN trim(coalesce(organisms, ''), ' ') <> '' THEN 'Organisms: ' || organisms END, CASE WHEN trim(coalesce(summary, ''), ' ') <> '' THEN 'Summary: ' || summary END,
CASE WHEN trim(coalesce(overall_design, ''), ' ') <> '' THEN 'Overall design: ' || overall_design END) AS x FROM series) SELECT id, md5(x) AS digest, length(x) AS n_chars FROM t""",
    "list_blobs": """WITH p AS (SELECT id, list_filter(list_transform(string_split(organisms, ','), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM series WHERE organisms IS NOT NULL),
d AS (SELECT id, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: list_position(l, x[1]) = x[2]), lambda x: x[1]) AS u FROM p)
SELECT id, left(array_to_string(u, ' | '), 200) AS blob, len(u)::INT AS n FROM d""",
    "storage_buckets": "SELECT 'GSE' || CASE WHEN length(gse) > 6 THEN substr(gse, 4, length(gse) - 6) ELSE '' END || 'nnn' AS bucket, count(*) AS n FROM series GROUP BY 1",
    "token_bounds": "SELECT sum(greatest(1, strlen(coalesce(search_text, ''))))::BIGINT AS bound, max(greatest(1, strlen(coalesce(search_text, ''))))::INT AS largest FROM series",
    "backoff": "SELECT attempts, count(*) AS n_keys, least(30 * pow(2, greatest(0, attempts - 1)), 300)::DOUBLE AS seconds FROM (SELECT gsm, count(*) AS attempts FROM gsm GROUP BY gsm) GROUP BY attempts",
    "log_redact_filter": f"WITH {_LOG} SELECT event, level, logger, message, method, route, status_code, auth, note, tries, cookie, query, body_level FROM k",
    "stream_pipeline": f"WITH {_LOG} SELECT event, level, count(*) AS n FROM k GROUP BY event, level",
    "hourly_archive": "SELECT year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2, 3, 4",
    "minute_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS level, count(*) AS n FROM events GROUP BY 1, 2",
    "single_cell_share": f"""WITH l AS (SELECT source, coalesce({_rules(N.ASSAY_LABELS, 'text')}, '') AS labels FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (labels <> '') AS n_named, count(*) FILTER (list_has_any(string_split(labels, '|'), [{', '.join("'" + x + "'" for x in N.SINGLE_CELL)}])) AS n_single FROM l GROUP BY source""",
    "assay_refresh": f"WITH {_ASSAY} SELECT gse, labels, {_ASSAY_STATUS} AS assay_status, old IS DISTINCT FROM {_ASSAY_STATUS} AS changed FROM a",
    "normalized_rows": f"WITH {_all_fields()} SELECT * FROM normal",
    "mapped_counts": f"WITH {_all_fields()} " + " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) AS n_rows, count(*) FILTER ({f}_status IN ('mapped', 'detailed', 'category', 'parsed')) AS n_mapped FROM normal" for f in N.STATUS_FIELDS),
    "token_bucket": """WITH RECURSIVE n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS rn FROM events),
b AS (SELECT user_id, rn, ts, 3.0::DOUBLE AS fill FROM n WHERE rn = 1
  UNION ALL SELECT n.user_id, n.rn, n.ts, least(3.0, b.fill - (CASE WHEN b.fill >= 1 THEN 1 ELSE 0 END) + (epoch_us(n.ts) - epoch_us(b.ts)) / 1e6 / 7200) FROM b JOIN n ON n.user_id = b.user_id AND n.rn = b.rn + 1)
SELECT user_id, count(*) AS n, count(*) FILTER (fill >= 1) AS n_admitted FROM b GROUP BY user_id""",
    **{f"{f}_map": f"WITH {_TAGS}, {_curated_sql(f)} SELECT gsm, array_to_string(tags, '|') AS tags, array_to_string(i, '|') AS ids, {_status('i', 'u')} AS status FROM f_{f}" for f in ("cell_type", "cell_line", "disease")},
}
