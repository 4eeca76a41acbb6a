"""Queries by name over the driver's tables, and the SQL that each must agree with.

The tables hold prose only, so code, hints and rating texts are made from the ids by plain concatenation, alike on both sides;
the SQL then states the expected result of each made pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import python_code
from .functions import text as T
from .operators import chatml, dedup, filters, ranking, ratings
from .plans import stages
from .sources import jsonl
from .sources.backends import StubBackend
from .sources.jsonl import read_table
from .sources.scratch import fresh_path

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__.lstrip("_")] = f
        if sql is not None:
            _SQL[f.__name__.lstrip("_")] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- hashes, dedup, resume -------------------------------------------------------------------------------------------


@_query("SELECT doc_id, sha256(text)[:16] AS uid FROM documents")
def uid_hash(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.uid16(F.col("text")).alias("uid"))


@_query("SELECT doc_id, sha256(text)[:16] AS uid FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text)[:16] ORDER BY doc_id) = 1")
def dedup_first_wins(spark, sf):
    return dedup.new_rows(read_table(spark, sf, "documents").select("doc_id", "text"), None, "text", "doc_id").select("doc_id", "uid")


@_query('SELECT count(*) AS total, count(DISTINCT text) AS "unique", count(*) - count(DISTINCT text) AS duplicates FROM documents')
def dedup_counters(spark, sf):
    return dedup.duplicate_counters(read_table(spark, sf, "documents"), "text")


@_query("""SELECT doc_id, sha256(text)[:16] AS uid FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 3 = 0 AND s.text = d.text)
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def resume_new_rows(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    seen = docs.where("doc_id % 3 = 0").select(T.uid16(F.col("text")).alias("uid"))
    return dedup.new_rows(docs, seen, "text", "doc_id").select("doc_id", "uid")


@_query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents s WHERE s.doc_id % 3 = 0 AND s.text = d.text) ORDER BY doc_id LIMIT 100""")
def resume_anti_join(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", T.uid16(F.col("text")).alias("uid"))
    return dedup.first_rows(dedup.unseen(docs, docs.where("doc_id % 3 = 0")), 100, "doc_id").select("doc_id")


@_query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50")
def first_n_limit(spark, sf):
    return dedup.first_rows(read_table(spark, sf, "documents").select("doc_id", "text"), 50, "doc_id")


@_query("SELECT DISTINCT sha256(text)[:16] AS uid FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)")
def key_union(spark, sf):
    keys = [read_table(spark, sf, t).select(T.uid16(F.col("text")).alias("uid")) for t in ("documents", "benchmark")]
    return dedup.merged_keys(*keys)


# --- projections and prompts ---------------------------------------------------------------------------------------------


@_query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, nullif(CASE WHEN doc_id % 3 = 1 THEN source ELSE '' END, ''), '') AS prompt,
  CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS code FROM documents""")
def normalize_record(spark, sf):
    d = read_table(spark, sf, "documents")
    prompt = T.first_filled(F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise(""))
    code = T.first_filled(F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.col("text")))
    return d.select("doc_id", prompt.alias("prompt"), code.alias("code"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@_query(f"SELECT doc_id, replace('Solve: {{{{problem}}}} now', '{{{{problem}}}}', trim(text, {_WS})) AS prompt FROM documents")
def prompt_skeleton(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.skeleton_prompt("Solve: {{problem}} now", F.col("text")).alias("prompt"))


@_query(f"SELECT item_id, replace(replace('P {{{{problem}}}} S {{{{skeleton}}}}', '{{{{problem}}}}', trim(text, {_WS})), '{{{{skeleton}}}}', 'def f' || item_id || '(x):') AS prompt FROM benchmark")
def prompt_code(spark, sf):
    skeleton = F.concat(F.lit("def f"), F.col("item_id").cast("string"), F.lit("(x):\n"))
    return read_table(spark, sf, "benchmark").select("item_id", T.code_prompt("P {{problem}} S {{skeleton}}", F.col("text"), skeleton).alias("prompt"))


@_query("SELECT doc_id, replace(replace('P {{problem_text}} C {{code}}', '{{problem_text}}', text), '{{code}}', lang) AS prompt FROM documents")
def prompt_rating(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.rating_prompt("P {{problem_text}} C {{code}}", F.col("text"), F.col("lang")).alias("prompt"))


@_query("""SELECT range AS id, '<|fim_prefix|>This is an algorithm function.' || chr(10) || chr(10) || 'def <|fim_suffix|>():' || chr(10) || '<|fim_middle|>' AS prompt FROM range(10)""")
def prompt_fim(spark, sf):
    return ranking.repeat_prompt(spark, T.fim_prompt(), 10)


@_query("""SELECT p_partkey, 'This is an algorithm function.' || chr(10) || chr(10) || 'def ' || replace(p_name, ' ', '_') || '():' || chr(10) || '    \"\"\"' || chr(10) || '    ' || p_type || chr(10) || '    \"\"\"' AS prompt FROM part""")
def prompt_definition(spark, sf):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return read_table(spark, sf, "part").select("p_partkey", T.definition_prompt(name, F.col("p_type")).alias("prompt"))


@_query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE 'name_' || doc_id END AS name, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN '' ELSE source || ' only' END AS description FROM documents""")
def name_and_description(spark, sf):
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    text = F.when(k == 0, F.concat("source", F.lit("\n\nFunction name:\n\ndef name_"), i, F.lit("(x):"))).when(k == 1, F.concat(F.lit("Function name: def name_"), i, F.lit("(a, b)"))).otherwise(F.concat("source", F.lit(" only\n")))
    d = read_table(spark, sf, "documents").select("doc_id", "source", text.alias("t"))
    return d.select("doc_id", T.name_after_description(F.col("t")).alias("name"), T.description_before_name(F.col("t")).alias("description"))


@_query("SELECT p_partkey, 'f' || p_partkey AS fim, 'g' || p_partkey AS l2r FROM part")
def completion_names(spark, sf):
    i = F.col("p_partkey").cast("string")
    fim, l2r = F.concat(F.lit(" f"), i, F.lit(" x(y):")), F.concat(F.lit("\ndef g"), i, F.lit("(a):\n  pass"))
    return read_table(spark, sf, "part").select("p_partkey", T.name_of_completion(fim, "FIM").alias("fim"), T.name_of_completion(l2r, "L2R").alias("l2r"))


# --- filters ---------------------------------------------------------------------------------------------------------------

_NAMES_SQL = """WITH n AS (SELECT 'p' || p_partkey AS id, replace(p_name, ' ', '_') AS name FROM part UNION ALL SELECT 'c' || c_custkey, c_name FROM customer
  UNION ALL SELECT 'e' || event_id, event_type FROM events),
f AS (SELECT id, name, CASE WHEN NOT regexp_matches(trim(name), '^[a-z_][a-z0-9_]{2,64}$') THEN 'regex' WHEN lower(name) IN ('click', 'view') THEN 'weaklist' END AS failed FROM n)
"""


def _names(spark, sf) -> DataFrame:
    part, customer, events = (read_table(spark, sf, t) for t in ("part", "customer", "events"))
    ids = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    rows = part.select(ids("p", "p_partkey"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name")).union(customer.select(ids("c", "c_custkey"), "c_name"))
    return rows.union(events.select(ids("e", "event_id"), "event_type"))


@_query(_NAMES_SQL + "SELECT id, name FROM f WHERE failed IS NULL")
def funcname_chain(spark, sf):
    return filters.FilterChain.for_names(weak=["Click", "view"]).apply(_names(spark, sf), "name")


@_query(_NAMES_SQL + "SELECT k AS filter, (SELECT count(*) FROM f WHERE failed = k) AS removed FROM (VALUES ('regex'), ('weaklist')) v(k)")
def funcname_chain_stats(spark, sf):
    return filters.FilterChain.for_names(weak=["Click", "view"]).stats(_names(spark, sf), "name")


@_query("SELECT doc_id, length(text) >= 600 AS raw_ok, length(trim(text, ' ' || chr(10))) >= 600 AS stripped_ok FROM documents")
def code_length_filter(spark, sf):
    long = lambda s: filters.code_long_enough(F.col("text"), 600, s)
    return read_table(spark, sf, "documents").select("doc_id", long(False).alias("raw_ok"), long(True).alias("stripped_ok"))


# --- candidates, perplexity, top-k ------------------------------------------------------------------------------------------------


@_query("SELECT item_id, i, 'def auto_gen_' || i || '():' || chr(10) || '    pass' || chr(10) AS code, NULL::DOUBLE AS score FROM benchmark, (SELECT range AS i FROM range(4))")
def mock_candidates(spark, sf):
    return stages.candidates(read_table(spark, sf, "benchmark").select("item_id"), 4).select("item_id", "i", "code", "score")


@_query("SELECT doc_id, round(100 / (1 + ln(greatest(1, length(text)))), 6) AS ppl FROM documents")
def mock_perplexity(spark, sf):
    return ranking.with_perplexity(read_table(spark, sf, "documents"), "text").select("doc_id", F.round("ppl", 6).alias("ppl"))


@_query("""WITH d AS (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 600),
r AS (SELECT doc_id, n, row_number() OVER (ORDER BY 100 / (1 + ln(n)), doc_id) AS k, count(*) OVER () AS c FROM d)
SELECT doc_id, round(100 / (1 + ln(n)), 6) AS ppl FROM r WHERE k <= greatest(1, floor(c * 0.5))""")
def keep_ratio_topk(spark, sf):
    docs = stages.scored(read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("code")))
    return stages.filtered(docs, 0.5, 600, "doc_id").select("doc_id", F.round("ppl", 6).alias("ppl"))


@_query("SELECT vec_id, round(exp(-list_avg(list_transform(embedding, lambda x: x::DOUBLE))), 6) AS ppl FROM embeddings")
def logprob_perplexity(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", F.round(T.logprob_perplexity(F.col("embedding")), 6).alias("ppl"))


# --- scans and sinks: lines made from a table are written, and read back by each policy ------------------------------------------------------


def _written(df: DataFrame, line: Column) -> str:
    """A fresh folder of text files with one line a row."""
    path = fresh_path(df.sparkSession, "lines")
    df.select(line.alias("value")).write.text(path)
    return path


def _json(**fields: Column) -> Column:
    """A JSON object with all its keys, those of nulls too."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _texts() -> tuple[Column, Column, Column]:
    """doc_id as text, text and source."""
    return F.col("doc_id").cast("string"), F.col("text"), F.col("source")


def _odd(line: Column) -> Column:
    """Every seventh line blank, every seventh of spaces, every seventh no JSON, the others as they are."""
    k = F.col("doc_id") % 7
    return F.when(k == 0, "").when(k == 1, " \t ").when(k == 2, F.concat(F.lit("{bad "), F.col("lang"))).otherwise(line)


@_query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE list_contains(json_keys(props), 'k') AND event_id % 3 <> 0")
def json_presence(spark, sf):
    """Lines without the required key are dropped."""
    line = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", "), F.when(F.col("event_id") % 3 == 0, F.replace("props", F.lit('"k"'), F.lit('"j"'))).otherwise(F.col("props")).substr(F.lit(2), F.length("props")))
    return jsonl.read_jsonl(spark, _written(read_table(spark, sf, "events"), line), "event_id long, k string", "skip", ("k",)).select("event_id", "k")


@_query("""SELECT doc_id::VARCHAR AS uid, CASE WHEN doc_id % 7 = 4 THEN 'UNKNOWN' ELSE source END AS source, CASE WHEN doc_id % 7 <> 5 THEN text END AS problem_text FROM documents WHERE doc_id % 7 >= 4""")
def scan_problems(spark, sf):
    uid, text, source = _texts()
    k = F.col("doc_id") % 7
    line = F.when(k == 3, _json(uid=uid, other=text)).when(k == 4, _json(uid=uid, problem_description=text)).otherwise(_json(uid=uid, source=source, problem_description=F.when(k != 5, text)))
    path = _written(read_table(spark, sf, "documents"), _odd(line))
    return jsonl.read_problems(spark, path).select("uid", "source", "problem_text")


@_query("""SELECT doc_id::VARCHAR AS uid, CASE WHEN doc_id % 2 = 1 THEN lang ELSE text END AS prompt, source AS code, 2 AS extra FROM documents""")
def scan_samples(spark, sf):
    uid, text, source = _texts()
    line = _json(uid=uid, prompt=F.when(F.col("doc_id") % 2 == 1, F.col("lang")).otherwise(""), docstring=text, solution=source, k=F.col("doc_id"))
    rows = jsonl.read_samples(spark, _written(read_table(spark, sf, "documents"), line))
    return rows.select(F.col("meta")["uid"].alias("uid"), "prompt", "code", F.size("meta").alias("extra"))


@_query("""SELECT doc_id::VARCHAR AS uid, coalesce(CASE WHEN doc_id % 7 <> 6 THEN source END, 'UNKNOWN') AS source, text AS problem_text, lang AS skeleton_code, 'f' || doc_id AS function_name
  FROM documents WHERE doc_id % 7 IN (3, 6)""")
def scan_skeletons(spark, sf):
    uid, text, source = _texts()
    k = F.col("doc_id") % 7
    whole = {"uid": uid, "problem_text": text, "skeleton_code": F.col("lang"), "function_name": F.concat(F.lit("f"), uid)}
    line = F.when(k == 3, _json(**whole, source=source, valid=F.lit(True))).when(k == 4, _json(**whole, source=source, valid=F.lit(False))).when(k == 5, _json(uid=uid, problem_text=text)).otherwise(_json(**whole))
    return jsonl.read_skeletons(spark, _written(read_table(spark, sf, "documents"), _odd(line))).select("uid", "source", "problem_text", "skeleton_code", "function_name")


@_query("""SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE '' END AS uid, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'UNKNOWN' END AS source, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS problem_text,
  lang AS code, '' AS function_name FROM documents""")
def scan_implementations(spark, sf):
    uid, text, source = _texts()
    line = F.when(F.col("doc_id") % 2 == 0, _json(uid=uid, source=source, problem_text=text, code=F.col("lang"))).otherwise(_json(code=F.col("lang"), problem_text=F.lit(None).cast("string")))
    return jsonl.read_implementations(spark, _written(read_table(spark, sf, "documents"), line)).select("uid", "source", "problem_text", "code", "function_name")


@_query("""SELECT doc_id::VARCHAR AS uid, CASE WHEN doc_id % 2 = 0 THEN 'FIM' ELSE 'L2R' END AS mode, 1 + quality AS correctness, CASE WHEN doc_id % 5 <> 0 THEN 4 END AS readability FROM labels WHERE doc_id % 7 <> 3""")
def scan_ratings(spark, sf):
    """Two files of ratings, and both as one table by mode."""
    labels, uid = read_table(spark, sf, "labels"), F.col("doc_id").cast("string")
    scores = F.struct((1 + F.col("quality")).alias("correctness"), F.when(F.col("doc_id") % 5 != 0, 4).alias("readability"))
    line = F.when(F.col("doc_id") % 7 == 3, _json(uid=uid)).otherwise(_json(uid=uid, ratings=scores))
    both = [jsonl.read_ratings(spark, _written(labels.where(F.col("doc_id") % 2 == i), line)) for i in (0, 1)]
    return ratings.by_mode(*both).select("uid", "mode", "ratings.correctness", "ratings.readability")


@_query("SELECT doc_id % 7 = 2 AS json_error, CASE WHEN doc_id % 7 <> 2 THEN doc_id::VARCHAR END AS uid, CASE WHEN doc_id % 7 <> 2 THEN text END AS code FROM documents WHERE doc_id % 7 >= 2")
def scan_rated_lines(spark, sf):
    uid, text, source = _texts()
    path = _written(read_table(spark, sf, "documents"), _odd(_json(uid=uid, code=text)))
    return jsonl.read_rated_lines(spark, path).select("json_error", "uid", "code")


@_query("SELECT DISTINCT sha256(text)[:16] AS uid FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)")
def scan_keys(spark, sf):
    """Keys of two runs, appended to one file, then read."""
    path = fresh_path(spark, "keys")
    for t in ("documents", "benchmark"):
        jsonl.write_keys(read_table(spark, sf, t).select(T.uid16(F.col("text")).alias("uid")), path)
    return jsonl.read_keys(spark, path)


@_query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, text, 3 AS keys FROM documents")
def sink_jsonl(spark, sf):
    """Whole texts written and read back; nulls keep their keys."""
    path = fresh_path(spark, "sink")
    jsonl.write_jsonl(read_table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), "text"), path)
    entry = F.from_json("value", "map<string,string>")
    return jsonl.read_lines(spark, path).select(entry["doc_id"].alias("doc_id"), entry["lang"].alias("lang"), entry["text"].alias("text"), F.size(entry).alias("keys"))


@_query(f"SELECT doc_id, trim(replace(replace(text, chr(13), ' '), chr(10), ' '), {_WS}) AS value FROM documents WHERE trim(text, {_WS}) <> ''")
def scan_lines(spark, sf):
    """Lines in the order of their file: the n-th that is read is the n-th that was written."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[\r\n]", " ").alias("line")).where(T.strip(F.col("line")) != "")
    path = fresh_path(spark, "ordered")
    ordered = docs.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    ordered.select(F.concat(F.lit("  "), "line").alias("value")).write.text(path)
    at = lambda df, *by: df.withColumn("at", F.row_number().over(Window.orderBy(*by)))
    return at(jsonl.read_lines(spark, path), *jsonl.ORDER).join(at(docs.select("doc_id"), "doc_id"), "at").select("doc_id", "value")


# --- ratings -------------------------------------------------------------------------------------------------------------------------

_RATED_SQL = """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'FIM' ELSE 'L2R' END AS mode, quality * 3 + 1 + doc_id % 2 AS problem_design, doc_id % 7 AS function_definition,
  5 - toxic * 4 AS correctness, 1 + doc_id % 5 AS efficiency, CASE WHEN doc_id % 11 <> 0 THEN 3 + quality END AS readability FROM labels),
u AS (SELECT doc_id, mode, unnest(['problem_design', 'function_definition', 'correctness', 'efficiency', 'readability']) AS dimension,
  unnest([problem_design, function_definition, correctness, efficiency, readability])::DOUBLE AS score FROM s),
v AS (SELECT * FROM u WHERE score BETWEEN 1 AND 5),
frame AS (SELECT * FROM (VALUES ('FIM'), ('L2R')) m(mode), (VALUES ('problem_design'), ('function_definition'), ('correctness'), ('efficiency'), ('readability')) d(dimension)),
st AS (SELECT mode, dimension, coalesce(avg(score), 0) AS mean, coalesce(median(score), 0) AS median, coalesce(stddev_pop(score), 0) AS std, count(score) AS count
  FROM frame LEFT JOIN v USING (mode, dimension) GROUP BY mode, dimension)
"""


def _rated(spark, sf) -> DataFrame:
    i, q, t = F.col("doc_id"), F.col("quality"), F.col("toxic")
    made = {"problem_design": q * 3 + 1 + i % 2, "function_definition": i % 7, "correctness": 5 - t * 4, "efficiency": 1 + i % 5, "readability": F.when(i % 11 != 0, 3 + q)}
    scores = F.struct(*[c.cast("int").alias(k) for k, c in made.items()])
    return read_table(spark, sf, "labels").select("doc_id", F.when(i % 2 == 0, "FIM").otherwise("L2R").alias("mode"), scores.alias("ratings"))


@_query(_RATED_SQL + "SELECT mode, dimension, round(mean, 6) AS mean, median, round(std, 6) AS std, count FROM st")
def rating_stats(spark, sf):
    s = ratings.statistics(ratings.scores(_rated(spark, sf)))
    return s.select("mode", "dimension", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"), "count")


@_query(_RATED_SQL + """SELECT dimension, round(max(mean) FILTER (mode = 'FIM'), 6) AS fim_mean, round(max(mean) FILTER (mode = 'L2R'), 6) AS l2r_mean,
  round(max(mean) FILTER (mode = 'L2R') - max(mean) FILTER (mode = 'FIM'), 6) AS difference FROM st GROUP BY dimension""")
def rating_compare(spark, sf):
    c = ratings.comparison(ratings.statistics(ratings.scores(_rated(spark, sf))))
    return c.select("dimension", *[F.round(x, 6).alias(x) for x in ("fim_mean", "l2r_mean", "difference")])


@_query(_RATED_SQL + "SELECT mode, round(avg(mean), 6) AS overall, sum(count) FILTER (dimension = 'problem_design')::BIGINT AS samples FROM st GROUP BY mode")
def rating_overall(spark, sf):
    return ratings.overall(ratings.statistics(ratings.scores(_rated(spark, sf)))).select("mode", F.round("overall", 6).alias("overall"), "samples")


@_query(_RATED_SQL + """SELECT mode, dimension, bin, count(score) AS count FROM frame CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5])::INT AS bin)
  LEFT JOIN (SELECT mode, dimension, score, least(5, floor(score + 0.5))::INT AS bin FROM v) USING (mode, dimension, bin) GROUP BY ALL""")
def rating_hist(spark, sf):
    return ratings.histogram(ratings.scores(_rated(spark, sf)))


@_query(_RATED_SQL + "SELECT doc_id FROM s WHERE problem_design >= 4 AND correctness >= 4 AND coalesce(readability, 0) >= 4")
def quality_all(spark, sf):
    rows = _rated(spark, sf)
    return rows.where(filters.meets_thresholds(F.col("ratings"), {"problem_design": 4, "correctness": 4, "readability": 4})).select("doc_id")


@_query(_RATED_SQL + "SELECT doc_id FROM s WHERE efficiency >= 5 OR coalesce(readability, 0) >= 4")
def quality_any(spark, sf):
    rows = _rated(spark, sf)
    return rows.where(filters.meets_thresholds(F.col("ratings"), {"efficiency": 5, "readability": 4}, False)).select("doc_id")


def _rating_text() -> Column:
    i = F.col("doc_id")
    parts = [F.concat(F.lit(f"{t} SCORE:\n"), (i % (j + 4) + 1).cast("string"), F.lit(".5\n")) for j, t in enumerate(T.DIMENSIONS.values())]
    return F.concat(*parts, F.when(i % 4 == 0, F.lit("Summary:")).when(i % 4 == 1, F.concat(F.lit("summary: s"), i.cast("string"), F.lit(" --- x"))).otherwise(F.concat(F.lit("Summary: a\nb"), i.cast("string"), F.lit("\n\nrest"))))


_PARSED_SQL = """WITH r AS (SELECT doc_id, (doc_id % 4 + 1)::INT AS problem_design, (doc_id % 5 + 1)::INT AS function_definition, (doc_id % 6 + 1)::INT AS correctness, (doc_id % 7 + 1)::INT AS efficiency,
  (doc_id % 8 + 1)::INT AS readability, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 's' || doc_id ELSE 'a' || chr(10) || 'b' || doc_id END AS summary FROM labels)
"""


@_query(_PARSED_SQL + "SELECT * FROM r")
def parse_rating(spark, sf):
    rows = read_table(spark, sf, "labels").select("doc_id", _rating_text().alias("t"))
    return rows.select("doc_id", T.rating(F.col("t")).alias("r"), T.rating_summary(F.col("t")).alias("summary")).select("doc_id", "r.*", "summary")


@_query(_PARSED_SQL + "SELECT doc_id, correctness <= 5 AND efficiency <= 5 AND readability <= 5 AND summary IS NOT NULL AS ok FROM r")
def validate_rating(spark, sf):
    rows = read_table(spark, sf, "labels").select("doc_id", _rating_text().alias("t"))
    return rows.select("doc_id", filters.scores_valid(T.rating(F.col("t")), T.rating_summary(F.col("t"))).alias("ok"))


# --- code ----------------------------------------------------------------------------------------------------------------------------

#: (code, signature, body, parses); {i} is the doc_id.
_CODES = (
    ('def f{i}(a: int) -> int:\n    """Doc."""\n    x = 1\n    if a:\n        x = 2\n    return x', "def f{i}(a: int) -> int:", "x = 1\nif a:\n    x = 2\nreturn x", True),
    ("import math\n\ndef f{i}(a):\n    return math.pi\n\ndef g():\n    return 2", "def f{i}(a):", "return math.pi", True),
    ("def f{i}(\n    a,\n    b\n) -> int:\n    return a", "def f{i}(\n    a,\n    b\n) -> int:", "a,\nb", True),
    ("def f{i}(a): return a", "def f{i}(a): return a", None, True),
    ("def f{i}(:", None, None, False),
    ("class A{i}:\n    def m(self):\n        return {i}", "def m(self):", "return {i}", True),
    ("async def f{i}():\n    return 1", None, None, True),
)


def _made(pattern: str | None) -> Column:
    return F.lit(None).cast("string") if pattern is None else F.replace(F.lit(pattern), F.lit("{i}"), F.col("doc_id").cast("string"))


def _code() -> Column:
    out = _made(_CODES[-1][0])
    for k, row in list(enumerate(_CODES))[:-1][::-1]:
        out = F.when(F.col("doc_id") % len(_CODES) == k, _made(row[0])).otherwise(out)
    return out


def _case(part: int) -> str:
    quote = lambda s: "NULL" if s is None else "replace('" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "', '{i}', doc_id::VARCHAR)"
    return f"CASE doc_id % {len(_CODES)} " + " ".join(f"WHEN {k} THEN {quote(r[part])}" for k, r in enumerate(_CODES)) + " END"


def _codes(spark, sf) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "source", _code().alias("code"))


@_query(f"SELECT doc_id, doc_id % {len(_CODES)} <> 4 AS valid FROM documents")
def syntax_valid(spark, sf):
    return _codes(spark, sf).select("doc_id", python_code.syntax_valid(F.col("code")).alias("valid"))


@_query(f"SELECT doc_id, {_case(1)} AS signature, {_case(2)} AS body FROM documents")
def signature_body(spark, sf):
    return _codes(spark, sf).select("doc_id", python_code.split_function(F.col("code")).alias("f")).select("doc_id", "f.signature", "f.body")


@_query(f"SELECT doc_id, CASE WHEN doc_id % {len(_CODES)} < 5 THEN 'f' || doc_id END AS name FROM documents")
def func_name(spark, sf):
    return _codes(spark, sf).select("doc_id", T.function_name(F.col("code")).alias("name"))


@_query(f"SELECT doc_id, CASE WHEN doc_id % {len(_CODES)} = 1 THEN 'import math' ELSE '' END AS imports FROM documents")
def extract_imports(spark, sf):
    return _codes(spark, sf).select("doc_id", F.array_join(T.imports(F.col("code")), ";").alias("imports"))


def _bodies(spark, sf) -> DataFrame:
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    body = F.when(k == 0, F.concat(F.lit("return "), i)).when(k == 1, F.concat(F.lit("for i in x:\n  y = "), i, F.lit("\n\n    z = 1"))).when(k == 2, F.concat(F.lit("# only "), i, F.lit("\n\n#b"))).otherwise(F.concat(F.lit("  def g"), i, F.lit("(): pass")))
    return read_table(spark, sf, "documents").select("doc_id", F.concat(F.lit("def f"), i, F.lit("(x):\n \n")).alias("skeleton"), body.alias("body"))


@_query("""SELECT doc_id, 'def f' || doc_id || '(x):' || chr(10) || CASE doc_id % 4 WHEN 0 THEN '    return ' || doc_id
  WHEN 1 THEN '    for i in x:' || chr(10) || '    y = ' || doc_id || chr(10) || chr(10) || '    z = 1' WHEN 2 THEN '    # only ' || doc_id || chr(10) || chr(10) || '    #b'
  ELSE '    def g' || doc_id || '(): pass' END AS code FROM documents""")
def combine_body(spark, sf):
    return _bodies(spark, sf).select("doc_id", T.combine(F.col("skeleton"), F.col("body")).alias("code"))


@_query("SELECT doc_id, doc_id % 4 <> 2 AS has_code, doc_id % 4 <> 3 AS format_ok FROM documents")
def body_checks(spark, sf):
    return _bodies(spark, sf).select("doc_id", T.has_code(F.col("body")).alias("has_code"), (~T.starts_with_def(F.col("body"))).alias("format_ok"))


@_query(rf"SELECT doc_id, trim(regexp_replace(text, '(?s)(^|\n)\s*Hint:.*$', ''), {_WS}) AS text FROM documents")
def remove_hint(spark, sf):
    hinted = F.concat(F.col("text"), F.lit("\n  Hint: "), F.col("source"), F.lit("\nmore"))
    return read_table(spark, sf, "documents").select("doc_id", T.drop_hint(hinted).alias("text"))


# --- chat records ----------------------------------------------------------------------------------------------------------------------


@_query("""SELECT conv_id, turn, text AS user_content, answer AS assistant_content FROM (
  SELECT *, lead(role) OVER w AS follower, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user' AND follower = 'assistant'""")
def chat_pairs(spark, sf):
    """Each question with its answer as a chat record's messages."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = read_table(spark, sf, "conversations").withColumns({"follower": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    pairs = rows.where("role = 'user' AND follower = 'assistant'").select("conv_id", "turn", chatml.messages(F.col("text"), F.col("answer")).alias("m"))
    return pairs.select("conv_id", "turn", F.col("m")[0]["content"].alias("user_content"), F.col("m")[1]["content"].alias("assistant_content"))


def _records(spark, sf) -> DataFrame:
    rows = _rated(spark, sf).select("doc_id", "ratings").withColumn("source", F.lit("s"))
    return rows.select("doc_id", F.concat(F.lit("Title "), F.col("doc_id").cast("string"), F.lit("\nHint: no")).alias("problem_text"), _code().alias("code"), "ratings", (F.col("doc_id") % 13 == 0).alias("json_error"))


_STATUS_SQL = _RATED_SQL + f""", k AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'json_error' WHEN NOT (correctness >= 4 AND coalesce(readability, 0) >= 3) THEN 'quality'
  WHEN doc_id % {len(_CODES)} IN (3, 4, 6) THEN 'parse' ELSE 'success' END AS status FROM s)
"""


@_query(_STATUS_SQL + f"SELECT doc_id, 'Title ' || doc_id || chr(10) || chr(10) || {_case(1)} AS user_content, {_case(2)} AS assistant_content FROM k WHERE status = 'success'")
def chatml_messages(spark, sf):
    rows = chatml.chat_records(_records(spark, sf), {"correctness": 4, "readability": 3}, fields=("doc_id", "messages"))
    return rows.select("doc_id", F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("assistant_content"))


@_query(_STATUS_SQL + """SELECT count(*) AS total, count(*) FILTER (status = 'success') AS converted, count(*) FILTER (status = 'quality') AS filtered_quality,
  count(*) FILTER (status IN ('json_error', 'parse')) AS failed_parse, round(count(*) FILTER (status = 'success') / count(*) * 100, 6) AS success_rate FROM k""")
def convert_stats(spark, sf):
    stats = chatml.conversion_stats(chatml.chat_status(_records(spark, sf), {"correctness": 4, "readability": 3}))
    return stats.withColumn("success_rate", F.round("success_rate", 6))


# --- model stages over the deterministic stub ----------------------------------------------------------------------------------------------


def _skeleton_answer(prompt: str, attempt: int) -> str:
    return f"\ndef f_{len(prompt) % 50}(x):\n    pass\n" if len(prompt) % 5 else "def broken(:"


@_query(f"""WITH d AS (SELECT doc_id, 2 + length(trim(text, {_WS})) AS n FROM documents),
k AS (SELECT doc_id, n, CASE WHEN n % 5 = 0 THEN 'invalid_syntax' WHEN row_number() OVER (PARTITION BY n % 50 ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'kept' END AS status FROM d)
SELECT doc_id, status, CASE WHEN n % 5 <> 0 THEN 'f_' || (n % 50) END AS function_name FROM k""")
def stage_skeletons(spark, sf):
    rows = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("problem_text"), "source")
    done = stages.skeletons(rows, "P:{{problem}}", lambda: StubBackend(_skeleton_answer), ("doc_id",))
    return done.select("doc_id", "status", F.when(F.col("status") != "invalid_syntax", F.col("function_name")).alias("function_name"))


def _body_answer(prompt: str, attempt: int) -> str:
    n = len(prompt)
    return "# nothing" if attempt == 1 and n % 3 == 0 else "def again(): pass" if n % 7 == 0 else "" if n % 11 == 0 else f"return {n}"


@_query(f"""WITH d AS (SELECT doc_id, 1 + length(trim(text, {_WS})) + length('def f' || doc_id || '(x):') AS n FROM documents)
SELECT doc_id, CASE WHEN n % 7 = 0 THEN 'wrong_format' WHEN n % 11 = 0 THEN 'empty' ELSE 'kept' END AS status, CASE WHEN n % 3 = 0 OR n % 7 = 0 THEN 2 ELSE 1 END AS attempts FROM d""")
def stage_code(spark, sf):
    i = F.col("doc_id").cast("string")
    rows = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("problem_text"), "source", F.concat(F.lit("def f"), i, F.lit("(x):\n")).alias("skeleton_code"), F.concat(F.lit("f"), i).alias("function_name"))
    done = stages.implementations(rows, "{{problem}} {{skeleton}}", lambda: StubBackend(_body_answer), ("doc_id",))
    return done.select("doc_id", "status", "attempts")


def _rating_answer(prompt: str, attempt: int) -> str:
    n = len(prompt) % 4 + 2
    text = "".join(f"{t} Score: {n if attempt == 1 else 5}\n" for t in T.DIMENSIONS.values())
    return text + ("Summary: fine\n\nmore" if len(prompt) % 6 else "")


@_query("""WITH d AS (SELECT doc_id, sha256(text)[:16] AS uid, 1 + length(text) + length(lang) AS n FROM documents),
k AS (SELECT doc_id, n FROM d WHERE uid NOT IN (SELECT uid FROM d WHERE doc_id % 10 = 0))
SELECT doc_id, CASE WHEN n % 6 = 0 THEN 'invalid_scores' ELSE 'kept' END AS status, (CASE WHEN n % 6 = 0 THEN 5 ELSE n % 4 + 2 END)::INT AS correctness, CASE WHEN n % 6 = 0 THEN 2 ELSE 1 END AS attempts FROM k""")
def stage_ratings(spark, sf):
    rows = read_table(spark, sf, "documents").select("doc_id", T.uid16(F.col("text")).alias("uid"), F.col("text").alias("problem_text"), F.col("lang").alias("code"))
    done = stages.rated(rows, "{{problem_text}} {{code}}", lambda: StubBackend(_rating_answer), ("doc_id",), seen=rows.where("doc_id % 10 = 0").select("uid"))
    return done.select("doc_id", "status", "ratings.correctness", "attempts")


@_query("SELECT CASE WHEN range = 0 THEN 'kept' ELSE 'duplicate' END AS status, 'x = 1' AS problem_description, 'FIM' AS source FROM range(20)")
def stage_problems(spark, sf):
    done = stages.problems(spark, "FIM", 20, lambda: StubBackend(lambda p, a: " x = 1 --- y", ("---",)))
    return done.select("status", "problem_description", "source")
