"""Operator 4: secret scans, with corpus-wide ownership frequency.

Plan
1. One scan finds spans per text with regular expressions: the base kinds `assign`, `access` and `hex`, and generic
   high-entropy literals as further candidates.  Positions come from the lengths of the pieces between matches.
2. Candidates are hashed and aggregated: distinct documents (each one a repository, unless another column is given) and
   distinct owners (the source) per hash.  Repeats within a text and within an owner collapse map-side before the shuffle.
3. A value of more than `max_owners` owners, or of more than one and `max_repos` repositories, is a widely copied example; any
   other is owner-specific and may be live, however often its owner repeats it.  Generic literals that may be live are added as spans of kind `live`; base spans stay.

All is DataFrame functions.

Defined results: a null text is empty.  A null owner counts as one owner of its own.  Repeated rows are one repository.
Texts without spans have empty strings (base_sha256 of none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import hidden, restored, running, table

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")
MAX_OWNERS, MAX_REPOS = 3, 50


_SPAN = "array<struct<start:bigint,ord:int,end:bigint,value:string>>"


def _spans(text: Column, pattern: str, group: int, kind: int, gate: Column | None = None) -> Column:
    """array<struct<start, ord, end, value>> of all matches, in order; positions are code points.

    gate: a cheaper test without which there is no match.  A text without matches is read once.
    """
    none = F.array().cast(_SPAN)

    def placed(match: Column) -> Column:
        rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(match)).alias("gap"), match.alias("match"))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at + F.length(x["gap"])
            end = start + F.length(x["match"])
            value = F.regexp_extract(x["match"], pattern, group) if group else x["match"]
            return end, F.struct(start.alias("start"), F.lit(kind).alias("ord"), end.alias("end"), value.alias("value"))

        return F.when(F.size(match) > 0, running(rows, F.lit(0).cast("long"), step, none)).otherwise(none)

    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if gate is not None:
        match = F.when(gate, match).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(match), placed), 1)


def find_spans(text: Column) -> Column:
    """Base spans and generic candidates (ord 3), sorted by start and kind."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(_spans(text, ASSIGN, 2, 0), lambda x: F.length(x["value"]) >= 6)
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(x["value"], ""))) >= 10)

    def long_runs(generic: Column) -> Column:
        """An access or hex span lies in a run of the generic alphabet of at least its length."""
        gate = F.size(generic) > 0
        access = F.filter(_spans(text, ACCESS, 0, 1, gate), lambda x: x["end"] - x["start"] >= 20)
        return F.concat(access, _spans(text, HEX, 0, 2, gate), F.filter(generic, mixed))

    runs = F.element_at(F.transform(F.array(_spans(text, GENERIC, 0, 3)), long_runs), 1)
    return F.array_sort(F.concat(assign, runs))


def _hash(value: Column) -> Column:
    return F.sha2(value, 256)


def copied_values(found: DataFrame, repo: str, owner: str, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """(row, copied): per repository, the hashes of its candidates that are widely copied examples.  found has repo, owner, found."""
    values = found.where(F.size("found") > 0).select(F.col(repo).alias("repo"), F.col(owner).alias("owner"), F.explode(F.array_distinct(F.transform("found", lambda x: _hash(x["value"])))).alias("hash"))
    values = table(values.distinct(), "candidates")
    by_owner = values.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    wide = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")).where((F.col("owners") > max_owners) | (F.col("owners") > 1) & (F.col("repos") > max_repos))
    return values.join(wide, "hash").groupBy("repo").agg(F.collect_set("hash").alias("copied"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["ord"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def judged(rows: DataFrame, copied: DataFrame, repo: str) -> DataFrame:
    """rows (with found) and spans: base spans, and generic ones that aren't copied, each with a field `copied`."""
    copied = copied.withColumnRenamed("repo", "_repo")
    rows = rows.join(copied, F.col(repo).eqNullSafe(F.col("_repo")), "left").drop("_repo")
    copied = F.coalesce("copied", F.array().cast("array<string>"))
    spans = F.transform("found", lambda x: x.withField("copied", F.array_contains(copied, _hash(x["value"]))))
    return rows.withColumn("spans", F.filter(spans, lambda x: (x["ord"] < 3) | ~x["copied"])).drop("copied")


def scan_documents(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of all documents."""
    found = table(docs.select(*dict.fromkeys(["doc_id", repo, owner]), find_spans(F.col("text")).alias("found")), "spans")
    out = judged(found, copied_values(found, repo, owner), repo)
    base = F.filter("spans", lambda x: x["ord"] < 3)
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda i: count(lambda x: x["ord"] == i)
    kinds = {f"n_{k}": of_kind(i) for i, k in enumerate(KINDS[:3])}
    return out.select("doc_id", *[v.alias(k) for k, v in kinds.items()], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count(lambda x: ~x["copied"]).alias("n_live"), count(lambda x: x["copied"]).alias("n_copied"))


def _rebuilt(text: Column, cuts: Column) -> Column:
    """The pieces [from, to) of a text, each with what is put after it.

    A piece is found by counting from the text's start; so a stretch is cut out for every block of about the square root of the
    pieces, and pieces are cut out of their stretch.
    """

    def build(cuts: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(cuts))).cast("int")

        def block(part: Column) -> Column:
            first = part[0]["from"]
            stretch = F.substring(text, (first + 1).cast("int"), (F.element_at(part, -1)["to"] - first).cast("int"))

            def piece(at: Column) -> Column:
                return F.array_join(F.transform(part, lambda c: F.concat(F.substring(at, (c["from"] - first + 1).cast("int"), (c["to"] - c["from"]).cast("int")), c["put"])), "")

            return F.element_at(F.transform(F.array(stretch), piece), 1)

        blocks = F.transform(F.sequence(F.lit(1), F.size(cuts), F.greatest(size, F.lit(1))), lambda i: F.slice(cuts, i, size))
        return F.array_join(F.transform(blocks, block), "")

    return F.element_at(F.transform(F.array(cuts), lambda c: F.when(F.size(c) > 0, build(c)).otherwise("")), 1)


def redact(docs: DataFrame, repo: str = "doc_id", owner: str = "source") -> DataFrame:
    """docs with each span replaced: <secret> where it may be live, <example> where it is widely copied."""
    packed = hidden(docs, F.col(repo).alias("repo"), F.col(owner).alias("owner"), "text")
    rows = table(packed.withColumn("found", find_spans(F.col("text"))), "found")
    out = judged(rows, copied_values(rows, "repo", "owner"), "repo")
    none = F.array().cast("array<struct<from:bigint,to:bigint,put:string>>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        """The text from the end of what is done to this span, and its mark; nothing for a span within what is done."""
        start, end = F.greatest(x["start"], at), F.greatest(x["end"], at)
        put = F.when(x["end"] <= at, "").when(x["copied"], "<example>").otherwise("<secret>")
        return end, F.struct(at.alias("from"), F.when(x["end"] <= at, at).otherwise(start).alias("to"), put.alias("put"))

    cuts = running(F.col("spans"), F.lit(0).cast("long"), step, none)
    last = F.array_max(F.transform("spans", lambda x: x["end"]))
    clean = F.concat(_rebuilt(F.col("text"), cuts), F.substring(F.col("text"), (last + 1).cast("int"), F.length("text")))
    hit = F.size("spans") > 0
    out = out.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own = F.col(f"_c{docs.columns.index('n_chars')}")
        changed["n_chars"] = F.when(hit, F.length("text").cast("long")).otherwise(own)
    return restored(out, docs.columns, **changed)


SCAN_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT rid, doc_id, source, 'assign' AS kind, 0 AS ord, regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS ms,
    regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vs,
    string_split_regex(t, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS ps FROM d
  UNION ALL SELECT rid, doc_id, source, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, doc_id, source, 'hex', 2, regexp_extract_all(t, '[0-9a-f]{24,}'), regexp_extract_all(t, '[0-9a-f]{24,}'), string_split_regex(t, '[0-9a-f]{24,}') FROM d
  UNION ALL SELECT rid, doc_id, source, 'live', 3, regexp_extract_all(t, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{20,}'), string_split_regex(t, '[A-Za-z0-9+/_-]{20,}') FROM d),
u AS (SELECT rid, doc_id, source, kind, ord, unnest(list_transform(range(1, len(ms) + 1), lambda i: {'m': ms[i], 'v': vs[i],
    's': list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT})) AS x FROM m WHERE len(ms) > 0),
c AS (SELECT rid, doc_id, source, kind, ord, x.s AS s, x.s + length(x.m) AS e, x.v AS v FROM u
  WHERE CASE ord WHEN 0 THEN length(x.v) >= 6 WHEN 1 THEN length(x.m) >= 20 WHEN 2 THEN true
    ELSE regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[A-Za-z]') AND len(list_distinct(string_split(x.v, ''))) >= 10 END),
f AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT coalesce(doc_id, -1)) AS repos FROM c GROUP BY v),
j AS (SELECT c.*, owners > 3 OR (owners > 1 AND repos > 50) AS copied FROM c JOIN f USING (v)),
g AS (SELECT rid, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans,
    count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied
  FROM j WHERE ord < 3 OR NOT copied GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN g USING (rid)
"""
