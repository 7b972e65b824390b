"""All queries of the engine over the driver's tables, and the SQL that they are checked against.

The tables have no annotations; these stand in for them, made from documents by integer arithmetic so that
any engine makes the same: chunks are 16 documents, each document is a passage that one annotator reports, and
every eighth one a passage that four report.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium import prepare
from scriptorium.functions import scoring, text
from scriptorium.operators import chat, chunking, consensus, dataset, evaluation, inference, matching, parsing, reports, semantic, traces
from scriptorium.schemas import SOC_TYPES, TYPE_LABELS
from scriptorium.storage import scratch
from scriptorium.streaming import groups

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODELS = ["m0", "m1", "m2", "m3"]
PER_CHUNK = 16


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def annotations(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """The stand-in annotation rows; passages are the whole texts."""
    d, i, k, w = table(spark, sf_dir, "documents") if docs is None else docs, F.col("doc_id"), F.col("k"), F.col("w")
    each = d.withColumn("w", text.words(F.col("text"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.when(i % 8 == 0, 3).otherwise(0))))
    chunk = F.floor(i / PER_CHUNK)
    return each.select(
        (i * 4 + k).alias("row_id"), F.concat(F.lit("m"), ((i + k) % 4).cast("string")).alias("model_label"), F.col("source").alias("source_file"),
        F.concat(F.lit("c"), chunk.cast("string")).alias("chunk_id"), F.lit("").alias("chunk_label"), (chunk % 5).cast("int").alias("chunk_index"),
        F.concat(F.array_join(w, " "), F.when(k == 3, " indeed").otherwise("")).alias("passage"), F.element_at(F.array(*map(F.lit, SOC_TYPES)), ((chunk * 7 + F.when(i % 16 == 8, F.floor(k / 3)).otherwise(0)) % 12 + 1).cast("int")).alias("soc_type"),
        F.when(i % 7 == 0, "low").when((i + k) % 5 == 0, "medium").otherwise("high").alias("confidence"),
        F.concat(F.size("w").cast("string"), F.lit(" words: "), F.left(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), F.lit(8))).alias("explanation"),
        F.concat_ws(", ", "lang", F.size("w").cast("string"), F.try_element_at("w", F.lit(-1))).alias("evidence"),
    )


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\x0c\r]+')"
_TYPES = "[" + ", ".join(f"'{t}'" for t in SOC_TYPES) + "]"
_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
_ANN = rf"""ann AS (
  SELECT doc_id * 4 + k AS row_id, 'm' || ((doc_id + k) % 4) AS model_label, source AS source_file, 'c' || (doc_id // {PER_CHUNK}) AS chunk_id, '' AS chunk_label,
         CAST((doc_id // {PER_CHUNK}) % 5 AS INTEGER) AS chunk_index, array_to_string(w, ' ') || CASE WHEN k = 3 THEN ' indeed' ELSE '' END AS passage,
         {_TYPES}[((doc_id // {PER_CHUNK}) * 7 + CASE WHEN doc_id % 16 = 8 THEN k // 3 ELSE 0 END) % 12 + 1] AS soc_type,
         CASE WHEN doc_id % 7 = 0 THEN 'low' WHEN (doc_id + k) % 5 = 0 THEN 'medium' ELSE 'high' END AS confidence,
         len(w) || ' words: ' || left(md5(coalesce(text, '')), 8) AS explanation, concat_ws(', ', lang, len(w), w[-1]) AS evidence,
         CASE WHEN doc_id % 7 = 0 THEN 1 WHEN (doc_id + k) % 5 = 0 THEN 2 ELSE 3 END AS rank
  FROM (SELECT *, {_WORDS} AS w FROM documents), unnest(range(0, CASE WHEN doc_id % 8 = 0 THEN 4 ELSE 1 END)) AS u(k)),
tok AS (SELECT *, list_distinct(list_filter(string_split({_NORM.format("passage")}, ' '), lambda x: x <> '')) AS tokens FROM ann)"""
_CLUSTER = rf"""{_ANN},
ordered AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY row_id) AS k FROM tok),
scan AS (
  SELECT chunk_id, k, [{{'id': row_id, 'g': 0, 't': tokens}}] AS state, 0 AS top FROM ordered WHERE k = 1
  UNION ALL
  SELECT chunk_id, k, list_append(state, {{'id': row_id, 'g': g, 't': tokens}}), greatest(top, g) FROM (
    SELECT s.chunk_id, o.k, s.state, s.top, o.row_id, o.tokens,
           coalesce(list_min(list_transform(list_filter(s.state, lambda m: len(m.t) > 0 AND len(o.tokens) > 0 AND len(list_intersect(m.t, o.tokens)) / least(len(m.t), len(o.tokens)) >= 0.35), lambda m: m.g)), s.top + 1) AS g
    FROM scan s JOIN ordered o ON o.chunk_id = s.chunk_id AND o.k = s.k + 1)),
last AS (SELECT chunk_id, arg_max(state, k) AS state, max(top) + 1 AS n FROM scan GROUP BY chunk_id),
base AS (SELECT chunk_id, state, CAST(sum(n) OVER (ORDER BY chunk_id) - n AS BIGINT) AS before FROM last),
gid AS (SELECT u.m.id AS row_id, before + u.m.g AS group_id FROM base, unnest(state) AS u(m)),
clu AS (SELECT ann.*, CAST(group_id AS BIGINT) AS group_id FROM ann JOIN gid USING (row_id))"""


def clustered(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """All annotations in their groups, with all columns or with those that a query asks for."""
    return matching.grouped_annotations(annotations(spark, sf_dir), columns=columns)


#: What tables of groups need of a row beside its passage.
_OF_GROUPS = ["source_file", "model_label", "soc_type"]


# Text operators


@query(rf"SELECT doc_id, {_NORM.format('text')} AS norm, CAST(len(list_distinct(list_filter(string_split({_NORM.format('text')}, ' '), lambda x: x <> ''))) AS INTEGER) AS n_tokens FROM documents")
def normalised_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", text.normalised_words(F.col("text")).alias("w"))
    return words.select("doc_id", F.array_join("w", " ").alias("norm"), F.size(F.array_distinct("w")).alias("n_tokens"))


@query(r"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, s[1] AS first_sentence, s[len(s)] AS last_sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"), F.element_at("s", -1).alias("last_sentence"))


@query(rf"SELECT doc_id, CAST(i // 300 AS INTEGER) AS pos, array_to_string(w[i + 1:i + 300], ' ') AS passage FROM (SELECT doc_id, {_WORDS} AS w FROM documents) AS d, unnest(range(0, greatest(0, len(w) - 300), 300)) AS t(i)")
def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.window_texts(F.col("text"))).alias("pos", "passage"))


@query(rf"SELECT doc_id, CAST(len({_WORDS}) AS INTEGER) AS n_words, left(text, 80) || CASE WHEN length(text) > 80 THEN '…' ELSE '' END AS shown FROM documents WHERE len({_WORDS}) >= 1000")
def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(text.words(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_words"), text.preview(F.col("text"), 80).alias("shown")).where("n_words >= 1000")


@query(r"""SELECT doc_id, regexp_replace(CASE WHEN doc_id % 4 IN (0, 1) THEN text ELSE 'title ' || doc_id || chr(10) || text END || CASE WHEN doc_id % 4 IN (0, 2) THEN '' ELSE chr(10) || '** END OF THE PROJECT GUTENBERG EBOOK' END, '^\s+|\s+$', '', 'g') AS body
FROM documents""")
def boilerplate_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with both marker lines, in several spellings, with one of them, and with none or a broken one."""
    i = F.col("doc_id") % 4
    start = F.when(i == 0, "*** START OF THIS PROJECT GUTENBERG EBOOK X ***\n").when(i == 1, "***start of project gutenberg ebook y\n").otherwise("")
    end = F.when(i == 0, "\n***END OF THE PROJECT GUTENBERG EBOOK X\nend").when(i == 2, "\n***  End of this Project Gutenberg Ebook").otherwise("\n** END OF THE PROJECT GUTENBERG EBOOK")
    wrapped = F.concat(F.lit("title "), F.col("doc_id").cast("string"), F.lit("\n"), start, "text", end)
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_boilerplate(wrapped).alias("body"))


@query(r"""SELECT doc_id, printf('%s_%03d', lower(regexp_replace(regexp_replace(stem, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), doc_id) AS chunk_id,
       regexp_replace(regexp_replace(label, '[^\p{L}\p{N}_\-]', '_', 'g'), '^_+|_+$', '', 'g') AS safe,
       printf('pg%05d_%s.txt', doc_id, regexp_replace(regexp_replace(lower(label), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s-]+', '_', 'g')) AS book
FROM (SELECT doc_id, source || ' of ' || lang AS stem, source || ': ' || lang || '!' AS label FROM documents)""")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(" of "), "lang", F.lit(".txt")).alias("file"), F.concat("source", F.lit(": "), "lang", F.lit("!")).alias("label"))
    return d.select("doc_id", text.chunk_id(F.col("file"), F.col("doc_id")).alias("chunk_id"), text.safe_name(F.col("label")).alias("safe"), text.book_name(F.col("doc_id"), F.col("label")).alias("book"))


@query(r"""SELECT doc_id, md5(s) AS slug_md5, printf('%s_%03d', left(s, 40), doc_id) AS chunk_id
FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(coalesce(text, '')), '[^\x00-\x7F]+', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS s FROM documents)""")
def unicode_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of whole texts, accents folded, and the numbered ones of their first 40 characters."""
    s = table(spark, sf_dir, "documents").select("doc_id", text.slug(F.coalesce("text", F.lit(""))).alias("s"))
    return s.select("doc_id", F.md5(F.col("s").cast("binary")).alias("slug_md5"), F.format_string("%s_%03d", F.left("s", F.lit(40)), "doc_id").alias("chunk_id"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.format_string("conv %d.txt", "conv_id").alias("source_file"), F.col("turn").cast("int").alias("chunk_index"), F.col("role").alias("chunk_label"), F.col("text").alias("chunk_text"))


@query("""SELECT source_file, chunk_index, coalesce(right(lag(text) OVER w, 100), '') AS context_before, coalesce(left(lead(text) OVER w, 100), '') AS context_after
FROM (SELECT printf('conv %d.txt', conv_id) AS source_file, CAST(turn AS INTEGER) AS chunk_index, text FROM conversations) WINDOW w AS (PARTITION BY source_file ORDER BY chunk_index)""")
def neighbour_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_contexts(_turns(spark, sf_dir), 100).select("source_file", "chunk_index", "context_before", "context_after")


@query(r"""SELECT source_file, chunk_index, coalesce(lag(tail) OVER w, '') AS context_before, coalesce(lead(head) OVER w, '') AS context_after
FROM (SELECT printf('conv %d.txt', conv_id) AS source_file, CAST(turn AS INTEGER) AS chunk_index, regexp_extract(text, '^\s*(\S+(\s+\S+){0,6})', 1) AS head, regexp_extract(text, '(\S+(\s+\S+){0,6})\s*$', 1) AS tail FROM conversations)
WINDOW w AS (PARTITION BY source_file ORDER BY chunk_index)""")
def token_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of turns by seven tokens, which are words here."""
    return chunking.token_contexts(_turns(spark, sf_dir), 7).select("source_file", "chunk_index", "context_before", "context_after")


@query(r"""SELECT source_file, CAST(row_number() OVER (PARTITION BY source_file ORDER BY turn) - 1 AS INTEGER) AS chunk_index, role AS chunk_label, body AS chunk_text
FROM (SELECT printf('conv %d.txt', conv_id) AS source_file, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM conversations) WHERE body <> ''""")
def markup_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as chunk markup and read again."""
    return chunking.from_markup(chunking.to_markup(_turns(spark, sf_dir))).select("source_file", "chunk_index", "chunk_label", "chunk_text")


@query()
def structural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a heading before every line, split at headings."""
    d = table(spark, sf_dir, "documents").select(F.format_string("doc %d.txt", "doc_id").alias("source_file"), F.concat(F.lit("CHAPTER I\n"), F.replace("text", F.lit("\n"), F.lit("\nChapter 2\n"))).alias("text"))
    return chunking.chunk_documents(d, 2000, 200)


@query(r"""WITH RECURSIVE d AS (
  SELECT printf('doc %d.txt', doc_id) AS source_file, string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, list_transform(s, lambda x: length(x)) AS n FROM d),
t AS (SELECT *, list_transform(range(0, len(n) + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE list_sum(n[1:i]) END) AS up FROM l),
-- k: last sentence taken; a: the open chunk's first; used: its length as counted; b: first sentence of a chunk that was closed before k
walk AS (
  SELECT source_file, 1 AS k, 1 AS a, CAST(n[1] AS BIGINT) AS used, CAST(NULL AS BIGINT) AS b FROM t
  UNION ALL
  SELECT w.source_file, w.k + 1, CASE WHEN full_up THEN first ELSE w.a END,
         CASE WHEN full_up THEN CASE WHEN first > w.k THEN 0 ELSE up[w.k + 1] - up[first] + w.k - first END ELSE used END + t.n[w.k + 1], CASE WHEN full_up THEN w.a END
  FROM (SELECT *, used + (SELECT n[x.k + 1] FROM t WHERE t.source_file = x.source_file) > 1000 AS full_up FROM walk x) w JOIN t USING (source_file),
       LATERAL (SELECT w.k + 1 - len(list_filter(range(w.a, w.k + 1), lambda j: up[w.k + 1] - up[j] + greatest(0, w.k - j - 1) <= 100)) AS first)
  WHERE w.k < len(t.s)),
done AS (
  SELECT source_file, b AS a, k - 1 AS e FROM walk WHERE b IS NOT NULL
  UNION ALL SELECT source_file, a, k FROM walk JOIN t USING (source_file) WHERE k = len(s)),
c AS (SELECT source_file, array_to_string(s[a:e], ' ') AS chunk_text, CAST(row_number() OVER (PARTITION BY source_file ORDER BY e) - 1 AS INTEGER) AS chunk_index FROM done JOIN t USING (source_file))
SELECT source_file, printf('%s_%03d', replace(replace(source_file, '.txt', ''), ' ', '-'), chunk_index) AS chunk_id, 'Chunk ' || (chunk_index + 1) AS chunk_label, chunk_text, chunk_index FROM c""")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.format_string("doc %d.txt", "doc_id").alias("source_file"), "text")
    return chunking.chunk_documents(d, 1000, 100, chunking.split_sentences).drop("context_before", "context_after")


@query("SELECT 'c' || conv_id || '_' || turn AS chunk_id, role AS chunk_label, CAST(length(text) AS INTEGER) AS n_chars, CAST(4 AS INTEGER) AS n_calls FROM conversations")
def chunk_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("chunk_id"), F.col("role").alias("chunk_label"), F.col("text").alias("chunk_text"))
    return chunking.chunk_listing(c, len(MODELS))


@query()
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of 100 words, cut at paragraphs, lines and sentences where that is possible."""
    d = table(spark, sf_dir, "documents").select(F.format_string("doc %d.txt", "doc_id").alias("source_file"), "text")
    return chunking.token_chunks(d, "recursive", 100, 50)


_SEMANTIC = r"""split AS (SELECT printf('doc %d.txt', doc_id) AS source_file, string_split(regexp_replace(text, '([.!?])(\s+[A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents WHERE text <> ''),
s AS (SELECT source_file, i, s[i] AS s, len(s) AS last FROM split, unnest(range(1, len(s) + 1)) AS u(i)),
terms AS (SELECT source_file, i, ('0x' || left(md5(t), 8))::BIGINT % 262144 AS p, count(*) AS tf FROM (SELECT source_file, i, unnest(regexp_extract_all(lower(s), '[\p{L}\p{N}]+')) AS t FROM s) GROUP BY ALL),
weights AS (SELECT p, CAST(floor(1000 * ln((1 + (SELECT count(*) FROM s)) / (1 + count(*)))) AS BIGINT) AS w FROM terms GROUP BY p),
v AS (SELECT source_file, i, p, tf * w AS v FROM terms JOIN weights USING (p) WHERE w <> 0),
norm AS (SELECT source_file, i, sqrt(CAST(sum(v * v) AS DOUBLE)) AS n FROM v GROUP BY ALL),
dot AS (SELECT a.source_file, a.i, sum(a.v * b.v) AS d FROM v a JOIN v b ON a.source_file = b.source_file AND a.i + 1 = b.i AND a.p = b.p GROUP BY ALL),
dist AS (SELECT s.source_file, s.i, CASE WHEN a.n > 0 AND b.n > 0 THEN greatest(0.0, 1.0::DOUBLE - coalesce(CAST(d AS DOUBLE), 0.0) / (a.n * b.n)) ELSE 1.0 END AS distance FROM s LEFT JOIN norm a ON a.source_file = s.source_file AND a.i = s.i
         LEFT JOIN norm b ON b.source_file = s.source_file AND b.i = s.i + 1 LEFT JOIN dot ON dot.source_file = s.source_file AND dot.i = s.i WHERE s.i < last),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY distance) AS k, count(*) OVER (PARTITION BY source_file) AS n FROM dist),
cut AS (SELECT source_file, distance AS floor_at FROM ranked WHERE k = greatest(1, ceil(95.0::DOUBLE / 100 * n))),
brk AS (SELECT source_file, i, distance, distance >= floor_at AND distance > 0 AS is_break FROM dist JOIN cut USING (source_file))"""


@query(f"WITH {_SEMANTIC} SELECT source_file, CAST(i - 1 AS INTEGER) AS position, round(distance, 9) AS distance, is_break FROM brk")
def semantic_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between neighbouring sentences of whole texts, and where they reach their text's 95th percentile."""
    d = table(spark, sf_dir, "documents").select(F.format_string("doc %d.txt", "doc_id").alias("source_file"), "text")
    return semantic.sentence_breaks(d).withColumn("distance", F.round("distance", 9))


@query(rf"""WITH RECURSIVE {_SEMANTIC},
z AS (SELECT s.source_file, s.i, s.s, len(regexp_extract_all(s.s, '[^ \t\n\x0b\x0c\r]+')) AS n, coalesce(is_break, FALSE) AS cut_before FROM s LEFT JOIN brk ON brk.source_file = s.source_file AND brk.i + 1 = s.i),
walk AS (SELECT source_file, i, 0 AS chunk, n AS used FROM z WHERE i = 1
  UNION ALL
  SELECT w.source_file, z.i, chunk + CASE WHEN used + z.n > 200 OR (cut_before AND used >= 50) THEN 1 ELSE 0 END, CASE WHEN used + z.n > 200 OR (cut_before AND used >= 50) THEN 0 ELSE used END + z.n
  FROM walk w JOIN z ON z.source_file = w.source_file AND z.i = w.i + 1)
SELECT source_file, printf('%s_%03d', replace(source_file, '.txt', ''), chunk) AS chunk_id, 'Chunk ' || (chunk + 1) AS chunk_label, string_agg(s, '' ORDER BY i) AS chunk_text, chunk AS chunk_index FROM walk JOIN z USING (source_file, i) GROUP BY source_file, chunk""")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in chunks of 200 words at most, cut where the subject changes."""
    d = table(spark, sf_dir, "documents").select(F.format_string("doc %d.txt", "doc_id").alias("source_file"), "text")
    return semantic.semantic_chunks(d, 200, 0).drop("context_before", "context_after")


# Matching and consensus


@query(rf"WITH {_ANN}, f AS (SELECT chunk_id AS k, row_id, len(tokens) AS n, unnest(tokens) AS t FROM tok) SELECT a.row_id AS a, b.row_id AS b, count(*) / least(a.n, b.n) AS overlap FROM f a JOIN f b ON a.k = b.k AND a.t = b.t AND a.row_id < b.row_id GROUP BY a.row_id, b.row_id, a.n, b.n HAVING count(*) / least(a.n, b.n) >= 0.35")
def overlapping_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.overlapping_pairs(annotations(spark, sf_dir), "chunk_id")


@query(rf"WITH RECURSIVE {_CLUSTER} SELECT row_id, chunk_id, group_id FROM clu")
def passage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir, []).select("row_id", "chunk_id", "group_id")


_GROUPS = f"""{_CLUSTER}, grp AS (
  SELECT group_id, chunk_id, min(source_file) AS source_file, list(DISTINCT model_label ORDER BY model_label) AS models, count(DISTINCT model_label) AS n_models,
         arg_max(passage, (length(passage), -row_id)) AS representative,
         CASE WHEN count(DISTINCT model_label) = 1 THEN 'single' WHEN count(DISTINCT soc_type) = 1 THEN 'full' ELSE 'partial' END AS agreement
  FROM clu GROUP BY group_id, chunk_id)"""


@query(f"WITH RECURSIVE {_GROUPS} SELECT group_id, chunk_id, source_file, array_to_string(models, ', ') AS models, CAST(n_models AS INTEGER) AS n_models, representative, agreement FROM grp")
def group_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.groups_table(clustered(spark, sf_dir)).withColumn("models", F.array_join(F.array_sort("models"), ", "))


@query(f"WITH RECURSIVE {_GROUPS} SELECT chunk_id, CAST(group_id - min(group_id) OVER (PARTITION BY chunk_id) AS INTEGER) AS chunk_group, source_file, array_to_string(models, ', ') AS models, representative, CAST(n_models AS INTEGER) AS n_models, agreement FROM grp")
def streamed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that a stream over the documents' files keeps as state, as its last batch leaves them."""
    docs = table(spark, sf_dir, "documents")
    rows = annotations(spark, sf_dir, spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*"))
    path = scratch(spark, "stream")
    groups.run_groups(rows, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return groups.read_groups(spark, f"{path}/out").withColumn("models", F.array_join(F.array_sort("models"), ", "))


@query(f"WITH RECURSIVE {_GROUPS} SELECT count(*) AS n_groups, count(*) FILTER (WHERE n_models > 1) AS n_multi, count(*) FILTER (WHERE agreement = 'full') AS n_full, count(*) FILTER (WHERE agreement = 'partial') AS n_partial FROM grp")
def group_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.group_figures(matching.groups_table(clustered(spark, sf_dir, _OF_GROUPS)))


@query(f"WITH RECURSIVE {_GROUPS} SELECT group_id, CAST(n_models AS INTEGER) AS n_models FROM grp WHERE n_models >= 2 AND (list_contains(models, 'm0') OR list_contains(models, 'm2')) AND source_file IN (SELECT source_file FROM ann WHERE confidence = 'high')")
def visible_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = annotations(spark, sf_dir).where("confidence = 'high'")
    return reports.visible_groups(matching.groups_table(clustered(spark, sf_dir, _OF_GROUPS)), 2, ["m0", "m2"], view).select("group_id", "n_models")


@query(f"WITH RECURSIVE {_GROUPS} SELECT group_id, CAST(n_models AS INTEGER) AS n_models, row_number() OVER (ORDER BY n_models DESC, chunk_id, group_id) - 1 AS place FROM grp")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sorted_groups(matching.groups_table(clustered(spark, sf_dir, _OF_GROUPS))).select("group_id", "n_models", F.col("place").cast("long").alias("place"))


@query(f"WITH RECURSIVE {_GROUPS} SELECT group_id, chunk_id FROM grp WHERE agreement = 'partial'")
def partial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.agreeing_groups(matching.groups_table(clustered(spark, sf_dir, _OF_GROUPS)), "partial").select("group_id", "chunk_id")


def _track_sql(t: consensus.Track) -> str:
    floor = {"high": 3, "medium": 2, "low": 1}[t.min_confidence]
    order = {
        "majority": "votes DESC, mean DESC, first, rank DESC, length(passage) DESC, row_id",
        "longest": "length(passage) DESC, row_id",
        "all": "row_id",
    }[t.resolve_type]
    one = "" if t.resolve_type == "all" else "WHERE k = 1"
    full = "AND types = 1" if t.agreement == "full" else ""
    return f"""WITH RECURSIVE {_CLUSTER}, q AS (SELECT * FROM clu WHERE rank >= {floor}),
st AS (SELECT group_id, count(DISTINCT model_label) AS n_models, string_agg(DISTINCT model_label, ', ' ORDER BY model_label) AS models_agreed, count(DISTINCT soc_type) AS types FROM q GROUP BY group_id),
v AS (SELECT q.*, CAST(n_models AS INTEGER) AS n_models, models_agreed, CASE WHEN types = 1 THEN 'full' ELSE 'partial' END AS agreement,
             count(*) OVER t AS votes, avg(rank) OVER t AS mean, min(row_id) OVER t AS first
      FROM q JOIN st USING (group_id) WHERE n_models >= {t.min_models} {full} WINDOW t AS (PARTITION BY group_id, soc_type)),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {order}) AS k FROM v)
SELECT group_id, row_id, source_file, chunk_id, chunk_label, chunk_index, passage, soc_type, explanation, evidence, confidence, n_models, models_agreed, agreement FROM o {one}"""


def _add_track(t: consensus.Track) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return consensus.apply_track(clustered(spark, sf_dir), t)

    run.__name__ = f"consensus_{t.name}"
    query(_track_sql(t))(run)


for _track in (*consensus.TRACKS, consensus.Track("longest", min_models=1, min_confidence="low", resolve_type="longest")):
    _add_track(_track)


@query(f"WITH o AS ({_SQL['consensus_moderate'].replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}) SELECT count(*) AS n, count(*) FILTER (WHERE agreement = 'full') AS n_full, count(*) FILTER (WHERE agreement = 'partial') AS n_partial FROM o")
def consensus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.consensus_summary(consensus.apply_track(clustered(spark, sf_dir), consensus.TRACKS[1]))


# Training data

_RECORDS = f"""{_CLUSTER},
v AS (SELECT *, count(*) OVER t AS votes, avg(rank) OVER t AS mean, min(row_id) OVER t AS first FROM clu WINDOW t AS (PARTITION BY group_id, soc_type)),
tp AS (SELECT group_id, arg_max(soc_type, (votes, mean, -first)) AS top FROM v GROUP BY group_id),
ex AS (SELECT group_id, array_to_string(list(explanation ORDER BY f)[1:2], ' ') AS told FROM (
         SELECT clu.group_id, explanation, min(row_id) AS f FROM clu JOIN tp USING (group_id) WHERE soc_type = top AND explanation <> '' GROUP BY clu.group_id, explanation) GROUP BY group_id),
g AS (SELECT group_id, count(DISTINCT model_label) AS n_models, arg_max(passage, (length(passage), -row_id)) AS passage,
             arg_max({{'s': source_file, 'c': chunk_id, 'f': confidence, 'e': evidence, 'x': explanation}}, (rank, length(passage), -row_id)) AS b FROM clu GROUP BY group_id),
cnt AS (SELECT soc_type AS top, count(*) AS rows_of FROM clu GROUP BY soc_type),
rec AS (SELECT group_id, b.s AS source_file, b.c AS chunk_id, passage, n_models >= 3 AS is_soc, n_models < 3 AS hard_negative,
               CASE WHEN top IN ('soliloquy', 'space_montage') OR rows_of < 5 THEN 'other_soc' ELSE top END AS soc_type, b.f AS confidence, b.e AS evidence,
               coalesce(nullif(told, ''), b.x, '') AS explanation
        FROM g JOIN tp USING (group_id) JOIN cnt USING (top) LEFT JOIN ex USING (group_id) WHERE n_models >= 3 OR n_models = 1)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.group_records(clustered(spark, sf_dir), min_models=3, rare_below=5)


@query(f"WITH RECURSIVE {_RECORDS} SELECT * FROM rec")
def dataset_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir)


@query(f"WITH RECURSIVE {_RECORDS} SELECT is_soc, hard_negative, soc_type, count(*) AS n FROM rec GROUP BY ALL")
def dataset_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("is_soc", "hard_negative", "soc_type").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_RECORDS} SELECT soc_type, count(*) AS n FROM rec WHERE is_soc GROUP BY 1")
def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the positive records, read back from their answers."""
    return dataset.type_distribution(dataset.training_records(records(spark, sf_dir).withColumns({c: F.lit("") for c in ("secondary_devices", "affective_register", "narrator_position", "character_pov", "notes")})))


@query(f"WITH RECURSIVE {_RECORDS} SELECT count(*) FILTER (WHERE is_soc) AS n_positive, count(*) FILTER (WHERE hard_negative) AS n_hard, count(*) FILTER (WHERE NOT is_soc AND NOT hard_negative) AS n_clean FROM rec")
def record_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.record_figures(records(spark, sf_dir))


@query(r"""SELECT conv_id, CAST(least(2, n) AS INTEGER) AS n_prompt, coalesce(u, '') AS passage, a IS NOT NULL AND conv_id % 2 = 0 AS is_soc, CASE WHEN a IS NOT NULL AND conv_id % 2 = 0 THEN 'imagery' ELSE '' END AS soc_type,
       coalesce(regexp_extract(a, '(?s)^\s*(.*?)\s*$', 1), '') AS think_content, CASE WHEN a IS NULL THEN '' WHEN conv_id % 2 = 0 THEN '{"instances": [{"soc_type": "imagery"}]}' ELSE '{"instances": []}' END AS assistant_json
FROM (SELECT conv_id, count(*) AS n, arg_min(text, turn) FILTER (WHERE role = 'user') AS u, arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)""")
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats whose answers hold the texts as think blocks and an instance or none, as raw records."""
    body = F.when(F.col("conv_id") % 2 == 0, '{"instances": [{"soc_type": "imagery"}]}').otherwise('{"instances": []}')
    content = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>"), "text", F.lit("</think>\n"), body)).otherwise(F.col("text"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", content.alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    return dataset.from_chat(chats.withColumn("n_prompt", F.size(dataset.prompt_messages(F.col("messages")))))


_THOUGHTS = r"""chats AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' THEN '<think>' || text || '</think>' || chr(10) || '{"instances": []}' ELSE text END || '<|im_end|>' || chr(10), '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)"""


def thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats whose answers hold the texts as think blocks, as messages in the order of turns."""
    content = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>"), "text", F.lit('</think>\n{"instances": []}'))).otherwise(F.col("text"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", content.alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))


@query(f"WITH {_THOUGHTS} SELECT conv_id, t AS chat_text FROM chats")
def chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thoughts(spark, sf_dir).select("conv_id", chat.ChatTemplate().text(F.col("messages")).alias("chat_text"))


_MARKED = r"<\|im_start\|>|<\|im_end\|>|</?think>|[^\s<]+|<"
_WORD_ID = "('0x' || left(md5({}), 7))::INTEGER"


@query(rf"""WITH {_THOUGHTS}, w AS (SELECT conv_id, list_transform(regexp_extract_all(t, '{_MARKED}')[1:300], lambda x: {_WORD_ID.format("x")}) AS ids FROM chats),
m AS (SELECT conv_id, ids, coalesce(list_max(list_filter(range(1, len(ids) + 1), lambda i: ids[i] = {_WORD_ID.format("'</think>'")})), 0) AS last FROM w),
l AS (SELECT *, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i <= last THEN -100 ELSE ids[i] END) AS labels FROM m)
SELECT conv_id, CAST(len(ids) AS INTEGER) AS n_tokens, CAST(last AS INTEGER) AS n_ignored, md5(array_to_string(ids, ' ')) AS ids_md5, md5(array_to_string(labels, ' ')) AS labels_md5 FROM l""")
def chat_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of chats whose tokens are words and marks, 300 at most, numbered by their digests."""
    body = F.slice(F.regexp_extract_all(chat.ChatTemplate().text(F.col("messages")), F.lit(_MARKED), F.lit(0)), 1, 300)
    number = lambda t: F.conv(F.left(F.md5(t.cast("binary")), F.lit(7)), 16, 10).cast("int")
    end = int(md5(b"</think>").hexdigest()[:7], 16)
    ids = thoughts(spark, sf_dir).select("conv_id", F.transform(body, number).alias("ids"))
    out = ids.withColumn("labels", chat.think_labels(F.col("ids"), [end]))
    return out.select("conv_id", F.size("ids").alias("n_tokens"), F.size(F.filter("labels", lambda x: x == chat.IGNORED)).alias("n_ignored"), F.md5(F.array_join("ids", " ").cast("binary")).alias("ids_md5"), F.md5(F.array_join("labels", " ").cast("binary")).alias("labels_md5"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoder = chat.file_encoder(public_tokenizers.path("byte_bpe_50k.json"), chat.ChatTemplate().marks)
    return chat.training_tokens(thoughts(spark, sf_dir), encoder, 1024)


@query()
def chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and labels of chats by a public tokenizer with the template's marks added, 1024 at most."""
    ignored = F.size(F.filter("labels", lambda x: x == chat.IGNORED))
    return _tokens(spark, sf_dir).select("conv_id", F.size("input_ids").alias("n_tokens"), ignored.alias("n_ignored"), *(F.crc32(F.array_join(c, " ").cast("binary")).alias(n) for c, n in (("input_ids", "ids_crc32"), ("labels", "labels_crc32"))))


@query()
def chat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chats in batches of 16, padded to each batch's longest."""
    ignored = F.size(F.filter("labels", lambda x: x == chat.IGNORED))
    got = chat.padded_batches(_tokens(spark, sf_dir), "conv_id", 16, 50256)
    return got.select("conv_id", "batch", F.size("input_ids").alias("length"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"), ignored.alias("n_ignored"), F.crc32(F.array_join("input_ids", " ").cast("binary")).alias("ids_crc32"))


@query("SELECT doc_id, 'test_' || replace(coalesce(source, 'unk'), '/', '_') || '_' || left(md5(coalesce(text, '')), 10) AS passage_id FROM documents")
def passage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", traces.passage_id("test", F.col("source"), F.col("text")).alias("passage_id"))


@query("SELECT doc_id AS row_id, toxic = 0 AS is_soc FROM labels ORDER BY is_soc, row_id LIMIT 50")
def negatives_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 records, negatives before positives: the limit is the operator's."""
    return traces.negatives_first(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), (F.col("toxic") == 0).alias("is_soc")), 50)


@query()
def sampled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows at most of each document; the sample is the operator's."""
    return dataset.window_negatives(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_file"), "text"), 3)


@query(r"""SELECT conv_id, u AS passage, regexp_extract(t, '(?s)^\s*(.*?)\s*$', 1) AS think FROM (
  SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS u, coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS t FROM conversations GROUP BY conv_id)""")
def chat_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First user message and think block of chats, whose first answers are put into think blocks."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.when(F.col("role") == "assistant", F.concat(F.lit("<think>"), "text", F.lit("</think>{}"))).otherwise(F.col("text")).alias("content"))))
    chats = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("messages"))
    return chats.select("conv_id", dataset.role_text(F.col("messages"), "user").alias("passage"), F.coalesce(text.think_block(dataset.role_text(F.col("messages"), "assistant")), F.lit("")).alias("think"))


@query(f"WITH {_ANN}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY row_id) AS k FROM ann WHERE chunk_id NOT IN (SELECT 'c' || (doc_id // {PER_CHUNK}) FROM labels WHERE toxic = 1)) SELECT chunk_id, row_id, passage FROM r WHERE k = 1 AND passage <> ''")
def clean_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    positives = table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("c"), F.floor(F.col("doc_id") / PER_CHUNK).cast("string")).alias("chunk_id"))
    return dataset.clean_negatives(annotations(spark, sf_dir), positives).select("chunk_id", "row_id", "passage")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT chunk_id, model_label FROM (SELECT DISTINCT 'c' || (doc_id // 16) AS chunk_id FROM documents), (VALUES ('m0'), ('m1'), ('m2'), ('m3')) AS m(model_label) EXCEPT SELECT 'c' || (doc_id // 16), 'm' || (doc_id % 4) FROM labels")
def annotation_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with every model, without what is done."""
    from scriptorium.operators.annotate import pending, work_list

    done = table(spark, sf_dir, "labels").select(F.concat(F.lit("c"), F.floor(F.col("doc_id") / PER_CHUNK).cast("string")).alias("chunk_id"), F.concat(F.lit("m"), (F.col("doc_id") % 4).cast("string")).alias("model_label"))
    work = work_list(annotations(spark, sf_dir).select("chunk_id").distinct(), MODELS)
    return pending(work, done).select("chunk_id", "model_label")


_KEY = "doc_id * 2654435761 % 1000003"


@query(f"""SELECT doc_id, is_soc, CASE WHEN k <= greatest(1, floor(n * 0.1)) THEN 'test' WHEN k <= 2 * greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, toxic = 1 AS is_soc, row_number() OVER (PARTITION BY toxic ORDER BY {_KEY}) AS k, count(*) OVER (PARTITION BY toxic) AS n FROM labels)""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_soc"))
    return dataset.split(rows, F.expr(_KEY)).select("doc_id", "is_soc", "split")


# Reports


@query(f"WITH {_ANN} SELECT model_label, count(*) AS n FROM ann GROUP BY 1")
def rows_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_model(annotations(spark, sf_dir))


_PIVOT = ", ".join(f"count(*) FILTER (WHERE model_label = '{m}') AS {m}" for m in MODELS)


@query(f"WITH {_ANN} SELECT soc_type, {_PIVOT} FROM ann GROUP BY 1")
def types_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pivot_counts(annotations(spark, sf_dir), "soc_type", MODELS)


@query(f"WITH {_ANN} SELECT chunk_id, {_PIVOT} FROM ann GROUP BY 1")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pivot_counts(annotations(spark, sf_dir), "chunk_id", MODELS)


@query(f"WITH {_ANN} SELECT l.confidence, {_PIVOT} FROM (VALUES ('high'), ('medium'), ('low')) AS l(confidence) LEFT JOIN ann ON ann.confidence = l.confidence GROUP BY 1")
def confidence_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confidence_by_model(annotations(spark, sf_dir), MODELS)


@query(f"WITH {_ANN} SELECT count(*) AS n_rows, count(DISTINCT model_label) AS n_models, count(DISTINCT source_file) AS n_files, count(DISTINCT chunk_id) AS n_chunks FROM ann")
def key_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.key_figures(annotations(spark, sf_dir))


@query(f"WITH {_ANN} SELECT source_file, count(*) AS n FROM ann GROUP BY 1")
def rows_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_file(annotations(spark, sf_dir))


@query(f"WITH {_ANN} SELECT row_id FROM ann WHERE source_file IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') AND model_label IN ('m0', 'm2') AND chunk_id = 'c1'")
def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chosen_rows(annotations(spark, sf_dir), [f"src{k}" for k in range(8)], ["m0", "m2"], "c1").select("row_id")


@query(f"WITH {_ANN} SELECT DISTINCT chunk_id FROM ann")
def chunk_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.menu(annotations(spark, sf_dir), "chunk_id")


@query("WITH c AS (SELECT DISTINCT 'c' || (doc_id // 16) AS chunk_id FROM documents), d AS (SELECT DISTINCT 'c' || (doc_id // 16) AS chunk_id, 'm' || (doc_id % 4) AS model_label FROM labels) SELECT m.model_label, (SELECT count(*) FROM c) - count(d.chunk_id) AS n_pending, count(d.chunk_id) AS n_done FROM (VALUES ('m0'), ('m1'), ('m2'), ('m3')) AS m(model_label) LEFT JOIN (SELECT d.* FROM d JOIN c USING (chunk_id)) AS d ON d.model_label = m.model_label GROUP BY 1")
def work_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select(F.concat(F.lit("c"), F.floor(F.col("doc_id") / PER_CHUNK).cast("string")).alias("chunk_id"), F.concat(F.lit("m"), (F.col("doc_id") % 4).cast("string")).alias("model_label"))
    return reports.work_figures(annotations(spark, sf_dir).select("chunk_id"), done, MODELS)


@query(f"WITH {_ANN} SELECT model_label, 'type' AS kind, soc_type AS value, count(*) AS n FROM ann GROUP BY ALL UNION ALL SELECT model_label, 'confidence', confidence, count(*) FROM ann GROUP BY ALL")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.export_summary(annotations(spark, sf_dir))


@query(f"WITH {_ANN} SELECT model_label, count(*) AS total, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'medium') AS medium, count(*) FILTER (WHERE confidence = 'low') AS low FROM ann GROUP BY 1")
def confidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confidence_table(annotations(spark, sf_dir))


@query("WITH RECURSIVE " + _CLUSTER + ", f AS (SELECT *, row_number() OVER (PARTITION BY group_id, model_label ORDER BY row_id) AS k FROM clu), l AS (SELECT group_id, model_label, 'soc_type' AS field, soc_type AS value FROM f WHERE k = 1 UNION ALL SELECT group_id, model_label, 'explanation', coalesce(nullif(explanation, ''), '—') FROM f WHERE k = 1) SELECT group_id, field, " + ", ".join(f"max(value) FILTER (WHERE model_label = '{m}') AS {m}" for m in MODELS) + " FROM l GROUP BY group_id, field")
def field_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.field_table(clustered(spark, sf_dir, ["model_label", "soc_type", "explanation"]), ["soc_type", "explanation"], MODELS)


_SHOWN = "CASE soc_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_LABELS.items()) + " ELSE soc_type END"


@query(f"WITH RECURSIVE {_CLUSTER}, f AS (SELECT *, row_number() OVER (PARTITION BY group_id, model_label ORDER BY row_id) - 1 AS k FROM clu) SELECT group_id, model_label, CAST(k AS INTEGER) AS place, {_SHOWN} AS soc_type, confidence, left(passage, 100) AS shown FROM f WHERE k > 0")
def further_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's rows of a group after its first."""
    return reports.further_rows(clustered(spark, sf_dir), MODELS)


_PAIRS = "p AS (SELECT CASE WHEN quality = 1 THEN 'soc' ELSE 'none' END AS y_true, CASE WHEN n_chars > 1000 THEN 'soc' ELSE 'none' END AS y_pred FROM labels JOIN documents USING (doc_id))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.when(F.col("quality") == 1, "soc").otherwise("none").alias("y_true"), F.when(F.col("n_chars") > 1000, "soc").otherwise("none").alias("y_pred"))


@query(f"WITH {_PAIRS}, l AS (SELECT y_true AS y FROM p UNION SELECT y_pred FROM p) SELECT a.y AS y_true, b.y AS y_pred, count(p.y_true) AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.y_true = a.y AND p.y_pred = b.y GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_pairs(spark, sf_dir))


_METRICS = f"""{_PAIRS}, l AS (SELECT y_true AS label FROM p UNION SELECT y_pred FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE y_true = label) AS support, (SELECT count(*) FROM p WHERE y_pred = label) AS predicted, (SELECT count(*) FROM p WHERE y_true = label AND y_pred = label) AS tp FROM l),
m AS (SELECT label, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall, support FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m)"""


@query(f"WITH {_METRICS} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM f")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_metrics(_pairs(spark, sf_dir)).select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), F.col("support").cast("long").alias("support"))


@query(f"WITH {_METRICS} SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FROM p), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM f")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_pairs(spark, sf_dir)).select("n", *(F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")))


@query(f"""WITH {_METRICS} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM f""")
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.report(_pairs(spark, sf_dir)).select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), F.col("support").cast("long").alias("support"))


@query("""WITH p AS (SELECT CASE WHEN quality = 1 THEN 'soc' ELSE 'none' END AS y_true, CASE WHEN length(coalesce(text, '')) > 1000 THEN 'soc' ELSE 'none' END AS y_pred FROM labels JOIN documents USING (doc_id))
SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY 1, 2""")
def resumed_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a model of one rule over all labelled documents, answered in two runs of which the second takes up the first, counted from what is stored."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", F.col("text").alias("passage"), (F.col("quality") == 1).alias("is_soc"), F.lit('{"instances": []}').alias("assistant_json"))
    path = scratch(spark, "outputs")

    def model() -> inference.Model:
        return lambda prompts, sampling: ['{"instances": [{"soc_type": "imagery"}]}' if len(p) > 1000 else "none" for p in prompts]

    for part in (rows.where("is_soc"), rows):
        inference.answer_examples(part, "doc_id", "passage", path, "rule", model, 4)
    return evaluation.detection(inference.stored_pairs(rows, "doc_id", path)).groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(text, '') AS passage, quality = 1 AS true_is_soc, n_chars > 1000 AS pred_is_soc, CASE WHEN quality <> 1 THEN 'none' WHEN doc_id % 3 = 0 THEN 'other_soc' ELSE 'hybrid' END AS true_type,
       CASE WHEN n_chars > 1000 THEN 'imagery' ELSE 'none' END AS pred_type, left(coalesce(text, ''), 500) AS raw_output
FROM labels JOIN documents USING (doc_id)""")
def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of whole texts with an instance behind those of over 1000 characters."""
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").withColumn("body", F.translate(F.coalesce("text", F.lit("")), "{}", "()"))
    told = F.when(F.col("doc_id") % 3 == 0, "no json").otherwise('{"instances": [{"soc_type": "hybrid"}]}')
    rows = d.select("text", F.col("text").alias("passage"), (F.col("quality") == 1).alias("is_soc"), told.alias("assistant_json"), F.concat("body", F.when(F.col("n_chars") > 1000, '<think>{"instances": 1}</think> {"instances": [{"soc_type": "imagery"}]} end').otherwise("{broken}")).alias("raw_output"))
    return evaluation.answer_pairs(rows).withColumn("raw_output", F.left("passage", F.lit(500)))


@query(f"WITH {_METRICS} SELECT (SELECT count(*) FROM p) AS n, round((SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FROM p), 9) AS observed, round((SELECT sum(support * predicted) FROM c) / ((SELECT count(*) FROM p) * (SELECT count(*) FROM p)), 9) AS expected")
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.kappa(_pairs(spark, sf_dir)).select("n", F.round("observed", 9).alias("observed"), F.round("expected", 9).alias("expected"))


# Scores and parsing


_HITS = lambda words: " + ".join("CAST(contains(lower(trace), '{}') AS INTEGER)".format(w.replace("'", "''")) for w in words)
_TRACE = r"""d AS (SELECT doc_id, text AS passage, doc_id % 2 = 0 AS is_soc, 'It could appear ' || source || ' ' || [""" + ", ".join(f"'{t}'" for t in SOC_TYPES) + r"""][doc_id % 12 + 1] || ' but falls short: "' || array_to_string(w, ' ') || '"' AS trace FROM (SELECT *, """ + _WORDS + r""" AS w FROM documents))"""


@query(f"""WITH {_TRACE}, s AS (SELECT doc_id, is_soc, {_HITS(scoring.SPECIFIC_WORDS)} AS n, {_HITS(scoring.SCEPTICAL_PHRASES)} AS k FROM d)
SELECT doc_id, CASE WHEN n >= 2 THEN 1.0 WHEN n = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS specificity, least(1.0, k * CASE WHEN is_soc THEN 0.4 ELSE 0.5 END)::DOUBLE AS skepticism FROM s""")
def trace_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _traces(spark, sf_dir)
    return t.select("doc_id", scoring.specificity(F.col("trace")).alias("specificity"), scoring.skepticism(F.col("trace"), F.col("is_soc")).alias("skepticism"))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, SOC_TYPES)), (F.col("doc_id") % 12 + 1).cast("int"))
    words = text.words(F.col("text"))
    quote = F.array_join(words, " ")
    trace = F.concat(F.lit("It could appear "), "source", F.lit(" "), kind, F.lit(' but falls short: "'), quote, F.lit('"'))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("passage"), (F.col("doc_id") % 2 == 0).alias("is_soc"), trace.alias("trace"))


_QUOTES = """["‘’“”]([^"'']+)["‘’“”]"""
# of rows with trace, low (the passage in lower case), is_soc: g, n specific words, h sceptical phrases
_SCORED = rf"""g AS (SELECT *, {_HITS(scoring.SPECIFIC_WORDS)} AS n, {_HITS(scoring.SCEPTICAL_PHRASES)} AS h, regexp_extract_all(trace, '[^ \t\n\x0b\f\r]+') AS w,
  len(list_filter(regexp_extract_all(trace, '{_QUOTES}', 1), lambda q: len(regexp_extract_all(q, '[^ \t\n\x0b\f\r]+')) >= 3 AND contains(low, trim(lower(q), ' ')))) AS quoted FROM t),
v AS (SELECT *, CASE WHEN quoted > 0 THEN 1.0 WHEN len(list_filter(range(1, greatest(1, len(w) - 2)), lambda i: contains(low, regexp_replace(lower(array_to_string(w[i:i + 3], ' ')), '[^\p{{L}}\p{{N}}_\s]', '', 'g')))) > 0 THEN 0.5 ELSE 0.0 END AS g,
  CASE WHEN n >= 2 THEN 1.0 WHEN n = 1 THEN 0.5 ELSE 0.0 END AS sp, least(1.0, h * CASE WHEN is_soc THEN 0.4 ELSE 0.5 END) AS sk FROM g)"""


@query(f"WITH {_TRACE}, t AS (SELECT doc_id, is_soc, trace, lower(passage) AS low FROM d), {_SCORED} SELECT doc_id, round(CAST(0.4 * g + 0.35 * sp + 0.25 * sk AS DOUBLE), 9) AS score, round(CAST(0.2 * g + 0.1 + 0.2 * CASE WHEN is_soc THEN sp ELSE 0.5 END + 0.2 AS DOUBLE), 9) AS reward FROM v")
def trace_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate scores and rewards of made-up traces, judged values missing."""
    t, none = _traces(spark, sf_dir), F.lit(None).cast("double")
    args = (F.col("trace"), F.col("passage"), F.col("is_soc"))
    return t.select("doc_id", F.round(scoring.candidate_score(*args), 9).alias("score"), F.round(scoring.reward(*args, none, none), 9).alias("reward"))


@query(rf"""WITH t AS (SELECT doc_id, doc_id % 2 = 0 AS is_soc, lower(coalesce(text, '')) AS low, k,
  regexp_replace(CASE k WHEN 0 THEN 'It could appear imagery but falls short: ' || coalesce(text, '') ELSE '"' || coalesce(text, '') || '" would need a soliloquy' END, '^\s+|\s+$', '', 'g') AS trace FROM documents, unnest([0, 1]) AS u(k)),
{_SCORED}, s AS (SELECT doc_id, k, trace, round(CAST(0.4 * g + 0.35 * sp + 0.25 * sk AS DOUBLE), 9) AS score FROM v)
SELECT doc_id, arg_min(trace, (-score, k)) AS think_content, max(score) AS trace_score FROM s GROUP BY doc_id""")
def best_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three candidates for each document, the last one blank, and the best by score."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("passage"), (F.col("doc_id") % 2 == 0).alias("is_soc"), F.lit("old").alias("think_content"), traces.passage_id("test", F.col("source"), F.col("text")).alias("passage_id"))

    def model() -> traces.Model:
        return lambda prompt, n: [f"It could appear imagery but falls short: {prompt}", f'"{prompt}" would need a soliloquy', " "][:n]

    found = traces.candidates(d, model, F.col("passage"), 3)
    return traces.with_best(d, found).select("doc_id", "think_content", F.round("trace_score", 9).alias("trace_score"))


@query(f"""WITH c AS (SELECT doc_id, doc_id % 2 = 0 AS is_soc, k, CASE k WHEN 0 THEN 'could appear' WHEN 1 THEN CASE WHEN doc_id % 3 = 1 THEN ' ' ELSE {_TYPES}[doc_id % 12 + 1] END ELSE CASE WHEN doc_id % 7 = 0 THEN 'not soc, falls short' ELSE '' END END AS trace
  FROM documents, unnest([0, 1, 2]) AS u(k) WHERE doc_id % 5 <> 0),
s AS (SELECT *, {_HITS(scoring.SPECIFIC_WORDS)} AS n, {_HITS(scoring.SCEPTICAL_PHRASES)} AS h FROM c WHERE trim(trace) <> ''),
v AS (SELECT doc_id, k, trace, 0.35 * CASE WHEN n >= 2 THEN 1.0 WHEN n = 1 THEN 0.5 ELSE 0.0 END + 0.25 * least(1.0, h * CASE WHEN is_soc THEN 0.4 ELSE 0.5 END) AS score FROM s),
b AS (SELECT doc_id, arg_min(trace, (-score, k)) AS trace, max(score) AS score FROM v GROUP BY doc_id)
SELECT doc_id, coalesce(trace, 'old') AS think_content, round(CAST(score AS DOUBLE), 6) AS trace_score FROM documents LEFT JOIN b USING (doc_id)""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three candidates for each document, some blank, and the best one by its score; a fifth have none and keep what they had."""
    i, kind = F.col("doc_id"), F.element_at(F.array(*map(F.lit, SOC_TYPES)), (F.col("doc_id") % 12 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("passage_id"), F.coalesce("text", F.lit("")).alias("passage"), (i % 2 == 0).alias("is_soc"), F.lit("old").alias("think_content"))
    told = F.array(F.lit("could appear"), F.when(i % 3 == 1, " ").otherwise(kind), F.when(i % 7 == 0, "not soc, falls short").otherwise(""))
    found = d.where(i % 5 != 0).select("passage_id", F.posexplode(told).alias("idx", "trace"))
    return traces.with_best(d, found).select("doc_id", "think_content", F.round("trace_score", 6).alias("trace_score"))


@query(rf"""WITH i AS (SELECT doc_id, k AS pos, array_to_string({_WORDS}, ' ') AS passage FROM documents, unnest(range(0, CASE WHEN doc_id % 11 = 10 THEN 0 WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END)) AS u(k))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, passage, CASE WHEN doc_id % 2 = 0 THEN {_TYPES}[doc_id % 12 + 1] ELSE 'other_soc' END AS soc_type, NOT (doc_id % 3 = 0 AND pos = 0) AS is_soc,
       CASE WHEN doc_id % 5 = 0 THEN 'a, b' WHEN doc_id % 5 = 1 THEN 'c' ELSE '' END AS secondary_devices, CASE WHEN doc_id % 4 = 0 THEN 'low' ELSE 'medium' END AS confidence FROM i""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a think block and text after the JSON, parsed leniently: no, one or two instances under either name, fields missing or in another form, and JSON that is broken."""
    i, told = F.col("doc_id"), F.array_join(text.words(F.col("text")), " ")
    kind = F.when(i % 2 == 0, F.element_at(F.array(*map(F.lit, SOC_TYPES)), (i % 12 + 1).cast("int")))
    one = lambda soc, devices: F.to_json(F.struct(told.alias("passage"), kind.alias("soc_type"), soc.alias("is_soc"), devices.alias("secondary_devices"), F.when(i % 4 == 0, "low").alias("confidence")))
    form = lambda soc: F.when(i % 5 == 0, one(soc, F.lit(" a,, b "))).when(i % 5 == 1, one(soc, F.array(F.lit("c")))).otherwise(one(soc, F.lit(None).cast("string")))
    first, second = form(F.when(i % 3 == 0, False)), form(F.lit(True))
    body = F.when(i % 11 == 10, F.concat(F.lit('{"instances": ['), first)).when(i % 7 == 0, F.concat(F.lit('{"instances": ['), first, F.lit(", "), second, F.lit(', "no object"]}'))).otherwise(F.concat(F.lit('{"soc_instances": ['), first, F.lit("]}")))
    answers = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<think>a {b}</think>\n"), body, F.lit(" tail")).alias("raw"))
    return parsing.parse_answers(answers).select("doc_id", "pos", "passage", "soc_type", "is_soc", F.array_join("secondary_devices", ", ").alias("secondary_devices"), "confidence")
