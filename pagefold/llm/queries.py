"""The queries opN_<name> of the training-data operators, and their DuckDB SQL.

Each query applies its operator with production parameters to the whole table and derives
the digest columns from the operator's real outputs. A query without SQL is tested against
a brute-force version in tests/llm/.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.sources.tables import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return keep


SUBSTRING_SQL = r"""
WITH docs AS (
  SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws
  FROM documents),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM docs),
win AS (
  SELECT doc_id, p, ws[p] AS w,
         CASE WHEN p + 34 <= len(ws) THEN md5(array_to_string(ws[p:p + 34], ' ')) END AS h FROM pos),
rep AS (SELECT h FROM win WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
hit AS (SELECT win.doc_id, win.p, win.w, rep.h IS NOT NULL AS d FROM win LEFT JOIN rep ON win.h = rep.h),
cov AS (
  SELECT doc_id, p, w, bool_or(d) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM hit),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (NOT gone) AS t
  FROM cov GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


@query("op1_substring_dedup", SUBSTRING_SQL)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.substring_dedup import dedup_substrings
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed",
                                         F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


#: Reachability over the links of all pairs that share a shingle.
JACCARD_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, [x FOR x IN string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')
         IF x <> ''] AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + 4], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS p FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT docs.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
       least(docs.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = docs.doc_id), docs.doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id)
"""


@query("op10_jaccard_join", JACCARD_SQL)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.jaccard_join import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


DECONTAMINATE_SQL = r"""
WITH docs AS (
  SELECT doc_id, [x FOR x IN string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws
  FROM documents),
items AS (
  SELECT item_id, [x FOR x IN string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS ws
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, k, md5(array_to_string(ws[p:p + k - 1], ' ')) AS h
  FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS p
        FROM items WHERE len(ws) > 0)),
doc_windows AS (
  SELECT doc_id, k, p, md5(array_to_string(ws[p:p + k - 1], ' ')) AS h
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p
        FROM docs, (SELECT DISTINCT k FROM item_windows) WHERE len(ws) >= k)),
hits AS (SELECT doc_id, item_id, p, k FROM doc_windows JOIN item_windows USING (k, h)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY 1),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT docs.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op2_decontaminate", DECONTAMINATE_SQL)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.decontaminate import contamination
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The public tokenizer file that the token queries use; operators take any path."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.bpe import encode
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, tokenizer_file()).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op4_html_extract")
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.html_extract import extract, fit
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).select("page_id", "url", F.col("main_text").alias("text"),
                                             F.length("main_text").cast("long").alias("n_chars"))


@query("op5_importance")
def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.importance import resample
    learn_from = F.crc32(F.col("doc_id").cast("string")) % 4 != 2  # the rest is for held-out accuracy
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"),
                    learn_from=learn_from, keep=["doc_id"])


@query("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm import quality_rules as Q
    from pagefold.llm.blocks import saved
    counted = saved(Q.with_counts(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"]))
    learn_from = F.crc32(F.col("doc_id").cast("string")) % 4 != 2  # the rest is for held-out risk
    cutoffs = saved(Q.calibrate(counted, table(spark, sf_dir, "labels"), learn_from=learn_from))
    return Q.judge(counted, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                            "base_failed", "kept", "lang")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.token_counts import token_counts
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_file()).select("doc_id", "n_bytes", "n_tokens",
                                                       (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.toxicity import THRESHOLD, fit, score
    docs, fold = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs, table(spark, sf_dir, "labels"), learn_from=fold != 2)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


#: Captures: every page with a fetch time. {h}(x) stands for a number from the md5 of x.
CAPTURES = "SELECT page_id, url, page_id * 86400 % 31536000 + page_id % 86400 AS fetched_at FROM pages"
#: List entries of the pages' own hosts: some hosts, parent domains and words are added, removed and added again.
LIST_ENTRIES = """
SELECT list, verdict, kind, pattern, action, CAST(dated AS BIGINT) AS dated FROM (
  SELECT 'hosts' AS list, 'block' AS verdict, 'host' AS kind, host AS pattern, 'add' AS action, x % 200 * 86400 AS dated
  FROM hosts WHERE x % 3 = 0
  UNION ALL
  SELECT 'hosts', 'block', 'host', host, 'remove', (x % 200 + 60 + x % 90) * 86400 FROM hosts WHERE x % 6 = 0
  UNION ALL
  SELECT 'hosts', 'block', 'host', host, 'add', (x % 200 + 150) * 86400 FROM hosts WHERE x % 12 = 0
  UNION ALL
  SELECT 'sections', 'block', 'path', concat(host, '/fr'), 'add', x % 300 * 86400 FROM hosts WHERE x % 5 = 0
  UNION ALL
  SELECT 'words', 'block', 'word', word, 'add', x % 100 * 86400 FROM words WHERE x % 4 = 0
  UNION ALL
  SELECT 'words', 'block', 'word', word, 'remove', (x % 100 + 180) * 86400 FROM words WHERE x % 8 = 0
  UNION ALL
  SELECT 'trusted', 'allow', 'domain', domain, 'add', x % 250 * 86400 FROM domains WHERE x % 7 = 0) AS e
"""
_HOSTS = """
hosts AS (SELECT host, {number} AS x FROM (
  SELECT DISTINCT lower({host}) AS host FROM pages WHERE url IS NOT NULL) AS h),
words AS (SELECT word, {number_word} AS x FROM (SELECT DISTINCT {word} AS word FROM hosts) AS w),
domains AS (SELECT domain, {number_domain} AS x FROM (SELECT DISTINCT {domain} AS domain FROM hosts) AS d)
"""


def _entries_sql(number: str, extract: str) -> str:
    """The entry tables; ``number`` and ``extract`` are the dialect's text for a number of a string and a group of a pattern."""
    return _HOSTS.format(
        host=extract.format("url", "://([^/?#]*)"), number=number.format("host"), number_word=number.format("word"),
        number_domain=number.format("domain"), word=extract.format("host", "([a-z0-9]+)[.][a-z]+[.][a-z]+$"),
        domain=extract.format("host", "([^.]+[.][^.]+[.][^.]+)$"))


URL_SQL = f"""
WITH {_entries_sql("CAST(concat('0x', substr(md5({0}), 1, 8)) AS BIGINT)", "regexp_extract({0}, '{1}', 1)")},
entries AS ({LIST_ENTRIES}),
log AS (SELECT list, verdict, kind, pattern, dated, bool_or(action = 'remove') AS removed FROM entries GROUP BY ALL),
spans AS (
  SELECT *, lead(dated) OVER (PARTITION BY list, verdict, kind, pattern ORDER BY dated) AS valid_to FROM log),
captures AS ({CAPTURES}),
parts AS (
  SELECT page_id, url, fetched_at, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
         regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM captures),
keys AS (
  SELECT page_id, fetched_at, 'host' AS kind, host AS pattern FROM parts
  UNION SELECT page_id, fetched_at, 'domain', array_to_string(string_split(host, '.')[i:], '.')
        FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM parts)
  UNION SELECT page_id, fetched_at, 'path', host || '/' || array_to_string(steps[1:i], '/')
        FROM (SELECT *, unnest(range(0, len(steps) + 1)) AS i FROM (
              SELECT *, [x FOR x IN string_split(path, '/') IF x <> ''] AS steps FROM parts))
  UNION SELECT page_id, fetched_at, 'word', unnest(regexp_extract_all(lower(host || '/' || path), '[a-z0-9]+')) FROM parts),
met AS (
  SELECT page_id, verdict, list FROM keys JOIN spans USING (kind, pattern)
  WHERE NOT removed AND fetched_at >= dated AND (valid_to IS NULL OR fetched_at < valid_to))
SELECT captures.page_id, url, fetched_at,
       coalesce(bool_or(verdict = 'block'), false) AND NOT coalesce(bool_or(verdict = 'allow'), false) AS blocked,
       count(list) AS n_active, coalesce(string_agg(DISTINCT list, ',' ORDER BY list), '') AS active_lists
FROM captures LEFT JOIN met USING (page_id) GROUP BY 1, 2, 3
"""


@query("op8_url_filters", URL_SQL)
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.url_filters import filter_urls
    tables = _entries_sql("CAST(conv(substr(md5({0}), 1, 8), 16, 10) AS BIGINT)", "regexp_extract({0}, '{1}', 1)")
    pages = {"pages": table(spark, sf_dir, "pages").select("page_id", "url")}
    entries = spark.sql(f"WITH pages AS (SELECT * FROM {{pages}}), {tables} {LIST_ENTRIES}", **pages)
    return filter_urls(spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}"), **pages), entries)


def _crc_table() -> list[int]:
    """The table of the usual crc32, one byte at a time, for SQL without that function."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


SPELLING_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY 1, 2),
bytes AS (SELECT run, k, hex(encode(concat(doc_id, ':', run))) AS x FROM runs),
summed AS (
  SELECT run, k, xor(list_reduce([CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT) FOR i IN range(1, len(x) // 2 + 1)],
    lambda c, b: xor(c >> 8, {_crc_table()}[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h FROM bytes),
varied AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
              ELSE run END AS word, k FROM summed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM varied WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cuts AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
links AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, w.word, w.n FROM cuts a JOIN words w ON a.d = w.word
  UNION SELECT w.word, w.n, a.word, a.n FROM cuts a JOIN words w ON a.d = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top, min(n) AS n, arg_min(other, (-other_n, other)) AS other
  FROM links GROUP BY word),
forms AS MATERIALIZED (
  SELECT word, n_near, CASE WHEN top >= 10 * n THEN other END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n FROM best),
ways AS (
  SELECT word, form AS last, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT ways.word, forms.form, step + 1 FROM ways JOIN forms ON ways.last = forms.word WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, step) AS root FROM ways GROUP BY word)
SELECT words.word, form, coalesce(root, words.word) AS root, words.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n
FROM words LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""


@query("op11_spelling_variants", SPELLING_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.spelling import variants
    return variants(table(spark, sf_dir, "documents"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.token_alignment import COLUMNS, Alignment
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Alignment(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).documents().select("doc_id", *COLUMNS)


@query("op13_pii")
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagefold.llm.sanitise import sanitise
    return sanitise(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans")
